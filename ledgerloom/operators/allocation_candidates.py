"""Candidate allocations of a pool, their objectives, and the choice among those that none dominates.

A candidate is a weight for every item of the pool: a random number from a hash of
candidate and item, times a tilt towards items that are good in the objectives. Each
candidate has tilts of its own, so that the candidates cover the whole front and not
only the mean of a large pool. The weights are never kept: a task multiplies blocks
of them with its items' columns and holds one row of sums for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pareto import OBJECTIVES, choose, pareto_front
from .sizes import attach_one_row

# Arithmetic modulo this prime fits 64 bits, so that any engine can repeat the draws.
PRIME = 2**31 - 1
TILT = 4.0
# A standardised column counts for no more than this.
FAR = 8.0
# Weights of a block: candidates times items.
CANDIDATES, ITEMS = 256, 4096
COLUMNS = [*OBJECTIVES, "risk"]


def _fifth(x: np.ndarray) -> np.ndarray:
    """The fifth power modulo the prime, which maps its remainders one to one."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draws(candidate: np.ndarray, item: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in (0, 1], one for each candidate (rows) and item key (columns)."""
    candidate, item = np.asarray(candidate, np.int64)[:, None], np.asarray(item, np.int64)[None, :]
    mixed = _fifth((candidate * 48271 % PRIME + item * 69621 % PRIME + seed) % PRIME)
    return (_fifth((mixed + candidate) % PRIME) + 1) / float(PRIME + 1)


def tilts(candidate: np.ndarray, seed: int, most: float = TILT) -> np.ndarray:
    """How much each candidate shuns items that are high in each column; keys above all remainders are theirs."""
    return most * draws(candidate, PRIME + 1 + np.arange(len(COLUMNS)), seed)


def objectives_of(pool: DataFrame, columns: dict[str, Column], n: int, key: Column | None = None, seed: int = 42, tilt: float = TILT) -> DataFrame:
    """The weighted means (id, f1, f2, f3, risk) of ``n`` candidates over the pool.

    ``columns`` names f1, f2, f3 (all minimised) and risk. Items that lack one of
    them, or their key, take no part. ``key`` is a whole number that tells items
    apart; without it the whole row is hashed, and equal rows share a draw. An
    empty pool has no candidates. Means are rounded to twelve places, so that they
    do not depend on the order in which tasks add up.
    """
    key = F.xxhash64(*pool.columns) if key is None else key.cast("long")
    items = pool.select(F.pmod(key, F.lit(PRIME)).alias("key"), *(columns[c].cast("double").alias(c) for c in COLUMNS))
    present = reduce(lambda a, b: a & b, [F.col("key").isNotNull(), *(F.col(c).isNotNull() & ~F.isnan(c) for c in COLUMNS)])
    items = items.where(present)
    spread = items.agg(*(F.avg(c).alias(f"{c}_mean") for c in COLUMNS), *(F.stddev_pop(c).alias(f"{c}_dev") for c in COLUMNS))
    scaled = attach_one_row(items, spread).select(
        "key", *COLUMNS,
        *(
            F.when(F.col(f"{c}_dev") > 1e-12, F.greatest(F.lit(-FAR), F.least(F.lit(FAR), (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_dev"))))
            .otherwise(0.0).alias(f"{c}_z")
            for c in COLUMNS
        ),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lean, seen = np.zeros((n, len(COLUMNS) + 1)), tilts(np.arange(n), seed, tilt), False
        for batch in batches:
            for start in range(0, batch.num_rows, ITEMS):
                part = batch.slice(start, ITEMS)
                seen = True
                keys, *rest = (np.asarray(c) for c in part.columns)
                values = np.column_stack([*rest[: len(COLUMNS)], np.ones(part.num_rows)])
                z = np.column_stack(rest[len(COLUMNS) :])
                for first in range(0, n, CANDIDATES):
                    some = np.arange(first, min(first + CANDIDATES, n))
                    sums[some] += (draws(some, keys, seed) * np.exp(-lean[some] @ z.T)) @ values
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(s) for s in sums.T)], ["id", *COLUMNS, "total"])

    summed = scaled.mapInArrow(run, "id long, " + ", ".join(f"{c} double" for c in [*COLUMNS, "total"]))
    total = summed.groupBy("id").agg(*(F.sum(c).alias(c) for c in [*COLUMNS, "total"]))
    return total.select("id", *(F.round(F.col(c) / F.col("total"), 12).alias(c) for c in COLUMNS))


def front_within(candidates: DataFrame, most_risk: float) -> DataFrame:
    """Candidates within the limit of risk that no other of these dominates."""
    inside = candidates.where(F.col("risk") <= most_risk)
    return pareto_front(inside.select("id", *OBJECTIVES))


def chosen(front: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """The front with each candidate's weighted score and whether it is the one to take: at most one."""
    best = choose(front, weights).agg(F.first("id").alias("__best"), F.first("score").alias("__score"))
    score = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, OBJECTIVES)), F.lit(0.0))
    shown = attach_one_row(front.withColumn("score", score), best)
    return shown.withColumn("chosen", F.coalesce(F.col("id") == F.col("__best"), F.lit(False))).drop("__best", "__score")


def weights_of(pool: DataFrame, columns: dict[str, Column], candidate: int, key: Column, seed: int = 42, tilt: float = TILT) -> DataFrame:
    """The pool with the weight of every item in one candidate; items that take no part have none, the others add up to one."""
    shape = {c: columns[c].cast("double") for c in COLUMNS}
    reduced = F.pmod(key.cast("long"), F.lit(PRIME))
    present = reduce(lambda a, b: a & b, [reduced.isNotNull(), *(v.isNotNull() & ~F.isnan(v) for v in shape.values())])
    seen = {c: F.when(present, v) for c, v in shape.items()}
    spread = pool.agg(*(F.avg(v).alias(f"__{c}_mean") for c, v in seen.items()), *(F.stddev_pop(v).alias(f"__{c}_dev") for c, v in seen.items()))

    def fifth(x: Column) -> Column:
        square = x * x % PRIME
        return square * square % PRIME * x % PRIME

    mixed = fifth((F.lit(candidate * 48271 % PRIME + seed) + reduced * 69621 % PRIME) % PRIME)
    drawn = (fifth((mixed + F.lit(candidate)) % PRIME) + 1) / F.lit(float(PRIME + 1))
    lean = tilts(np.array([candidate]), seed, tilt)[0].tolist()
    pull = F.lit(0.0)
    for c, t in zip(COLUMNS, lean):
        z = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), (shape[c] - F.col(f"__{c}_mean")) / F.col(f"__{c}_dev")))
        pull += F.lit(t) * F.when(F.col(f"__{c}_dev") > 1e-12, z).otherwise(0.0)
    raw = F.when(present, drawn * F.exp(-pull)).otherwise(0.0)
    weighed = attach_one_row(pool, spread).withColumn("allocation_weight", raw)
    total = weighed.agg(F.sum("allocation_weight").alias("__total"))
    extra = [f"__{c}_{kind}" for c in COLUMNS for kind in ("mean", "dev")]
    return attach_one_row(weighed, total).withColumn("allocation_weight", F.col("allocation_weight") / F.col("__total")).drop(*extra, "__total")
