"""Isotonic regression over ranges: pooled where values fall, merged where ranges meet.

Pooling adjacent violators gives the same blocks in whatever order neighbours are
pooled. So every range of scores pools its own, and then only what meets at a
border can still violate: such ranges merge in pairs and pool again, until no
border is left where values fall. A task holds the points of one range, later the
blocks of two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lineage_cut

BLOCK_SCHEMA = "part long, low double, high double, total double, weight double"
# Up to this many blocks travel to the tasks that score rows; more meet the rows by range.
TRAVEL = 100_000


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray):
    """Blocks in order of their scores, pooled until their means rise."""
    stack: list[list[float]] = []
    for block in zip(low, high, total, weight):
        a, b, t, w = block
        while stack and stack[-1][2] * w >= t * stack[-1][3]:
            p = stack.pop()
            a, t, w = p[0], p[2] + t, p[3] + w
        stack.append([a, b, t, w])
    return np.array(stack, float).reshape(-1, 4).T


def _pool(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("low")
    low, high, total, weight = pooled(*(group[c].to_numpy(float) for c in ("low", "high", "total", "weight")))
    return pd.DataFrame({"part": group["part"].iloc[0], "low": low, "high": high, "total": total, "weight": weight})


def fit(points: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Blocks of equal value: part, low, high, total and weight; the value is total / weight.

    Rows without a score or a label do not count. Every distinct score is a point of
    its own.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = points.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y"), w.alias("w")).dropna()
    known = known.where(~F.isnan("low")).groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    # Bounds of ranges are sampled, so the deal is written.
    dealt = lineage_cut(known.where("weight > 0").repartitionByRange("low").withColumn("part", F.spark_partition_id().cast("long")), "scores")
    blocks = dealt.select("part", "low", F.col("low").alias("high"), "total", "weight")
    while True:
        blocks = lineage_cut(blocks.groupBy("part").applyInPandas(_pool, BLOCK_SCHEMA), "pooled")
        mean = F.col("total") / F.col("weight")
        ends = blocks.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        # A row for each range.
        over = Window.orderBy("part")
        falls = F.coalesce(F.lag("last").over(over) >= F.col("first"), F.lit(False))
        ends = ends.select("part", falls.alias("falls"), F.lag("part").over(over).alias("before"))
        chain = F.sum(F.when(F.col("falls"), 0).otherwise(1)).over(over)
        place = F.row_number().over(Window.partitionBy("chain").orderBy("part"))
        ends = lineage_cut(ends.withColumn("chain", chain).withColumn("merges", place % 2 == 0), "borders")
        if ends.where("merges").isEmpty():
            return blocks
        # Of a chain of falling borders every other one goes first.
        into = ends.select("part", F.when(F.col("merges"), F.col("before")).otherwise(F.col("part")).alias("into"))
        blocks = blocks.join(into, "part").select(F.col("into").alias("part"), "low", "high", "total", "weight")


def _knots(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Scores where the value is known, in order, and the values: both ends of each block."""
    blocks = blocks.sort_values("low")
    low, high = blocks["low"].to_numpy(float), blocks["high"].to_numpy(float)
    value = (blocks["total"] / blocks["weight"]).to_numpy(float)
    x, y = np.column_stack([low, high]).ravel(), np.repeat(value, 2)
    kept = np.concatenate([[True], x[1:] > x[:-1]]) if len(x) else np.zeros(0, bool)
    return x[kept], y[kept]


def apply(df: DataFrame, score: str, blocks: DataFrame, name: str, travel: int = TRAVEL) -> DataFrame:
    """Add ``name``: the block's value, a straight line between blocks, the outermost values beyond; null without a score or without blocks."""
    size = blocks.count()
    if size <= travel:
        x, y = _knots(blocks.toPandas())

        # Only the scores travel to Python, those of several calls together.
        @F.arrow_udf("double")
        def valued(score: pa.Array) -> pa.Array:
            at = score.to_numpy(zero_copy_only=False)
            return pa.array(np.interp(at, x, y) if len(x) else np.full(len(at), np.nan), mask=np.isnan(at) | (len(x) == 0))

        out = df.withColumn(name, valued(F.col(score).cast("double")))
    else:
        columns = df.columns
        rows = df.withColumn("__x", F.col(score).cast("double"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{name}` double"

        def valued(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
            at = pdf["__x"].to_numpy(float)
            found = np.interp(at, x, y) if len(x) else np.full(len(at), np.nan)
            return pdf[columns].assign(**{name: np.where(np.isnan(at), np.nan, found)})

        # Each range also needs the last block before it and the first one after it.
        over = Window.orderBy("part")
        first, last = F.min_by(F.struct("low", "high", "total", "weight"), "low"), F.max_by(F.struct("low", "high", "total", "weight"), "low")
        ends = lineage_cut(blocks.groupBy("part").agg(first.alias("first"), last.alias("last")), "ends")
        around = ends.select("part", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
        extra = around.select("part", F.explode(F.array("before", "after")).alias("b")).where("b IS NOT NULL").select("part", "b.*")
        # One start for each range; a score belongs to the last range that starts at or before it.
        starts = sorted((r["first"]["low"], r["part"]) for r in ends.select("part", "first").collect())
        edges, parts = np.array([s for s, _ in starts]), np.array([p for _, p in starts])

        def placed(batches):
            for pdf in batches:
                at = np.maximum(np.searchsorted(edges, pdf["__x"].to_numpy(float), side="right") - 1, 0)
                yield pdf.assign(__part=parts[at])

        dealt = rows.mapInPandas(placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __part long")
        near = blocks.unionByName(extra).groupBy("part")
        out = dealt.groupBy("__part").cogroup(near).applyInPandas(lambda pdf, own: valued(pdf, *_knots(own)), schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
