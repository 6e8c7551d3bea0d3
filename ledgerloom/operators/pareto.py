"""Pareto front over candidate allocations, all three objectives minimised."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lineage_cut
from .sizes import broadcast_if_small

OBJECTIVES = ["f1", "f2", "f3"]
# Points of a slice, and most points a partition holds before it hands them on.
SLICE = 100_000
HELD = 500_000


def _undominated(points: np.ndarray) -> np.ndarray:
    """Mask of the distinct points that no other dominates.

    Whatever dominates a point comes before it in order of the objectives, so it
    is enough to keep the staircase of second and third objective of what has
    gone before, and to look one step up.
    """
    keep = np.zeros(len(points), dtype=bool)
    f2: list[float] = []
    f3: list[float] = []
    for i in np.lexsort(points.T[::-1]).tolist():
        _, second, third = points[i].tolist()
        at = bisect_right(f2, second)
        if at and f3[at - 1] <= third:
            continue
        keep[i] = True
        # Steps that the new one makes needless: no lower second, no lower third.
        if at and f2[at - 1] == second:
            at -= 1
        stop = at
        while stop < len(f3) and f3[stop] >= third:
            stop += 1
        f2[at:stop], f3[at:stop] = [second], [third]
    return keep


def _local_front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fewer points with the same front: what is held is reduced whenever it has doubled."""
    held, size, reduced = [], 0, 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size >= 2 * reduced:
            front = pd.concat(held).drop_duplicates(ignore_index=True)
            front = front[_undominated(front[OBJECTIVES].to_numpy(dtype=float))]
            held, size = [front], len(front)
            reduced = size
            if size > HELD:  # handed on as it is; the slices do the rest
                yield front
                held, size, reduced = [], 0, 0
    if held:
        front = pd.concat(held).drop_duplicates(ignore_index=True)
        yield front[_undominated(front[OBJECTIVES].to_numpy(dtype=float))]


def _staircase(pdf: pd.DataFrame) -> pd.DataFrame:
    """Points of a slice that are minimal in the second and third objective."""
    pts = pdf[["f2", "f3"]].drop_duplicates().sort_values(["f2", "f3"])
    best = pts["f3"].cummin().shift(1, fill_value=np.inf)
    return pd.DataFrame({"slice": pdf["slice"].iloc[0], **pts[pts["f3"] < best]})


def _slice_front(own: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
    if len(own) == 0:
        return own
    pts = own[OBJECTIVES].to_numpy(dtype=float)
    keep = _undominated(pts)
    if len(earlier):
        stairs = earlier[["f2", "f3"]].sort_values(["f2", "f3"])
        f2, f3 = stairs["f2"].to_numpy(), np.minimum.accumulate(stairs["f3"].to_numpy())
        at = np.searchsorted(f2, pts[:, 1], side="right") - 1
        # Points of an earlier slice differ and are no worse in the first objective.
        keep &= ~((at >= 0) & (f3[np.maximum(at, 0)] <= pts[:, 2]))
    return own[keep]


def pareto_front(candidates: DataFrame, slices: int | None = None) -> DataFrame:
    """Candidates (id, f1, f2, f3) that no other candidate dominates.

    Each partition reduces its distinct points to their own front. What survives
    is dealt by ranges of all three objectives, of about ``SLICE`` points unless
    ``slices`` says otherwise; a slice needs its own points and only the staircase
    of second and third objectives of the slices before it. Candidates rejoin at
    the end, so many candidates at one point cost one.
    """
    points = "f1 double, f2 double, f3 double"
    local = lineage_cut(candidates.select(*OBJECTIVES).mapInPandas(_local_front, points).distinct(), "local-fronts")
    slices = slices or max(1, -(-local.count() // SLICE))
    # Range bounds are sampled, so the deal is written rather than done again.
    ranged = local.repartitionByRange(slices, *OBJECTIVES)
    sliced = lineage_cut(ranged.select(*OBJECTIVES, F.spark_partition_id().alias("slice")), "slices")
    stairs = sliced.groupBy("slice").applyInPandas(_staircase, "slice int, f2 double, f3 double")
    later = stairs.where(F.col("slice") < slices - 1).select(
        F.explode(F.sequence(F.col("slice") + 1, F.lit(slices - 1))).alias("slice"), "f2", "f3"
    )
    fronts = sliced.groupBy("slice").cogroup(later.groupBy("slice")).applyInPandas(
        lambda own, earlier: _slice_front(own, earlier)[OBJECTIVES], points
    )
    # Written once: its size is then known before the join.
    found = lineage_cut(fronts, "front")
    return candidates.join(broadcast_if_small(found), OBJECTIVES).select("id", *OBJECTIVES)


def choose(front: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """The front's candidate with the least weighted score."""
    score = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, OBJECTIVES)), F.lit(0.0))
    return front.withColumn("score", score).orderBy("score", "id").limit(1)
