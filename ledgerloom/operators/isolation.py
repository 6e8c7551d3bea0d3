"""Isolation-forest anomaly scores.

Trees are grown in parallel, one small group of sampled rows per tree, and then
shared with the tasks that score the rows. A forest's size depends only on its
parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.random import uniform

EULER = 0.5772156649
# Rows that walk the trees together.
WALKED = 4096
NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def path_correction(n):
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    full = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes, pending = [], [(np.arange(len(x)), 0, None)]
    while pending:
        rows, depth, parent = pending.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = at
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            nodes.append([-1, 0.0, -1, -1, len(rows)])
            continue
        f = int(rng.choice(splittable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, len(rows)])
        below = x[rows, f] < cut
        pending.append((rows[below], depth + 1, (at, 2)))
        pending.append((rows[~below], depth + 1, (at, 3)))
    return nodes


def _drawn(data: DataFrame, key: str, trees: int, rate: float, seed: int) -> DataFrame:
    """Rows with the trees they are drawn for, each tree independently with chance ``rate``.

    The trees between two draws of a row follow a geometric distribution, so a
    row that is never drawn, as most of a large table, costs one hash.
    """

    def passed_over(step):
        return F.floor(F.log(uniform(seed, F.col(key), step)) / F.lit(math.log1p(-rate))) if rate < 1 else F.lit(0).cast("bigint")

    first = data.withColumn("__first", passed_over(F.lit(0).cast("bigint"))).where(F.col("__first") < trees)
    start = F.struct(F.array("__first").alias("drawn"), F.col("__first").alias("last"))

    def draw(state, step):
        after = state["last"] + 1 + passed_over(step)
        more = F.struct(F.array_append(state["drawn"], after).alias("drawn"), after.alias("last"))
        return F.when(state["last"] < trees, F.when(after < trees, more).otherwise(F.struct(state["drawn"].alias("drawn"), after.alias("last")))).otherwise(state)

    picks = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(trees).cast("bigint")), start, draw)["drawn"]
    return first.select(*data.columns, F.explode(picks).alias("tree"))


def fit(df: DataFrame, key: str, features: list[str], trees: int = 200, sample: int = 256, seed: int = 42) -> pd.DataFrame:
    """Grow the forest; returns its nodes, at most trees * 2 * sample rows."""
    data = df.select(key, *features).dropna(subset=features)
    drawn = _drawn(data, key, trees, min(1.0, sample / max(data.count(), 1)), seed)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[features].to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "size"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    return drawn.groupBy("tree").applyInPandas(grow, NODES).toPandas()


def _flat(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree for walking: feature, cut, the nodes to the right and left of each, path length of each, and its depth.

    A leaf leads to itself, so all rows take as many steps as the tree is deep.
    """
    feature, cut = nodes[:, 0].astype(np.intp), nodes[:, 1].copy()
    inner, own, depth = feature >= 0, np.arange(len(nodes), dtype=np.intp), np.zeros(len(nodes))
    left, right = (np.where(inner, nodes[:, c].astype(np.intp), own) for c in (2, 3))
    # A parent stands before its children.
    for at in np.flatnonzero(inner):
        depth[left[at]] = depth[right[at]] = depth[at] + 1
    return np.maximum(feature, 0), cut, np.column_stack([right, left]).ravel(), depth + path_correction(nodes[:, 4]), int(depth.max())


def path_lengths(x: np.ndarray, trees: list) -> np.ndarray:
    """The sum over all trees of each row's path, some rows at a time so that they stay in the processor's cache."""
    total = np.zeros(len(x))
    for start in range(0, len(x), WALKED):
        part = x[start : start + WALKED]
        n, columns, own = len(part), np.ascontiguousarray(part.T).ravel(), np.arange(len(part))
        for feature, cut, child, path, depth in trees:
            at = np.zeros(n, dtype=np.intp)
            place = feature * n
            for _ in range(depth):
                below = columns.take(place.take(at) + own) < cut.take(at)
                at = child.take(2 * at + below)
            total[start : start + n] += path.take(at)
    return total


def score(df: DataFrame, forest: pd.DataFrame, features: list[str], sample: int = 256, name: str = "anomaly_raw") -> DataFrame:
    """Isolation score 2^(-mean path / expected path); higher is more anomalous.

    The expected path is that of a tree's own rows where the table has fewer than ``sample``.
    """
    shared = df.sparkSession.sparkContext.broadcast(
        [_flat(t.sort_values("node")[["feature", "cut", "left", "right", "size"]].to_numpy()) for _, t in forest.groupby("tree")]
    )
    grown = int(forest.loc[forest["node"] == 0, "size"].max()) if len(forest) else sample
    expected = float(path_correction(max(2, min(sample, grown))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = path_lengths(pdf[features].to_numpy(dtype=float), shared.value)
            yield pdf.assign(**{name: 2.0 ** (-total / len(shared.value) / expected)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"
    return df.dropna(subset=features).mapInPandas(walk, schema)
