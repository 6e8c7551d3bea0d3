"""Quantile forecasts by trees whose leaves hold quantiles, for several targets and horizons at once.

One forest is grown for all outputs, on the mean of the scaled targets. Every leaf
then gets, for each output, the quantile of the rows it holds: tasks count the
values of their rows leaf by leaf, and the counts of a leaf meet by tree and leaf.
A forecast is the mean of the leaves a row falls in, so the quantile moves with the
features, its spread included.
Rows left out of the forest show by how much forecasts are off within each group
of rows, and are moved by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..session import lineage_cut
from .models import SEED, assembler
from .sizes import attach_one_row, broadcast_if_small

# Quantiles lie within 1/ACCURACY of a leaf's rows.
ACCURACY = 10_000
# Rows whose values a task counts at a time.
COUNTED = 1 << 18


@dataclass(frozen=True)
class QuantileForest:
    """A forest, its leaves' quantiles (one row, an array by tree of arrays by leaf) and the shifts of the groups."""

    forest: object
    leaves: DataFrame
    outputs: tuple[str, ...]
    features: tuple[str, ...]
    group: str | None
    shifts: DataFrame | None
    floor: float | None

    def raw(self, df: DataFrame) -> DataFrame:
        """Add ``<output>_q`` from the leaves alone; rows with a missing feature are left out."""
        if self.forest is None:
            return df.dropna(subset=list(self.features)).withColumns({f"{c}_q": F.lit(None).cast("double") for c in self.outputs})
        # Bounded by trees and leaves.
        kept = self.leaves.first()
        tables = [[np.array(of_tree, float) for of_tree in kept[f"__{c}"]] for c in self.outputs]
        names = [f"q{i}" for i in range(len(tables))]

        @F.arrow_udf(", ".join(f"{n} double" for n in names))
        def mean(leaf: pa.Array) -> pa.Array:
            at = _by_tree(leaf)
            found = []
            for trees in tables:
                total, known = np.zeros(at.shape[1]), np.zeros(at.shape[1])
                for of_tree, own in zip(trees, at):
                    q = of_tree.take(own)
                    total += np.where(np.isnan(q), 0.0, q)
                    known += ~np.isnan(q)
                found.append(pa.array(total / np.maximum(known, 1), mask=known == 0))
            return pa.StructArray.from_arrays(found, names=names)

        rows = _fallen(self.forest, df).withColumn("__q", mean("__leaf"))
        return rows.select(*df.columns, *(F.col(f"__q.{n}").alias(f"{c}_q") for n, c in zip(names, self.outputs)))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``<output>_q`` to the rows that have all features."""
        rows = self.raw(df)
        if self.shifts is not None:
            shifts = self.shifts.withColumnRenamed(self.group, "__group") if self.group else self.shifts
            if self.group:
                rows = rows.join(broadcast_if_small(shifts), F.col(self.group).eqNullSafe(F.col("__group")), "left").drop("__group")
            else:
                rows = attach_one_row(rows, shifts)
            rows = rows.withColumns({f"{c}_q": F.col(f"{c}_q") + F.coalesce(f"__shift_{c}", F.lit(0.0)) for c in self.outputs})
            rows = rows.drop(*(f"__shift_{c}" for c in self.outputs))
        return rows.withColumns({f"{c}_q": clip(F.col(f"{c}_q"), low=self.floor) for c in self.outputs})


def _fallen(forest, df: DataFrame) -> DataFrame:
    """Rows with ``__leaf``, the leaf of each tree they fall in."""
    return forest.transform(df).withColumn("__leaf", vector_to_array("__leaves")).select(*df.columns, "__leaf")


def _by_tree(leaf: pa.Array) -> np.ndarray:
    """Leaves (trees x rows) of arrays of one length."""
    found = leaf.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return np.ascontiguousarray(found.reshape(len(leaf), -1).T) if len(leaf) else np.zeros((0, 0), np.int32)


def _thinned(value: np.ndarray, weight: np.ndarray, accuracy: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``accuracy`` of the ascending values: each stands for as many rows, and no rank moves by more than half of them."""
    ends = np.cumsum(weight)
    edges = np.linspace(0, ends[-1], accuracy + 1).round().astype(np.int64)
    return value[np.searchsorted(ends, (edges[:-1] + edges[1:]) // 2, side="right")], np.diff(edges)


def _counted(leaf: np.ndarray, values: list[np.ndarray], accuracy: int) -> Iterator[tuple]:
    """(tree, leaf, output, values ascending, rows of each) of the known values in each leaf."""
    leaf = leaf.astype(np.int16) if leaf.size and leaf.max() < 1 << 15 else leaf
    for output, y in enumerate(values):
        known = np.flatnonzero(~np.isnan(y))
        order = known[np.argsort(y[known], kind="stable")]
        if not len(order):
            continue
        y = y[order]
        for tree, own in enumerate(leaf):
            own = own.take(order)
            place = np.argsort(own, kind="stable")
            own, value = own.take(place), y.take(place)
            new = own[1:] != own[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new | (value[1:] != value[:-1])) + 1])
            weight, own, value = np.diff(np.append(starts, len(value))), own[starts], value[starts]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(own)]):
                few = value[a:b], weight[a:b]
                yield (tree, int(own[a]), output, *(few if b - a <= accuracy else _thinned(*few, accuracy)))


def leaf_quantiles(fallen: DataFrame, outputs: list[str], alpha: float, accuracy: int = ACCURACY, counted: int = COUNTED) -> DataFrame:
    """tree, leaf and, for each output, the quantile of the rows of ``fallen`` (outputs, ``__leaf``) in each leaf.

    The value at rank ceil(alpha * n), as exact as ``percentile_approx``: a task keeps
    ``accuracy`` values of a leaf, or all if fewer.
    """
    data = fallen.select("__leaf", *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(outputs)))
    schema = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("output", pa.int32()), ("value", pa.list_(pa.float64())), ("weight", pa.list_(pa.int64()))])

    def count(batches):
        waiting, size = [], 0

        def found():
            rows = pa.Table.from_batches(waiting).combine_chunks()
            values = [rows.column(f"v{i}").to_numpy() for i in range(len(outputs))]
            found = list(_counted(_by_tree(rows.column("__leaf").chunk(0)), values, accuracy))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [[]] * len(schema), schema)], schema=schema)

        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= counted:
                yield found()
                waiting, size = [], 0
        if size:
            yield found()

    def quantile(rows: pa.Table) -> pa.Table:
        own = np.asarray(rows.column("output"))
        out = [rows.column(c).combine_chunks()[:1] for c in ("tree", "leaf")]
        for i in range(len(outputs)):
            part = rows.filter(pa.array(own == i))
            if not part.num_rows:
                out.append(pa.nulls(1, pa.float64()))
                continue
            value, weight = (np.concatenate([np.asarray(x.values) for x in part.column(c)]) for c in ("value", "weight"))
            order = np.argsort(value, kind="stable")
            ends = np.cumsum(weight[order])
            out.append(pa.array([value[order[np.searchsorted(ends, max(1, np.ceil(alpha * ends[-1])))]]], pa.float64()))
        return pa.Table.from_arrays(out, names=["tree", "leaf", *outputs])

    counts = data.mapInArrow(count, "tree int, leaf int, output int, value array<double>, weight array<long>")
    return counts.groupBy("tree", "leaf").applyInArrow(quantile, "tree int, leaf int, " + ", ".join(f"`{c}` double" for c in outputs))


def fit(
    train: DataFrame, features: list[str], outputs: list[str], alpha: float, calibrate: DataFrame | None = None, group: str | None = None,
    trees: int = 20, depth: int = 7, least: int = 20, seed: int = SEED, floor: float | None = None,
) -> QuantileForest:
    """Fit on ``train``; ``calibrate`` (other rows) gives the shift of each ``group``, a column of few values.

    ``train`` is read some five times and not kept in memory: give a written table.
    Rows with a missing feature take no part; of the others each output uses those
    where it is known. ``least`` is the fewest rows of a leaf. Without any row to
    learn from, forecasts are null.
    """
    clean = train.dropna(subset=features).dropna(subset=outputs, how="all")
    if clean.isEmpty():
        return QuantileForest(None, clean, tuple(outputs), tuple(features), group, None, floor)
    scale = lineage_cut(clean.agg(*(F.avg(c).alias(f"__m_{c}") for c in outputs), *(F.stddev_samp(c).alias(f"__s_{c}") for c in outputs)), "scale")
    parts = [(F.col(c) - F.col(f"__m_{c}")) / F.greatest(F.col(f"__s_{c}"), F.lit(1e-12)) for c in outputs]
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in outputs), F.lit(0))
    label = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / known
    rows = attach_one_row(clean, scale).select(*features, *outputs, label.alias("__label"))
    grow = RandomForestRegressor(
        featuresCol="features", labelCol="__label", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, leafCol="__leaves",
        featureSubsetStrategy="onethird",
    )
    forest = Pipeline(stages=[assembler(features), grow]).fit(rows)
    # Leaves are all that is asked of the forest.
    forest.stages[-1].setPredictionCol("")
    quantiles = lineage_cut(leaf_quantiles(_fallen(forest, clean), outputs, alpha), "leaf-quantiles")
    # Bounded by trees and leaves. A leaf no row fell in keeps its place, empty.
    each = quantiles.groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("leaf", F.struct(*outputs)))).alias("by"), F.max("leaf").alias("most"))

    def by_leaf(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.element_at("by", i)[c].cast("double")).alias(c)

    laid = F.array_sort(F.collect_list(F.struct("tree", *outputs)))
    leaves = lineage_cut(each.select("tree", *map(by_leaf, outputs)).agg(laid.alias("all")).select(*(F.col(f"all.{c}").alias(f"__{c}") for c in outputs)), "leaves")
    out = QuantileForest(forest, leaves, tuple(outputs), tuple(features), group, None, floor)
    if calibrate is None:
        return out
    off = out.raw(calibrate.dropna(subset=features))
    shift = [F.percentile_approx(F.col(c) - F.col(f"{c}_q"), F.lit(float(alpha)), F.lit(ACCURACY)).cast("double").alias(f"__shift_{c}") for c in outputs]
    shifts = lineage_cut((off.groupBy(group) if group else off).agg(*shift), "shifts")
    return QuantileForest(forest, leaves, tuple(outputs), tuple(features), group, shifts, floor)


def coverage(df: DataFrame, outputs: list[str], alpha: float, group: Column, name: str, within: float = 0.02) -> DataFrame:
    """How many known values lie at or below their forecast, by output and group.

    ``n``, ``coverage`` and ``covered``: whether that is within ``within`` of alpha,
    or within four standard deviations of a share of so many rows.
    """
    cells = [F.struct(F.lit(c).alias("output"), F.col(c).alias("y"), F.col(f"{c}_q").alias("q")) for c in outputs]
    rows = df.select(group.alias(name), F.explode(F.array(*cells)).alias("c")).where("c.y IS NOT NULL AND c.q IS NOT NULL")
    found = rows.groupBy("c.output", name).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("c.y") <= F.col("c.q")).cast("double")).alias("coverage"))
    room = F.greatest(F.lit(within), 4 * F.sqrt(F.lit(alpha * (1 - alpha)) / F.col("n")))
    return found.withColumn("covered", F.abs(F.col("coverage") - alpha) <= room)
