"""Ordered per-key computations that do not depend on key balance.

A plain window sends every row of a key to one task. Where a key holds more
rows than one task should take, its history is cut into consecutive chunks and
each chunk also receives the ``depth`` rows before it, so bounded frames and
lags see the same rows as in the uncut history. Only oversized keys are cut;
without any the plan is the plain window with one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import lineage_cut
from .sizes import broadcast_if_small, int_conf, is_small_input

CHUNK_ROWS_CONF = "spark.ledgerloom.chunkRows"
CHUNK_ROWS = 500_000
_CHUNK, _HOME, _SLOT, _TARGETS = "__chunk", "__home", "__slot", "__targets"


@dataclass(frozen=True)
class Series:
    """A keyed, time-ordered table.

    ``order`` starts with the time column and ends with columns that make the
    order total. ``slot`` is the grain of time at which a long history may be cut.
    ``one_per_slot`` marks tables aggregated to one row per key and slot: the
    calendar bounds a key's rows, so its size is not checked.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    slot: str = "day"
    one_per_slot: bool = False

    def ordering(self, descending: bool = False) -> list[Column]:
        return [F.desc(c) if descending else F.asc(c) for c in self.order]

    def window(self, descending: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.ordering(descending))


Step = tuple[Callable[[DataFrame, WindowSpec], DataFrame], int]


def chained(*steps: Step) -> Step:
    """Several (compute, depth) steps as one, so that they share one pass over the history."""

    def compute(d: DataFrame, w: WindowSpec) -> DataFrame:
        for step, _ in steps:
            d = step(d, w)
        return d

    return compute, sum(depth for _, depth in steps)


def over_history(
    df: DataFrame,
    series: Series,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    depth: int,
    descending: bool = False,
) -> DataFrame:
    """Run ``compute(df, w)`` where ``w`` is the series' window.

    ``depth`` is how many earlier rows a result may depend on (later rows in a
    descending series). ``compute`` must keep all columns and rows it is given.
    """
    chunk_rows = max(int_conf(df, CHUNK_ROWS_CONF, CHUNK_ROWS), depth + 1)
    oversized = None if series.one_per_slot else oversized_keys(df, series.keys, chunk_rows)
    if oversized is None:
        return compute(df, series.window(descending))
    cut = _cut(df, series, oversized, chunk_rows, depth, descending)
    w = Window.partitionBy(*series.keys, _CHUNK).orderBy(*series.ordering(descending))
    return compute(cut, w).where(F.col(_HOME)).drop(_CHUNK, _HOME)


def oversized_keys(df: DataFrame, keys: tuple[str, ...], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None.

    There are fewer than rows/limit of them, which bounds the result. Inputs
    that are an ordinary single-task amount in total are not counted at all.
    """
    if is_small_input(df.select(*keys)):
        return None
    over = df.groupBy(*keys).count().where(F.col("count") > limit).drop("count")
    return None if over.isEmpty() else over


def _cut(
    df: DataFrame, series: Series, oversized: DataFrame, size: int, depth: int, descending: bool
) -> DataFrame:
    """Give every row its chunk, and repeat the rows later chunks look back on.

    Adds the chunk number and whether the row is at home in it; other keys are
    one chunk.
    """
    keys = list(series.keys)
    slotted = df.withColumn(_SLOT, F.date_trunc(series.slot, F.col(series.order[0])))
    same_key = [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    big = broadcast_if_small(oversized).alias("o")
    per_slot = lineage_cut(
        slotted.select(*keys, _SLOT)
        .alias("s")
        .join(big, same_key, "left_semi")
        .groupBy(*keys, _SLOT)
        .agg(F.count(F.lit(1)).alias("n")),
        "slots",
    )
    if not per_slot.where(F.col("n") > size).isEmpty():
        # A single slot is too large as well: time does not divide this history.
        rest = df.alias("s").join(big, same_key, "left_anti")
        whole = rest.select("s.*", F.lit(0).cast("long").alias(_CHUNK), F.lit(True).alias(_HOME))
        hot = df.alias("s").join(big, same_key, "left_semi").select("s.*")
        return whole.unionByName(_cut_by_position(hot, series, size, depth, descending))

    # At most one row per key and calendar slot, so this window is bounded by the calendar.
    slot_order = F.desc(_SLOT) if descending else F.asc(_SLOT)
    running = Window.partitionBy(*keys).orderBy(slot_order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("n").over(running)

    def chunk_at(position: Column) -> Column:
        return F.floor(position / F.lit(float(size))).cast("long")

    later = F.array(chunk_at(F.col("end")), chunk_at(F.col("end") + F.lit(depth - 1))) if depth else F.array()
    targets = (
        per_slot.withColumn("end", end)
        .withColumn("home", chunk_at(F.col("end") - F.col("n")))
        .select(
            *keys,
            _SLOT,
            F.array_distinct(
                F.concat(F.array("home"), F.filter(later.cast("array<bigint>"), lambda c: c >= F.col("home")))
            ).alias(_TARGETS),
        )
    )
    same_slot = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*keys, _SLOT]]
    placed = (
        slotted.alias("s")
        .join(broadcast_if_small(targets).alias("t"), same_slot, "left")
        .select("s.*", F.coalesce(F.col(f"t.{_TARGETS}"), F.array(F.lit(0).cast("long"))).alias(_TARGETS))
    )
    return _spread(placed.drop(_SLOT))


def _spread(placed: DataFrame) -> DataFrame:
    """One row per target chunk; the first target is the row's home."""
    return (
        placed.select("*", F.explode(_TARGETS).alias(_CHUNK))
        .withColumn(_HOME, F.col(_CHUNK) == F.element_at(_TARGETS, 1))
        .drop(_TARGETS)
    )


def _cut_by_position(df: DataFrame, series: Series, size: int, depth: int, descending: bool) -> DataFrame:
    """Cut by row position, for histories of which one moment holds too many rows.

    A range partitioning over keys and order puts the rows in sequence. It is
    written down, because its bounds are sampled and must not change between
    counting the parts and numbering the rows inside them.
    """
    keys, part, position = list(series.keys), "__part", "__position"
    parts = max(2, -(-df.count() // size))
    ranged = df.repartitionByRange(parts, *[F.asc(k) for k in keys], *series.ordering(descending))
    ranged = lineage_cut(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, part]]
    inside = Window.partitionBy(*keys, part).orderBy(*series.ordering(descending))
    at = F.col("offset") + F.row_number().over(inside) - 1
    numbered_rows = (
        ranged.alias("r").join(broadcast_if_small(offsets).alias("o"), same).select("r.*", "o.offset")
    ).withColumn(position, at)
    home = F.floor(F.col(position) / size).cast("long")
    looked_back_on = F.col(position) % size >= size - depth
    targets = F.when(looked_back_on, F.array(home, home + 1)).otherwise(F.array(home))
    return _spread(numbered_rows.withColumn(_TARGETS, targets).drop(part, position, "offset"))


def last_known(
    df: DataFrame, series: Series, value: str, name: str, at_or_before: bool = True
) -> DataFrame:
    """Latest present ``value`` at or before each row, however far back it lies.

    An oversized key is cut; its chunks look at their own rows and take over
    the closing value of the chunks before.
    """
    keys, last_row = list(series.keys), 0 if at_or_before else -1
    size = int_conf(df, CHUNK_ROWS_CONF, CHUNK_ROWS)
    oversized = None if series.one_per_slot else oversized_keys(df, series.keys, size)
    if oversized is None:
        w = series.window().rowsBetween(Window.unboundedPreceding, last_row)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    cut = _cut(df, series, oversized, size, 0, descending=False).drop(_HOME)
    rank = F.when(F.col(value).isNotNull(), F.struct(*series.order))
    closing = cut.groupBy(*keys, _CHUNK).agg(F.max_by(value, rank).alias("__closing"))
    earlier = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = closing.select(*keys, _CHUNK, F.last("__closing", ignorenulls=True).over(earlier).alias("__carried"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, _CHUNK]]
    inside = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*series.ordering())
        .rowsBetween(Window.unboundedPreceding, last_row)
    )
    return (
        cut.alias("c")
        .join(carried.alias("k"), same, "left")
        .select("c.*", "k.__carried")
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__carried")))
        .drop(_CHUNK, "__carried")
    )


def latest_rows(df: DataFrame, series: Series, n: int = 1) -> DataFrame:
    """The last n rows per key; the rank filter is applied before the shuffle as well."""
    w = series.window(descending=True)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def latest_row(df: DataFrame, series: Series) -> DataFrame:
    """The last row per key as an aggregate, so a key's rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in series.keys]
    best = F.max_by(F.struct(*rest), F.struct(*series.order)).alias("__row")
    return df.groupBy(*series.keys).agg(best).select(*series.keys, "__row.*")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def numbered(df: DataFrame, order_id: str, name: str, slices: int | None = None) -> DataFrame:
    """Number rows 1..n in the order of a unique id.

    Rows are dealt by ranges of the id with about as many rows each, however the
    ids lie, and written with their range; counts give each range its offset, so
    numbering runs in parallel. There are as many ranges as shuffle partitions
    unless ``slices`` says otherwise.
    """
    ranged = df.repartitionByRange(slices, order_id) if slices else df.repartitionByRange(order_id)
    # Range bounds are sampled, so the deal is written rather than done again.
    sliced = lineage_cut(ranged.withColumn("__slice", F.spark_partition_id()), "numbered")
    counts = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__slice").orderBy(order_id)
    return (
        sliced.join(broadcast_if_small(offsets), "__slice")
        .withColumn(name, F.row_number().over(inside) + F.col("__offset"))
        .drop("__slice", "__offset")
    )
