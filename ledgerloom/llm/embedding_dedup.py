"""Near copies among vectors by an epsilon grid order join.

Vectors of unit length with a cosine of at least c lie within epsilon =
sqrt(2 - 2c). They are turned onto the leading principal dimensions, which never
lengthens a distance, laid on a grid of cells with sides of epsilon and sorted by
label and cells. The sequence is cut into intervals. Two intervals meet only if
they share a label and reach neighbouring cells of the first dimension, and if the
boxes around them are no further apart than epsilon; a task joins two intervals by
halving them, skips halves whose boxes are too far apart, and compares what is left
by blocks of products in double precision.

Copies of a vector are one point with a count, so a common vector costs no more
than a rare one. A pair of intervals reports how many rows each point links with,
and a spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .simhash_dedup import smallest, stars

COSINE = 0.98
DIMENSIONS = 6
# Vectors that the principal dimensions are fitted on, at most; they decide what is skipped, not what is found.
SAMPLE = 4096
# Points of an interval at most, and of a block of products.
INTERVAL = 8192
BLOCK = 512
# Products so near to the bound are computed again in the order of the components.
CLOSE = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which changes no cosine, so that no square is too large or too small."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, pair by pair, with sums in the order of the components."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = (np.add.accumulate(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    return dot / np.sqrt(aa * bb)


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one width as float64 rows."""
    values = np.asarray(column.flatten()).astype(np.float64)
    return values.reshape(len(column), -1)


def groups(vectors: pa.Array):
    """Positions of the vectors of each width."""
    sizes = np.diff(np.asarray(vectors.offsets))
    for width in np.unique(sizes):
        yield int(width), np.flatnonzero(sizes == width)


def principal(points: DataFrame, most: int = SAMPLE, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Leading principal directions, one a row, of a sample of the vectors, chosen by a hash."""
    sample = points.orderBy(F.xxhash64("pid"), "pid").limit(most).select(F.transform("v", lambda x: x.cast("double")).alias("v")).toArrow()
    column = sample.column("v").combine_chunks()
    width = max((w for w, _ in groups(column)), default=1)
    laid = np.zeros((len(column), width))
    for w, at in groups(column):
        laid[at, :w] = unit(rows_of(column.take(pa.array(at))))
    if not len(laid):
        return np.zeros((0, width))
    laid -= laid.mean(axis=0)
    _, vectors = np.linalg.eigh(laid.T @ laid)
    return np.ascontiguousarray(vectors[:, ::-1][:, :dimensions].T)


def laid_out(points: DataFrame, directions: np.ndarray, epsilon: float) -> DataFrame:
    """Add ``spot``, the point on the principal dimensions, and ``cells``."""
    out = "pid long, label string, width int, m long, v array<double>, spot array<double>, cells array<int>"

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            spots = np.zeros((batch.num_rows, len(directions)))
            for w, at in groups(column):
                w = min(w, directions.shape[1])
                spots[at] = unit(rows_of(column.take(pa.array(at))))[:, :w] @ directions[:, :w].T
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat(spots), flat(np.floor(spots / epsilon).astype(np.int32))], [*batch.schema.names, "spot", "cells"])

    return points.select("pid", "label", "width", "m", F.transform("v", lambda x: x.cast("double")).alias("v")).mapInArrow(run, out)


def intervals(laid: DataFrame, most: int) -> DataFrame:
    """Points in epsilon grid order with the ``interval`` they fall in: consecutive points of one label and width.

    Ranges are dealt by a sample, so the deal is written with each point's place.
    """
    order = ["label", "width", "cells", "pid"]
    dealt = laid.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "grid-order")
    first = dealt.groupBy("label", "width", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"))
    first = first.select(F.col("label").alias("l"), F.col("width").alias("w"), "range", "first")
    found = dealt.join(first, (F.col("label") == F.col("l")) & (F.col("width") == F.col("w")) & (F.shiftright("at", 33) == F.col("range")))
    # A range holds a label's points together, so the place of an interval's first point names it.
    start = F.col("first") + F.floor((F.col("at") - F.col("first")) / most) * most
    return found.withColumn("interval", start.cast("long")).drop("l", "w", "range", "first")


def meetings(placed: DataFrame, dimensions: int, epsilon: float) -> DataFrame:
    """Pairs (x, y), x <= y, of intervals whose boxes lie within epsilon."""
    spot = [F.col("spot")[i] for i in range(dimensions)]
    boxes = written(
        placed.groupBy("label", "width", "interval").agg(
            F.array(*(F.min(c) for c in spot)).alias("low"), F.array(*(F.max(c) for c in spot)).alias("high")
        ),
        "boxes",
    )
    cell = lambda c: F.floor(c / epsilon)
    near = F.explode(F.sequence(cell(F.col("low")[0]) - 1, cell(F.col("high")[0]) + 1)).alias("cell")
    own = F.explode(F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell")
    left = boxes.select("label", "width", own, F.col("interval").alias("x"), "low", "high")
    right = boxes.select("label", "width", near, F.col("interval").alias("y"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    away = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col("low")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high")[i]), F.lit(2.0)) for i in range(dimensions)),
        F.lit(0.0),
    )
    met = left.join(right, ["label", "width", "cell"]).where(away <= (epsilon + CLOSE) ** 2)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def interval_join(a: dict, b: dict | None, least: float, epsilon: float):
    """Link counts of the points of one or two intervals, and a forest of their links, as positions in a then b.

    ``a`` and ``b`` hold v (unit rows), raw, spot and m in grid order; without b, a meets itself.
    """
    same = b is None
    b = a if same else b
    shift = 0 if same else len(a["m"])
    count = np.zeros(shift + len(b["m"]), np.int64)
    left, right = [], []
    reach = (epsilon + CLOSE) ** 2
    todo = [(0, len(a["m"]), 0, len(b["m"]))]
    while todo:
        i, j, k, l = todo.pop()  # noqa: E741
        p, q = a["spot"][i:j], b["spot"][k:l]
        apart = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if (apart * apart).sum() > reach or same and k > i:
            continue
        if j - i <= BLOCK and l - k <= BLOCK:
            products = a["v"][i:j] @ b["v"][k:l].T
            if same and i == k:
                products[np.triu_indices(j - i, 0, l - k)] = -2
            hit = products >= least + CLOSE
            x, y = np.nonzero((products >= least - CLOSE) & ~hit)
            if len(x):
                hit[x, y] = cosine(a["raw"][i + x], b["raw"][k + y]) >= least
            if hit.any():
                count[i:j] += hit @ b["m"][k:l]
                count[shift + k : shift + l] += a["m"][i:j] @ hit
                x, y = np.nonzero(hit)
                label = smallest(x, (j - i) + y, (j - i) + (l - k))
                moved = np.flatnonzero(label != np.arange(len(label)))
                place = np.concatenate([np.arange(i, j), np.arange(shift + k, shift + l)])
                left.append(place[moved])
                right.append(place[label[moved]])
        elif j - i >= l - k:
            half = (i + j) // 2
            todo += [(i, half, k, l), (half, j, k, l)]
        else:
            half = (k + l) // 2
            todo += [(i, j, k, half), (i, j, half, l)]
    if not left:
        return count, np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = smallest(np.concatenate(left), np.concatenate(right), len(count))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return count, moved, label[moved]


def joined(placed: DataFrame, pairs: DataFrame, least: float, epsilon: float) -> DataFrame:
    """(a, b, n): a point's links counted by rows (b null), and links (a, b) that connect what all links connect (n null)."""
    first = placed.join(pairs, placed["interval"] == pairs["x"]).withColumn("side", F.lit(0))
    second = placed.join(pairs.where("x < y"), placed["interval"] == pairs["y"]).withColumn("side", F.lit(1))
    units = first.unionByName(second).select("x", "y", "side", "at", "pid", "m", "v", "spot")
    dealt = units.repartition("x", "y").sortWithinPartitions("x", "y", "side", "at")

    def column(part, name):
        return np.asarray(part.column(name)).astype(np.int64)

    def solved(parts):
        whole = pa.Table.from_batches(parts).combine_chunks()
        raw, spot = (rows_of(whole.column(c).chunk(0)) for c in ("v", "spot"))
        v, m, pid, side = unit(raw), column(whole, "m"), column(whole, "pid"), column(whole, "side")
        cut = int((side == 0).sum())
        half = lambda s: {"v": v[s], "raw": raw[s], "spot": spot[s], "m": m[s]}
        count, left, right = interval_join(half(slice(0, cut)), half(slice(cut, None)) if cut < len(m) else None, least, epsilon)
        some = np.flatnonzero(count)
        gap = lambda n, kind: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pid[some]), gap(len(some), 0), pa.array(count[some])], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(pid[right]), pa.array(pid[left]), gap(len(left), 0)], ["a", "b", "n"])

    def run(batches):
        unit_, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = column(batch, "x"), column(batch, "y")
            cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(x)]):
                if (x[start], y[start]) != unit_:
                    if parts:
                        yield from solved(parts)
                    unit_, parts = (x[start], y[start]), []
                parts.append(batch.slice(start, stop - start))
        if parts:
            yield from solved(parts)

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_vectors(
    rows: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE, interval: int = INTERVAL
) -> DataFrame:
    """id, n_links, component_id and kept of each row.

    Rows of one label link if the cosine of their vectors is ``least`` or more.
    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id that links reach, the row's own included;
    ``kept`` says whether that is the row's own.

    Rows without a label, without a vector, with a zero or empty vector or with a
    null or non-finite component link with nothing, and vectors of different lengths
    do not link. Rows that repeat an id have a row each, and so have copies; rows
    without an id get the smallest id they reach, or null. An empty table gives
    no rows.
    """
    epsilon = sqrt(max(0.0, 2 - 2 * least))
    x = F.col("v")
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf"))) & F.exists(x, lambda c: c.cast("double") != 0)
    base = rows.select(F.col(id_col).alias("id"), label.cast("string").alias("label"), F.col(vector_col).alias("v"))
    base = base.withColumn("takes", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False)))
    points = base.where("takes").groupBy("label", "v").agg(F.count("*").alias("m"), F.min("id").alias("low"))
    points = written(points.select(F.monotonically_increasing_id().alias("pid"), "label", "v", F.size("v").alias("width"), "m", "low"), "points")

    directions = principal(points)
    placed = written(intervals(laid_out(points, directions, max(epsilon, CLOSE)), interval), "placed")
    found = written(joined(placed, meetings(placed, len(directions), max(epsilon, CLOSE)), least, epsilon), "vector-links")

    counts = found.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n"))
    hung = stars(found.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    linked = points.select("pid", "label", "v", "m", "low").join(counts, F.col("pid") == F.col("a"), "left").drop("a")
    linked = linked.join(hung, F.col("pid") == F.col("node"), "left").select(
        "label", "v", "low", F.coalesce("root", "pid").alias("root"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    )
    linked = written(linked, "linked")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = linked.join(lowest, "root").select("label", "v", "n_links", "component_id")
    taken = base.where("takes").select("label", "v", "id").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    rest = base.where(~F.col("takes")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return taken.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), F.col("label"))


QUERIES = {"op12_embedding_dedup": op12_embedding_dedup}
ORACLES = {
    "op12_embedding_dedup": f"""WITH RECURSIVE e AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
      reach(node, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.node, b FROM reach JOIN links ON links.a = reach.low),
      lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
      SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, low AS component_id, vec_id = low AS kept
      FROM embeddings JOIN lowest ON node = vec_id"""
}
