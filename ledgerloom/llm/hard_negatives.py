"""Hard negatives by exact integer scores, multiplied by Strassen's recursion.

Vectors become whole numbers, and every anchor meets every row in tiles of a grid:
anchors in blocks, rows in blocks, one group of the shuffle for each pair of
blocks. In a group the anchors come first and are held; the rows stream past in
tiles, each tile is one product by Strassen's recursion in 64-bit integers (sums
that pass 2^63 on the way wrap around and come back, so products are exact), and
what it finds goes into bounded heaps. Heaps of groups merge, whatever the order
and however often a task is run again: an entry is told apart by score, id and a
hash of its row.

Positives need rows of the anchor's own label only, so their grid is laid within
labels; a label with many rows gets many blocks. Windows of negatives depend on
the positives and are searched in a second grid over all rows.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
# A negative's score lies between these hundredths of the positive's.
WINDOW = (50, 95)
# Anchors that a group holds, rows that stream past it at most, and products of one tile.
ANCHORS = 4096
ROWS = 65_536
TILE = 1 << 21
# No side of a product is halved to less than this.
LEAF = 32
LEAST = np.iinfo(np.int64).min
# Squared lengths from here on could give scores beyond a long.
LONGEST = float(2**56)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64: seven half products where eight would do, down to ``leaf``.

    Odd sides are padded with zeros.
    """
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) < 2 * leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.zeros((2 * i, 2 * l), np.int64)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    # Each product goes where it is needed and is forgotten.
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11 += p
    c22 += p
    p = strassen(a21 + a22, b11, leaf)
    c21 += p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12 += p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:n, :m]


def merged(key, score, ids, prints, most: int):
    """Of each key the first ``most`` distinct entries: higher scores first, then smaller ids."""
    order = np.lexsort((prints, ids, -score, key))
    key, score, ids, prints = key[order], score[order], ids[order], prints[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
    key, score, ids, prints = key[fresh], score[fresh], ids[fresh], prints[fresh]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    kept = rank < most
    return key[kept], score[kept], ids[kept], prints[kept]


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).astype(np.int64, copy=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


class Positives:
    """The heap of an anchor's best rows of its label."""

    columns = "anchor_id long, anchor_print long, score long, id long, print long"

    def __init__(self, held: pa.Table, most: int):
        self.ids, self.prints = (np.asarray(held.column(c)).astype(np.int64) for c in ("id", "print"))
        self.most = most
        self.heap = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, scores, ids, prints, labels):
        scores = np.where((self.ids[:, None] == ids) & (self.prints[:, None] == prints), LEAST, scores)
        # What could reach the heap: a tile's own best suffices.
        cut = min(self.most, len(ids))
        least = np.partition(scores, len(ids) - cut, axis=1)[:, len(ids) - cut]
        row, col = np.nonzero((scores >= least[:, None]) & (scores != LEAST))
        new = row, scores[row, col], ids[col], prints[col]
        self.heap = merged(*(np.concatenate(x) for x in zip(self.heap, new)), self.most)

    def found(self):
        key, score, ids, prints = self.heap
        return [self.ids[key], self.prints[key], score, ids, prints]


class Negatives:
    """The heaps of an anchor's windows, one for each of its positives."""

    columns = (
        "anchor_id long, anchor_print long, positive_id long, positive_print long, positive_score long, score long, id long, print long"
    )

    def __init__(self, held: pa.Table, most: int, window: tuple[int, int]):
        self.ids, self.prints, self.labels = (np.asarray(held.column(c)).astype(np.int64) for c in ("id", "print", "label"))
        lists = held.column("positives").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(np.asarray(lists.offsets))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        values = lists.flatten()
        self.pos = {c: np.asarray(values.field(c)).astype(np.int64) for c in ("score", "id", "print")}
        score = self.pos["score"]
        # Bounds in whole numbers: 100 * negative between window[0] and window[1] times the positive.
        self.low, self.high = -(-window[0] * score // 100), window[1] * score // 100
        self.most = most
        self.heap = tuple(np.zeros(0, np.int64) for _ in range(4))
        # Per anchor, what any of its windows spans.
        self.floor = np.full(len(sizes), np.iinfo(np.int64).max)
        self.ceiling = np.full(len(sizes), LEAST)
        real = self.low <= self.high
        np.minimum.at(self.floor, self.owner[real], self.low[real])
        np.maximum.at(self.ceiling, self.owner[real], self.high[real])
        self.slots = [np.flatnonzero(np.arange(len(self.owner)) - (np.cumsum(sizes) - sizes)[self.owner] == i) for i in range(int(sizes.max(initial=0)))]

    def add(self, scores, ids, prints, labels):
        hit = (scores >= self.floor[:, None]) & (scores <= self.ceiling[:, None]) & (self.labels[:, None] != labels)
        row, col = np.nonzero(hit)
        score = scores[row, col]
        order = np.lexsort((prints[col], ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        parts = [self.heap]
        for slot in self.slots:
            # The one positive of each anchor in this slot.
            at = np.full(len(self.floor), -1)
            at[self.owner[slot]] = slot
            key = at[row]
            inside = np.flatnonzero((key >= 0) & (score >= self.low[key]) & (score <= self.high[key]))
            parts.append(merged(key[inside], score[inside], ids[col[inside]], prints[col[inside]], self.most))
        self.heap = merged(*(np.concatenate(x) for x in zip(*parts)), self.most)

    def found(self):
        key, score, ids, prints = self.heap
        at = self.owner[key]
        return [self.ids[at], self.prints[at], self.pos["id"][key], self.pos["print"][key], self.pos["score"][key], score, ids, prints]


def met(units: DataFrame, make, columns: str) -> DataFrame:
    """Heaps of every unit (g, a, c) of the grid: first the anchors it holds, then the rows, each with id, print, label, v and positives.

    A task keeps one unit's anchors and heaps, and a tile of products.
    """
    dealt = units.repartition("g", "a", "c").sortWithinPartitions("g", "a", "c", F.desc("held"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        unit, waiting, heap, anchors = None, [], None, None

        def closed():
            if heap is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in heap.found()], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in "gac"], axis=1)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (held[1:] != held[:-1])) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(start, stop - start)
                if tuple(keys[start]) != unit:
                    yield from closed()
                    unit, waiting, heap, anchors = tuple(keys[start]), [], None, None
                if held[start]:
                    waiting.append(part)
                    continue
                if not waiting and heap is None:
                    continue
                if heap is None:
                    whole = pa.Table.from_batches(waiting).combine_chunks()
                    waiting, heap, anchors = [], make(whole), matrix(whole.column("v").chunk(0))
                rows = matrix(part.column("v"))
                width = max(rows.shape[1], anchors.shape[1])
                left = np.pad(anchors, ((0, 0), (0, width - anchors.shape[1])))
                right = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
                ids, prints, labels = (np.asarray(part.column(c)).astype(np.int64) for c in ("id", "print", "label"))
                step = max(1, TILE // len(anchors))
                for at in range(0, len(rows), step):
                    tile = slice(at, at + step)
                    heap.add(strassen(left, np.ascontiguousarray(right[tile].T)), ids[tile], prints[tile], labels[tile])
        yield from closed()

    return dealt.mapInArrow(run, columns)


def vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label, v (whole numbers) and print (a hash of label and v) of the rows that take part."""
    x = F.col(vector_col)
    numbers = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    sound = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    length = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"), F.lit(2.0)))
    taken = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull()).where(sound).where(length < LONGEST)
    taken = taken.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), numbers.alias("v"))
    return taken.withColumn("print", F.xxhash64("label", "v"))


def block(count: Column) -> Column:
    return F.pmod(F.xxhash64("id", "print"), count).cast("int")


def mined(
    rows: DataFrame, anchor_where: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each anchor (``anchor_where``) and each of its best ``positives`` rows of the
    same label, the best ``negatives`` rows of another label whose score lies in
    ``window`` hundredths of the positive's score; of equal scores the smaller id
    comes first. Scores are inner products of floor(scale * component).

    Rows without id or label, without a vector, with a null or non-finite
    component, or with a squared length from 2^56 (their scores might not fit) take
    no part. Shorter vectors end in zeros. Rows alike in id, label and vector are one
    row; rows that share an id only are different rows, also as an anchor's positives.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    base = vectors(rows, id_col, vector_col, label, scale)
    chosen = written(base.where(anchor_where).dropDuplicates(["id", "print"]), "anchors")
    sizes = written(
        base.groupBy("label").agg(F.count("*").alias("rows")).join(chosen.groupBy("label").agg(F.count("*").alias("anchors")), "label", "left"),
        "label-sizes",
    )
    n, held = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    kind = "array<struct<score:bigint,id:bigint,print:bigint>>"
    spread = 4 * spark.sparkContext.defaultParallelism

    def crossed(anchors, others, a, c, group):
        """Anchors once for each block of rows, rows once for each block of anchors."""
        every = lambda count: F.explode(F.sequence(F.lit(0), count.cast("int") - 1))
        columns = [group.cast("long").alias("g"), "a", "c", "id", "print", "label", "v"]
        left = anchors.withColumn("a", block(a)).withColumn("c", every(c)).select(*columns, "positives", F.lit(True).alias("held"))
        right = others.withColumn("c", block(c)).withColumn("a", every(a)).withColumn("positives", F.lit(None).cast(kind))
        return left.unionByName(right.select(*columns, "positives", F.lit(False).alias("held")))

    # Within labels. A label's share of the tasks goes by its rows, and by what a unit may hold.
    share = F.least(F.ceil(F.col("rows") * spread / max(n, 1)), F.ceil(F.col("rows") / 1024))
    grid = sizes.where("anchors > 0").select(
        F.col("label").alias("l"), F.ceil(F.col("anchors") / ANCHORS).alias("na"), F.greatest(F.ceil(F.col("rows") / ROWS), share).alias("nc")
    )
    units = crossed(
        chosen.withColumn("positives", F.lit(None).cast(kind)).join(grid, F.col("label") == F.col("l")),
        base.join(grid, F.col("label") == F.col("l")), F.col("na"), F.col("nc"), F.col("label"),
    )
    near = met(units, lambda t: Positives(t, positives), Positives.columns)
    best = Window.partitionBy("anchor_id", "anchor_print").orderBy(F.desc("score"), "id", "print")
    near = near.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives)
    # Windows of negative scores are empty.
    owned = near.where("score >= 0").groupBy("anchor_id", "anchor_print").agg(F.array_sort(F.collect_list(F.struct("score", "id", "print"))).alias("positives"))
    owned = chosen.join(owned, (F.col("id") == F.col("anchor_id")) & (F.col("print") == F.col("anchor_print"))).drop("anchor_id", "anchor_print")
    owned = written(owned, "anchors-with-positives")

    blocks_a = max(1, ceil(held / ANCHORS))
    blocks_c = max(1, ceil(n / ROWS), min(ceil(spread / blocks_a), ceil(n / 1024)))
    units = crossed(owned, base, F.lit(blocks_a), F.lit(blocks_c), F.lit(0))
    found = met(units, lambda t: Negatives(t, negatives, window), Negatives.columns)
    best = Window.partitionBy("anchor_id", "anchor_print", "positive_id", "positive_print").orderBy(F.desc("score"), "id", "print")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of the anchors whose id 50 divides; labels of ids that 7 divides move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, moved)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {
    "op11_hard_negatives": """WITH e AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      p AS (SELECT a, al, b AS positive_id, score AS positive_score FROM s WHERE al = bl
        QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
      SELECT a AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY a, positive_id ORDER BY score DESC, b) AS INTEGER) AS rank,
        b AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (a) WHERE s.bl <> s.al AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
      QUALIFY rank <= 3"""
}
