"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 segments of two bits. The
Manhattan distance of two embeddings never exceeds the number of differing bits,
so fingerprints within three bits lie within three in the grid, and within one in
at least one half of its dimensions. Each half is a grid of cells: a point enters
its own cell, and the cells one step away if the sum of its counts is even, which
brings every such pair together in a cell. Candidates of a cell are verified on
all bits. Cells with very many points are cut into chunks that meet pairwise.

Only distinct fingerprints take part. A cell reports the links of small groups,
and of large ones a spanning forest; connected components then follow from
alternating large-star and small-star steps.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, table, written

WORDS = 3
BITS = 3
SEED = 42
CHUNK = 8192
# Groups up to this size report each of their links.
FEW = 32
EVERY_OTHER = 0x55555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    width = min(words, len(parts))
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(parts) - width]]
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n - n % 255
    # Sums of up to 255 rows fit a byte.
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """id and fingerprint, as a signed long, of each row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def cells(points: DataFrame) -> DataFrame:
    """(cell, fp, own): the cells each fingerprint enters; ``own`` is false for a neighbour's cell."""
    out = []
    for half in (0, 1):
        part = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = part.bitwiseAND(F.lit(EVERY_OTHER)) + F.shiftrightunsigned(part, 1).bitwiseAND(F.lit(EVERY_OTHER))
        base = points.select("fp", (F.bit_count(part) % 2 == 0).alias("even"), (counts + F.lit(half << 32)).alias("home"))
        around = []
        for i in range(16):
            count = F.shiftright("home", 2 * i).bitwiseAND(F.lit(3))
            around += [F.when(count > 0, F.col("home") - F.lit(1 << 2 * i)), F.when(count < 2, F.col("home") + F.lit(1 << 2 * i))]
        near = F.when(F.col("even"), F.array_compact(F.array(*around))).otherwise(F.array().cast("array<bigint>"))
        base = base.select("fp", "home", F.explode(F.array_append(near, F.col("home"))).alias("cell"))
        out.append(base.select("cell", "fp", (F.col("cell") == F.col("home")).alias("own")))
    return out[0].unionByName(out[1])


def smallest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest index each of ``size`` points is linked with, over any number of links."""
    label = np.arange(size)
    while True:
        new = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(points: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the points of a large group just as all links within ``bits`` do.

    Points one bit apart are linked first, by search. What the largest component
    then lacks is compared with every point, in blocks.
    """
    points = np.unique(points)
    size = len(points)
    left, right = [], []
    for i in range(64):
        other = points ^ np.uint64(1 << i)
        at = np.minimum(np.searchsorted(points, other), size - 1)
        hit = np.flatnonzero((points[at] == other) & (points < other))
        left.append(hit)
        right.append(at[hit])
    label = smallest(np.concatenate(left), np.concatenate(right), size)
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    more_left, more_right = [], []
    for at in range(0, len(rest), 256):
        block = rest[at : at + 256]
        i, j = np.nonzero(np.bitwise_count(points[block, None] ^ points[None, :]) <= bits)
        i = block[i]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        _, first = np.unique(label[i] * size + label[j], return_index=True)
        more_left.append(i[first])
        more_right.append(j[first])
    if more_left:
        label = smallest(np.concatenate([np.arange(size), *more_left]), np.concatenate([label, *more_right]), size)
    moved = np.flatnonzero(label != np.arange(size))
    return points[moved], points[label[moved]]


def unit_links(unit: np.ndarray, points: np.ndarray, own: np.ndarray, bits: int):
    """Links within runs of equal ``unit``: all in small runs, a spanning forest in large ones."""
    begins = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(begins, len(unit)))
    for b, n in zip(begins[sizes > FEW], sizes[sizes > FEW]):
        if own[b : b + n].any():
            yield forest(points[b : b + n], bits)
    small = sizes <= FEW
    ends = np.repeat(begins + sizes, sizes)[np.repeat(small, sizes)]
    at = np.flatnonzero(np.repeat(small, sizes))
    k = 1
    while len(at):
        inside = at + k < ends
        at, ends = at[inside], ends[inside]
        a, b = points[at], points[at + k]
        hit = (own[at] | own[at + k]) & (np.bitwise_count(a ^ b) <= bits)
        yield a[hit], b[hit]
        k += 1


def links(points: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b, that connect distinct fingerprints as all links within ``bits`` do."""
    if bits > BITS:
        raise ValueError(f"the grid finds up to {BITS} differing bits")
    entered = written(cells(points), "simhash-cells")
    full = entered.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    full = full.select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("k"))
    own_chunk = F.pmod(F.xxhash64("fp"), F.coalesce("k", F.lit(1))).cast("int")
    meets = F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)
    units = (
        entered.join(full, "cell", "left")
        .withColumn("c", own_chunk)
        .withColumn("d", F.explode(meets))
        .select("cell", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"), "fp", "own")
    )

    def run(batches):
        rest = None

        def pairs(unit, points, own):
            for a, b in unit_links(unit, points, own, bits):
                if len(a):
                    a, b = a.view(np.int64), b.view(np.int64)
                    low, high = np.minimum(a, b), np.maximum(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

        for batch in batches:
            unit = np.stack([np.asarray(batch.column(n)).astype(np.int64) for n in ("cell", "c", "d")], axis=1)
            points = np.asarray(batch.column("fp")).view(np.uint64)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)
            if rest is not None:
                unit, points, own = (np.concatenate(x) for x in zip(rest, (unit, points, own)))
            if not len(unit):
                continue
            # The last unit may go on in the next batch; it has at most two chunks.
            last = int(np.flatnonzero((unit != unit[-1]).any(axis=1))[-1]) + 1 if (unit != unit[-1]).any() else 0
            if last:
                yield from pairs(unit[:last], points[:last], own[:last])
            rest = unit[last:].copy(), points[last:].copy(), own[last:].copy()
        if rest is not None:
            yield from pairs(*rest)

    dealt = units.repartition("cell", "c", "d").sortWithinPartitions("cell", "c", "d")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` but the roots: each component hangs on its smallest node."""

    def both(e):
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges, "links")
    before = state(edges)
    while True:
        sym = both(edges)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(low, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # In ``large`` a < b; the small star of b joins its lower neighbours and itself to the lowest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("x"), F.col("b").alias("y")).unionByName(
            small.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
        )
        edges = written(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        after = state(edges)
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS
) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id and root (one fingerprint of the component) of each row.

    ``component_id`` is the smallest id that links of ``bits`` or fewer differing
    bits reach, the row's own included. Texts without words, null or empty, have
    fingerprint zero and link like any other. Rows that repeat an id or a text get
    a row each; rows without an id get the smallest id of their component, or null.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("id").alias("low")), "points")
    hung = stars(links(points.select("fp"), bits))
    rooted = points.join(hung, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    known = rooted.join(lowest, "root").select("fp", "component_id", "root")
    return prints.join(known, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id.

    Rows are told apart by id and text; of rows that repeat both one stays. A row
    without an id comes before all others, and texts without words are one group.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    name = free_name(docs, "key")
    found = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", words, bits)
    first = found.where(F.col("key") == F.col("component_id")).select(F.col("key").alias(name))
    return docs.withColumn(name, key).join(first, name, "left_semi").dropDuplicates([name]).select(docs.columns)


def op3_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
