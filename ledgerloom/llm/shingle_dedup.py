"""Near copies by the words they share: SimHash popcounts and MinHash bands give candidates, the exact similarity decides.

A text is the set of its runs of five words. Sets whose SimHashes differ in three
bits or fewer meet in the popcount grid of ``simhash_dedup``. Sets with a similarity
of 0.8 or more (common runs by all runs of both) may differ in more bits; they agree
in all four rows of at least one of 24 bands, but for three pairs in a million that
lie right at the bound. What a large group of copies costs grows with its size, not
with its square:

1. Links of the grid are verified. Then every bucket tests its members against one
   leader, but for those the grid has linked with it. Leaders are the first by a
   hash of the text, so the buckets of a group share a few of them.
2. What the leaders leave apart is compared within its buckets by bit parities: a
   run that only one of two sets has flips one bit, so sets whose parities differ
   in more bits than the similarity allows are no candidates. Members without a
   candidate outside their own component go no further.
3. The others bring their sets to their buckets, where components merge as pairs
   are verified, so that a pair within a component is not verified again.

Buckets report at most one link for each member. Those with many members are cut
into chunks that meet pairwise.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .shared import free_name, mixed, slices, written
from .simhash_dedup import SEED, stars

WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
# Hashes that meet all rows at a time, and members that meet a bucket's others at a time.
BLOCK = 2048
STRIP = 256
# Bits of a set's parities.
BITS = 1024
# Members of a leader that one task verifies; members and bytes of sets of a bucket's chunk.
LED = 4096
CHUNK = 8192
CHUNK_BYTES = 32 << 20
FLIPS = mixed(np.arange(BANDS * ROWS))
FACTORS = mixed(np.arange(BANDS * ROWS) + 1_000_000) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C55)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; a shorter text is one run, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    width = min(words, len(parts))
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[: len(parts) - width]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(starts)))


def bands(found: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    key = mixed(np.arange(BANDS))
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * STEP + row)
    return key


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's runs falls on each of ``BITS`` bits."""
    odd = np.bincount((mixed(found) % np.uint64(BITS)).astype(np.int64), minlength=BITS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketches(docs: DataFrame, key_col: str, text_col: str, words: int) -> DataFrame:
    """key, hash, size, parities, SimHash and buckets of the set of each row; a set without members has hash 0 and no bucket."""
    source = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            fp, size, buckets, bits, prints = [], [], [], [], []
            for text in part.column("text"):
                found = shingles(text.as_py(), words)
                fp.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
                size.append(len(found))
                buckets.append(bands(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
                bits.append(parities(found).tobytes())
                prints.append(simhash_dedup.majority(found))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(size, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["key", "fp", "n", "bits", "print", "buckets"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fp long, n long, bits binary, print long, buckets array<long>")


def sets(texts: DataFrame, words: int) -> DataFrame:
    """fp and set (64-bit hashes, ascending) of each text."""

    def run(batches):
        for part in slices(batches, "text"):
            found = [shingles(text.as_py(), words).tobytes() for text in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("fp"), pa.array(found, pa.binary())], ["fp", "set"])

    return texts.mapInArrow(run, "fp long, set binary")


def alike(points: DataFrame) -> DataFrame:
    """Pairs (a, an, b, bn) of sets, with their sizes, that the grid of SimHashes brings together.

    Sets of one SimHash meet the first of them, and the first sets of two SimHashes that are linked meet.
    """
    points = points.where("n > 0").select("print", "fp", "n")
    heads = written(points.groupBy("print").agg(F.min(F.struct("fp", "n")).alias("head")), "heads")
    same = points.join(heads, "print").where(F.col("fp") != F.col("head.fp"))
    same = same.select(F.col("head.fp").alias("a"), F.col("head.n").alias("an"), F.col("fp").alias("b"), F.col("n").alias("bn"))
    near = simhash_dedup.links(heads.select(F.col("print").alias("fp")))
    for c in ("a", "b"):
        own = heads.select(F.col("print").alias(c), F.col("head.fp").alias(f"{c}fp"), F.col("head.n").alias(f"{c}n"))
        near = near.join(own, c)
    return same.unionByName(near.select(F.col("afp").alias("a"), "an", F.col("bfp").alias("b"), "bn"))


def led_links(pairs: DataFrame, known: DataFrame, similarity: float, led: int = LED) -> DataFrame:
    """The pairs (a, b), a leader and its member, that have the similarity. Members of a leader are dealt to several tasks."""
    units = pairs.groupBy("a").agg(F.ceil(F.count("*") / led).cast("int").alias("k"))
    first = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).join(known, F.col("a") == F.col("fp"))
    rest = pairs.join(units, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("k")).cast("int")).join(known, F.col("b") == F.col("fp"))
    both = first.select("a", "part", F.lit(True).alias("leads"), "fp", "set").unionByName(rest.select("a", "part", F.lit(False).alias("leads"), "fp", "set"))

    def run(batches):
        leader = None
        for batch in batches:
            links = []
            for a, leads, fp, found in zip(*(batch.column(c).to_pylist() for c in ("a", "leads", "fp")), batch.column("set")):
                found = np.frombuffer(found.as_py(), np.uint64)
                if leads:
                    leader = found
                elif similar(leader, found, similarity):
                    links.append((a, fp))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = both.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))
    return dealt.mapInArrow(run, "a long, b long")


def candidates(part: np.ndarray, n: np.ndarray, bits: np.ndarray, chunk: np.ndarray, similarity: float):
    """Pairs of positions of different parts (and chunks, where there are two) that size and parities leave possible, strip by strip."""
    whole = chunk.min() == chunk.max()
    for at in range(0, len(n), STRIP):
        i = np.arange(at, min(at + STRIP, len(n)))
        j = np.arange(at if whole else 0, len(n))
        small, large = np.minimum(n[i, None], n[j]), np.maximum(n[i, None], n[j])
        ok = (part[i, None] != part[j]) & (small >= similarity * large - 1e-9)
        ok &= (i[:, None] < j) if whole else (chunk[i, None] < chunk[j])
        x, y = np.nonzero(ok)
        for lo in range(0, len(x), 1 << 16):
            a, b = i[x[lo : lo + (1 << 16)]], j[y[lo : lo + (1 << 16)]]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            # With c common runs the sets differ in n + m - 2c, and c is at least s / (1 + s) of n + m.
            hit = differ <= (n[a] + n[b]) * (1 - similarity) / (1 + similarity) + 1e-6
            yield a[hit], b[hit], differ[hit]


def in_buckets(members: DataFrame, chunks: DataFrame, solve, columns: str) -> DataFrame:
    """``solve`` on the members of each bucket, or of two chunks of it. ``chunks``: bucket, k."""
    every = members.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    every = every.withColumns({"c": F.least("chunk", "other"), "d": F.greatest("chunk", "other")}).drop("k", "other")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        unit, waiting = None, []

        def solved():
            found = solve(pa.Table.from_batches(waiting).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("bucket", "c", "d")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
                if tuple(keys[start]) != unit:
                    if waiting:
                        yield solved()
                    unit, waiting = tuple(keys[start]), []
                waiting.append(batch.slice(start, stop - start))
        if waiting:
            yield solved()

    dealt = every.repartition("bucket", "c", "d").sortWithinPartitions("bucket", "c", "d")
    return dealt.mapInArrow(run, columns)


def _arrays(unit: pa.Table):
    part, n, chunk = (np.asarray(unit.column(c)).astype(np.int64) for c in ("part", "n", "chunk"))
    bits = np.frombuffer(b"".join(unit.column("bits").to_pylist()), np.uint64).reshape(len(n), BITS // 64)
    return part, n, bits, chunk


def near_copies(docs: DataFrame, key_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """key and component_id of each row: the smallest key that links of the similarity or more reach.

    Texts without words, null or empty, are one group. Rows that repeat a text get a row each.
    """
    found = written(sketches(docs, key_col, text_col, words), "sketches")
    one = (F.first(c).alias(c) for c in ("n", "bits", "print", "buckets"))
    points = written(found.groupBy("fp").agg(F.min("key").alias("low"), *one), "points")
    entered = written(points.select("fp", "n", F.explode("buckets").alias("bucket")), "buckets")

    order = F.struct(F.xxhash64("fp").alias("at"), "fp", "n")
    leaders = entered.groupBy("bucket").agg(F.min(order).alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = written(entered.join(leaders.drop("members"), "bucket"), "shared-buckets")

    def sized(n, m):
        return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-9

    met = written(alike(points).where(sized("an", "bn")).select("a", "b"), "alike")
    asked = shared.select("fp").unionByName(met.select(F.col("a").alias("fp"))).unionByName(met.select(F.col("b").alias("fp")))
    wanted = points.join(asked.distinct(), "fp", "left_semi").select("fp", F.col("low").alias("key"))
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(wanted, "key")
    known = written(sets(texts.dropDuplicates(["fp"]).select("fp", "text"), words), "shared-sets", "none")

    def verified(pairs):
        return led_links(pairs, known, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    gridded = written(stars(verified(met)), "gridded")
    led = shared.where((F.col("fp") != F.col("leader.fp")) & sized("n", "leader.n")).select(F.col("leader.fp").alias("a"), F.col("fp").alias("b")).distinct()
    for c in ("a", "b"):
        led = led.join(gridded.select(F.col("node").alias(c), F.col("root").alias(f"{c}root")), c, "left")
    led = written(led.where(F.coalesce("aroot", "a") != F.coalesce("broot", "b")).select("a", "b"), "led")
    hung = written(stars(verified(led).unionByName(gridded.select(F.col("root").alias("a"), F.col("node").alias("b")))), "hung")

    members = shared.select("bucket", "fp").join(hung, F.col("fp") == F.col("node"), "left")
    members = written(members.select("bucket", "fp", F.coalesce("root", "fp").alias("part")), "members")
    several = members.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("size"))
    several = several.where("least < most")
    apart = members.join(several.select("bucket"), "bucket").join(points.select("fp", "n", "bits"), "fp")

    def hopeful(unit):
        part, n, bits, chunk = _arrays(unit)
        hit = np.zeros(len(n), bool)
        for a, b, _ in candidates(part, n, bits, chunk, similarity):
            hit[a] = hit[b] = True
        return [np.asarray(unit.column(c)).astype(np.int64)[hit] for c in ("bucket", "fp", "part")]

    def linked(unit):
        part, n, bits, chunk = _arrays(unit)
        fp = np.asarray(unit.column("fp")).astype(np.int64)
        sets_ = unit.column("set")
        left, right, group = [], [], part.copy()
        for a, b, differ in candidates(part, n, bits, chunk, similarity):
            for i in np.argsort(differ, kind="stable"):
                x, y = a[i], b[i]
                if group[x] != group[y] and similar(*(np.frombuffer(sets_[int(k)].as_py(), np.uint64) for k in (x, y)), similarity):
                    left.append(min(fp[x], fp[y]))
                    right.append(max(fp[x], fp[y]))
                    group[group == group[y]] = group[x]
        return np.array(left, np.int64), np.array(right, np.int64)

    chunks = several.select("bucket", F.ceil(F.col("size") / CHUNK).cast("int").alias("k"))
    active = written(in_buckets(apart, chunks, hopeful, "bucket long, fp long, part long").distinct(), "apart")
    rest = written(active.join(points.select("fp", "n", "bits"), "fp"), "apart-members")
    chunks = rest.groupBy("bucket").agg(F.ceil(F.sum(F.col("n") * 8 + BITS // 8) / CHUNK_BYTES).cast("int").alias("k"))
    more = in_buckets(rest.join(known, "fp"), chunks, linked, "a long, b long")
    links = hung.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)

    rooted = points.select("fp", "low").join(stars(links.distinct()), F.col("fp") == F.col("node"), "left")
    rooted = written(rooted.select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return found.select("key", "fp").join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(
        F.col("key").alias(key_col), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """One row of every component, with all its columns: the one with the smallest id.

    Rows are told apart by id and text; of rows that repeat both one stays. A row
    without an id comes before all others, and texts without words are one group.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    name = free_name(docs, "key")
    found = near_copies(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", words, similarity)
    first = found.where(F.col("key") == F.col("component_id")).select(F.col("key").alias(name))
    return docs.withColumn(name, key).join(first, name, "left_semi").dropDuplicates([name]).select(docs.columns)
