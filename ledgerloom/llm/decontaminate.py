"""Benchmark decontamination by q-gram filtering and banded alignment.

If a piece of a document is an item of m characters with at most k edits, the two
share at least m + 1 - (k + 1) q of their q-grams, on diagonals at most k apart.
Shared q-grams are counted in bands of diagonals 2k wide, each overlapping the
next by half; bands that meet the bound are aligned within the band, and kept when
the alignment stays within the edit budget. Items shorter than a q-gram allow no edit;
they are looked up whole, as words of their own.

The benchmark is the query side: it is taken in blocks of bounded text, each
carried to all documents; documents are never moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, free_name, mixed, raw, slices, table

Q = 8
# Edits allowed for each character of an item.
RATE = 0.10
BLOCK_BYTES = 4 << 20
BLOCK_ITEMS = 20_000
PART_BYTES = 1 << 20
# Bands that are aligned together, and bytes of their texts.
BANDS = 4096
CELLS = 1 << 19
BITMAP = 1 << 22
FIELDS = "item_id long, start long, stop long, edits int, item_chars int"


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z in lower case and runs of white space as one space, none at the ends; row offsets; place of each byte in its text."""
    data, offsets = raw(column)
    space = SPACE[data]
    out = np.where(space, np.uint8(32), LOWER[data])
    keep = ~space
    solid = np.flatnonzero(keep)
    keep[1:] |= space[1:] & ~space[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    keep[firsts] = ~space[firsts]
    # A space that ends a text goes too: it comes after the last byte that is none.
    before = np.searchsorted(solid, offsets[1:])
    ends = solid[before[before > 0] - 1] + 1
    keep[ends[ends < offsets[1:][before > 0]]] = False
    place = np.flatnonzero(keep)
    kept = np.searchsorted(place, offsets)
    out = out[place]
    place -= np.repeat(offsets[:-1], np.diff(kept))
    return out, kept, place


def grams(data: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams that begin at each byte, and whether they stay in their row."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    # Powers of two of steps: 1, 2, 4, 8 bytes packed exactly, then two overlapping packs are mixed.
    pack, width = data.astype(np.uint64), 1
    while width * 2 <= min(q, 8):
        pack = (pack[:-width] << np.uint64(8 * width)) | pack[width:]
        width *= 2
    last = pack[q - width :][:n]
    code = mixed(pack[:n])
    code += last * np.uint64(0x9E3779B97F4A7C55)
    code ^= code >> np.uint64(29)
    inside = np.ones(n, bool)
    cross = offsets[1:-1]
    for back in range(1, q):
        at = cross - back
        inside[at[(at >= 0) & (at < n)]] = False
    return code, inside


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes (at most 8) from each place on as one exact number."""
    n = max(0, len(data) - width + 1)
    code = np.zeros(n, np.uint64)
    for j in range(width):
        code = (code << np.uint64(8)) | data[j : j + n].astype(np.uint64)
    return code


# Bytes that go on with a word: letters and digits of ASCII, and all of other scripts.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Index:
    """The q-grams of a block of items, sorted by hash, and the items themselves; short items by their length."""

    ids: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    texts: list[bytes]
    codes: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray
    bitmap: np.ndarray
    q: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build(ids: list[int], texts: list[str], q: int = Q, rate: float = RATE) -> Index:
    """Index items. Items too short for the bound get the largest budget for which it is at least one.

    Items of less than q bytes, once white space is single, have no q-gram: for each length they are sorted by all
    their bytes. Blank items are in neither.
    """
    if not 1 <= q <= 8:
        raise ValueError("q-grams have one to eight bytes")
    data, offsets, _ = plain(pa.array(texts, pa.string()))
    sizes = np.diff(offsets)
    edits = np.minimum((sizes * rate).astype(np.int64), np.maximum(sizes // q - 1, 0))
    need = np.maximum(sizes + 1 - (edits + 1) * q, 1)
    code, inside = grams(data, offsets, q)
    at = np.flatnonzero(inside)
    item = np.searchsorted(offsets, at, "right") - 1
    order = np.argsort(code[at], kind="stable")
    at, item = at[order], item[order]
    codes, starts = np.unique(code[at], return_index=True)
    bitmap = np.zeros(BITMAP, bool)
    bitmap[(codes & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    cut = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    short = {}
    for width in sorted(set(sizes[(sizes > 0) & (sizes < q)].tolist())):
        mine = np.flatnonzero(sizes == width)
        whole = np.array([int.from_bytes(cut[i], "big") for i in mine], np.uint64)
        order = np.argsort(whole, kind="stable")
        short[width] = (whole[order], mine[order])
    return Index(
        np.array(ids, np.int64), sizes, edits, need, cut, codes, np.append(starts, len(at)), item, at - offsets[item], bitmap, q, short
    )


def align(item: bytes, text: bytes, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Best place of ``item`` in ``text`` on diagonals low to high: (edits, start, stop), or None beyond ``most`` edits."""
    exact = text.find(item, max(0, low), max(0, high + len(item)))
    if exact >= 0:
        return 0, exact, exact + len(item)
    return align_bands([item], np.frombuffer(text, np.uint8), *(np.array([x]) for x in (0, len(text), most, low, high)))[0]


def align_bands(items: list[bytes], data: np.ndarray, base, size, most, low, high) -> list[tuple[int, int, int] | None]:
    """``align`` of each item, without the look for exact places, in the text of ``size`` bytes that begins at ``base``.

    Bands of about the same width are filled together, at most ``CELLS`` cells of text at a time.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    width = high - low + 1
    order = np.lexsort((lengths, width))
    at = 0
    while at < len(order):
        # Widths ascend, lengths need not; one band is taken whatever its size.
        ahead = order[at : at + BANDS]
        cells = (np.maximum.accumulate(lengths[ahead]) + width[ahead]) * np.arange(1, len(ahead) + 1)
        some = ahead[: max(1, int(np.searchsorted(cells, CELLS, "right")))]
        at += len(some)
        _fill(some, items, lengths, width, data, base, size, most, low, out)
    return out


def _fill(some, items, lengths, width, data, base, size, most, low, out) -> None:
    """One row of the tables for each byte of the items; a cell of a band at offset d stands for text position row + low + d.

    Free at both ends of the text. Tables end with their item, or when all cells are beyond the edits allowed.
    """
    some = some[np.argsort(lengths[some], kind="stable")]
    n, w = lengths[some], width[some]
    first, chars, far = low[some], size[some], (most[some] + 1).astype(np.int32)
    wide, tall = int(w.max()), int(n.max())
    place = first[:, None] + np.arange(tall + wide)
    valid = (place >= 0) & (place < chars[:, None])
    text = np.where(valid, data[np.where(valid, place + base[some, None], 0)], np.int16(-1)) if len(data) else np.full(place.shape, np.int16(-1))
    letters = np.frombuffer(b"".join(items[k].ljust(tall, b"\0") for k in some), np.uint8).reshape(len(some), tall)
    offset = np.arange(wide, dtype=np.int32)
    # Cells of a row that stand for a position of the text: from lowest on, before beyond.
    lowest, beyond = -first, chars - first + 1
    cost = np.where((offset >= lowest[:, None]) & (offset < np.minimum(beyond, w)[:, None]), np.int32(0), far[:, None])
    start = np.broadcast_to(offset, cost.shape)
    alive = np.arange(len(some))
    for i in range(tall):
        limit = far[alive, None]
        # Same diagonal: match or replace. From the right: an item byte that the text lacks.
        cross = cost + (text[alive, i : i + wide] != letters[alive, i, None])
        lacks = np.concatenate([cost[:, 1:] + 1, limit], axis=1, dtype=np.int32)
        take = lacks < cross
        new = np.where(take, lacks, cross)
        begun = np.where(take, np.concatenate([start[:, 1:], start[:, -1:]], axis=1), start)
        # From the left: text bytes that the item lacks, one edit for each.
        lead = new - offset
        least = np.minimum.accumulate(lead, axis=1)
        source = np.maximum.accumulate(np.where(lead == least, offset, 0), axis=1)
        cost = np.minimum(least + offset, limit)
        start = np.take_along_axis(begun, source, axis=1)
        begin, stop = lowest[alive] - i - 1, np.minimum(beyond[alive] - i - 1, w[alive])
        if (begin > 0).any() or (stop < wide).any():
            cost = np.where((offset < begin[:, None]) | (offset >= stop[:, None]), limit, cost)
        stays = cost.min(axis=1) < far[alive]
        ended = stays & (n[alive] == i + 1)
        for k in np.flatnonzero(ended):
            d = int(cost[k].argmin())
            a = alive[k]
            out[some[a]] = int(cost[k, d]), int(first[a] + start[k, d]), int(n[a] + first[a] + d)
        stays &= ~ended
        if not stays.all():
            alive, cost, start = alive[stays], cost[stays], start[stays]
            if not len(alive):
                return


def find_short(index: Index, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """(row, item number) and the places in the row of items under q bytes.

    A letter or digit of ASCII at an end of an item must not go on with a word there.
    """
    found: dict[tuple[int, int], list[int]] = {}
    if not index.short:
        return found
    wordlike = np.concatenate([[False], WORDLIKE[data], [False]])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    for width, (whole, items) in index.short.items():
        code = packed(data, width)
        low, high = np.searchsorted(whole, code, "left"), np.searchsorted(whole, code, "right")
        at = np.flatnonzero(high > low)
        row = np.searchsorted(offsets, at, "right") - 1
        goes_on = wordlike[at] & ~first[at] & WORDLIKE[data[at]] & (data[at] < 128)
        last = data[at + width - 1]
        goes_on |= wordlike[at + width + 1] & ~first[at + width] & WORDLIKE[last] & (last < 128)
        fits = (at + width <= offsets[row + 1]) & ~goes_on
        for a, r in zip(at[fits].tolist(), row[fits].tolist()):
            for i in items[low[a] : high[a]].tolist():
                places = found.setdefault((r, i), [])
                # Places are in order: one that overlaps the last is left out.
                if not places or a - int(offsets[r]) >= places[-1] + width:
                    places.append(a - int(offsets[r]))
    return found


def find(index: Index, column: pa.Array):
    """(row, item number, start, stop, edits) of every item found in a slice of texts; places are bytes of the text."""
    data, offsets, origin = plain(column)
    code, inside = grams(data, offsets, index.q)
    maybe = np.flatnonzero(index.bitmap[(code & np.uint64(BITMAP - 1)).astype(np.int64)] & inside)
    at = np.searchsorted(index.codes, code[maybe])
    real = at < len(index.codes)
    real[real] = index.codes[at[real]] == code[maybe[real]]
    maybe, at = maybe[real], at[real]
    # One entry for each place of the q-gram in an item.
    n = index.starts[at + 1] - index.starts[at]
    spread = np.repeat(index.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, diagonal = index.items[spread], np.repeat(maybe, n) - index.places[spread]
    # A band is a run of diagonals of an item; hits of the item in the same place count once.
    step = np.maximum(index.edits[item], 1)
    band = diagonal // step
    row = np.searchsorted(offsets, np.repeat(maybe, n), "right") - 1
    # Row, item and band as one number; each hit enters its own band and the one before.
    tall = int(band.max(initial=0) - band.min(initial=0)) + 3
    lowest = int(band.min(initial=0)) - 1
    key = (row * len(index.ids) + item) * tall + (band - lowest)
    key = np.concatenate([key, key - 1])
    keys, counts = np.unique(key, return_counts=True)
    bands, pairs = keys % tall + lowest, keys // tall
    rows, items = pairs // len(index.ids), pairs % len(index.ids)
    enough = counts >= index.need[items]
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    rows, items, bands = rows[enough], items[enough], bands[enough]
    budget = index.edits[items]
    base, span = offsets[rows], np.maximum(budget, 1)
    size = offsets[rows + 1] - base
    # The band covers two steps of diagonals; edits can lead k further on either side.
    low, high = bands * span - base - budget, (bands + 2) * span - 1 - base + budget
    # An exact place needs no table.
    inexact = []
    for k, (r, i, o, a, b) in enumerate(zip(rows.tolist(), items.tolist(), base.tolist(), np.maximum(low, 0).tolist(), high.tolist())):
        item = index.texts[i]
        exact = data[o + a : min(o + max(0, b + len(item)), int(offsets[r + 1]))].tobytes().find(item)
        if exact >= 0:
            found.setdefault((r, i), []).append((0, a + exact, a + exact + len(item)))
        else:
            inexact.append(k)
    aligned = align_bands([index.texts[i] for i in items[inexact]], data, *(x[inexact] for x in (base, size, budget, low, high)))
    for r, i, hit in zip(rows[inexact].tolist(), items[inexact].tolist(), aligned):
        if hit:
            found.setdefault((r, i), []).append(hit)
    short = find_short(index, data, offsets)
    for r, i in sorted([*found, *short]):
        if (r, i) in short:
            size, base = int(index.sizes[i]), int(offsets[r])
            for start in short[r, i]:
                yield r, i, int(origin[base + start]), int(origin[base + start + size - 1]) + 1, 0
            continue
        hits, free = found[r, i], []
        for edits, start, stop in sorted(hits):
            if all(stop <= s or start >= e for _, s, e in free):
                free.append((edits, start, stop))
        base = int(offsets[r])
        for edits, start, stop in sorted(free, key=lambda x: x[1]):
            yield r, i, int(origin[base + start]), int(origin[base + stop - 1]) + 1, edits


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, q: int, rate: float, most_bytes: int, most_items: int):
    """Indexes of the items, a block at a time; the driver never holds more than one block's text."""
    items = benchmark.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    )
    ids, texts, size = [], [], 0
    for row in items.distinct().orderBy("id", "text").toLocalIterator():
        if ids and (size + len(row["text"]) > most_bytes or len(ids) >= most_items):
            yield build(ids, texts, q, rate)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield build(ids, texts, q, rate)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row for every place of a document that holds an item within its edit budget.

    Columns: the document's id, item_id, start and stop (bytes of the text as it
    is), edits, item_chars. A-Z and a-z are alike, and so are runs of white space.
    The budget is ``rate`` edits for each byte of the item, less for items under
    about ten q-grams and none for items under q bytes, which have to stand as words
    of their own. Null and empty texts hold nothing; items that are null, blank or
    without an id are not searched for; repeated rows of either side give repeated
    documents and single items. Overlapping places of an item count as its best
    one, of equally good ones as the first.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = None
    for index in benchmark_blocks(benchmark, item_id_col, item_text_col, q, rate, block_bytes, block_items):

        # The index travels with the task: at most block_bytes of items and their q-grams.
        def run(batches, index=index):
            for part in slices(batches, "text", PART_BYTES):
                hits = list(find(index, part.column("text")))
                if hits:
                    row, item, start, stop, edits = map(np.array, zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").take(pa.array(row)),
                            pa.array(index.ids[item]),
                            pa.array(start.astype(np.int64)),
                            pa.array(stop.astype(np.int64)),
                            pa.array(edits.astype(np.int32)),
                            pa.array(index.sizes[item].astype(np.int32)),
                        ],
                        ["id", "item_id", "start", "stop", "edits", "item_chars"],
                    )

        hits = source.mapInArrow(run, f"id {kind}, {FIELDS}")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kind}, {FIELDS}")
    return out.withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no item was found, with all their columns.

    Hits go by id and text, so rows that share an id are judged by their own text,
    and rows without an id too.
    """
    keyed = docs.select(F.struct(F.col(id_col), F.xxhash64(text_col).alias("th")).alias("key"), F.col(text_col).alias("text"))
    name = free_name(docs, "key")
    hits = contaminated(keyed, benchmark, "key", "text", **options).select(F.col("key").alias(name)).distinct()
    key = F.struct(F.col(id_col), F.xxhash64(text_col).alias("th"))
    return docs.join(hits, key.eqNullSafe(F.col(name)), "left_anti")


def op5_decontaminate(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
