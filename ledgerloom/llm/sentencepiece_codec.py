"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model goes on after a white-space marker that follows another
character, so merges never cross the border before a run of markers. A text is
cut there into chunks, each a run of markers with the characters up to the next
one. Every distinct chunk is segmented once, its ids are kept in a table, and the
ids of the texts are joined back from the table by position.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import encoded, raw, slices, table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
# Chunks a task keeps; beyond it the table starts anew, which costs time only.
TABLE_ROWS = 100_000
# Chunks that are segmented together.
ADDED = 4096
SLICE = 1 << 20


def model_file(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_model(processor) -> None:
    """Refuse models whose pieces cross a border of chunks, or that change or trim their input."""
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        if not processor.is_control(i) and MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a white-space marker")
    for probe in ("  a  b ", "ﬁ\n１\t"):
        if processor.decode(processor.encode(probe)) != probe:
            raise ValueError("the model normalises its input")


class Runs:
    """Runs of values, one after another in an array that doubles when it is full."""

    def __init__(self, dtype):
        self.values = np.zeros(1 << 16, dtype)
        self.bounds = np.zeros(1 << 12, np.int64)
        self.rows = 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used, rows = int(self.bounds[self.rows]), self.rows + len(sizes)
        while used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while rows >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.values[used : used + len(values)] = values
        self.bounds[self.rows + 1 : rows + 1] = used + np.cumsum(sizes)
        self.rows = rows

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the runs at ``place`` one after another, and the size of each run."""
        starts = self.bounds[place]
        sizes = self.bounds[place + 1] - starts
        ends = np.cumsum(sizes)
        # The positions of a run's values follow each other.
        at = np.repeat(starts - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.values[at], sizes


class Chunks:
    """The table of distinct chunks: ids and decoded text (UTF-8) of each, one after another in flat arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = Runs(np.int32)
        self.texts = Runs(np.uint8)

    def add(self, chunks: list[bytes]) -> None:
        # The model sets one marker in front of what it gets; a chunk brings its own, so one goes.
        texts = [c.decode("utf-8", "replace") for c in chunks]
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        mark = self.model.piece_to_id(MARK)
        for i, t in enumerate(texts):
            if t == " ":  # what is left is empty, and an empty text has no marker
                found[i] = [mark]
        n = len(self.known)
        self.known.update(zip(chunks, range(n, n + len(chunks))))
        self.ids.extend(np.fromiter((i for f in found for i in f), np.int32), np.fromiter(map(len, found), np.int64, len(found)))
        # Decoding drops the first marker of what it gets: the chunk goes behind another marker.
        decoded = [t.encode() for t in self.model.decode([[mark, *f] for f in found])]
        self.texts.extend(np.frombuffer(b"".join(decoded), np.uint8), np.fromiter(map(len, decoded), np.int64, len(decoded)))

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """The place of each chunk in the table; new ones are segmented and added."""
        if len(self.known) > TABLE_ROWS:
            self.clear()
        fresh = [c for c in chunks if c not in self.known]
        for at in range(0, len(fresh), ADDED):
            self.add(fresh[at : at + ADDED])
        return np.fromiter((self.known[c] for c in chunks), np.int64, len(chunks))


def cut(column: pa.Array):
    """The chunks of all texts: distinct ones, and for each place the number of its chunk and its text.

    Every text gets its leading marker; texts without a character have no chunk.
    """
    data, offsets = raw(column)
    full = np.diff(offsets) > 0
    firsts = (offsets[:-1] + np.cumsum(full) - 1)[full]
    brought = np.ones(len(data) + len(firsts), bool)
    brought[firsts] = False
    out = np.full(len(brought), 32, np.uint8)
    out[brought] = data
    space = out == 32
    begins = ~brought
    begins[1:] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(out))[: len(starts)]
    ids, distinct = encoded(out, np.zeros(len(out), bool), starts, ends)
    return ids, distinct, np.flatnonzero(full)[np.searchsorted(firsts, starts, "right") - 1] if len(starts) else starts


def marked(column: pa.Array) -> pa.Array:
    """Markers that a text brings itself read as spaces, as they do for the library."""
    import pyarrow.compute as pc

    return pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")


def encode_slice(chunks: Chunks, column: pa.Array):
    """Ids of all texts one after another, where each text ends, and its decoded text."""
    rows = len(column)
    number, distinct, row = cut(marked(column))
    place = chunks.rows(distinct.to_pylist())[number] if len(number) else number
    ids, sizes = chunks.ids.take(place)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, rows).astype(np.int64))])
    text, sizes = chunks.texts.take(place)
    ends = np.cumsum(np.bincount(row, sizes, rows).astype(np.int64))
    # The marker that a text did not bring goes.
    full = np.bincount(row, minlength=rows) > 0
    text = np.delete(text, np.concatenate([[0], ends[:-1]])[full])
    ends -= np.cumsum(full)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return ids, bounds, pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(text)).to_pylist()


def encode(
    docs: DataFrame, path: str | None = None, text_col: str = "text", columns: list[str] | None = None, digests: bool = False
) -> DataFrame:
    """The named columns of ``docs``, all unless given, with ``ids`` and ``decoded``; columns of these names are replaced.

    ``ids`` are those of the library's encode without begin and end ids, and
    ``decoded`` is its decode of them. A null or empty text has no ids and decodes
    to an empty text. With ``digests`` the columns are instead ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``.
    ``path`` is the model's file on every executor.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    docs = docs.drop(*added)
    columns = docs.columns if columns is None else columns
    path = path or model_file()

    def run(batches):
        chunks = Chunks(path)
        names = [str(i).encode() for i in range(chunks.model.vocab_size())] if digests else []
        names = pd.Series(names, dtype=object).to_numpy() if digests else None
        for part in slices(batches, text_col, SLICE):
            ids, bounds, decoded = encode_slice(chunks, part.column(text_col))
            if digests:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                found = [
                    pa.array(np.diff(bounds)),
                    pa.array([sha(b",".join(names[ids[a:b]].tolist())) for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                    pa.array([sha(t.encode()) for t in decoded], pa.string()),
                ]
            else:
                found = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *found], [*columns, *added])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    fields = [f"`{c}` {kinds[c]}" for c in columns]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded string"]
    return docs.mapInArrow(run, ", ".join(fields))


def decode(frame: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``, the library's decode of a column of ids; null ids decode to an empty text."""
    path = path or model_file()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return pd.Series([model.decode([] if x is None else [int(i) for i in x]) for x in ids])

    return frame.withColumn("decoded", text(ids_col))


def op6_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return encode(docs, columns=["doc_id"], digests=True)


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
