"""What the text operators share: tables, written intermediates, folds, and text as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back without another look at its files.

    Hashes do not compress: with ``compression="none"`` their files need no codec buffers.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text, fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


# --- text as numpy arrays, inside tasks -----------------------------------


def _flags(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


SPACE = _flags([0x20, *range(0x09, 0x0E)])
NEWLINE = _flags([0x0A])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, text: str, most: int = SLICE_BYTES):
    """Cut record batches into runs of whole rows of about ``most`` bytes of text; a longer row is a run of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs between separator bytes; a run never crosses rows."""
    if not len(separator):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= separator[:-1]
    stops[:-1] &= separator[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(separator))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def encoded(data: np.ndarray, separator: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Exact ids of the runs, equal for equal bytes, and the distinct runs they stand for."""
    ends_packed = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=ends_packed[1:])
    packed = np.ascontiguousarray(data[~separator])
    runs = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends_packed), pa.py_buffer(packed)]
    ).dictionary_encode()
    return np.asarray(runs.indices).astype(np.int64), runs.dictionary


def running(values: np.ndarray) -> np.ndarray:
    """Running totals with a leading zero."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread hashes of whole numbers."""
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
