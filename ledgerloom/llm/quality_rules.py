"""Repetition rules: how many characters lie in repeated n-grams and repeated lines.

Words become exact ids within a slice of texts. A window's hash grows from the
one a word shorter, so each n-gram length costs one multiplication and addition;
a window can only repeat where the shorter one does, so longer lengths look at
what is left of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NEWLINE, SPACE, encoded, mixed, raw, running, slices, spans, table

BASE_NGRAM = 5
# The most a text may have of its word characters inside repeated n-grams of a length. None is under the
# base's fifth, so that one line said twice does not reject an otherwise clean text.
NGRAM_SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_SHARE = 0.50
LINE_CHAR_SHARE = 0.35
# Symbols for each word.
SYMBOL_SHARE = 0.10
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STEP = np.uint64(0x9E3779B97F4A7C55)


def repeated_windows(ids: np.ndarray, rows: np.ndarray, lengths: list[int]):
    """Yield (n, first words of the windows of n words that occur twice or more in their text)."""
    words = mixed(ids)
    places = np.arange(len(ids))
    hashes = mixed(rows) * STEP + words if len(ids) else words
    n = 1
    for want in lengths:
        while n < want:
            places, hashes = (x[: np.searchsorted(places, len(ids) - n)] for x in (places, hashes))
            same = rows[places + n] == rows[places]
            places, hashes = places[same], hashes[same]
            hashes = hashes * STEP + words[places + n]
            n += 1
        again = pd.Series(hashes).duplicated(keep=False).to_numpy()
        places, hashes = places[again], hashes[again]
        yield want, places


def covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words that starts at one of ``places``."""
    steps = np.zeros(size + 1, np.int32)
    steps[places] += 1
    steps[places + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def measure(column: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """The counts of each text in a slice."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    chars = running((data & 0xC0) != 0x80)
    separator = SPACE[data]
    starts, ends, row = spans(separator, offsets)
    sizes = chars[ends] - chars[starts]
    total = lambda index, weights=None: np.bincount(index, weights, rows).astype(np.int64)
    symbols = running(SYMBOLS[data])
    out = {
        "n_words": total(row),
        "word_chars": total(row, sizes),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
    }

    breaks = NEWLINE[data]
    line_starts, line_ends, line_row = spans(breaks, offsets)
    begun = running(np.bincount(starts, minlength=len(data))[: len(data)]) if len(data) else np.zeros(1, np.int64)
    line_ids, _ = encoded(data, breaks, line_starts, line_ends)
    real = begun[line_ends] > begun[line_starts]
    line_row, line_ids = line_row[real], line_ids[real]
    line_sizes = (chars[line_ends] - chars[line_starts])[real]
    again = pd.Series((line_row << 32) + line_ids).duplicated().to_numpy(dtype=bool)
    out["n_lines"] = total(line_row)
    out["line_chars"] = total(line_row, line_sizes)
    out["n_dup_lines"] = total(line_row[again])
    out["dup_line_chars"] = total(line_row[again], line_sizes[again])

    ids, _ = encoded(data, separator, starts, ends)
    for n, places in repeated_windows(ids, row, lengths):
        inside = covered(places, n, len(ids))
        if n == BASE_NGRAM:
            out["n_repeat_words"] = total(row[inside])
        out[f"dup_{n}gram_chars"] = total(row[inside], sizes[inside])
    return out


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=tuple(NGRAM_SHARES)) -> DataFrame:
    """The id and the repetition counts of every row.

    A null text has no words and no lines. Rows are independent: repeated rows
    and ids give repeated results. Only the two named columns are read. The first
    length has to be the base's five words.
    """
    lengths = sorted(set(lengths) | {BASE_NGRAM})
    if lengths[0] != BASE_NGRAM:
        raise ValueError(f"n-gram lengths start at {BASE_NGRAM}")
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "line_chars", "n_dup_lines", "dup_line_chars", "n_repeat_words"]
    names += [f"dup_{n}gram_chars" for n in lengths]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            found = measure(part.column("text"), lengths)
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[n], pa.int64()) for n in names)], ["id", *names])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: dict[int, float] | None = None) -> DataFrame:
    """Repetition counts with the base's verdict and the final one.

    ``base_failed``: under ten words, or over a fifth of them in repeated windows
    of five. ``kept`` further asks that characters in repeated n-grams, repeated
    lines, characters in repeated lines and symbols stay within their shares.
    """
    shares = shares or NGRAM_SHARES
    found = repetition_counts(docs, id_col, text_col, tuple(shares))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fits = (F.col("n_dup_lines") <= LINE_SHARE * F.col("n_lines")) & (F.col("dup_line_chars") <= LINE_CHAR_SHARE * F.col("line_chars"))
    fits &= F.col("n_symbols") <= SYMBOL_SHARE * F.col("n_words")
    for n, most in shares.items():
        fits &= F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars")
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def op2_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same counts and verdicts in SQL, with windows as texts in place of hashes."""
    lengths = list(NGRAM_SHARES)
    grams = ", ".join(" || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n)) + f" AS g{n}" for n in lengths)
    twice = ", ".join(f"CASE WHEN g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 THEN 1 ELSE 0 END AS t{n}" for n in lengths)
    inside = ", ".join(f"max(t{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in lengths)
    chars = ", ".join(f"CAST(sum(c{n} * length(w)) AS BIGINT) AS dup_{n}gram_chars" for n in lengths)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ["n_words", "word_chars", "n_repeat_words", *(f"dup_{n}gram_chars" for n in lengths)])
    fits = " AND ".join(f"dup_{n}gram_chars <= {share} * word_chars" for n, share in NGRAM_SHARES.items())
    return rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM docs)),
per_words AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(sum(c{BASE_NGRAM}) AS BIGINT) AS n_repeat_words, {chars}
  FROM (SELECT *, {inside} FROM (SELECT *, {twice} FROM (SELECT *, {grams} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)))) GROUP BY r),
lines AS (SELECT *, row_number() OVER (PARTITION BY r, line) > 1 AS again
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per_lines AS (SELECT r, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS line_chars, count(*) FILTER (WHERE again) AS n_dup_lines,
  CAST(coalesce(sum(length(line)) FILTER (WHERE again), 0) AS BIGINT) AS dup_line_chars FROM lines GROUP BY r),
counted AS (SELECT doc_id, {filled}, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(line_chars, 0) AS line_chars, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM docs LEFT JOIN per_words USING (r) LEFT JOIN per_lines USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_dup_lines <= {LINE_SHARE} * n_lines AND dup_line_chars <= {LINE_CHAR_SHARE} * line_chars
  AND n_symbols <= {SYMBOL_SHARE} * n_words AND {fits} AS kept FROM judged"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": _sql()}
