"""Language ID with bit-sliced Bloom filters of character n-grams.

Bit l of every slot belongs to language l, so one lookup of an n-gram gives, as a
bitmask, all languages whose filter has it. A text's hits are counted for each
language and corrected for that filter's false positives; the largest share wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, fold, free_name, mixed, raw, slices, table

SIZES = (3, 4, 5)
SLOTS = 1 << 20
HASHES = 3
# Most n-grams of a language in its filter, most documents of a language to learn from.
NGRAMS = 40_000
TRAIN_DOCS = 4_000
# How many times its mean share over the languages an n-gram needs in a language to mark it.
MARKED = 1.5
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PART_BYTES = 1 << 20


def ngrams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(code, row) of all n-grams of bytes, for each size.

    A-Z become lower case, anything but letters a space; runs of spaces count
    once, and each text has a space before and after. Codes are the bytes
    themselves, so different n-grams never share one.
    """
    data, offsets = raw(column)
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    # One space after each text also stands before the next one; another goes in front of all.
    out = np.full(len(data) + rows + 1, 32, np.uint8)
    row = np.repeat(np.arange(rows), sizes)
    place = np.arange(len(data)) + row + 1
    out[place] = np.where(LETTER[data], LOWER[data], 32)
    owner = np.zeros(len(out), np.int32)
    owner[place] = row
    owner[offsets[1:] + np.arange(1, rows + 1)] = np.arange(rows)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    out, owner = out[keep].astype(np.uint64), owner[keep]
    found, code = [], out
    for n in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint64(8)) | out[n - 1 :]
        if n in SIZES:
            # The text of an n-gram is that of its second byte: a first space may close the text before.
            rows_of = owner[1 : len(code) + 1]
            inside = owner[n - 1 :] == rows_of
            if n > 2:
                spread = np.zeros(len(code), bool)
                for j in range(1, n - 1):
                    spread |= out[j : j + len(code)] == 32
                # Within a word or up to its borders; n-grams over several words tell little.
                inside &= ~spread
            found.append((code[inside], rows_of[inside]))
    return found


def has_letter(texts: list) -> np.ndarray:
    return np.array([t is not None and any(c.isalpha() for c in t) for t in texts], bool)


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; only texts without a-z are looked at one by one."""
    data, offsets = raw(column)
    plain = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = has_letter([column[int(i)].as_py()])[0]
    return out


def places(codes: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The slots of each code, from two halves of one hash."""
    h = mixed(codes)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)]


class Filters:
    """Filters of all languages, one bit plane each; its size depends on the parameters alone."""

    def __init__(self, languages: list[str], slots: int = SLOTS, hashes: int = HASHES):
        if len(languages) > 64:
            raise ValueError("a slot holds 64 languages")
        self.languages, self.hashes = languages, hashes
        width = next(w for w in (8, 16, 32, 64) if len(languages) <= w)
        self.bits = np.zeros(slots, f"uint{width}")
        self.wrong = np.zeros(len(languages))

    def add(self, language: int, codes: np.ndarray) -> None:
        for place in places(codes, len(self.bits), self.hashes):
            self.bits[place] |= self.bits.dtype.type(1 << language)

    def close(self) -> None:
        for i in range(len(self.languages)):
            self.wrong[i] = ((self.bits >> self.bits.dtype.type(i)) & 1).mean() ** self.hashes

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that have it."""
        first, *rest = places(codes, len(self.bits), self.hashes)
        out = self.bits[first]
        for place in rest:
            out &= self.bits[place]
        return out

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each text in each language, and its n-grams."""
        rows = len(column)
        hits, total = np.zeros((rows, len(self.languages))), np.zeros(rows)
        for codes, row in ngrams(column):
            masks = self.masks(codes)
            total += np.bincount(row, minlength=rows)
            some = masks != 0
            masks, row = masks[some], row[some]
            for i in range(len(self.languages)):
                hits[:, i] += np.bincount(row[(masks >> masks.dtype.type(i)) & 1 != 0], minlength=rows)
        wrong = total[:, None] * self.wrong
        return np.clip((hits - wrong) / (1 - self.wrong), 0, None), total


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_docs: int = TRAIN_DOCS, most_ngrams: int = NGRAMS,
) -> Filters:
    """Filters from texts with a language.

    Of each language about ``most_docs`` documents are used, chosen by a hash of
    their id; an n-gram enters a language's filter when its share there is
    ``MARKED`` times its mean share, the ``most_ngrams`` most frequent of them.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([])
    chosen = F.lit(False)
    for lang, n in sizes.items():
        rate = int(min(1.0, most_docs / n) * 1_000_000)
        chosen |= (F.col("lang") == lang) & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < rate)

    def counts(batches):
        for part in slices(batches, "text"):
            langs = np.asarray(part.column("lang").to_pandas())
            for lang in dict.fromkeys(langs):
                texts = part.column("text").filter(pa.array(langs == lang))
                for codes, _ in ngrams(texts):
                    code, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"]
                    )

    found = known.where(chosen).select("lang", "text").mapInArrow(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("code")
    per_lang = found.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = (
        found.join(F.broadcast(per_lang), "lang")  # one row for each of at most 64 languages
        .withColumn("share", F.col("n") / F.col("total"))
        .withColumn("mean", F.sum("share").over(totals) / len(sizes))
        .where((F.col("n") > 1) & (F.col("share") >= (MARKED if len(sizes) > 1 else 0) * F.col("mean")))
    )
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    picked = shares.withColumn("best", best).where(F.col("best") <= most_ngrams).select("lang", "code")
    frame = picked.toPandas()  # at most most_ngrams rows a language
    filters = Filters(sorted(sizes))
    for i, lang in enumerate(filters.languages):
        filters.add(i, frame.loc[frame["lang"] == lang, "code"].to_numpy().astype(np.uint64))
    filters.close()
    return filters


def identify(
    docs: DataFrame, filters: Filters, text_col: str = "text", columns: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The named columns of ``docs``, all unless given, with ``lang_pred`` and ``score`` (or other ``names``); columns of these names are replaced.

    ``score`` is the winner's share of all corrected hits. A null text, or one
    without a letter of any script, is ``und`` with score 0, and so is any text
    when no language is known. A text without a hit gets the first language and
    score 0; ties go to the first in order of name.
    """
    docs = docs.drop(*names)
    columns = docs.columns if columns is None else columns
    languages = np.array([*filters.languages, "und"], object)

    def run(batches):
        for part in slices(batches, text_col, PART_BYTES):
            texts = part.column(text_col).cast(pa.string())
            best, score = np.full(len(texts), len(filters.languages)), np.zeros(len(texts))
            if filters.languages:
                hits, _ = filters.hits(texts)
                real = lettered(texts)
                best[real] = hits[real].argmax(axis=1)
                total = hits.sum(axis=1)
                some = real & (total > 0)
                score[some] = hits[some].max(axis=1) / total[some]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array(languages[best], pa.string()), pa.array(score)],
                [*columns, *names],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema)
    return docs.mapInArrow(run, ", ".join(filter(None, [fields, f"`{names[0]}` string, `{names[1]}` double"])))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known, with all their columns.

    Rejected are texts that are null or without a letter, and texts that share no
    n-gram with any language. The filters are learned from the same rows.
    """
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = identify(docs, learn(docs, id_col, text_col, lang_col), text_col, names=(pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) > 0)).select(docs.columns)


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    filters = learn(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters, columns=["doc_id", "held_out"])


QUERIES = {"op9_language_id": op9_language_id}
