"""Quality classifier: ridge on random Fourier features, calibrated by isotonic regression.

Statistics of each text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Every partition sums its part
of the normal equations; the sums of all partitions are added up row by row of
the matrix, and one small system is solved. Raw scores of labelled rows that the
fit has not seen are binned and made monotone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import repeated_windows
from .shared import NEWLINE, SPACE, encoded, fold, raw, running, slices, spans, table, written

STATISTICS = [
    "log_words", "word_chars", "long_words", "short_words", "distinct_words", "next_same", "upper", "digits", "stops",
    "commas", "marks", "symbols", "bars", "other_ascii", "non_ascii", "line_words", "repeated_lines", "repeated_fives",
]
FEATURES = 256
GAMMA = 0.35
RIDGE = 3.0
BINS = 512
SEED = 20


def _flag(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


CLASSES = {
    "upper": _flag(range(65, 91)),
    "digits": _flag(range(48, 58)),
    "stops": _flag(b"."),
    "commas": _flag(b","),
    "marks": _flag(b"!?"),
    "symbols": _flag(b"#*$%&<>"),
    "bars": _flag(b"|"),
    "other_ascii": _flag(set(range(33, 127)) - {*range(48, 58), *range(65, 91), *range(97, 123), *b".,!?#*$%&<>|"}),
    "non_ascii": _flag(range(192, 256)),
}


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; shares are taken of words, characters or lines, of none they are 0."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    chars = running((data & 0xC0) != 0x80)
    separator = SPACE[data]
    starts, ends, row = spans(separator, offsets)
    ids, _ = encoded(data, separator, starts, ends)
    sizes = chars[ends] - chars[starts]
    count = lambda index: np.bincount(index, minlength=rows).astype(float)
    words = count(row)
    per_word = 1 / np.maximum(words, 1)
    solid = np.bincount(row, sizes, rows)
    per_char = 1 / np.maximum(solid, 1)
    first = ~pd.Series((row << 32) + ids).duplicated().to_numpy(dtype=bool)
    same = (ids[1:] == ids[:-1]) & (row[1:] == row[:-1])
    fives = np.zeros(len(ids), bool)
    for _, places in repeated_windows(ids, row, [5]):
        fives[places] = True
    line_starts, line_ends, line_row = spans(NEWLINE[data], offsets)
    line_ids, _ = encoded(data, NEWLINE[data], line_starts, line_ends)
    lines = np.maximum(count(line_row), 1)
    again = pd.Series((line_row << 32) + line_ids).duplicated().to_numpy(dtype=bool)
    out = {
        "log_words": np.log1p(words),
        "word_chars": solid * per_word,
        "long_words": count(row[sizes > 12]) * per_word,
        "short_words": count(row[sizes < 4]) * per_word,
        "distinct_words": count(row[first]) * per_word,
        "next_same": count(row[1:][same]) * per_word,
        "line_words": np.log1p(words / lines),
        "repeated_lines": count(line_row[again]) / lines,
        "repeated_fives": count(row[fives]) * per_word,
    }
    for name, codes in CLASSES.items():
        seen = running(codes[data])
        out[name] = (seen[offsets[1:]] - seen[offsets[:-1]]) * per_char
    return np.stack([out[name] for name in STATISTICS], axis=1)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            found = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c) for c in found.T)], ["id", *STATISTICS])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} double" for n in STATISTICS))


class Features:
    """Standardised statistics as random Fourier features, with a constant in front."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, size: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = random.normal(0, gamma, (len(mean), size))
        self.shift = random.uniform(0, 2 * np.pi, size)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.turn + self.shift
        return np.hstack([np.ones((len(stats), 1)), np.cos(z) * np.sqrt(2 / len(self.shift))])


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(part.column(n), dtype=float) for n in STATISTICS], axis=1)


def fit_ridge(train: DataFrame, features: Features, ridge: float = RIDGE) -> np.ndarray:
    """Weights from the partitions' sums of the normal equations; the driver holds one matrix of fixed size."""

    def sums(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = features(_matrix(part))
                both = z.T @ np.column_stack([z, np.asarray(part.column("label"), dtype=float)])
                total = both if total is None else total + both
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"]
            )

    def added(key, frame):
        return pd.DataFrame({"i": [key[0]], "sums": [sum(np.frombuffer(x) for x in frame["sums"]).tobytes()]})

    partial = train.mapInArrow(sums, "i int, sums binary")
    rows = sorted(partial.groupBy("i").applyInPandas(added, "i int, sums binary").collect())
    if not rows:
        return np.zeros(len(features.shift) + 1)
    total = np.stack([np.frombuffer(r["sums"]) for r in rows])
    penalty = ridge * np.eye(len(total))
    penalty[0, 0] = 1e-9
    return np.linalg.solve(total[:, :-1] + penalty, total[:, -1])


def monotone(labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weighted means made non-decreasing by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for label, n in zip(labels, counts):
        pools.append([label, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.concatenate([np.full(int(k), s / n) for s, n, k in pools]) if pools else np.zeros(0)


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, folds: int = 5, size: int = FEATURES, bins: int = BINS,
) -> DataFrame:
    """Score every row for quality: id, held_out, score in 0 to 1, predicted.

    Rows whose id falls in fold 0 are held out. Labelled rows of fold 1 calibrate,
    those of the other folds fit; all of them are used, and null labels are not
    labels. Raw scores meet the isotonic fit in ``bins`` bins of equal width from
    -0.5 to 1.5, with a prior of one row at the mean label in each pooled end.
    Empty and null texts have statistics of zero and are scored like any other. A
    repeated id takes each of its labels as a row. Without labels every score is 0.5.
    """
    stats = written(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    rows = stats.join(known, "id").where(fold(F.col("id"), folds) != 0)
    rows = written(rows.withColumn("part", fold(F.col("id"), folds)), "quality-labelled")
    train = rows.where("part <> 1")
    one = train.agg(
        F.count("*").alias("n"), *(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS)
    ).first()
    if one["n"]:
        mean = np.array([one[f"m_{s}"] for s in STATISTICS])
        scale = np.maximum([one[f"s_{s}"] for s in STATISTICS], 1e-6)
    else:
        mean, scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    features = Features(mean, scale, size)
    weights = fit_ridge(train, features)

    def raw_scores(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                place = np.clip((features(_matrix(part)) @ weights + 0.5) / 2 * bins, 0, bins - 1e-6)
                extra = [part.column("label")] if "label" in part.schema.names else []
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(place), *extra], ["id", "place", "label"][: 2 + len(extra)])

    kind = stats.schema["id"].dataType.simpleString()
    seen = rows.where("part = 1").mapInArrow(raw_scores, f"id {kind}, place double, label double")
    table_ = seen.groupBy(F.floor("place").alias("bin")).agg(F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    if table_:
        ones, n = np.array([r["ones"] for r in table_]), np.array([float(r["n"]) for r in table_])
        prior = ones.sum() / n.sum()
        ones[[0, -1]] += prior
        n[[0, -1]] += 1
        at, value = np.array([r["bin"] + 0.5 for r in table_]), monotone(ones, n)
    else:
        at, value = np.array([0.0]), np.array([0.5])

    def final(batches):
        for part in raw_scores(batches):
            score = np.interp(np.asarray(part.column("place")), at, value)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.clip(score, 0, 1))], ["id", "score"])

    scored = stats.mapInArrow(final, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        (fold(F.col("id"), folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
