"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class in its context times that of the word
in its class. The class part is a softmax over hashed features: the word before,
the word before that (a skip feature) and both as an n-gram. Partitions train it
by gradient steps on their own documents; after each round their weights are
averaged, row by row, by how often each saw the feature. Classes are the endings
of words, so any word has one. The word part is a softmax with a bias for each
word, whose optimum is the smoothed share of the word in its class.

Counts of words cover all training documents. Frequent words, a bounded number,
travel to the tasks; the others meet their counts in a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, encoded, fold, mixed, raw, slices, spans, table, written

CLASSES = 32
ROWS = 1 << 14
ROUNDS = 2
RATE = 0.4
BATCH = 4096
# Rows of a run up to which it is added up row by row.
SHORT = 8
FREQUENT = 200_000
ADD = 0.1
# Text that a task looks at together: to count words, and to train or score.
COUNT_BYTES = 6 << 20
PART_BYTES = 2 << 20
STARTS = np.uint64(0x51ED270B35CF9A1D)


def tokens(column: pa.Array):
    """Words in lower case (A-Z) of all texts, each text followed by an end.

    Returns the number of each token's word, its row, the distinct words with the
    empty one for the end, and the class of each distinct word.
    """
    data, offsets = raw(column)
    rows = len(offsets) - 1
    data = LOWER[data]
    separator = SPACE[data]
    starts, ends, row = spans(separator, offsets)
    ids, distinct = encoded(data, separator, starts, ends)
    distinct = pa.concat_arrays([distinct.cast(pa.binary()), pa.array([b""], pa.binary())])
    token = np.full(len(ids) + rows, len(distinct) - 1, np.int64)
    owner = np.zeros(len(token), np.int64)
    at = np.arange(len(ids)) + row
    token[at], owner[at] = ids, row
    owner[np.searchsorted(row, np.arange(rows), "right") + np.arange(rows)] = np.arange(rows)
    kind = np.zeros(len(distinct), np.int64)
    kind[ids] = classes(data, starts, ends)
    return token, owner, distinct, kind


def classes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class 1 and up of each word, from its last two bytes; 0 is the end of a text."""
    if not len(starts):
        return starts
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return (mixed((before << np.uint64(8)) | data[ends - 1]) % np.uint64(CLASSES - 1)).astype(np.int64) + 1


def contexts(token: np.ndarray, owner: np.ndarray, distinct: pa.Array) -> np.ndarray:
    """Rows of the weight table for each token: word before, word before that, both."""
    names = np.empty(len(distinct), object)
    names[:] = distinct.to_pylist()
    words = np.append(pd.util.hash_array(names), STARTS)
    start = len(distinct)
    one, two = np.full(len(token), start), np.full(len(token), start)
    same = owner[1:] == owner[:-1]
    one[1:][same] = token[:-1][same]
    same = owner[2:] == owner[:-2]
    two[2:][same] = token[:-2][same]
    # What depends on one word is worked out once for each distinct word.
    both = (words * np.uint64(3))[one] + (words * np.uint64(0x9E3779B97F4A7C55))[two]
    return np.stack([_row(words)[one], _row(words + np.uint64(0xA5A5A5A5))[two], _row(both)], axis=1)


def _row(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) % np.uint64(ROWS)).astype(np.int64)


class Weights:
    """Bias and one row for each hashed feature; the size is fixed by the parameters."""

    def __init__(self):
        self.bias = np.zeros(CLASSES, np.float32)
        self.table = np.zeros((ROWS, CLASSES), np.float32)

    def log_probs(self, features: np.ndarray) -> np.ndarray:
        logits = self.table.take(features[:, 0], axis=0)
        logits += self.table.take(features[:, 1], axis=0)
        logits += self.table.take(features[:, 2], axis=0)
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return logits


def run_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[at]`` over the runs that begin at ``first``, as ``np.add.reduceat`` adds them up: the first to the sum of the rest.

    Runs of up to ``SHORT`` rows, nearly all there are, are added up side by side.
    """
    size = np.diff(np.append(first, len(at)))
    out = values.take(at[first], axis=0)
    few = np.flatnonzero((size > 1) & (size <= SHORT))
    if len(few):
        few = few[np.argsort(-size[few], kind="stable")]
        places, longer = first[few], -size[few]
        rest = values.take(at[places + 1], axis=0)
        for k in range(2, SHORT):
            n = np.searchsorted(longer, -k)
            rest[:n] += values.take(at[places[:n] + k], axis=0)
        out[few] += rest
    many = np.flatnonzero(size > SHORT)
    if len(many):
        ends = np.cumsum(size[many])
        starts = ends - size[many]
        rows = np.repeat(first[many] - starts, size[many]) + np.arange(ends[-1])
        out[many] = np.add.reduceat(values.take(at[rows], axis=0), starts, axis=0)
    return out


class Trainer:
    """Gradient steps with a rate that falls with the squared gradients each weight has seen."""

    def __init__(self, weights: Weights):
        self.weights = weights
        self.seen_bias = np.ones(CLASSES, np.float32)
        self.seen = np.ones((ROWS, CLASSES), np.float32)
        self.uses = np.zeros(ROWS, np.int64)
        self.tokens = 0

    def step(self, features: np.ndarray, kinds: np.ndarray) -> None:
        gradient = self.weights.log_probs(features)
        np.exp(gradient, out=gradient)
        gradient[np.arange(len(kinds)), kinds] -= 1
        total = gradient.sum(axis=0)
        self.seen_bias += total * total
        self.weights.bias -= RATE * total / np.sqrt(self.seen_bias)
        # Row numbers of 16 bits are sorted by radix.
        flat = features.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows = ordered[first].astype(np.int64)
        total = run_sums(gradient, order // features.shape[1], first)
        seen = self.seen.take(rows, axis=0)
        seen += total * total
        self.seen[rows] = seen
        total *= RATE
        total /= np.sqrt(seen, out=seen)
        self.weights.table[rows] -= total
        self.uses[rows] += np.diff(np.append(first, len(flat)))
        self.tokens += len(kinds)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, class and count over all texts."""

    def run(batches):
        for part in slices(batches, "text", COUNT_BYTES):
            token, _, distinct, kind = tokens(part.column("text"))
            n = np.bincount(token, minlength=len(distinct))
            used = n > 0
            yield pa.RecordBatch.from_arrays(
                [distinct.filter(pa.array(used)), pa.array(kind[used].astype(np.int32)), pa.array(n[used])], ["word", "kind", "n"]
            )

    return texts.mapInArrow(run, "word binary, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("c"))


def train(texts: DataFrame, rounds: int = ROUNDS) -> Weights:
    """Weights from one pass over the texts in ``rounds`` parts, averaged over partitions after each."""
    weights = Weights()
    values = [f"w{k}" for k in range(CLASSES)]

    def run_with(start):
        def run(batches):
            weights = Weights()
            weights.bias, weights.table = start.bias.copy(), start.table.copy()
            trainer = Trainer(weights)
            for part in slices(batches, "text", PART_BYTES):
                token, owner, distinct, kind = tokens(part.column("text"))
                features, kinds = contexts(token, owner, distinct), kind[token]
                for at in range(0, len(token), BATCH):
                    trainer.step(features[at : at + BATCH], kinds[at : at + BATCH])
            used = np.flatnonzero(trainer.uses)
            if trainer.tokens:
                n = np.append(trainer.uses[used], trainer.tokens).astype(np.float64)
                rows = np.vstack([weights.table[used], weights.bias]) * n[:, None]
                columns = [pa.array(np.ascontiguousarray(c), pa.float32()) for c in rows.astype(np.float32).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(used, ROWS).astype(np.int32)), pa.array(n), *columns], ["row", "n", *values])

        return run

    for r in range(rounds):
        part = texts.where(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds)) == r).select("text")
        schema = "row int, n double, " + ", ".join(f"{v} float" for v in values)
        summed = part.mapInArrow(run_with(weights), schema).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in values))
        frame = summed.toPandas()  # a row for each feature row at most
        if len(frame):
            at = frame["row"].to_numpy()
            mean = (frame[values].to_numpy() / frame[["n"]].to_numpy()).astype(np.float32)
            weights.table[at[at < ROWS]] = mean[at < ROWS]
            weights.bias = mean[at == ROWS][0]
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose id falls in fold 0 are held out, all others are learned from. A
    null or empty text is its end alone. Repeated rows and ids give a row each.
    ``score`` is the model's log10 probability of the text. Without rows to learn
    from every count is 0.
    """
    source = docs.select(
        F.col(id_col).alias("id"), (fold(F.col(id_col), folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    learned = source.where("not held_out")
    counts = written(word_counts(learned.select("text")), "lm-counts")
    by_class = counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    train_tokens, distinct_words = sum(r["c"] for r in by_class), sum(r["v"] for r in by_class)
    mass = np.full(CLASSES, ADD)
    for r in by_class:
        mass[r["kind"]] = r["c"] + ADD * (r["v"] + 1)
    log_mass = np.log10(mass)
    log_all = np.log10(train_tokens + ADD * (distinct_words + 1))

    # Words are frequent from a count on that at most ``frequent`` of them reach; counts are looked at in steps of a twelfth.
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, room = None, frequent
    for s, n in sizes:
        room -= n
        if room < 0:
            break
        least = s
    is_frequent = step >= least if least is not None else F.lit(False)
    top = counts.where(is_frequent).select("word", "c").toPandas()  # at most ``frequent`` rows
    top_words, top_counts = pa.array(top["word"], pa.binary()), np.append(top["c"].to_numpy(np.int64), 0)
    weights = train(learned, rounds)

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            rows = part.num_rows
            token, owner, distinct, kind = tokens(part.column("text"))
            place = pc.fill_null(pc.index_in(distinct, value_set=top_words), len(top_counts) - 1)
            c = top_counts[np.asarray(place)]
            features, kinds = contexts(token, owner, distinct), kind[token]
            logs = np.empty(len(token))
            for at in range(0, len(token), BATCH):
                found = weights.log_probs(features[at : at + BATCH])
                logs[at : at + BATCH] = found[np.arange(len(found)), kinds[at : at + BATCH]]
            logs = logs / np.log(10) - log_mass[kinds]
            known = c[token] > 0
            common = np.where(known, np.log10(c + ADD)[token], 0)
            key, n = np.unique((owner[~known] << 32) | token[~known], return_counts=True)
            bounds = np.searchsorted(key >> 32, np.arange(rows + 1))
            rare = pa.StructArray.from_arrays([distinct.take(pa.array(key & 0xFFFFFFFF)), pa.array(n)], ["word", "n"])
            total = lambda w=None: np.bincount(owner, w, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(total().astype(np.int64)),
                    pa.array(total(known).astype(np.int64)),
                    pa.array(total(common)),
                    pa.array(total(logs)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare),
                ],
                ["id", "held_out", "n_tokens", "n_common", "common", "logs", "rare"],
            )

    kind = source.schema["id"].dataType.simpleString()
    scored = source.mapInArrow(
        run,
        f"id {kind}, held_out boolean, n_tokens long, n_common long, common double, logs double, rare array<struct<word: binary, n: long>>",
    )
    scored = written(scored.withColumn("key", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("key", F.inline("rare"))
    met = rare.join(counts.where(~is_frequent).select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = met.groupBy("key").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("tail"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_tail")
    )
    words = F.col("common") + F.coalesce("tail", F.lit(0.0))
    return scored.drop("rare").join(tail, "key", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(float(log_all))).alias("base_score"),
        (words + F.col("logs")).alias("score"),
    )


def op8_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op8_lm_score": op8_lm_score}
