"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ids. Every batch brings its distinct line
hashes, each with the smallest id holding it. They are merge-anti-joined with the
runs of earlier batches, and what is new becomes a sorted run of its own. Runs of
one level are merged into a run of the next as soon as there are ``fanout`` of
them. Runs are bucketed and sorted by hash, so the anti-joins do not move old
hashes again; a hash is moved once for each level it rises.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .shared import table, written

BLANKS = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case, other letters as they are."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


class Runs:
    """Sorted runs of (h1, h2, owner) in levels, as bucketed tables in the shared folder."""

    def __init__(self, spark, buckets: int, fanout: int):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.tables: list[str] = []

    def _sorted_run(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid4().hex}"
        (
            df.repartition(self.buckets, "h1")
            .write.format("parquet")
            .bucketBy(self.buckets, "h1")
            .sortBy("h1", "h2")
            .option("compression", "none")
            .option("path", shared_dir(self.spark, "line-run"))
            .saveAsTable(name)
        )
        self.tables.append(name)
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add what no run holds yet; ``batch`` has one row for each hash."""
        fresh = batch.repartition(self.buckets, "h1")
        for run in self.all():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._sorted_run(fresh))
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = level[0]
            for run in level[1:]:
                merged = merged.unionByName(run)
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(self._sorted_run(merged))
            self.levels[depth] = []

    def owners(self) -> DataFrame:
        first, *rest = self.all()
        for run in rest:
            first = first.unionByName(run)
        return first

    def close(self) -> None:
        """Forget the table names; the files stay in the shared folder for the plans that read them."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, text fingerprint, position and 128-bit key hash of every line whose key has ``min_chars`` code points."""
    lines = docs.select(
        F.col(id_col).alias("doc"),
        F.xxhash64(text_col).alias("th"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"),
    )
    # The second hash starts from another seed, so that together they are 128 bits.
    return (
        lines.withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )


def line_owners(lines: DataFrame, batches: int, buckets: int, fanout: int) -> DataFrame:
    """Every line hash with the smallest document that holds it, from the runs of all batches."""
    runs = Runs(lines.sparkSession, buckets, fanout)
    try:
        for k in range(batches):
            runs.add(lines.where(F.col("batch") == k).groupBy("h1", "h2").agg(F.min("doc").alias("owner")))
        return runs.owners()
    finally:
        runs.close()


def whole_copies(keyed: DataFrame) -> DataFrame:
    """doc and text fingerprint of every row whose line keys, short ones too, a smaller ``_id`` has in the same order, with position -1."""
    whole = F.filter(F.transform(F.split("_text", "\n", -1), line_key), lambda key: F.char_length(key) > 0)
    found = keyed.select(
        F.col("_id").alias("doc"), F.xxhash64("_text").alias("th"), F.xxhash64(whole).alias("w1"), F.xxhash64(F.lit("second"), whole).alias("w2")
    )
    first = found.groupBy("w1", "w2").agg(F.min("doc").alias("first"))
    return found.join(first, ["w1", "w2"]).where("first < doc").select("doc", "th", F.lit(-1).alias("pos"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2,
    names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"), copy_name: str | None = None,
) -> DataFrame:
    """Drop lines that a document with a smaller id holds too.

    Returns every row and column of ``docs`` with ``kept_text``, ``n_lines`` and
    ``n_dropped`` (or other ``names``) in addition; columns of these names are
    replaced. Names that begin with an underscore are the operator's own. With
    ``copy_name`` a column tells whether a document with a smaller id has all
    lines of the row.

    A null or empty text is one empty line and stays. A key repeated in its own
    first document stays there as often as it occurs; rows that repeat an id are
    one document. Rows without an id come after all others and keep the lines
    that no document with an id holds. The work on the driver is fixed by
    ``batches``, whatever the size.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.lit(2**63 - 1)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("_id"), F.col(text_col).alias("_text"))
    lines = hashed_lines(keyed, "_id", "_text", min_chars)

    shares = [i / batches for i in range(1, batches)]
    found = keyed.agg(F.percentile_approx("_id", F.array(*map(F.lit, shares)), F.lit(1000))).first()[0] if shares else []
    edges = sorted(set(found or []))
    number = sum((F.when(F.col("doc") > e, 1).otherwise(0) for e in edges), F.lit(0))
    lines = written(lines.withColumn("batch", number), "lines", "none")

    owners = line_owners(lines, len(edges) + 1, buckets, fanout)
    drops = lines.join(owners.hint("merge"), ["h1", "h2"]).where(F.col("owner") < F.col("doc"))
    if copy_name:
        drops = drops.select("doc", "th", "pos").unionByName(whole_copies(keyed))
    drops = drops.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_drops"))
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    own = F.coalesce(F.col(id_col).cast("long"), last)
    found = docs.join(
        drops,
        (own == F.col("_doc")) & (F.xxhash64(text_col) == F.col("_th")),
        "left",
    )
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_drops")), lambda i: F.get(F.col("_parts"), i)
    )
    gone = F.array_remove("_drops", -1) if copy_name else F.col("_drops")
    copy = [F.coalesce(F.array_contains("_drops", -1), F.lit(False)).alias(copy_name)] if copy_name else []
    return found.withColumn("_parts", parts).select(
        *docs.columns,
        F.when(F.col("_drops").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias(names[0]),
        F.size("_parts").cast("long").alias(names[1]),
        F.when(F.col("_drops").isNull(), 0).otherwise(F.size(gone)).cast("long").alias(names[2]),
        *copy,
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_chars: int = 10, **options
) -> DataFrame:
    """``docs`` with the kept lines as text and their code points as ``chars_col``, if there is one.

    A row that lost lines goes if it keeps nothing but white space, or if it keeps
    no line whose key has ``min_chars`` code points and a document with a smaller
    id has all its lines in the same order, the short ones too. Other rows stay
    with their short lines, and a text that lost nothing stays as it is.
    """
    found = dedup_lines(docs, id_col, text_col, min_chars, names=("_kept", "_lines", "_dropped"), copy_name="_copy", **options)
    size = lambda line: F.char_length(F.btrim(line, F.lit(BLANKS)))
    own = F.exists(F.split("_kept", "\n", -1), lambda line: size(line) >= min_chars)
    found = found.where((F.col("_dropped") == 0) | own | (~F.col("_copy") & (size(F.col("_kept")) > 0)))
    text = F.when(F.col("_dropped") == 0, F.col(text_col)).otherwise(F.col("_kept"))
    columns = [
        text.alias(c) if c == text_col else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(c)
        for c in docs.columns
    ]
    return found.select(*columns)


def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {
    "op1_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, row_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
    SELECT *, CASE WHEN length(key) >= 10 THEN min(doc_id) OVER (PARTITION BY key) ELSE doc_id END AS owner FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner = doc_id), '')) AS kept_sha256
FROM owned GROUP BY doc_id, row_id
"""
}
