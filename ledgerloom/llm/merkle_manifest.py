"""Merkle manifest of a table, with a proof of every row, by nested-interval labels.

Rows of a group are ranked, and every node of the group's tree is labelled with
the interval of leaf ranks it covers, so that a node's ancestors are the nodes
whose intervals contain its own, and its siblings are what is left of the parent's
children without its own interval. Nodes of one level have intervals of the same
width, which gives the bucket of the containing interval one level up: every
level takes one join with at most eight rows a key, whatever the group's size.
The groups' roots are the leaves of one more tree of the same make.

Everything is SQL functions. Ranks come from a range sort and counts per range, so
a group that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<pre:string,post:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as its byte count, a colon and its text; ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*(field(c) for c in fields.values())))


def ranked(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``n``, the rows of the group, and ``lo`` and ``hi``, both the row's rank from 0, in the given order, nulls first.

    Ranges are dealt by a sample, so the deal is written with each row's place in it.
    """
    key = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = leaves.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("range", F.shiftright("at", 33)), "merkle-ranks")
    # One row for each range that a group reaches into.
    parts = dealt.groupBy(group, "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    parts = written(parts, "merkle-ranges")
    other = parts.select(F.col(group).alias("g"), F.col("range").alias("r"), F.col("rows").alias("other"))
    offsets = (
        parts.join(other, F.col(group).eqNullSafe(F.col("g")))
        .groupBy(group, "range", "first")
        .agg(F.sum("other").alias("n"), F.sum(F.when(F.col("r") < F.col("range"), F.col("other")).otherwise(0)).alias("before"))
        .select(F.col(group).alias("g"), F.col("range").alias("r"), "n", (F.col("before") - F.col("first")).alias("shift"))
    )
    found = dealt.join(offsets, F.col(group).eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    place = F.col("at") + F.col("shift")
    return found.withColumns({"lo": place, "hi": place}).drop("at", "range", "g", "r", "shift")


def families(nodes: DataFrame, group: str, payload: list[str]) -> list[DataFrame]:
    """The nodes above the leaves by level, each with its children in order of their intervals.

    ``nodes`` has group, n, lo, hi, digest and what the children of the first level keep.
    A group has as many levels as it takes to come down to one node.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    out, width = [], 1
    while width < most:
        kid = F.struct("lo", "hi", "digest", *payload)
        made = (
            nodes.where(F.col("n") > width)
            .groupBy(group, F.expr(f"lo div {width * FANOUT}").alias("bucket"))
            .agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(kid)).alias("kids"))
            .withColumn("digest", digest(F.array_join(F.col("kids.digest"), "")))
        )
        out.append(written(made.drop("bucket"), "merkle-level"))
        nodes, payload, width = out[-1].select(group, "n", "lo", "hi", "digest"), [], width * FANOUT
    return out


def tops(nodes: DataFrame, levels: list[DataFrame], group: str) -> DataFrame:
    """group and digest of the node that covers a whole group: its root."""
    whole = [df.where((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).select(group, "digest") for df in (nodes, *levels)]
    out = whole[0]
    for df in whole[1:]:
        out = out.unionByName(df)
    return out


def beside(kids: Column, lo: Column, hi: Column) -> Column:
    """The digests of the children before and after the interval: the parent's interval less the node's own."""
    joined = lambda hit: F.array_join(F.transform(F.filter(kids, hit), lambda k: k["digest"]), "")
    return F.struct(joined(lambda k: k["hi"] < lo).alias("pre"), joined(lambda k: k["lo"] > hi).alias("post"))


def proven(nodes: DataFrame, levels: list[DataFrame], group: str, above: DataFrame, payload: list[str]) -> DataFrame:
    """Each leaf with its ``steps``: what stands before and after its path in every family up to the root.

    ``above`` has for every group the steps beyond its own root, and columns to attach.
    """
    more = [c for c in above.columns if c not in (group, "steps")]
    start = above.withColumnRenamed(group, "g")
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        at, width = levels[k], FANOUT ** (k + 2)
        whole = at.where((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
        found = whole.join(start, F.col(group).eqNullSafe(F.col("g"))).drop("g")
        if paths is not None:
            parent = paths.select(
                F.col(group).alias("g"), F.expr(f"lo div {width}").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
                F.col("kids").alias("family"), "steps", *more,
            )
            inside = F.col(group).eqNullSafe(F.col("g")) & (F.expr(f"lo div {width}") == F.col("bucket"))
            inside &= (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            lower = at.join(parent, inside).withColumn("steps", F.array_prepend("steps", beside(F.col("family"), F.col("lo"), F.col("hi"))))
            found = found.unionByName(lower.select(found.columns))
        paths = found
    kept = [group, "digest", *payload, "steps", *more]
    alone = nodes.where("n = 1").join(start, F.col(group).eqNullSafe(F.col("g"))).select(kept)
    if paths is None:
        return alone
    kids = paths.select(group, F.explode("kids").alias("kid"), "kids", "steps", *more)
    own = F.array_prepend("steps", beside(F.col("kids"), F.col("kid.lo"), F.col("kid.hi")))
    return kids.select(group, "kid.digest", *(f"kid.{c}" for c in payload), own.alias("steps"), *more).unionByName(alone)


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and what stands beside its path."""
    return F.aggregate(steps, start, lambda at, step: digest(F.concat(step["pre"], at, step["post"])))


def manifest(docs: DataFrame, text_change: Column | None = None, changed_where: Column | None = None) -> DataFrame:
    """leaf, subroot, root, proof_sha256, folded_root and verified of each row, with doc_id and lang.

    ``text_change`` says how tampering alters the text of the rows in
    ``changed_where``; without it nothing is tampered with. The columns doc_id,
    source, lang, n_chars and text take part; others, whatever their names, do
    not. Nulls are ``-`` in a leaf, so they differ from empty texts; null ids come
    first in their group, and rows without a language are a group that comes
    before the others. Rows that repeat an id are ordered by their leaves, and each
    has a row of its own. A table without rows gives none, and no root.
    """
    fields = {c: F.col(c) for c in FIELDS}
    changed = F.lit(None).cast("string")
    if text_change is not None:
        other = leaf(fields | {"text": text_change})
        hit = text_change.isNotNull() & (text_change != F.col("text"))
        changed = F.when(hit & (F.lit(True) if changed_where is None else changed_where), other)
    leaves = docs.select(F.col("lang").cast("string").alias("lang"), "doc_id", leaf(fields).alias("digest"), changed.alias("changed"))
    # The number settles the order of rows that repeat another in full.
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    payload = ["doc_id", "changed"]
    nodes = written(ranked(leaves, "lang", ["doc_id", "digest", "row"]).drop("row"), "merkle-nodes")
    levels = families(nodes, "lang", payload)

    subroots = tops(nodes, levels, "lang").select(F.lit(0).alias("all"), "lang", "digest")
    upper = written(ranked(subroots, "all", ["lang"]), "merkle-subroots")
    uppers = families(upper, "all", ["lang"])
    root = tops(upper, uppers, "all").select("all", F.col("digest").alias("root"), F.array().cast(STEP).alias("steps"))
    above = proven(upper, uppers, "all", root, ["lang"]).select("lang", F.col("digest").alias("subroot"), "steps", "root")

    out = proven(nodes, levels, "lang", written(above, "merkle-above"), payload)
    beside_path = F.transform("steps", lambda s: F.concat(s["pre"], s["post"]))
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("steps")))
    return out.select(
        "doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root",
        digest(F.array_join(beside_path, "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark, sf_dir):
    """Manifest of ``documents``; the texts of a third of the ids are lower-cased as tampering. A null id counts as empty text."""
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), F.translate("text", UPPER, LOWER), third)


# Levels of the SQL: 8^9 rows a language, 8^4 languages.
_DEPTH, _UPPER_DEPTH = 9, 4


def _sql() -> str:
    def field_sql(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf_sql(text):
        return f"sha256({' || '.join(field_sql(c) for c in (*FIELDS[:-1], text))})"

    # DuckDB has no crc32; bit by bit over the digits of the id.
    shifted = "list_reduce([xor(r, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda r, c: {shifted}), 4294967295)"
    ctes = [
        f"docs AS (SELECT *, CASE WHEN coalesce({crc} % 3, 0) = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS seen FROM documents)",
        f"l0 AS (SELECT doc_id, coalesce(lang, chr(1)) AS g, {leaf_sql('text')} AS leaf, {leaf_sql('seen')} AS f FROM docs)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, leaf AS d, '' AS proof FROM l0)",
        *(x for k in range(_DEPTH) for x in _level("n", k, "g")),
        f"m0 AS (SELECT g, 0 AS everything, d, '' AS f, '' AS proof, row_number() OVER (ORDER BY g) - 1 AS pos FROM (SELECT g, min(d) AS d FROM n{_DEPTH} GROUP BY g))",
        *(x for k in range(_UPPER_DEPTH) for x in _level("m", k, "everything")),
    ]
    # A leaf that came up to its subroot goes on beside the subroot's siblings.
    up = "n.f"
    for k in range(_UPPER_DEPTH):
        up = f"CASE WHEN p{k}.many THEN sha256(p{k}.pre || {up} || p{k}.post) ELSE {up} END"
    joins = " ".join(f"JOIN m{k}_beside p{k} ON p{k}.g = n.g" for k in range(_UPPER_DEPTH))
    return f"""WITH {', '.join(ctes)}
      SELECT n.doc_id, CASE WHEN n.g <> chr(1) THEN n.g END AS lang, n.leaf, n.d AS subroot, m.d AS root,
        sha256(n.proof || m.proof) AS proof_sha256, {up} AS folded_root, {up} = m.d AS verified
      FROM n{_DEPTH} n JOIN m{_UPPER_DEPTH} m ON m.g = n.g {joins}"""


def _level(name: str, k: int, group: str) -> list[str]:
    """One level of the SQL: runs of eight nodes where a group has several, and what stands beside each row's node."""
    here, runs, beside_, above = f"{name}{k}", f"{name}{k}_runs", f"{name}{k}_beside", f"{name}{k + 1}"
    return [
        f"""{runs} AS (SELECT grp, pos // 8 AS run, list(d ORDER BY pos) AS ds, bool_or(several) AS many
             FROM (SELECT grp, pos, d, count(*) OVER (PARTITION BY grp) > 1 AS several
                   FROM (SELECT {group} AS grp, pos, min(d) AS d FROM {here} GROUP BY ALL)) GROUP BY ALL)""",
        f"""{beside_} AS (SELECT x.*, many, ds, array_to_string(ds[1 : pos % 8], '') AS pre, array_to_string(ds[pos % 8 + 2 :], '') AS post
             FROM {here} x JOIN {runs} r ON r.grp = x.{group} AND r.run = x.pos // 8)""",
        f"""{above} AS (SELECT * EXCLUDE (many, ds, pre, post) REPLACE (pos // 8 AS pos,
             CASE WHEN many THEN sha256(array_to_string(ds, '')) ELSE d END AS d,
             CASE WHEN many THEN sha256(pre || f || post) ELSE f END AS f,
             CASE WHEN many THEN proof || pre || post ELSE proof END AS proof) FROM {beside_})""",
    ]


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _sql()}
