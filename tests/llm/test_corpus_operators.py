"""Operators over whole corpora against brute force, on odd rows, and the pipeline."""

import os
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import differences
from ledgerloom.llm import decontaminate, language_id, line_dedup, load, shingle_dedup, simhash_dedup

from .cases import ODD_TEXTS, empty_frame, lower, odd_frame, rows, words


def dedup_by_hand(docs, least=10):
    first = {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for x in (t or "").split("\n"):
            first[key(x)] = min(first.get(key(x), 10**9), i)
    return {(i, t): "\n".join(x for x in (t or "").split("\n") if len(key(x)) < least or first[key(x)] == i) for i, t in docs}


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines_match_brute_force(spark, sf, batches, fanout):
    docs = [(i, t) for i, t, _ in rows(sf)] + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = line_dedup.dedup_lines(frame, batches=batches, fanout=fanout).collect()
    want = dedup_by_hand(docs)
    assert {(r["doc_id"], r["text"]): r["kept_text"] for r in out} == want
    assert all(r["n_lines"] == (r["text"] or "").count("\n") + 1 for r in out)
    assert all(r["kept_text"].count("\n") + 1 == max(1, r["n_lines"] - r["n_dropped"]) for r in out)


def test_runs_hold_each_hash_once(spark):
    frame = spark.createDataFrame([(h, h, b) for b in range(6) for h in range(b * 3, b * 3 + 5)], "h1 long, h2 long, owner long")
    runs = line_dedup.Runs(spark, 3, 2)
    for b in range(6):
        runs.add(frame.where(f"owner = {b}"))
    assert [len(level) for level in runs.levels] == [0, 1, 1]
    got = {r["h1"]: r["owner"] for run in runs.all() for r in run.collect()}
    assert got == {h: min(b for b in range(6) if b * 3 <= h < b * 3 + 5) for h in range(20)}
    runs.close()


def test_lines_of_odd_rows(spark):
    frame = odd_frame(spark)
    out = line_dedup.dedup_lines(frame).toPandas()
    assert len(out) == frame.count()
    assert (out[out.doc_id == 12].n_dropped == 0).all()
    assert set(out[out.doc_id.isna()].kept_text) == {"no id at all, just text", ""}
    assert line_dedup.dedup_lines(empty_frame(spark)).count() == 0


def test_short_lines_of_a_document_with_a_shared_line_stay(spark):
    shared = "All rights reserved by the house"
    poem = f"one leaf\ntwo leaf\n{shared}"
    texts = [f"The first of all has this line.\n{shared}", poem, poem.upper(), f"a\nb\n{shared}", f"{shared}\n \n\t", "a\nb", None]
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(frame).collect()}
    assert out == {1: texts[0], 2: "one leaf\ntwo leaf", 4: "a\nb", 6: "a\nb", 7: None}


def fingerprint_by_hand(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_by_hand(points, bits=3):
    left, right = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= bits)
    return simhash_dedup.smallest(left, right, len(points))


def test_fingerprints(sf):
    for text in [t for _, t, _ in rows(sf)[:60]] + ODD_TEXTS[:15]:
        assert simhash_dedup.fingerprint(text) == fingerprint_by_hand(text)


def near(rng, base, flips):
    out = base.copy()
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
    return out


@pytest.mark.parametrize("chunk", [8192, 200])
def test_links_lose_no_component(spark, chunk):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    dense = np.full(1200, np.uint64(0x123456789ABCDEF1))
    for _ in range(5):
        dense ^= np.uint64(1) << (rng.integers(0, 20, len(dense)).astype(np.uint64) * np.uint64(3))
    points = np.unique(np.concatenate([base, *(near(rng, base[:200], k) for k in (1, 2, 3, 4)), dense]))
    frame = spark.createDataFrame(pd.DataFrame({"fp": points.view(np.int64)}))
    hung = simhash_dedup.stars(simhash_dedup.links(frame, chunk=chunk)).toPandas()
    root = dict(zip(hung["node"], hung["root"]))
    got = [root.get(p, p) for p in points.view(np.int64)]
    want = components_by_hand(points)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_near_duplicates_match_brute_force(spark, sf):
    docs = [(i, t) for i, t, _ in rows(sf)] + [(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    out = simhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    prints = np.array([fingerprint_by_hand(t) for _, t in docs], np.uint64)
    label = components_by_hand(prints)
    for k, (i, _) in enumerate(docs):
        assert out.fingerprint[i] == f"{prints[k]:016x}" and out.component_id[i] == docs[label[k]][0]


def test_near_duplicates_of_odd_rows(spark):
    frame = odd_frame(spark)
    assert simhash_dedup.near_duplicates(frame).count() == frame.count()
    kept = simhash_dedup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.where("text IS NULL OR trim(text) = ''").count() == 1
    assert simhash_dedup.near_duplicates(empty_frame(spark)).count() == 0
    assert simhash_dedup.drop_near_duplicates(empty_frame(spark)).count() == 0


def runs_by_hand(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_edited_copies_and_no_others(spark, sf):
    random.seed(11)
    texts = [t for _, t, _ in rows(sf) if 40 <= len(words(t)) <= 400][:60]
    docs = list(enumerate(texts + ODD_TEXTS))
    for t in texts[:30]:
        for edits in (1, 2, 3, 5):
            w = words(t)
            for p in random.sample(range(len(w)), edits):
                w[p] = "edited"
            docs.append((len(docs), " ".join(w)))
    # A group of many, none of which is more like one than like the others.
    base = words(texts[40])[:120] or ["w"]
    for k in range(60):
        w = list(base)
        w[k % len(w)] = f"other{k}"
        docs.append((len(docs), " ".join(w)))
    random.shuffle(docs)
    sets = [runs_by_hand(t) for _, t in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = simhash_dedup.smallest(np.array([i for i, _ in near]), np.array([j for _, j in near]), len(docs))
    want = {min(docs[i][0] for i in np.flatnonzero(label == part)) for part in set(label)}
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_members_that_no_leader_links_are_found(spark, monkeypatch):
    # All in one bucket of each band: only what is compared across components can link the pairs.
    monkeypatch.setattr(shingle_dedup, "bands", lambda found: np.arange(shingle_dedup.BANDS).astype(np.uint64))
    w = [[f"w{k}x{i}" for i in range(100)] for k in range(60)]
    docs = [(2 * k + half, " ".join(x[half:])) for k, x in enumerate(w) for half in (0, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in shingle_dedup.drop_near_copies(frame).collect()} == {2 * k for k in range(60)}


def test_the_grid_of_popcounts_finds_copies_that_share_no_bucket(spark, monkeypatch):
    # No two sets share a bucket: only the popcounts of SimHashes can link them.
    monkeypatch.setattr(shingle_dedup, "bands", lambda found: found[:1] ^ np.uint64(len(found)))
    w = [[f"w{k}x{i}" for i in range(400)] for k in range(20)]
    docs = [(2 * k + half, " ".join(x[2 * half :])) for k, x in enumerate(w) for half in (0, 1)]
    prints = [simhash_dedup.majority(shingle_dedup.shingles(t)) for _, t in docs]
    near = {k for k in range(20) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= simhash_dedup.BITS}
    # Fingerprints that meet are not enough: these two share nothing.
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in shingle_dedup.drop_near_copies(frame).collect()}
    assert len(near) > 10 and kept == {i for i, _ in docs} - {2 * k + 1 for k in near}


@pytest.mark.parametrize("edits", [1, 4])
def test_a_group_of_near_copies_costs_what_its_size_says(spark, monkeypatch, tmp_path, edits):
    """Sets compared exactly for 200, 400 and 800 copies with edits: one keeps them above the bound, four below it."""
    plain = shingle_dedup.similar
    compared = []
    for size in (200, 400, 800):
        log = str(tmp_path / str(size))

        def counted(a, b, similarity=0.8):
            with open(log, "ab") as out:
                out.write(b".")
            return plain(a, b, similarity)

        monkeypatch.setattr(shingle_dedup, "similar", counted)
        draw = random.Random(size)
        docs = []
        for i in range(size):
            w = [f"w{k}" for k in range(100)]
            for at in draw.sample(range(100), edits):
                w[at] = f"x{i}y{at}"
            docs.append((i, " ".join(w)))
        kept = shingle_dedup.drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).count()
        sets = [runs_by_hand(t) for _, t in docs]
        if edits == 1:
            assert kept == 1
        elif not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(size) for j in range(i)):
            assert kept == size
        compared.append(os.path.getsize(log))
    assert compared[1] <= 2.5 * compared[0] and compared[2] <= 2.5 * compared[1] and compared[2] <= 8 * 800, compared


CLASHES_WITH_STAGES = ["_key", "_text", "key", "th", "_lang_pred", "lang_pred", "_LANG_PRED", "lang_score"]


def test_stages_leave_columns_with_their_inner_names_alone(spark, sf):
    frame = odd_frame(spark)
    for name in CLASHES_WITH_STAGES:
        if name.lower() not in {c.lower() for c in frame.columns}:
            frame = frame.withColumn(name, F.lit("clash"))
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    for out in (
        shingle_dedup.drop_near_copies(frame), simhash_dedup.drop_near_duplicates(frame),
        decontaminate.remove_contaminated(frame, benchmark), language_id.keep_identified(frame),
    ):
        assert out.columns == frame.columns
        assert {r["_key"] for r in out.collect()} <= {"clash"}


@pytest.fixture(scope="module")
def items():
    return duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet' ORDER BY 1").fetchall()


def edited(text, k):
    s = list(text)
    for _ in range(k):
        p, how = random.randrange(len(s)), random.randrange(3)
        if how == 0:
            s[p] = random.choice("xyz")
        elif how == 1:
            del s[p]
        else:
            s.insert(p, random.choice("xyz"))
    return "".join(s)


def distance(item, text):
    """Fewest edits between the item and any piece of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_items_within_the_budget_are_found(items, sf):
    random.seed(4)
    index = decontaminate.build(*zip(*items))
    plain = [(k, i, t) for k, (i, t) in enumerate(items) if t.isascii()]
    texts, want = [], []
    for n in range(60):
        k, item_id, text = random.choice(plain)
        around = random.choice(rows(sf))[1][:400]
        texts.append(around + " " + edited(text, random.randint(0, int(index.edits[k]))) + "\n\n " + around)
        want.append(item_id)
    found = list(decontaminate.find(index, pa.array(texts)))
    assert {(r, i) for r, i in enumerate(want)} <= {(r, int(index.ids[i])) for r, i, *_ in found}


def test_alignment_matches_full_table():
    random.seed(5)
    for _ in range(60):
        item = "".join(random.choice("abcd ") for _ in range(40)).strip() + "e"
        text = "".join(random.choice("abcd ") for _ in range(30)) + edited(item, random.randint(0, 5)) + "zz"
        best = distance(item, text)
        got = decontaminate.align(item.encode(), text.encode(), 6, 10, 50)
        assert (got is None and best > 6) or got[0] == best
        if got:
            assert distance(item, text[got[1] : got[2]]) == best


def test_bands_aligned_together_match_each_alone(monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 1000)
    random.seed(7)
    items, texts, bands = [], [], []
    for _ in range(300):
        item = "".join(random.choice("abcd ") for _ in range(random.randint(10, 60)))
        around = "".join(random.choice("xyz") for _ in range(random.randint(0, 30)))
        items.append(item.encode())
        texts.append((around + edited(item, random.randint(0, 6)) + around)[: random.randint(0, 120)].encode())
        low = random.randint(-10, 30)
        bands.append((len(texts[-1]), random.randint(0, 6), low, low + random.randint(0, 40)))
    base = np.cumsum([0, *map(len, texts[:-1])])
    found = decontaminate.align_bands(items, np.frombuffer(b"".join(texts), np.uint8), base, *np.array(bands).T)
    for item, text, (_, most, low, high), hit in zip(items, texts, bands, found):
        alone = decontaminate.align(item, text, most, low, high)
        assert alone == hit or alone[0] == hit[0] == 0
        if hit:
            assert distance(item, text[hit[1] : hit[2]]) <= hit[0] <= most
    assert sum(hit is not None for hit in found) > 30


def test_clean_documents_are_left_alone(items, sf):
    index = decontaminate.build(*zip(*items))
    norm = lambda s: " ".join(words(lower(s)))
    docs = [(i, t) for i, t, _ in rows("/root/testdata/sf0.01")]
    found = {docs[r][0] for r, *_ in decontaminate.find(index, pa.array([t for _, t in docs]))}
    assert found == {i for i, t in docs if any(norm(x) in norm(t) for _, x in items)}


def test_blocks_give_what_one_index_gives(spark, items):
    docs = spark.createDataFrame([(i, "before " + t.replace(" ", "\n") + " after") for i, t in items] + [(None, items[0][1]), (1, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items + [(None, "no id, so not searched"), (77, None), (78, "short"), items[0]], "item_id long, text string")
    one = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    many = {tuple(r) for r in decontaminate.contaminated(docs, bench, block_items=7).collect()}
    assert one == many and {(r[0], r[1]) for r in one} == {(i, i) for i, _ in items} | {(None, items[0][0])}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    short = ["日本語の試", "cat", "A b", "é", "no. 7", "ああ", "x", "   ", "cat", "日本"]
    index = decontaminate.build(list(range(len(short))), short)
    texts = [
        "Diese 日本語の試験 ist da", "concatenate cats Cat", "(cat) cat's CAT", "a\n\tB and aab b", "café é", "No.  7 no. 75", "あああああ", None, "", "x",
        "scat " * 500 + "cat", "xcatx\ncat", "ca", "t",
    ]
    got = sorted({(r, i) for r, i, *_ in decontaminate.find(index, pa.array(texts, pa.string()))})
    norm = lambda s: " ".join(words(lower(s or "")))

    def holds(item, text):
        edge = "0-9A-Za-z\u0080-\U0010ffff"
        before = f"(?<![{edge}])" if re.match("[0-9a-z]", item) else ""
        after = f"(?![{edge}])" if re.search("[0-9a-z]$", item) else ""
        return bool(item) and bool(re.search(before + re.escape(item) + after, text))

    assert got == [(r, i) for r, t in enumerate(texts) for i, s in enumerate(short) if holds(norm(s), norm(t))]
    places = [(r, s, e, k) for r, i, s, e, k in decontaminate.find(index, pa.array(texts, pa.string())) if i in (3, 5, 2)]
    assert all(k == 0 for *_, k in places)
    assert [texts[r].encode()[s:e].decode() for r, s, e, _ in places] == ["a\n\tB", "é", "é", "ああ", "ああ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat"), (2, "日本語の試"), (3, "  "), (4, ""), (None, "x")], "item_id long, text string")
    assert {(r[0], r[1]) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, 2), (1, 1), (2, 1), (10, 1), (11, 1)}
    assert {r[0] for r in decontaminate.remove_contaminated(docs, bench).collect()} == set(range(len(texts))) - {0, 1, 2, 10, 11}


def test_decontamination_of_odd_rows(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = odd_frame(spark)
    assert decontaminate.contaminated(frame, bench).count() == 0
    assert decontaminate.remove_contaminated(frame, bench).count() == frame.count()
    assert decontaminate.contaminated(empty_frame(spark), bench).count() == 0


def test_queries_match_their_sql(spark, sf):
    queries, oracles = load()
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in oracles.items():
        assert differences(queries[name](spark, sf).toPandas(), con.execute(sql).df()) == ""


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf, name, stage):
    for frame in (odd_frame(spark), empty_frame(spark)):
        out = stage(spark, frame, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.simpleString() == frame.schema.simpleString()
        assert out.count() <= frame.count()


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, items, tmp_path):
    text = {i: t for i, t, _ in rows("/root/testdata/sf0.01")}
    clean = [i for i, t in text.items() if len(t) > 600 and not re.search("[*$%&|!]", t)][:40]
    item = items[3][1]
    docs = [(i, text[i], "en", "s", len(text[i])) for i in clean]
    docs += [(90_001, "12345 ... !!!", "en", "s", 13), (90_002, f"Some words before it. {item} and after.", "en", "s", 1), (90_003, text[clean[0]], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not kept & {90_001, 90_002, 90_003}
    by_hand = set(clean) - {i for i in clean if any(" ".join(words(lower(x))) in " ".join(words(lower(text[i]))) for _, x in items)}
    assert len(by_hand - kept) <= 1
