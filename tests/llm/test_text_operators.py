"""Operators on single texts against brute force, and on odd rows."""

import collections
import hashlib
import html
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_extract, language_id, license_scan, maxent_lm, quality_classifier, quality_rules, sentencepiece_codec

from .cases import ODD_TEXTS, empty_frame, fold, lower, odd_frame, rows, words


@pytest.fixture(scope="module")
def sf1():
    return "/root/testdata/sf0.01"


def windows(w, n):
    seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = set()
    for i in range(len(w) - n + 1):
        if seen[tuple(w[i : i + n])] > 1:
            inside |= set(range(i, i + n))
    return inside


def test_repetition_counts_match_brute_force(sf):
    texts = [t for _, t, _ in rows(sf)] + ODD_TEXTS
    got = quality_rules.measure(pa.array(texts, pa.string()), list(quality_rules.NGRAM_SHARES))
    for i, text in enumerate(texts):
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert got["n_words"][i] == len(w)
        assert got["word_chars"][i] == sum(map(len, w))
        assert got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in text or "")
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert got["n_repeat_words"][i] == len(windows(w, 5))
        for n in (6, 10):
            assert got[f"dup_{n}gram_chars"][i] == sum(len(w[j]) for j in windows(w, n))


def test_quality_rules_on_odd_rows(spark):
    out = quality_rules.quality_rules(odd_frame(spark)).toPandas()
    assert len(out) == len(ODD_TEXTS) + 5
    assert not out[out.n_words < 10].kept.any()
    assert not out[out.n_words == 3000].kept.any()
    assert quality_rules.quality_rules(empty_frame(spark)).count() == 0


def test_quality_scores_separate_held_out_labels(spark, sf1):
    docs, labels = (spark.read.parquet(f"{sf1}/{n}.parquet") for n in ("documents", "labels"))
    out = quality_classifier.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.held_out == [fold(i, 5) == 0 for i in held.doc_id]).all()
    rank = held.score.rank()
    good = held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and out.score.between(0, 1).all()
    assert (held[good].predicted == 1).mean() > 0.95


def test_quality_scores_on_odd_rows(spark):
    frame = odd_frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(3, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = quality_classifier.score_quality(frame, labels).toPandas()
    assert len(out) == frame.count() and out.score.between(0, 1).all()
    none = quality_classifier.score_quality(frame, labels.where("false")).toPandas()
    assert (none.score == 0.5).all()
    assert quality_classifier.score_quality(empty_frame(spark), labels).count() == 0


def test_pooled_means_are_monotone():
    random.seed(1)
    for _ in range(20):
        n = np.array([random.randint(1, 9) for _ in range(30)], float)
        y = np.array([random.uniform(0, k) for k in n])
        got = quality_classifier.monotone(y, n)
        assert (np.diff(got) > -1e-12).all() and math.isclose((got * n).sum(), y.sum())


def test_partition_sums_do_not_depend_on_partitions(spark, sf1):
    stats = quality_classifier.document_statistics(spark.read.parquet(f"{sf1}/documents.parquet"), "doc_id", "text")
    train = stats.withColumn("label", (F.col("symbols") > 0.02).cast("double"))
    width = len(quality_classifier.STATISTICS)
    features = quality_classifier.Features(np.zeros(width), np.ones(width), 32)
    one, many = (quality_classifier.fit_ridge(train.repartition(n), features) for n in (1, 7))
    assert np.allclose(one, many, atol=1e-6)


def test_ids_equal_the_library(sf1):
    chunks = sentencepiece_codec.Chunks(sentencepiece_codec.model_file())
    random.seed(3)
    texts = [t for _, t, _ in rows(sf1)[:200]] + ODD_TEXTS
    texts += ["".join(random.choice(" a▁\nbthe é日😀<s>\t") for _ in range(random.randint(0, 30))) for _ in range(800)]
    ids, bounds, decoded = sentencepiece_codec.encode_slice(chunks, pa.array(texts, pa.string()))
    want = chunks.model.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert decoded == chunks.model.decode(want)


def test_table_of_chunks_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "TABLE_ROWS", 5)
    chunks = sentencepiece_codec.Chunks(sentencepiece_codec.model_file())
    for text in ("one two three four five six seven", "one two", "eight nine ten", None):
        ids, _, _ = sentencepiece_codec.encode_slice(chunks, pa.array([text], pa.string()))
        assert ids.tolist() == chunks.model.encode(text or "")


def test_chunks_are_segmented_some_at_a_time(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "ADDED", 16)
    chunks = sentencepiece_codec.Chunks(sentencepiece_codec.model_file())
    sizes, add = [], chunks.add
    monkeypatch.setattr(chunks, "add", lambda new: (sizes.append(len(new)), add(new)))
    texts = [" ".join(f"word{i}é" for i in range(300)), None, "", " ", "word7é  word301é\n", "日本 ▁"]
    ids, bounds, decoded = sentencepiece_codec.encode_slice(chunks, pa.array(texts, pa.string()))
    want = chunks.model.encode([t or "" for t in texts])
    assert max(sizes) == 16 and sum(sizes) == len(chunks.known) > 300
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert decoded == chunks.model.decode(want)


def test_encoding_odd_rows_and_back(spark):
    frame = odd_frame(spark)
    out = sentencepiece_codec.encode(frame)
    assert set(out.columns) == set(frame.columns)
    again = sentencepiece_codec.decode(out.withColumnRenamed("decoded", "first")).toPandas()
    assert (again["first"] == again["decoded"]).all()
    assert (again["first"] == again["text"].fillna("").str.replace("▁", " ")).all()
    digests = sentencepiece_codec.encode(frame, columns=["doc_id"], digests=True).toPandas()
    assert hashlib.sha256(b"").hexdigest() in set(digests.ids_sha256)
    assert sentencepiece_codec.encode(empty_frame(spark)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="article-page">
<header><a href=/>Site</a></header><nav><ul><li>Home<li>More</ul></nav><div class="cookie-notice">We use cookies</div>
<div id=main><article><header><h1>Head &amp; tail</h1></header><p>One  <b>bold</b>\n line<br>next<p>Two &lt;x&gt; <script>var a="</p>";</script>
<ul><li>first<li>second</ul><form><input><button>Go</button></form><aside>Side</aside></article></div>
<section class="comments"><article><p>Nice post</p></article></section><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    blocks = [t for _, t, _ in html_extract.Page(PAGE).main_blocks()]
    assert blocks == ["Head & tail", "One bold line next", "Two <x>", "first", "second"]


def test_very_deep_pages_take_no_more_than_their_length():
    deep = html_extract.Page("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after</p>" + "</b>" * 50_000)
    assert [t for _, t, _ in deep.main_blocks()] == ["deep", "after"]


def test_pages_of_the_tables(spark, sf1):
    out = html_extract.op7_html_extract(spark, sf1).toPandas()
    want = {}
    for page_id, source in duckdb.sql(f"SELECT page_id, html FROM '{sf1}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", body)]
        want[page_id] = "\n\n".join(x for x in (re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(p)).strip(" ") for p in parts) if x)
    assert dict(zip(out.page_id, out.text)) == want
    assert (out.n_chars == out.text.str.len()).all()


def test_tree_cuts_what_all_pages_repeat(spark):
    data = [
        (i, f"http://h.example/{i}", f"<body><div class=x><p>Same words on every page</p></div><div class=y><p>Text number {i} of {i * 7}</p></div></body>")
        for i in range(30)
    ]
    out = html_extract.extract(spark.createDataFrame(data, "page_id long, url string, html string")).toPandas()
    assert all(t == f"Text number {i} of {i * 7}" for i, t in zip(out.page_id, out.text))


def _pages(spark, bodies, host="h"):
    data = [(i, f"http://{host}.example/{i}", f"<body>{b}</body>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def _texts(pages):
    return [r["text"] for r in html_extract.extract(pages).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [2, 3, 6, 30])
def test_small_hosts_lose_what_they_repeat_as_large_ones_do(spark, n):
    bodies = [f"<div class=x><p>Same words on every page</p></div><div class=y><p>Text number {i} of {i * 7}</p></div>" for i in range(n)]
    assert _texts(_pages(spark, bodies)) == [f"Text number {i} of {i * 7}" for i in range(n)]


def test_a_single_page_keeps_all_its_text(spark):
    assert _texts(_pages(spark, ["<div class=x><p>One</p></div><div class=y><p>Two</p></div>"])) == ["One\n\nTwo"]


def test_class_words_within_an_article_need_the_tree(spark):
    inside = (
        "<article><p>Start {0}</p><div class='media-share-price'><p>Shares rose by {0}</p></div><section class='menu-review'><p>Soup number {0}</p></section>"
        "<div class='share-hints'><p>Tell all your friends</p></div><div class='related-posts'><p>Other text {0}</p></div><div class=comments><p>Nice {0}</p></div></article>"
    )
    want = "Start {0}\n\nShares rose by {0}\n\nSoup number {0}"
    n = 5
    assert _texts(_pages(spark, [inside.format(i) for i in range(n)])) == [want.format(i) for i in range(n)]
    # Without other pages nothing speaks against the doubtful one.
    assert _texts(_pages(spark, [inside.format(7)])) == [want.format(7) + "\n\nTell all your friends"]


def test_importances_by_hand(spark):
    # Four pages: div.a repeats one text on three of them, div.b differs; b has one style, a two (a list on the last page).
    bodies = [f"<div class=a><p>{'same' if i < 3 else 'other'}</p>{'<ul><li>x</li></ul>' if i == 3 else ''}</div><div class=b><p>own {i}</p></div>" for i in range(4)]
    rows = html_extract.tree_rows(_pages(spark, bodies).selectExpr("'h' AS host", "html"))
    got = {r["branch"]: r["importance"] for r in html_extract.importances(rows).collect()}
    log, m = np.log, 4 + html_extract.UNSEEN
    paragraph = 1 - (3 * log(3) / log(m) + 1 * 0) / 4
    assert got["/body/div.a/p"] == pytest.approx(paragraph)
    assert got["/body/div.b/p"] == pytest.approx(1.0)
    # The list was seen on one page: its own importance is whole. Five blocks lie below div.a.
    content = (4 * paragraph + 1) / 5
    varied = -(0.75 * log(0.75) + 0.25 * log(0.25)) / log(4)
    assert got["/body/div.a"] == pytest.approx((1 - 0.9**2) * varied + 0.9**2 * content)
    assert got["/body/div.b"] == pytest.approx((1 - 0.9) * 0 + 0.9 * 1.0)


def test_odd_pages(spark):
    sources = [None, "", "plain text", "<", "<p", "<!-- open", "<script>x", "<p class='a", "</p></div>", "<article></article>", "a" * 100_000, "<div>" * 3000 + "deep"]
    data = [(i, None if i % 2 else f"http://A.example/{i}", s, "clash", "clash") for i, s in enumerate(sources)] + [(None, "no url", "<p>x</p>", "a", "b")] * 2
    frame = spark.createDataFrame(data, "page_id long, url string, html string, host string, low string")
    out = html_extract.extract(frame).toPandas()
    assert len(out) == len(data)
    got = dict(zip(out.page_id, out.text))
    assert got[0] == got[1] == got[9] == "" and got[2] == "plain text" and got[11] == "deep"
    assert html_extract.extract(frame.where("false")).count() == 0


def test_language_held_out_accuracy(spark, sf1):
    out = language_id.op9_language_id(spark, sf1).join(spark.read.parquet(f"{sf1}/documents.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == 1000 and (held.lang_pred == held.lang).mean() > 0.98 and out.score.between(0, 1).all()


def test_filters_hold_what_was_added_and_correct_what_was_not():
    filters = language_id.Filters(["a", "b"], slots=1 << 12)
    codes = np.random.default_rng(1).integers(0, 2**62, 3000).astype(np.uint64)
    filters.add(0, codes[:800])
    filters.add(1, codes[400:1000])
    filters.close()
    masks = filters.masks(codes)
    assert (masks[:800] & 1 == 1).all() and (masks[400:1000] & 2 == 2).all()
    other = filters.masks(codes[1000:])
    assert abs((other & 1).mean() - filters.wrong[0]) < 0.03


def test_languages_of_odd_rows(spark, sf1):
    filters = language_id.learn(spark.read.parquet(f"{sf1}/documents.parquet"))
    out = language_id.identify(odd_frame(spark), filters).toPandas()
    lettered = [t is not None and any(c.isalpha() for c in t) for t in out.text]
    assert ((out.lang_pred != "und") == lettered).all()
    assert language_id.identify(empty_frame(spark), filters).count() == 0
    unknown = language_id.learn(odd_frame(spark).where("false"))
    assert set(language_id.identify(odd_frame(spark), unknown).toPandas().lang_pred) == {"und"}


def test_language_model_counts_and_gain(spark, sf1):
    docs = spark.read.parquet(f"{sf1}/documents.parquet")
    out = maxent_lm.score_texts(docs, frequent=2000).toPandas().set_index("doc_id")
    counts = collections.Counter()
    tokens = {i: [*words(lower(t)), ""] for i, t, _ in rows(sf1)}
    for i, t in tokens.items():
        if fold(i, 10):
            counts.update(t)
    total, distinct = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = out.loc[i]
        assert r.n_tokens == len(t) and r.train_tokens == total and r.n_known == sum(counts[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t))
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_class_probabilities_sum_to_one():
    weights = maxent_lm.Weights()
    weights.table += np.random.default_rng(1).normal(size=weights.table.shape).astype(np.float32)
    features = np.random.default_rng(2).integers(0, maxent_lm.ROWS, (50, 3))
    assert np.allclose(np.exp(weights.log_probs(features)).sum(axis=1), 1, atol=1e-5)


def test_sums_of_runs_equal_those_of_reduceat():
    random.seed(6)
    for most in (1, 3, maxent_lm.SHORT, maxent_lm.SHORT + 1, 200):
        sizes = [random.randint(1, most) for _ in range(300)]
        values = np.random.default_rng(most).normal(size=(500, maxent_lm.CLASSES)).astype(np.float32)
        at = np.random.default_rng(most + 1).integers(0, len(values), sum(sizes))
        first = np.cumsum([0, *sizes[:-1]])
        assert (maxent_lm.run_sums(values, at, first) == np.add.reduceat(values[at], first, axis=0)).all()


def test_language_model_on_odd_rows(spark):
    out = maxent_lm.score_texts(odd_frame(spark)).toPandas()
    assert len(out) == len(ODD_TEXTS) + 5 and (out.score <= 0).all()
    assert (out[out.n_tokens == 1].n_known == 1).all()
    assert maxent_lm.score_texts(empty_frame(spark)).count() == 0


def test_license_notices(spark, sf1):
    out = license_scan.op10_license_scan(spark, sf1).toPandas()
    texts = {i: t for i, t, _ in rows(sf1)}
    assert set(out.doc_id) == {i for i, t in texts.items() if re.search("icensed under|Released under the MIT", t)}
    short = {k: v for k, v in license_scan.TEMPLATES.items() if len(v) < 80}
    for r in out.itertuples():
        assert texts[r.doc_id].encode()[r.start : r.stop].decode() == short[r.license]


def test_license_with_edits_and_within_longer_text():
    index = license_scan.Index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT permission"].replace("associated ", "").replace("Software", "Program")
    apache = "x " * 5 + license_scan.TEMPLATES["Apache-2.0 header"]
    found = [(r, index.names[t]) for r, t, *_ in license_scan.find(index, pa.array([None, "", mit, apache, "under the"], pa.string()))]
    assert found == [(2, "MIT permission"), (3, "Apache-2.0 header")]


def test_licenses_of_a_family_and_edited_short_notices():
    gnu = "This work is licensed under the GNU {}General Public License, version {}"
    cases = {
        "Released under the MIT licence": "MIT", "Released under MIT License": "MIT", "Issued under the MIT License": "MIT",
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC 3.0": "CC-BY-NC-3.0",
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licenced under CC BY-NC 4.0": "CC-BY-NC-4.0",
        gnu.format("", "2"): "GPL-2.0", gnu.format("", "3"): "GPL-3.0", gnu.format("Lesser ", "3"): "LGPL-3.0", gnu.format("Lesser ", "2.1"): "LGPL-2.1",
        gnu.format("Affero ", "3"): "AGPL-3.0", gnu.format("", "9"): None, "Licensed under the Apache License, Version 9.9": None,
        license_scan.TEMPLATES["GPL-3.0 header"].replace("version 3", "version 2"): "GPL-2.0 header",
        "Released under the BSD License": "BSD", "Released under the BSD 3-Clause License": "BSD-3-Clause", "Released under the GNU License": None,
        "Released under the 2-Clause BSD License": "BSD-2-Clause turned", "licensed under the eclipse license version 2.0": "EPL-2.0",
        "Licensed under the Mozilla Public License 2.0": "MPL-2.0", "Released under the ISC License": "ISC", "Released under the XYZ License": None,
        "Licensed under the GPL v3": "GPL-3.0 abbreviated", "Released under the GPLv3": "GPL-3.0 in a word, released",
        "Licensed under the LGPL v2.1": "LGPL-2.1 abbreviated", "Licensed under the GPL-2.0": "GPL-2.0 by version", "Licensed under the GPL": None,
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0 tag", "SPDX-License-Identifier: MIT": "MIT tag", "Licensed under the lease, version 2.0": None,
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause tag", "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0 tag",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0 tag", "He was released under the new license act": None,
    }
    index = license_scan.Index(license_scan.TEMPLATES)
    found = {}
    for r, t, *_ in license_scan.find(index, pa.array([f"some words, {x}. And more" for x in cases], pa.string())):
        found.setdefault(r, []).append(index.names[t])
    assert found == {r: [name] for r, name in enumerate(cases.values()) if name}


def _full_table(template, text):
    """Best score of an alignment with free ends of the text, and the numbers of matched words that reach it, cell by cell."""
    row = [(0.0, {0})] * (len(text) + 1)
    for word in template:
        new = [(row[0][0] - 0.5, row[0][1])]
        for j, other in enumerate(text, 1):
            ways = [(row[j][0] - 0.5, row[j][1]), (new[j - 1][0] - 0.5, new[j - 1][1])]
            same = word == other
            ways.append((row[j - 1][0] + (1 if same else -0.5), {m + same for m in row[j - 1][1]}))
            top = max(s for s, _ in ways)
            new.append((top, set().union(*(m for s, m in ways if s == top))))
        row = new
    top = max(s for s, _ in row)
    return set().union(*(m for s, m in row if s == top))


def test_alignment_of_words_matches_the_full_table():
    rng = np.random.default_rng(4)
    for _ in range(300):
        template, text = rng.integers(1, 6, rng.integers(1, 9)), rng.integers(1, 6, rng.integers(1, 14))
        matched, start, stop = license_scan.align(template, text, 0, len(template) + len(text))
        assert matched in _full_table(template.tolist(), text.tolist())
        assert matched == 0 or matched <= stop - start


def test_every_template_is_found_as_itself_or_as_its_license():
    index = license_scan.Index(license_scan.TEMPLATES)
    texts = [f"before it, {t} . after it" for t in license_scan.TEMPLATES.values()]
    found = {}
    for r, t, *_ in license_scan.find(index, pa.array(texts, pa.string())):
        found.setdefault(r, []).append(index.names[t])
    assert [found.get(r) for r in range(len(texts))] == [[name] for name in license_scan.TEMPLATES]


def test_license_on_odd_rows(spark):
    assert license_scan.scan(odd_frame(spark)).count() == 0
    twice = odd_frame(spark).limit(2).withColumn("text", F.lit("Released under the MIT License."))
    assert [r["license"] for r in license_scan.scan(twice).collect()] == ["MIT", "MIT"]
    assert license_scan.scan(empty_frame(spark)).count() == 0
