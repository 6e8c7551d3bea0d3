"""Hard negatives, vector near copies and the Merkle manifest against brute force, and on odd rows."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup, hard_negatives, merkle_manifest

from .cases import empty_frame, odd_frame

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(values):
    return [float(np.float32(x)) for x in values]


def vector_rows(n=400, width=12, seed=1):
    """Random vectors with scaled and noisy copies, and a vector that many rows share."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=width)
        if rows and i % 4 == 0:
            v = np.array(rows[rng.integers(len(rows))][1]) * rng.choice([1, 2, 0.5]) + rng.normal(size=width) * rng.choice([0, 0.05, 0.15])
        rows.append((i, f32(v), int(rng.integers(3))))
    return rows + [(n + i, rows[5][1], rows[5][2]) for i in range(80)]


ODD_VECTORS = [
    (None, [1.0, 2.0], 1), (7, None, 1), (8, [1.0, None], 1), (9, [1.0, math.nan], 1), (10, [math.inf, 0.0], 1), (11, [], 1), (12, [0.0, 0.0], 1),
    (13, [-0.0, 0.0], 1), (14, [1.0, 2.0], None), (50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (50, [2.0, 4.0], 1), (16, [1.0, 2.0, 0.0], 1),
    (17, [1e30, 2e30], 1), (18, [1e-38, 2e-38], 1), (20, [0.9, 1.5], 2), (21, [0.9, 1.5], 2), (22, [0.5, 1.0], 3), (23, [-1.0, -2.0], 2),
]


def odd_vectors(spark):
    frame = spark.createDataFrame(ODD_VECTORS, SCHEMA)
    for name in ("id", "v", "pid", "print", "low", "n_links", "g", "a", "c", "rank", "cell", "interval", "takes"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.mark.parametrize("shape", [(1, 1, 1), (64, 64, 64), (65, 64, 130), (7, 300, 129), (200, 67, 90)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(5)
    n, k, m = shape
    for most in (300, 2**31, 2**62):
        a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
        assert (hard_negatives.strassen(a, b, leaf=8) == a @ b).all()


def mined_by_hand(rows, moved=True):
    """All scores, one after another, as the contract words it."""
    taken, seen = [], set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) >= 2**56:
            continue
        label = (label + 1) % 10 if moved and i % 7 == 0 else label
        if (i, label, tuple(v)) not in seen:
            seen.add((i, label, tuple(v)))
            taken.append((i, v, label))
    out = []
    for a in (r for r in taken if r[0] % 50 == 0):
        scored = [(sum(x * y for x, y in zip(a[1], r[1])), r) for r in taken if r is not a]
        scored.sort(key=lambda s: (-s[0], s[1][0]))
        for p, pr in [s for s in scored if s[1][2] == a[2]][:5]:
            inside = [s for s in scored if s[1][2] != a[2] and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(a[0], pr[0], k + 1, s[1][0], p, s[0]) for k, s in enumerate(inside)]
    return sorted(out)


def moved_label():
    return F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = mined_by_hand(rows)
    assert len(want) > 50
    assert sorted(map(tuple, hard_negatives.mined(frame, F.col("id") % 50 == 0, moved_label()).collect())) == want
    # Small blocks and tiles: several units for each anchor, and heaps that merge.
    for name, value in (("ANCHORS", 3), ("ROWS", 40), ("TILE", 30), ("LEAF", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, hard_negatives.mined(frame, F.col("id") % 50 == 0, moved_label()).collect())) == want


def test_hard_negatives_on_odd_rows(spark):
    got = hard_negatives.mined(odd_vectors(spark), F.col("id") % 50 == 0, moved_label())
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in ODD_VECTORS]
    # Shorter vectors end in zeros.
    rows = [(i, v if v is None else v + [0.0] * (3 - len(v)), label) for i, v, label in rows]
    want = mined_by_hand(rows)
    assert want and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mined(odd_vectors(spark).where("false"), F.col("id") % 50 == 0, moved_label()).count() == 0


def linked_by_hand(rows, least=0.98):
    n = len(rows)
    sound = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = {i: set() for i in range(n)}
    for i, j in itertools.combinations([i for i in range(n) if sound[i]], 2):
        if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = ([x / max(map(abs, v)) for x in v] for v in (rows[i][1], rows[j][1]))
            if sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        reached, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - reached:
                reached.add(k)
                todo.append(k)
        low = min((rows[k][0] for k in reached if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("interval", [8192, 16])
def test_vector_links_match_brute_force(spark, interval, monkeypatch):
    rows = vector_rows(300)
    if interval < 100:
        monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA), F.col("label"), interval=interval)
    want = linked_by_hand(rows)
    assert sum(w[1] for w in want) > 80 * 79 and len({w[2] for w in want}) > 100
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_vector_links_on_odd_rows(spark):
    got = embedding_dedup.near_vectors(odd_vectors(spark), F.col("label"))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in ODD_VECTORS]
    assert sorted(map(tuple, got.collect()), key=str) == linked_by_hand(rows)
    assert embedding_dedup.near_vectors(odd_vectors(spark).where("false"), F.col("label")).count() == 0


def test_distant_halves_are_skipped_and_near_ones_are_not():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(700, 5))
    raw[::7] = raw[3] + rng.normal(size=(100, 5)) * 0.05
    v = embedding_dedup.unit(raw)
    order = np.lexsort(np.floor(v[:, 1::-1] / 0.2).T)
    one = {"v": v[order], "raw": raw[order], "spot": v[order, :2], "m": np.ones(700, np.int64)}
    count, left, right = embedding_dedup.interval_join(one, None, 0.98, 0.2)
    products = one["v"] @ one["v"].T >= 0.98
    assert (count == products.sum(axis=1) - 1).all()
    assert len(set(zip(left, right))) == len(left) < 700


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree_by_hand(leaves):
    """(root, the siblings before and after each leaf's path, level by level)."""
    nodes, at = list(leaves), list(range(len(leaves)))
    steps = [[] for _ in leaves]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 8 : p - p % 8 + 8]
            steps[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, at = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], steps


def manifest_by_hand(docs):
    """docs: (doc_id, source, lang, n_chars, text). Sorted (doc_id, lang, leaf, subroot, root, proof, folded, verified)."""
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, leaf_by_hand(d)))
        trees[lang] = own, *tree_by_hand([leaf_by_hand(d) for d in own])
    root, above = tree_by_hand([trees[lang][1] for lang in langs])
    out = []
    for lang, rest in zip(langs, above):
        own, subroot, steps = trees[lang]
        for d, path in zip(own, steps):
            path = path + rest
            start = leaf_by_hand(d)
            if zlib.crc32(("" if d[0] is None else str(d[0])).encode()) % 3 == 0 and d[4] is not None:
                start = leaf_by_hand((*d[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4])))
            for pre, post in path:
                start = h(pre + start + post)
            out.append((d[0], lang, leaf_by_hand(d), subroot, root, h("".join(a + b for a, b in path)), start, start == root))
    return sorted(out, key=str)


def with_tampering(frame):
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 0
    return merkle_manifest.manifest(frame, F.translate("text", merkle_manifest.UPPER, merkle_manifest.LOWER), third)


@pytest.mark.parametrize("sizes", [[1], [2, 1], [8, 9, 1], [63, 64, 65, 513], [1] * 9 + [20]])
def test_manifest_matches_brute_force(spark, sizes):
    docs = [(100 * k + 7 * i, f"s{i % 3}", None if k == 1 else f"l{k}é", i, f"Text {i} É\n" if i % 5 else None) for k, n in enumerate(sizes) for i in range(n)]
    got = with_tampering(spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_hand(docs)


def test_manifest_on_odd_rows(spark):
    frame = odd_frame(spark)
    for name in ("lo", "hi", "n", "at", "range", "kids", "steps", "digest", "bucket", "row", "changed", "root"):
        frame = frame.withColumn(name, F.lit("clash"))
    docs = [tuple(r) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = with_tampering(frame)
    assert sorted(map(tuple, got.collect()), key=str) == manifest_by_hand(docs)
    assert with_tampering(empty_frame(spark)).count() == 0
    assert merkle_manifest.manifest(frame).where("NOT verified").count() == 0
