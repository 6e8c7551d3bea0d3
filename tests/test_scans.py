"""Scans over whole histories: cut or not, the same rows as one pass."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import macro, scans
from ledgerloom.operators.series import Series

S = Series(("k",), ("t", "id"), "day")


@pytest.fixture(scope="module")
def flags(spark):
    """A key with most rows, runs longer than a chunk, missing flags, a null key, and moments with many rows."""
    rng = np.random.default_rng(3)
    rows = []
    for key, n in ((1, 900), (2, 30), (None, 200)):
        flag, left = 0, 0
        for i in range(n):
            if left == 0:
                flag, left = 1 - flag, int(rng.choice([1, 2, 7, 150]))
            left -= 1
            rows.append((key, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 6), None if i % 331 == 5 else flag))
    return spark.createDataFrame(rows, "k int, id long, t timestamp, flag int").cache()


def runs_by_hand(pdf):
    out = []
    for _, g in pdf.sort_values(["t", "id"]).groupby("k", dropna=False):
        run, place, last = 0, 0, None
        for flag in g["flag"]:
            same = last is not None and not pd.isna(flag) and flag == last
            run, place = (run, place + 1) if same else (run + 1, 1)
            last = None if pd.isna(flag) else flag
            out.append((run, place))
    return out


@pytest.mark.parametrize("chunk", [None, 40, 100, 400])
def test_runs_of_cut_histories(flags, conf, chunk):
    if chunk:
        conf(smallInputBytes=0, chunkRows=chunk)
        assert scans.chunked(flags, S) is not None
    got = scans.with_runs(flags, S, "flag").toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = runs_by_hand(flags.toPandas())
    assert list(zip(got["__run"], got["__place"])) == want
    lengths = macro.run_length(flags, S, "flag", "since").toPandas().sort_values(["k", "t", "id"])["since"]
    flag = flags.toPandas().sort_values(["k", "t", "id"])["flag"].to_numpy()
    assert [None if pd.isna(x) else x for x in lengths] == [None if pd.isna(f) else (p - 1) * f for (_, p), f in zip(want, flag)]


def test_segments_of_cut_histories(flags, conf):
    def found():
        out = macro.segments(flags, S, "flag").toPandas()
        return out.sort_values(["k", "segment"]).reset_index(drop=True)

    plain = found()
    assert plain["n"].sum() == flags.count() and plain["n"].max() > 100
    conf(smallInputBytes=0, chunkRows=60)
    pd.testing.assert_frame_equal(plain, found(), check_dtype=False)


MOVES = np.array([[0.9, 0.08, 0.02], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]])
START = np.array([0.5, 0.3, 0.2])


def by_hand(likelihood):
    ahead, x = [], START
    for i, b in enumerate(likelihood):
        x = (x if i == 0 else x @ MOVES) * b
        x = x / x.sum()
        ahead.append(x)
    behind, y = [np.ones(3)], np.ones(3)
    for b in likelihood[:0:-1]:
        y = MOVES @ (b * y)
        y = y / y.sum()
        behind.append(y)
    out = np.array(ahead) * np.array(behind[::-1])
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("chunk", [None, 16 * 37, 16 * 200])
def test_state_probabilities_match_the_recursion(spark, conf, chunk):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key, n in ((1, 1000), (2, 1), (None, 150)):
        likelihood = rng.random((n, 3)) ** 3
        for i in range(n):
            value = [float(x) for x in likelihood[i]]
            if i % 50 == 7:
                value, likelihood[i] = (None, [float("nan")] * 3, [0.0] * 3)[i % 3], 1.0
            rows.append((key, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 5), value))
        for i, p in enumerate(by_hand(likelihood)):
            want[key, i] = p
    frame = spark.createDataFrame(rows, "k int, id long, t timestamp, b array<double>").withColumn("extra", F.lit("kept"))
    if chunk:
        conf(chunkRows=chunk)
    got = scans.state_probabilities(frame, S, "b", MOVES, START, "p")
    assert got.columns == ["k", "id", "t", "b", "extra", "p"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.allclose(r["p"], want[r["k"], r["id"]], atol=1e-12)
    assert scans.state_probabilities(frame.where("false"), S, "b", MOVES, START, "p").count() == 0
