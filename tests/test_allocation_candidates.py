import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import allocation_candidates as ac

SCHEMA = "item long, f1 double, f2 double, f3 double, risk double"


def _columns():
    return {c: F.col(c) for c in ac.COLUMNS}


def _pool(n=300, seed=3):
    x = np.random.default_rng(seed).random((n, 4))
    return [(i, *map(float, r)) for i, r in enumerate(x)]


def _brute(rows, n, seed=42, tilt=ac.TILT):
    """One weight at a time, in plain Python numbers."""
    rows = [r for r in rows if all(v is not None and v == v for v in r)]
    x = np.array([r[1:] for r in rows])
    dev = x.std(axis=0)
    z = np.where(dev > 1e-12, (x - x.mean(axis=0)) / np.where(dev > 1e-12, dev, 1), 0).clip(-8, 8)

    def u(c, i):
        m = pow(c * 48271 + i * 69621 + seed, 5, ac.PRIME)
        return (pow(m + c, 5, ac.PRIME) + 1) / (ac.PRIME + 1)

    out = []
    for c in range(n):
        lean = [tilt * u(c, ac.PRIME + 1 + j) for j in range(4)]
        w = np.array([u(c, r[0] % ac.PRIME) * np.exp(-np.dot(lean, z[k])) for k, r in enumerate(rows)])
        out.append(w @ x / w.sum())
    return np.array(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_means_match_one_weight_at_a_time(spark, monkeypatch, parts):
    monkeypatch.setattr(ac, "CANDIDATES", 7)
    rows = _pool() + [(-5, 0.1, 0.2, 0.3, 0.4), (2**62, 0.5, 0.5, 0.5, 0.5)]
    rows += [(901, None, 1.0, 1.0, 1.0), (902, 1.0, float("nan"), 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    pool = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = ac.objectives_of(pool, _columns(), 40, F.col("item")).orderBy("id").toPandas()
    assert np.allclose(got[ac.COLUMNS].to_numpy(), _brute(rows, 40), atol=1e-10)


def test_weights_give_the_means(spark):
    pool = spark.createDataFrame(_pool() + [(901, None, 1.0, 1.0, 1.0)], SCHEMA)
    want = ac.objectives_of(pool, _columns(), 12, F.col("item")).where("id = 11").first()
    got = ac.weights_of(pool, _columns(), 11, F.col("item")).toPandas()
    assert got["allocation_weight"].sum() == pytest.approx(1) and (got["allocation_weight"] >= 0).all()
    assert got.set_index("item")["allocation_weight"][901] == 0
    for c in ac.COLUMNS:
        assert (got["allocation_weight"] * got[c].fillna(0)).sum() == pytest.approx(want[c])


def test_candidates_reach_further_than_plain_random_weights(spark):
    pool = spark.createDataFrame(_pool(5000), SCHEMA)
    tilted = ac.objectives_of(pool, _columns(), 200, F.col("item")).toPandas()
    plain = ac.objectives_of(pool, _columns(), 200, F.col("item"), tilt=0.0).toPandas()
    assert plain["f1"].min() > 0.45  # weights of many items alike give the mean
    assert tilted["f1"].min() < 0.15 and tilted["f2"].min() < 0.15


def test_front_keeps_the_limit_and_one_is_chosen(spark):
    found = ac.objectives_of(spark.createDataFrame(_pool(), SCHEMA), _columns(), 150, F.col("item")).toPandas()
    inside = found[found["risk"] <= 0.3]
    x = inside[ac.OBJECTIVES].to_numpy()
    want = {i for i, p in zip(inside["id"], x) if not ((x <= p).all(axis=1) & (x < p).any(axis=1)).any()}
    front = ac.chosen(ac.front_within(spark.createDataFrame(found), 0.3), (0.5, 0.3, 0.2)).toPandas()
    assert set(front["id"]) == want and 0 < len(inside) < len(found)
    best = front[front["chosen"]]
    assert len(best) == 1 and best["score"].iloc[0] == front["score"].min()


def test_odd_pools(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ac.objectives_of(none, _columns(), 5, F.col("item")).count() == 0
    empty = spark.createDataFrame(pd.DataFrame({"id": [1], "f1": [1.0], "f2": [1.0], "f3": [1.0], "risk": [0.9]}))
    assert ac.chosen(ac.front_within(empty, 0.3), (1, 1, 1)).count() == 0
    # One item: every candidate is that item, and the lowest id is taken.
    one = ac.objectives_of(spark.createDataFrame([(4, 0.1, 0.2, 0.3, 0.1)], SCHEMA), _columns(), 5, F.col("item"))
    front = ac.chosen(ac.front_within(one, 0.3), (1, 1, 1)).toPandas()
    assert len(front) == 5 and front[front["chosen"]]["id"].tolist() == [0]
    # Without a key the rows are hashed.
    assert ac.objectives_of(spark.createDataFrame(_pool(20), SCHEMA), _columns(), 5).count() == 5
