import numpy as np
import pandas as pd
import pytest

from ledgerloom.operators.pareto import _undominated, choose, pareto_front


def _brute(p):
    return {
        int(r[0])
        for r in p
        if not any((q[1:] <= r[1:]).all() and (q[1:] < r[1:]).any() for q in p)
    }


@pytest.mark.parametrize("kind", ["random", "grid", "hot point", "plane", "one first objective"])
def test_front_matches_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.random((n, 3))
    if kind == "grid":
        x = np.floor(x * 6)
    if kind == "hot point":
        x[rng.random(n) < 0.34] = [0.01, 0.5, 0.5]
    if kind == "plane":
        x[:, 2] = 2 - x[:, 0] - x[:, 1]  # nothing dominates anything
    if kind == "one first objective":
        x[:, 0] = 1.0
    pdf = pd.DataFrame(np.column_stack([np.arange(n), x]), columns=["id", "f1", "f2", "f3"]).astype({"id": int})
    got = {r["id"] for r in pareto_front(spark.createDataFrame(pdf).repartition(7), slices=8).collect()}
    assert got == _brute(pdf.to_numpy())


def test_choice_takes_the_least_weighted_score(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.0, 3.0, 0.0)], "id int, f1 double, f2 double, f3 double")
    assert choose(df, (1.0, 1.0, 1.0)).first()["id"] == 1


def test_points_that_none_dominates_take_no_quadratic_step():
    rng = np.random.default_rng(2)
    x = rng.random((200_000, 3))
    x[:, 2] = 2 - x[:, 0] - x[:, 1]
    assert _undominated(x).all()
