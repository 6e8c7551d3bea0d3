"""Allocations of many keys at once against brute force, single solves and keys that have no solution."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import allocation, allocation_batch
from ledgerloom.operators.simplex import simplex

SCHEMA = "book string, collateral_id long, asset_class string, eligible boolean, cost double, haircut double, quality_score double, recall_prob double"
LIMITS = {"haircut": ("max", 0.4), "quality_score": ("min", 0.55), "recall_prob": ("max", 0.5)}


def books(sizes, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for book, n in sizes.items():
        for i in range(n):
            rows.append((book, i, f"t{i % 4}", bool(i % 9), *(float(x) for x in rng.random(4).round(3))))
    return rows


def least_cost(rows, cap, limits):
    """The least cost over all corners of the linear program of a few items."""
    rows = [r for r in rows if r[3]]
    n, types = len(rows), sorted({r[2] for r in rows})
    column = {"haircut": 5, "quality_score": 6, "recall_prob": 7}
    signed = [(column[c], 1 if kind == "max" else -1, bound) for c, (kind, bound) in limits.items()]
    a = np.zeros((1 + len(types) + len(signed), n + len(types) + len(signed)))
    a[0, :n] = 1
    for i, r in enumerate(rows):
        a[1 + types.index(r[2]), i] = 1
        for j, (at, sign, _) in enumerate(signed):
            a[1 + len(types) + j, i] = sign * r[at]
    a[1:, n:] = np.eye(len(types) + len(signed))
    b = np.array([1.0] + [cap] * len(types) + [sign * bound for _, sign, bound in signed])
    c = np.array([r[4] for r in rows] + [0.0] * (len(types) + len(signed)))
    best = None
    for basis in combinations(range(a.shape[1]), len(b)):
        square = a[:, basis]
        if abs(np.linalg.det(square)) > 1e-10:
            x = np.linalg.solve(square, b)
            if x.min() >= -1e-9:
                value = c[list(basis)] @ x
                best = value if best is None else min(best, value)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_books_cost_what_the_best_corner_costs(spark, seed):
    rows = books({"a": 6, "b": 7}, seed)
    limits = {"haircut": ("max", 0.45), "quality_score": ("min", 0.5)}
    runs = allocation_batch.allocate_each(spark.createDataFrame(rows, SCHEMA), ["book"], F.col("cost"), 0.6, limits)
    got = {r["book"]: r for r in runs.collect()}
    for book in "ab":
        want = least_cost([r for r in rows if r[0] == book], 0.6, limits)
        if want is None:
            assert got[book]["status"] == "infeasible" and got[book]["shares"] == [] and got[book]["cost"] is None
        else:
            assert got[book]["status"] == "optimal" and got[book]["cost"] == pytest.approx(want, abs=1e-9) and got[book]["gap"] <= 1e-9


def test_every_book_solves_as_it_does_alone(spark):
    rows = books({"a": 60, "b": 200, "c": 35}, 4)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["book"]: r["cost"] for r in allocation_batch.allocate_each(frame, ["book"], F.col("cost"), 0.4, LIMITS).collect()}
    for book, cost in got.items():
        alone = allocation.allocate_within_limits(frame.where(F.col("book") == book), F.col("cost"), 0.4, LIMITS)
        want = alone.agg(F.sum(F.col("cost") * F.col("allocation_weight"))).first()[0]
        assert cost == pytest.approx(want, abs=1e-8)


def test_runs_show_that_they_are_feasible_and_at_their_bound(spark):
    frame = spark.createDataFrame(books({"a": 60, "b": 200}, 5), SCHEMA)
    runs = allocation_batch.allocate_each(frame, ["book"], F.col("cost"), 0.4, LIMITS)
    for r in allocation_batch.checked(frame, runs, ["book"], F.col("cost"), 0.4, LIMITS).collect():
        assert r["status"] == "optimal" and r["invested"] == pytest.approx(1) and r["inside"] and r["capped"] and abs(r["distance"]) < 1e-7
    weighed = allocation_batch.with_weights(frame, runs, ["book"])
    assert weighed.count() == 260
    assert weighed.where("allocation_weight > 0 AND NOT eligible").count() == 0


def test_books_without_a_solution_say_so(spark):
    rows = books({"a": 40}, 6)
    rows += [("no types", i, "t0", True, 0.1, 0.1, 0.9, 0.1) for i in range(5)]
    rows += [("none eligible", i, f"t{i}", False, 0.1, 0.1, 0.9, 0.1) for i in range(5)]
    rows += [("floor", i, f"t{i % 4}", True, 0.1, 0.1, 0.2, 0.1) for i in range(8)]
    rows += [(None, i, f"t{i % 4}", True, 0.1 * i, 0.1, 0.9, 0.1) for i in range(8)]
    rows += [("holes", i, f"t{i % 4}", True, None if i < 4 else 1.0, 0.1 if i != 5 else None, 0.9, 0.1) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("status", F.lit("clash"))
    got = {r["book"]: r for r in allocation_batch.allocate_each(frame, ["book"], F.col("cost"), 0.4, LIMITS).collect()}
    assert {b: r["status"] for b, r in got.items()} == {
        "a": "optimal", "no types": "infeasible", "none eligible": "infeasible", "floor": "infeasible", None: "optimal", "holes": "optimal",
    }
    # The cheapest of each type: two types in full and the third with what is left.
    assert got[None]["cost"] == pytest.approx(0.4 * 0.0 + 0.4 * 0.1 + 0.2 * 0.2)
    assert {s["item"] for s in got["holes"]["shares"]} <= {str(i) for i in range(4, 12)} - {"5"}
    assert allocation_batch.allocate_each(frame.where("false"), ["book"], F.col("cost"), 0.4, LIMITS).count() == 0


def test_many_limits_stay_small(spark):
    """Twelve limits: a look at all corners would be billions."""
    rng = np.random.default_rng(8)
    names = [f"x{j}" for j in range(12)]
    rows = [(i, f"t{i % 5}", True, *(float(x) for x in rng.random(13))) for i in range(500)]
    frame = spark.createDataFrame(rows, f"collateral_id long, asset_class string, eligible boolean, cost double, {', '.join(f'{c} double' for c in names)}")
    frame = frame.withColumn("book", F.lit(1))
    limits = {c: ("max", 0.47) for c in names}
    run = allocation_batch.allocate_each(frame, ["book"], F.col("cost"), 0.3, limits).first()
    assert run["status"] == "optimal" and run["gap"] <= 1e-9


def test_simplex_ends_on_degenerate_programs():
    # Beale's example, which cycles when ties are always broken by the same rule.
    a = np.array([[0.25, -60, -1 / 25, 9, 1, 0, 0], [0.5, -90, -1 / 50, 3, 0, 1, 0], [0, 0, 1, 0, 0, 0, 1]])
    basis, x, _ = simplex(a, np.array([0.0, 0.0, 1.0]), np.array([-0.75, 150, -0.02, 6, 0, 0, 0]), [4, 5, 6])
    assert np.array([-0.75, 150, -0.02, 6, 0, 0, 0])[basis] @ x == pytest.approx(-0.05)


def test_the_pool_is_not_written(spark, monkeypatch):
    frame = spark.createDataFrame(books({"a": 2_000, "b": 1_500, "c": 500}), SCHEMA)
    written, plain = [], allocation_batch.lineage_cut

    def counted(df, purpose="stage"):
        out = plain(df, purpose)
        written.append(out.count())
        return out

    monkeypatch.setattr(allocation_batch, "lineage_cut", counted)
    runs = allocation_batch.allocate_each(frame, ["book"], F.col("cost"), 0.4, LIMITS)
    assert {r["status"] for r in allocation_batch.checked(frame, runs, ["book"], F.col("cost"), 0.4, LIMITS).collect()} == {"optimal"}
    assert max(written) < 400
