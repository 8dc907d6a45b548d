import fractions
import math

import numpy as np
import pytest

from scriptloom.llm import topk_search as S


def slow(rows, k=10, every=100):
    usable = []
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(1024 * fractions.Fraction(float(x))) for x in v]))
    out = []
    for at, (q, a) in enumerate(usable):
        if q % every == 0:
            ends = lambda s: max(min(s, 2**63 - 1), -(2**63))
            scored = sorted((-ends(sum(x * y for x, y in zip(a, b))), i) for n, (i, b) in enumerate(usable) if n != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, part int")
    return sorted(tuple(r) for r in S.top_k(df, **more).collect())


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_like_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 6)) * spread
    rows = [(i, (centres[i % 5] + rng.normal(size=6) * 0.2).astype(np.float32).tolist()) for i in range(700)]
    assert run(spark, rows, n_pivots=16) == slow(rows)


def test_groups_and_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_QUERIES", 5)
    monkeypatch.setattr(S, "PART_VECTORS", 90)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 4)) * 4
    rows = [(i, (centres[i % 8] + rng.normal(size=4) * 0.1).astype(np.float32).tolist()) for i in range(600)]
    assert run(spark, rows, every=10, n_pivots=24) == slow(rows, every=10)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5]) for i in range(250)] + [(1000, [0.5, 1.0])]
    assert run(spark, rows) == slow(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]),
        (5, [-1.0, -0.0004]), (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, []), (200, None),
    ]
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_lengths_large_values_and_repeats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=1 + i % 5).tolist()) for i in range(240)]
    assert run(spark, rows, every=20) == slow(rows, every=20)
    large = [(i, [float(x) for x in rng.normal(size=4) * 1e7]) for i in range(130)]
    assert run(spark, large, every=10) == slow(large, every=10)
    huge = [(i, [10.0 ** (i % 60), -1.0, 0.3]) for i in range(130)]
    assert run(spark, huge, every=10) == slow(huge, every=10)
    again = [(i % 40, [float(i), 1.0]) for i in range(120)]
    assert run(spark, again, every=10) == slow(again, every=10)


def test_routes_prune(spark, monkeypatch):
    """Well separated cells: groups get little of the data, and the result is that of brute force."""
    monkeypatch.setattr(S, "GROUP_QUERIES", 6)
    monkeypatch.setattr(S, "PART_VECTORS", 60)
    rng = np.random.default_rng(3)
    turn = rng.permutation(12)
    rows = [(i, (np.eye(12)[turn[i % 12]] * 50 + rng.normal(size=12) * 0.1).tolist()) for i in range(960)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    flat = S.scaled(df).selectExpr("vec_id as row", "vec_id", "v")
    routed = S.routes(flat, 10, 13, 80)
    groups = routed.seekers.select("g", "salt").distinct().count()
    assert groups > 6
    assert routed.data.count() < 0.4 * groups * len(rows)
    met = routed.seekers.select("g", "salt", "part").distinct().count()
    assert met < 0.6 * groups * routed.data.select("part").distinct().count()
    assert run(spark, rows, every=13, n_pivots=80) == slow(rows, every=13)


def test_hot_cell(spark, monkeypatch):
    """One vector repeated in a third of all rows: its cell is split for queries and data."""
    monkeypatch.setattr(S, "GROUP_QUERIES", 7)
    monkeypatch.setattr(S, "PART_VECTORS", 50)
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(500)]
    assert run(spark, rows, every=5) == slow(rows, every=5)
