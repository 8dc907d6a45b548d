"""Edit distances of all pairs of a group, by a plain loop."""

from collections import Counter
from itertools import combinations

from scriptloom.operators import similarity as S
from scriptloom.plans import catalog


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


NAMES = ["red ring", "blue ring", "red rings", "", None, "größe", "grösse", "red ring"]


def test_pairs_like_a_loop(spark, monkeypatch):
    """Copies beyond a row of keys, null and empty texts, null groups and a key that repeats."""
    monkeypatch.setattr(S, "KEYS_A_ROW", 3)
    rows = [(k * 7 % 90, NAMES[k % 8], "ab"[k % 2] if k % 11 else None, k % 3) for k in range(90)] + [(7, "red ring", "b", 1)]
    df = spark.createDataFrame(rows, "k long, t string, g string, h int")
    want = Counter()
    for x, y in combinations(rows, 2):
        if x[0] != y[0] and x[2] is not None and x[2:] == y[2:]:
            far = None if x[1] is None or y[1] is None else min(4, slow_distance(x[1], y[1]))
            want[min(x[0], y[0]), max(x[0], y[0]), far] += 1
    assert Counter(map(tuple, S.bounded_distances(df, "k", "t", ["g", "h"]).collect())) == want


def test_distances_are_of_texts_not_of_rows(spark, tmp_path):
    """Copies of a part share one row of the join, so their pairs cost no distance each."""
    names = spark.range(3000).selectExpr("id as p_partkey", "if(id % 3 = 0, 'red ring', 'hot bolt') as p_name", "'x' as p_brand", "1 as p_size")
    names.write.parquet(str(tmp_path / "part.parquet"))
    found = catalog.QUERIES["bounded_edit_distance"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("levenshtein") < plan.index("Join")
    assert {(r.distance, r.n) for r in found.groupBy("distance").agg({"*": "count"}).toDF("distance", "n").collect()} == {
        (0, 1000 * 999 // 2 + 2000 * 1999 // 2), (4, 1000 * 2000)}
