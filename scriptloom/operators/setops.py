"""Set operations on ids, codes and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, returned: DataFrame, key: str = "id") -> DataFrame:
    """One row per id that is not returned exactly once: ``missing``, ``unknown`` or ``duplicate``.

    Both sides are counted before one outer join, so duplicates do not multiply.
    """
    a = expected.groupBy(key).agg(F.count(F.lit(1)).alias("n_expected"))
    b = returned.groupBy(key).agg(F.count(F.lit(1)).alias("n_returned"))
    code = (
        F.when(F.col("n_returned").isNull(), "missing").when(F.col("n_expected").isNull(), "unknown").when(F.col("n_returned") > 1, "duplicate")
    )
    both = a.join(b, key, "full_outer").withColumn("code", code).where("code is not null")
    return both.select(key, "code", F.coalesce("n_returned", F.lit(0)).alias("n_returned"))


def fixed_codes(before: Column, after: Column, watched: Column) -> Column:
    """Watched codes that a retry removed."""
    return F.array_intersect(F.array_except(before, after), watched)


def ordered_distinct(values: Column) -> Column:
    """Distinct values in order of first occurrence."""
    return F.array_distinct(values)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that were added, removed or changed, with the changed columns."""
    x, y = before.alias("x"), after.alias("y")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col(f"x.{key}").isNull(), "added").when(F.col(f"y.{key}").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return (
        x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
        .select(F.coalesce(F.col(f"x.{key}"), F.col(f"y.{key}")).alias(key), kind.alias("change"), F.array_join(changed, ",").alias("columns"))
        .where("change is not null")
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Do two frames hold the same rows, repeats counted?"""
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
