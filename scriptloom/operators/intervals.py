"""Interval algebra: islands, overlap, coverage and the holes in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 3_600_000


def islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals per key: ``island_start, island_end``."""
    w = Window.partitionBy(*by).orderBy("start_ms", "end_ms")
    latest = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(latest >= F.col("start_ms"), 0).otherwise(1)
    return (
        rows.where("end_ms > start_ms")
        .withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "island")
        .agg(F.min("start_ms").alias("island_start"), F.max("end_ms").alias("island_end"))
    )


def holes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Uncovered stretches between a key's intervals: ``hole_start, hole_end``."""
    w = Window.partitionBy(*by).orderBy("island_start")
    return (
        islands(rows, by)
        .withColumn("hole_start", F.lag("island_end").over(w))
        .where("hole_start is not null")
        .select(*by, "hole_start", F.col("island_start").alias("hole_end"))
    )


def covered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Covered and spanned milliseconds per key."""
    return (
        islands(rows, by)
        .groupBy(*by)
        .agg(
            F.sum(F.col("island_end") - F.col("island_start")).alias("covered_ms"),
            (F.max("island_end") - F.min("island_start")).alias("span_ms"),
            F.count(F.lit(1)).alias("n_islands"),
        )
    )


def _bucketed(df: DataFrame, start: str, end: str, bucket_ms: int) -> DataFrame:
    cells = F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.col(end) / bucket_ms))
    return df.withColumn("bucket", F.explode(cells))


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of closed intervals ``l_start..l_end`` and ``r_start..r_end`` of one key that meet.

    An equality join on key and time bucket with the exact test behind it. A pair is taken in
    the bucket where the later of both starts lies, hence once.
    """
    a = _bucketed(left, "l_start", "l_end", bucket_ms)
    b = _bucketed(right, "r_start", "r_end", bucket_ms)
    meets = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    home = F.floor(F.greatest("l_start", "r_start") / bucket_ms)
    return a.join(b, [key, "bucket"]).where(meets & (F.col("bucket") == home)).drop("bucket")


def point_in_interval(points: DataFrame, rows: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Intervals open at each point ``at`` of the key: ``r_start <= at < r_end``."""
    a = points.withColumn("bucket", F.floor(F.col("at") / bucket_ms))
    b = _bucketed(rows, "r_start", "r_end", bucket_ms)
    return a.join(b, [key, "bucket"]).where((F.col("r_start") <= F.col("at")) & (F.col("at") < F.col("r_end"))).drop("bucket")


def as_of(points: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """The last ``value`` at or before each point, by one sorted pass over both.

    ``points``: key, ``at`` and more columns. ``rows``: key, ``at``, ``value``.
    """
    more = [c for c in points.columns if c not in (key, "at")]
    kind = rows.schema[value].dataType
    both = points.select(key, "at", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("seen"), *more).unionByName(
        rows.select(key, "at", F.lit(0).alias("side"), F.col(value).alias("seen")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("seen", ignorenulls=True).over(w)).where("side = 1").drop("side", "seen")
