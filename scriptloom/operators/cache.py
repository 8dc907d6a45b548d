"""Result caches and usage counters as tables: lookups, inserts, upserts, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions.lexicons import CACHE_DAYS
from scriptloom.operators.joins import first_row


def cache_key(content: Column, params: Column | None = None) -> Column:
    """MD5 of the content and its parameters as JSON."""
    return F.md5(F.concat(content, F.coalesce(params, F.lit("{}")) if params is not None else F.lit("{}")))


def crc_key(data: Column) -> Column:
    """CRC-32 of the content as eight hex digits."""
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def lookup(requests: DataFrame, cache: DataFrame, keys: list[str], value: str, order: str = "id") -> DataFrame:
    """Requests with the first cached value of their keys, null on a miss."""
    first = first_row(cache.select(*keys, value, order), keys, [order]).drop(order)
    return requests.join(first, keys, "left").withColumn("hit", F.col(value).isNotNull())


def misses(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that a provider must answer."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def insert(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Appended rows; repeats stay, lookups take the first."""
    return cache.unionByName(rows)


def upsert(cache: DataFrame, rows: DataFrame, keys: list[str], stamp: str = "updated_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the newest; of equal times the new table's, then the greatest by ``ties``."""
    both = cache.withColumn("new", F.lit(0)).unionByName(rows.withColumn("new", F.lit(1)))
    return first_row(both, keys, [F.desc(stamp), F.desc("new"), *map(F.desc, ties)]).drop("new")


def expire(cache: DataFrame, now: Column, days: int = CACHE_DAYS, stamp: str = "created_at") -> DataFrame:
    """Rows younger than the time to live."""
    return cache.where(F.col(stamp) >= now - F.make_dt_interval(F.lit(days)))


def bulk_edit(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ``ord, value`` with ``text||translation`` written into rows."""
    parts = edits.select("file_id", "ord", F.split_part("value", F.lit("||"), F.lit(1)).alias("t"), F.split_part("value", F.lit("||"), F.lit(2)).alias("z"))
    return (
        rows.join(parts, ["file_id", "ord"], "left")
        .withColumns({"text": F.coalesce(F.nullif("t", F.lit("")), F.col("text")), "translated_text": F.coalesce(F.nullif("z", F.lit("")), F.col("translated_text"))})
        .drop("t", "z")
    )


def task_stats(log: DataFrame) -> DataFrame:
    """Hits and misses per task."""
    return log.groupBy("task").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))
