"""Lookups of the caption pipeline as joins: defaults, write-back, mappings, anti-joins, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_default(rows: DataFrame, values: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """Left join by key; a missing or blank value falls back to ``default``."""
    found = values.select(key, F.col(column).alias("found"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim("found"), F.lit("")), F.col(default))).drop("found")


def write_back(rows: DataFrame, groups: DataFrame, returned: DataFrame) -> DataFrame:
    """Translations by (group, id): only ids that came back change.

    ``rows``: ``id, text``. ``groups``: ``group_id, id``. ``returned``: ``group_id, id, text, ord``;
    of duplicates the last counts.
    """
    last = returned.groupBy("group_id", "id").agg(F.max_by("text", "ord").alias("new_text"))
    return (
        rows.join(groups, "id", "left")
        .join(last, ["group_id", "id"], "left")
        .select("id", "group_id", F.coalesce(F.nullif(F.trim("new_text"), F.lit("")), F.col("text")).alias("text"))
    )


def unique_mapping(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Items whose ids belong to exactly one group.

    ``items``: ``item_id, id``; ``groups``: ``group_id, id``.
    """
    return (
        items.join(groups, "id", "left")
        .groupBy("item_id")
        .agg(F.count_distinct("group_id").alias("n_groups"), F.min("group_id").alias("group_id"), F.count(F.lit(1)).alias("n_ids"), F.count("group_id").alias("n_known"))
        .withColumn("mapped", (F.col("n_groups") == 1) & (F.col("n_ids") == F.col("n_known")))
    )


def unique_signature(items: DataFrame, contexts: DataFrame) -> DataFrame:
    """Items joined to the one context with their signature; signatures met twice match nothing."""
    once = contexts.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("context_id").alias("context_id")).where("n = 1")
    return items.join(once.select("signature", "context_id"), "signature")


def merge_fields(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Outer merge by key; each field from ``a`` unless missing there."""
    x, y = a.alias("x"), b.alias("y")
    pick = [F.coalesce(F.col(f"x.{f}"), F.col(f"y.{f}")).alias(f) for f in fields]
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer").select(
        F.coalesce(F.col(f"x.{key}"), F.col(f"y.{key}")).alias(key), *pick, F.col(f"x.{key}").isNotNull().alias("in_a"), F.col(f"y.{key}").isNotNull().alias("in_b")
    )


def missing(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Expected keys that did not come back."""
    return expected.join(returned.select(key), key, "left_anti")


def restore_missing(returned: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Returned rows and, marked, the expected ones without one."""
    lost = missing(expected, returned, key)
    return returned.withColumn("restored", F.lit(False)).unionByName(lost.withColumn("restored", F.lit(True)), allowMissingColumns=True)


def first_row(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """First row per key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def near_sizes(windows: DataFrame, terms: DataFrame, tolerance: int = 1) -> DataFrame:
    """Windows with terms whose number of tokens differs by at most ``tolerance``.

    An equality join on the number of tokens; terms are repeated ``2 * tolerance + 1`` times.
    """
    spread = terms.withColumn("size", F.explode(F.sequence(F.col("tokens") - tolerance, F.col("tokens") + tolerance)))
    return windows.join(spread, "size")


#: Grams of items that may be broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_GRAMS = 2_000_000


def ngram_matches(items: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Occurrences of the items' token n-grams in texts, by equality (J04-J07 without cursor).

    Both sides: ``id, tokens``. Returns ``item_id, text_id, item_pos, text_pos``. Grams are equal if
    two 64-bit hashes of theirs are; strings are neither built nor shuffled. The items' grams, where
    a count finds them few, are broadcast, and then the texts don't move at all.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        hashed = df.where(F.size("tokens") >= n).select("id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
        part = lambda i: F.slice("h", i + 1, F.lit(n))
        gram = lambda i: F.struct(i.alias("pos"), F.xxhash64(part(i)).alias("g1"), F.xxhash64(F.lit(n), part(i)).alias("g2"))
        at = F.sequence(F.lit(0), F.size("h") - n)
        return hashed.select(F.col("id").alias(f"{name}_id"), F.explode(F.transform(at, gram)).alias("g")).select(
            f"{name}_id", F.col("g.pos").alias(f"{name}_pos"), "g.g1", "g.g2"
        )

    wanted = grams(items, "item")
    few = wanted.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return grams(texts, "text").join(F.broadcast(wanted) if few else wanted, ["g1", "g2"]).select("item_id", "text_id", "item_pos", "text_pos")
