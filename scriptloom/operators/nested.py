"""Ids anywhere in nested payloads, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.session import checkpointed

#: Keys that hold ids of captions and of groups, alone and in lists.
CAPTION_KEYS = ["subtitle_id", "left_subtitle_id", "right_subtitle_id"]
CAPTION_LISTS = [
    "subtitle_ids", "expected_subtitle_ids", "returned_subtitle_ids", "mapped_subtitle_ids", "missing_subtitle_ids", "duplicate_subtitle_ids",
    "unknown_subtitle_ids",
]
GROUP_KEYS, GROUP_LISTS = ["semantic_group_id"], ["semantic_group_ids"]
CAPTION_ID, GROUP_ID = r"^S\d{4}\z", r"^G\d{4}\z"


def nested_ids(payloads: DataFrame) -> DataFrame:
    """``row_id, caption_ids, group_ids`` of every row of ``row_id, payload`` (JSON text), sorted and distinct.

    Caption ids are keys that look like one, texts under the known keys and members of the known
    lists. A payload is a VARIANT, so no schema is given; each round opens one level of all
    payloads and ends when nothing nested is left. Broken, null and flat payloads have no ids;
    rows with one id share theirs.
    """
    spark = payloads.sparkSession
    kind = F.schema_of_variant("v")
    known, lists = [*CAPTION_KEYS, *GROUP_KEYS], [*CAPTION_LISTS, *GROUP_LISTS]
    # from every member: the keys that are ids, and texts under known keys and in known lists
    texts = F.when(F.col("key").isin(known) | F.col("list").isin(lists), F.when(kind == "STRING", F.variant_get("v", "$", "string")))
    ids = F.filter(F.array(F.when(F.col("key").rlike(CAPTION_ID), F.col("key")), texts), lambda x: x.isNotNull())
    found = []
    level = payloads.select("row_id", F.lit("").alias("key"), F.try_parse_json(F.col("payload").cast("string")).alias("v"))
    while True:
        nested = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        opened = nested.alias("l").lateralJoin(spark.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        level = checkpointed(
            opened.select(
                "l.row_id", F.coalesce("e.key", F.lit("")).alias("key"), F.when(F.col("e.key").isNull(), F.col("l.key")).otherwise("").alias("list"), F.col("e.value").alias("v")
            )
        )
        if not level.take(1):
            break
        found.append(level.select("row_id", F.explode(ids).alias("id")))
        level = level.select("row_id", "key", "v")
    some = payloads.select("row_id").distinct()
    if not found:
        return some.select("row_id", F.array().cast("array<string>").alias("caption_ids"), F.array().cast("array<string>").alias("group_ids"))
    each = reduce(DataFrame.union, found).where(F.col("id").rlike(CAPTION_ID) | F.col("id").rlike(GROUP_ID)).distinct()
    listed = lambda pattern: F.sort_array(F.coalesce(F.collect_list(F.when(F.col("id").rlike(pattern), F.col("id"))), F.array().cast("array<string>")))
    return some.join(each, "row_id", "left").groupBy("row_id").agg(listed(CAPTION_ID).alias("caption_ids"), listed(GROUP_ID).alias("group_ids"))
