"""Filter interaction audit: direct relational replay of every order of the filters.

Each document's failing filters are a bit mask. The masks are crossed with the 120 orders (a
table of fixed size, broadcast), the first failing place of each order is computed once, its
five steps are exploded, and conditional sums are combined in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import words

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = "#$%&*|"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(text: Column, split: Column) -> list[Column]:
    """Failure conditions A to D of a text and its ``split`` words, as booleans."""
    n = F.size(split)
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(split)) < DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        text.rlike(f"[{SYMBOLS}]"),
    ]


def with_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every row; bit k of the mask is set if it fails filter k.

    A text's first holder is found by its SHA-256 with a minimum that every task combines, so a
    group of copies, however large, is one row a task. Documents learn whether they are it by
    their id, never by the text, so no group of copies meets in one task. Null ids take no part
    in the joins: they are nobody's smaller id and fail E never.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    checks = text_filters(F.col("text"), F.col("split"))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(checks)), F.lit(0))
    flagged = plain.withColumn("split", words(F.col("text"))).select("doc_id", "part", "digest", mask.alias("mask"))
    firsts = plain.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    )
    same = (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    last = 1 << len(checks)
    known = (
        flagged.where("doc_id is not null")
        .join(firsts, same, "left")
        .join(marks, F.col("doc_id") == F.col("label_id"), "left")
        .select(
            "part",
            F.when(F.col("first_id").isNull(), F.col("mask") + last).otherwise(F.col("mask")).alias("mask"),
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )
    return known.union(flagged.where("doc_id is null").select("part", "mask", F.lit(False), F.lit(False)))


def replay(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Counts of every part, order of the filters ``names`` and step, from ``part, mask, good, toxic``."""
    spark = masks.sparkSession
    listed = [(k, "".join(names[i] for i in p), [1 << i for i in p]) for k, p in enumerate(permutations(range(len(names))))]
    orders = spark.createDataFrame(listed, "order_id int, filter_order string, bits array<int>")
    steps = range(1, len(names) + 1)
    bit = lambda s: F.col("bits")[s - 1]
    first: Column = F.lit(len(names) + 1)
    for s in reversed(steps):
        first = F.when(F.col("mask").bitwiseAND(bit(s)) != 0, F.lit(s)).otherwise(first)
    crossed = masks.crossJoin(F.broadcast(orders.select("order_id", "bits"))).withColumn("first", first)
    walked = crossed.select("part", "order_id", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "own"))
    step, fails = F.col("at") + 1, F.col("mask").bitwiseAND(F.col("own")) != 0
    out = F.col("first") == step
    total: Callable[[Column], Column] = lambda c: F.sum(c.cast("long"))
    sums = walked.groupBy("part", "order_id", step.alias("step")).agg(
        total(F.col("first") > step).alias("kept"),
        total(out).alias("removed"),
        total(fails & (F.col("first") < step)).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(out & F.col("good")).alias("good_lost"),
        total(out & F.col("toxic")).alias("toxic_lost"),
    )
    named = sums.join(F.broadcast(orders.select("order_id", "filter_order")), "order_id").drop("order_id")
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS, F.sum("removed").over(own).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes, in every order, within every ``source``.

    Null texts are empty, a null source is the empty part. Equal texts under one id are no copies
    of a smaller id; of ties only larger ids fail E. Rows with a null id fail E never and have no
    labels; ids with several labels have any that one of them gives. Every row counts, repeated
    ones as often; no rows give an empty result; extra columns are ignored.
    """
    return replay(with_masks(docs, labels))
