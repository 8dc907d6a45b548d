"""Adjacency and running-state operators: one shuffle by file, shared by chained windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import lexicons as L
from scriptloom.functions import text as T

FILE = ["file_id"]


def ordered(by: list[str] = FILE, order: tuple[str, ...] = ("start_ms", "ord")):
    return Window.partitionBy(*by).orderBy(*order)


def running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def timing_blend(rows: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """Neighbours closer than the threshold meet three quarters into their gap."""
    w = ordered()
    gap = lambda end, start: start - end
    meet = lambda end, start: F.floor((end + start) / 2) + F.floor(gap(end, start) / 4)
    next_start, last_end = F.lead("start_ms").over(w), F.lag("end_ms").over(w)
    return rows.withColumns(
        {
            "new_start_ms": F.when(F.col("start_ms") - last_end < threshold_ms, meet(last_end, F.col("start_ms"))).otherwise(F.col("start_ms")).cast("long"),
            "new_end_ms": F.when(next_start - F.col("end_ms") < threshold_ms, meet(F.col("end_ms"), next_start)).otherwise(F.col("end_ms")).cast("long"),
        }
    )


def gap_groups(rows: DataFrame, max_gap_ms: int = L.SPLIT_GAP_MS) -> DataFrame:
    """Adds ``group_id`` from 0: a pause above the maximum starts a group."""
    w = ordered()
    opens = F.when(F.col("start_ms") - F.lag("end_ms").over(w) > max_gap_ms, 1).otherwise(0)
    return rows.withColumn("opens", opens).withColumn("group_id", F.sum("opens").over(running(w))).drop("opens")


def gap_warnings(rows: DataFrame, warning_ms: int = L.GAP_WARNING_MS, error_ms: int = L.GAP_ERROR_MS) -> DataFrame:
    """Rows behind a long pause with its code."""
    gap = F.col("start_ms") - F.lag("end_ms").over(ordered(order=("ord",)))
    return (
        rows.withColumn("gap", gap)
        .where(F.col("gap") > warning_ms)
        .withColumn("code", F.when(F.col("gap") > error_ms, "coverage_gap_unverified").otherwise("coverage_gap_warning"))
    )


def time_overlaps(rows: DataFrame, tolerance_ms: int = 5) -> DataFrame:
    """Rows that start before the latest end so far."""
    latest = F.max("end_ms").over(before(ordered()))
    return rows.withColumn("latest_end_ms", latest).where(F.col("start_ms") < F.col("latest_end_ms") - tolerance_ms)


def move_marks(rows: DataFrame) -> DataFrame:
    """Leading marks of a translation move to the row before (F12); pairs are independent."""
    w = ordered(order=("ord",))
    mine = T.move_leading_marks(F.lag("translated_text").over(w), F.col("translated_text"))
    start = F.when(F.lag("ord").over(w).isNull(), T.blank(F.col("translated_text"))).otherwise(mine["current"])
    return (
        rows.withColumn("own", start)
        .withColumn("moved_text", F.coalesce(T.move_leading_marks(F.col("own"), F.lead("translated_text").over(w))["previous"], F.col("own")))
        .drop("own")
    )


def global_ids(rows: DataFrame) -> DataFrame:
    """``subtitle_id``: the existing one or S plus the place in the file."""
    n = F.row_number().over(ordered(order=("ord",)))
    has = F.col("subtitle_id") if "subtitle_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("subtitle_id", F.coalesce(F.nullif(has, F.lit("")), T.subtitle_id(n)))


def compact_ranges(ids: DataFrame, id_col: str) -> DataFrame:
    """Runs of consecutive ids: ``first, last, n, label``.

    Runs are found within blocks of a million ids and then joined across block borders, so no
    task sees all ids.
    """
    block = Window.partitionBy("block").orderBy("id")
    numbered = ids.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("block", F.floor(F.col("id") / 1000000))
    runs = (
        numbered.withColumn("island", F.col("id") - F.row_number().over(block))
        .groupBy("block", "island")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
    )
    # a run that fills up to a border continues in the next block; at most one such run a block
    edge = runs.where((F.col("first") % 1000000 == 0) | (F.col("last") % 1000000 == 999999))
    inner = runs.where((F.col("first") % 1000000 != 0) & (F.col("last") % 1000000 != 999999)).select("first", "last")
    w = Window.orderBy("first")
    joined = (
        edge.withColumn("opens", F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1))
        .withColumn("g", F.sum("opens").over(w))
        .groupBy("g")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select("first", "last")
    )
    label = F.when(F.col("first") == F.col("last"), T.subtitle_id(F.col("first"))).otherwise(
        F.concat(T.subtitle_id(F.col("first")), F.lit("-"), T.subtitle_id(F.col("last")))
    )
    return inner.union(joined).select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"), label.alias("label"))


def semantic_groups(rows: DataFrame, most: int = 4) -> DataFrame:
    """Adds ``group_no`` from 1: groups close at a sentence end or at ``most`` rows."""
    w = ordered(order=("ord",))
    ended = F.coalesce(F.lag(T.sentence_end(F.col("text"))).over(w), F.lit(True))
    part = (
        rows.withColumn("opens", F.when(ended, 1).otherwise(0))
        .withColumn("island", F.sum("opens").over(running(w)))
        .withColumn("k", F.floor((F.row_number().over(Window.partitionBy("file_id", "island").orderBy("ord")) - 1) / most))
    )
    fresh = F.when((F.col("island") != F.coalesce(F.lag("island").over(w), F.lit(-1))) | (F.col("k") != F.coalesce(F.lag("k").over(w), F.lit(-1))), 1).otherwise(0)
    return part.withColumn("fresh", fresh).withColumn("group_no", F.sum("fresh").over(running(w))).drop("opens", "island", "k", "fresh")


def group_text(grouped: DataFrame) -> DataFrame:
    """Rows of each group as one: times, joined texts, number of rows."""
    items = F.sort_array(F.collect_list(F.struct("ord", "text", "translated_text")))
    return grouped.groupBy("file_id", "group_no").agg(
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"),
        F.array_join(F.transform(items, lambda x: x["translated_text"]), "").alias("translated_text"),
    )


def boundary_issues(rows: DataFrame, editor: bool = False) -> DataFrame:
    """Neighbours with broken syntax: reasons and confidence (W10-W13), by the audit's or the editor's profile."""
    w = ordered(order=("ord",))
    joined = rows.withColumns({"previous": F.lag("text").over(w), "from_ord": F.lag("ord").over(w)}).where("previous is not null")
    reasons = joined.withColumn("reasons", T.boundary_reasons(F.col("previous"), F.col("text"), editor)).where(F.size("reasons") > 0)
    score = F.least(F.lit(0.95), 0.65 + 0.12 * F.size("reasons"))
    return reasons.withColumn("confidence_score", F.round(score, 2)).withColumn(
        "confidence", F.when(F.col("confidence_score") >= 0.75, "high").otherwise("medium")
    )


def fixed_batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``batch_no`` from 0: every ``size`` rows of a file."""
    return rows.withColumn("batch_no", F.floor((F.row_number().over(ordered()) - 1) / size))


def word_pauses(words: DataFrame) -> DataFrame:
    """Pause to the next word, null behind the last."""
    w = Window.partitionBy("file_id").orderBy("word_id")
    return words.withColumns({"pause_ms": F.lead("start_ms").over(w) - F.col("end_ms"), "next_token": F.lead("token").over(w)})


def boundary_records(items: DataFrame) -> DataFrame:
    """One record for each pair of neighbouring items with the pause between them."""
    w = Window.partitionBy("file_id").orderBy("ord")
    return (
        items.withColumns(
            {
                "right_ord": F.lead("ord").over(w),
                "right_text": F.lead("text").over(w),
                "pause_ms": F.lead("start_ms").over(w) - F.col("end_ms"),
            }
        )
        .where("right_ord is not null")
        .select("file_id", F.col("ord").alias("left_ord"), "right_ord", F.col("text").alias("left_text"), "right_text", "pause_ms")
    )


def boundary_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cuts of two segmentations by ``file_id, cut``: kept, removed or added."""
    a, b = old.select("file_id", "cut").distinct().withColumn("o", F.lit(1)), new.select("file_id", "cut").distinct().withColumn("n", F.lit(1))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return a.join(b, ["file_id", "cut"], "full_outer").select("file_id", "cut", change.alias("change"))


def restored_words(words: DataFrame, rows: DataFrame, min_missing_ms: int = 700, most_words: int = 18) -> DataFrame:
    """Rows for stretches of words that no row covers.

    Ranges open and close among the words of their file, so words move once and no range is spelled out.
    """
    edge = lambda at, step: F.struct(at.cast("long").alias("word_id"), F.lit(step).alias("step"))
    both = F.array(edge(F.col("word_start"), 1), edge(F.col("word_end") + 1, -1))
    edges = rows.where("word_start <= word_end").select("file_id", F.inline(both))
    marked = words.select("file_id", "word_id", "surface", "start_ms", "end_ms", F.lit(0).alias("step")).unionByName(edges, allowMissingColumns=True)
    depth = F.sum("step").over(running(Window.partitionBy("file_id").orderBy("word_id", F.col("step") == 0)))
    loose = marked.withColumn("depth", depth).where("step = 0 and depth = 0").drop("step", "depth")
    w = Window.partitionBy("file_id").orderBy("word_id")
    islands = loose.withColumn("island", F.col("word_id") - F.row_number().over(w))
    own = Window.partitionBy("file_id", "island").orderBy("word_id")
    parts = islands.withColumn("k", F.floor((F.row_number().over(own) - 1) / most_words))
    return (
        parts.groupBy("file_id", "island", "k")
        .agg(
            F.min("word_id").alias("word_start"),
            F.max("word_id").alias("word_end"),
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "surface"))), lambda x: x["surface"]), " ").alias("text"),
        )
        .where(F.col("end_ms") - F.col("start_ms") >= min_missing_ms)
        .drop("island", "k")
    )


def variant(names: Column) -> Column:
    return F.lower(F.substring(names, 1, 4))
