"""Caption audit: issue rows, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import lexicons as L
from scriptloom.functions import text as T
from scriptloom.operators.windows import boundary_issues, group_text, ordered, semantic_groups

ISSUE = ["file_id", "ord", "level", "code", "value"]


def _coded(pairs: list[tuple[str, str, Column, Column]]) -> Column:
    """Array of ``level, code, value`` structs of the rules that hold."""
    return F.array_compact(
        F.array(
            *[
                F.when(rule, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value.cast("double").alias("value")))
                for level, code, rule, value in pairs
            ]
        )
    )


def cue_issues(cues: DataFrame, max_words: int = L.HARD_WORDS) -> DataFrame:
    """Issues of single cues and their pauses, one pass and one shuffle by file.

    ``cues``: ``file_id, ord, start_ms, end_ms, text, translated_text``. Returns :data:`ISSUE`.
    """
    duration = F.col("end_ms") - F.col("start_ms")
    words, han = T.word_count(F.col("text")), T.han_count(F.col("translated_text"))
    load = words + han
    seconds = duration / 1000
    gap = F.col("start_ms") - F.lag("end_ms").over(ordered(order=("ord",)))
    timed = cues.withColumns(
        {
            "d": duration,
            "w": words,
            "h": han,
            "gap": gap,
            "answer": T.simple_response(F.col("text"), F.col("translated_text")),
        }
    )
    d, w, h = F.col("d"), F.col("w"), F.col("h")
    load, seconds = w + h, d / 1000
    invalid = (d > 0) & ((d < L.DURATION_INVALID_MS) | ((d < L.DURATION_ERROR_MS) & ~F.col("answer") & (load > 4)))
    cps = F.when(d > 0, h / seconds)
    wps = F.when(d > 0, w / seconds)
    severe = (cps > L.CHINESE_CPS_ERROR) & (d >= 1200) & (h >= 12)
    rules = [
        ("error", "invalid_timing", d <= 0, d),
        ("warning", "coverage_gap_unverified", F.col("gap") > L.GAP_ERROR_MS, F.col("gap")),
        ("warning", "coverage_gap_warning", (F.col("gap") > L.GAP_WARNING_MS) & (F.col("gap") <= L.GAP_ERROR_MS), F.col("gap")),
        ("error", "subtitle_duration_invalid", invalid, d),
        ("warning", "subtitle_duration_too_short", ~invalid & (d > 0) & (d < L.DURATION_WARNING_MS), d),
        ("warning", "short_duration", (d > 0) & (d < L.SHORT_MS), d),
        ("error", "overlong_english", w > max_words, w),
        ("error", "missing_chinese", (T.blank(F.col("text")) != "") & (T.blank(F.col("translated_text")) == ""), w),
        ("warning", "english_speed_warning", wps > L.ENGLISH_WPS, F.round(wps, 2)),
        ("error", "chinese_speed_error", severe, F.round(cps, 2)),
        ("warning", "chinese_speed_warning", (cps > L.CHINESE_CPS) & ~severe, F.round(cps, 2)),
    ]
    return timed.withColumn("issue", F.explode(_coded(rules))).select("file_id", "ord", "issue.level", "issue.code", "issue.value")


def suspicious_words(cues: DataFrame) -> DataFrame:
    """Patterns of misrecognised English: ``file_id, ord, code, confidence``."""
    low = F.lower(T.blank(F.col("text")))
    rules = [("asr_repeated_word", F.col("text").rlike(L.REPEATED_WORD), "high")]
    rules += [(code, low.rlike(pattern), confidence) for code, pattern, confidence in L.SUSPICIOUS]
    hits = F.array_compact(
        F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(c).alias("confidence"))) for code, rule, c in rules])
    )
    return cues.withColumn("hit", F.explode(hits)).select("file_id", "ord", "hit.code", "hit.confidence")


def chinese_group_findings(cues: DataFrame) -> DataFrame:
    """Structure findings of semantic groups: ``file_id, group_no, code, high``."""
    rows = semantic_groups(cues.where("text <> '' or translated_text <> ''"))
    w = Window.partitionBy("file_id", "group_no").orderBy("ord")
    left = F.regexp_replace(T.blank(F.col("translated_text")), r"[，。！？；：,.!?;:]+$", "")
    follows = F.lead("translated_text").over(w)
    broken = follows.isNotNull() & (
        left.rlike("(?:" + "|".join(L.DANGLING_ENDINGS) + ")$") | (left.endswith("的") & follows.rlike(r"^[，。！？；：,.!?;:]"))
    )
    flags = rows.withColumn("broken", F.coalesce(broken, F.lit(False))).groupBy("file_id", "group_no").agg(F.bool_or("broken").alias("broken"))
    text = group_text(rows).where("text <> '' and translated_text <> ''").join(flags, ["file_id", "group_no"])
    compact = F.regexp_replace("translated_text", r"\s+", "")
    hit = {code: F.lit(False) for code in L.CHINESE_FINDINGS}
    for code, patterns in L.CHINESE_FINDINGS.items():
        for p in patterns:
            hit[code] = hit[code] | compact.rlike(p)
    hit["dangling_preposition"] = hit["dangling_preposition"] | F.col("broken")
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in hit.items()]))
    return (
        text.withColumn("codes", codes)
        .where(F.size("codes") > 0)
        .withColumn("high", F.size("codes") >= 2)
        .select("file_id", "group_no", F.explode("codes").alias("code"), "high")
    )


def all_issues(cues: DataFrame) -> DataFrame:
    """Union of the issue sets under one schema."""
    syntax = boundary_issues(cues).select(
        "file_id", "ord", F.lit("warning").alias("level"), F.lit("syntax_boundary_audit").alias("code"), F.col("confidence_score").alias("value")
    )
    words = suspicious_words(cues).select("file_id", "ord", F.lit("warning").alias("level"), "code", F.lit(None).cast("double").alias("value"))
    return cue_issues(cues).unionByName(syntax).unionByName(words)


def rollup(cues: DataFrame) -> DataFrame:
    """One row per file: counts, word and duration metrics, status.

    Issues are counted within their cue and both sums share the file's shuffle.
    """
    issues = cue_issues(cues).groupBy("file_id").agg(
        F.count(F.when(F.col("level") == "error", 1)).alias("errors"), F.count(F.when(F.col("level") == "warning", 1)).alias("warnings")
    )
    w = F.when(T.blank(F.col("text")) != "", T.word_count(F.col("text")))
    d = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.col("start_ms"))
    metrics = cues.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_cues"),
        F.coalesce(F.max(w), F.lit(0)).cast("long").alias("max_words"),
        F.round(F.coalesce(F.avg(w), F.lit(0.0)), 2).alias("avg_words"),
        F.round(F.avg(d), 2).alias("avg_duration_ms"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return metrics.join(issues, "file_id", "left").select(
        "file_id",
        "n_cues",
        "max_words",
        "avg_words",
        "avg_duration_ms",
        zero("errors").alias("errors"),
        zero("warnings").alias("warnings"),
        F.when(zero("errors") > 0, "ERROR").when(zero("warnings") > 0, "WARNING").otherwise("PASS").alias("status"),
    )


def severity_pivot(rows: DataFrame, by: list[str], kind: str, values: list[str]) -> DataFrame:
    """Counts per key with a column for each severity."""
    wide = rows.groupBy(*by).agg(*[F.count(F.when(F.col(kind) == v, 1)).alias(f"n_{v.lower()}") for v in values])
    return wide


def first_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows per key; the planner drops the rest before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ledger_comparison(words: DataFrame) -> DataFrame:
    """Word ledgers per file: durations, order errors and pause statistics."""
    w = Window.partitionBy("file_id").orderBy("word_id")
    latest = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    rows = words.withColumns({"d": F.col("end_ms") - F.col("start_ms"), "gap": gap, "late": latest})
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.min("d").alias("min_ms"),
        F.max("d").alias("max_ms"),
        F.count(F.when(F.col("start_ms") < F.col("late"), 1)).alias("order_errors"),
        F.count(F.when(F.col("gap") > 300, 1)).alias("gaps_300"),
        F.count(F.when(F.col("gap") > 500, 1)).alias("gaps_500"),
        F.count(F.when(F.col("gap") > 800, 1)).alias("gaps_800"),
        F.max("gap").alias("max_gap_ms"),
    )


def rank_quantile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """``sorted(values)[int(n * p)]`` per key (A15), by counts of distinct values, not lists."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(run)})
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * p))
    return placed.where(F.col("upto") > at).groupBy(by).agg(F.max("total").alias("n_values"), F.min(value).alias("quantile"))


def guard_summary(cues: DataFrame) -> DataFrame:
    """Counters that a repair must not raise."""
    d = F.col("end_ms") - F.col("start_ms")
    return cues.groupBy("file_id").agg(
        F.count(F.when(T.blank(F.col("translated_text")) == "", 1)).alias("missing_translation"),
        F.count(F.when(T.severe_chinese_speed(F.col("translated_text"), F.col("start_ms"), F.col("end_ms")), 1)).alias("severe_speed"),
        F.count(F.when((d > 0) & (d < L.DURATION_INVALID_MS), 1)).alias("duration_errors"),
        F.count(F.when(T.word_count(F.col("text")) > L.HARD_WORDS, 1)).alias("overlong"),
    )


def load_flags(cues: DataFrame) -> DataFrame:
    """Display-load predicates and targets of each cue."""
    text, zh, a, b = F.col("text"), F.col("translated_text"), F.col("start_ms"), F.col("end_ms")
    return cues.select(
        "file_id",
        "ord",
        T.high_load(text, zh, a, b).alias("high_load"),
        T.severe_chinese_speed(zh, a, b).alias("severe_speed"),
        T.chinese_pressure(zh, a, b).alias("speed_pressure"),
        T.target_chinese(b - a).alias("target_chars"),
        T.most_chinese(b - a).alias("most_chars"),
        T.target_duration(T.word_count(text), T.han_count(zh)).alias("target_ms"),
    )
