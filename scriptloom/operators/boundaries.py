"""Boundaries between words and fragments of rows: the columns that the rules of ``functions.boundaries`` see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import boundaries as B
from scriptloom.functions import lexicons as L
from scriptloom.session import compile_long_rules, once


def clean_token(surface):
    """Lower-case token of a surface, without marks at its ends."""
    return F.lower(F.regexp_replace(surface, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def word_boundaries(words: DataFrame) -> DataFrame:
    """``file_id, word_id, codes`` of each boundary behind a word that breaks a rule.

    ``words``: ``file_id, word_id, surface, start_ms, end_ms``; times may be null. Neighbours come
    from one window over a file's words, so one shuffle serves all rules.
    """
    compile_long_rules(words.sparkSession)
    w = Window.partitionBy("file_id").orderBy("word_id")
    token = {"l": clean_token(F.col("surface"))}
    near = {"l3": F.lag("l", 2), "l2": F.lag("l", 1), "r": F.lead("l", 1), "r2": F.lead("l", 2), "r3": F.lead("l", 3)}
    near |= {"pause": F.lead("start_ms", 1), "before": F.lag("surface", 1)}
    seen = words.withColumns(token).withColumns({name: f.over(w) for name, f in near.items()})
    ended = lambda c: F.coalesce(c.rlike(r"[.!?]\s*$"), F.lit(False))
    marked = seen.withColumns(
        {
            "pause": F.col("pause") - F.col("end_ms"),
            "l_end": ended(F.col("surface")),
            "l2_end": ended(F.col("before")),
            "l_sep": F.col("surface").rlike(r"[,;:]\s*$"),
        }
    )
    coded = marked.where("r is not null").select("file_id", "word_id", B.pair_codes().alias("codes"))
    return once(coded, "codes").where("codes <> ''")


def fragments(rows: DataFrame) -> DataFrame:
    """``file_id, ord, trailing_issue, codes`` of each row that is a fragment or stands alone.

    ``rows``: ``file_id, ord, speaker, start_ms, end_ms, text``.
    """
    compile_long_rules(rows.sparkSession)
    w = Window.partitionBy("file_id").orderBy("ord")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), F.lit(0))
    near = {
        "next_first": F.lead("first", 1),
        "next_text": F.lead("text", 1),
        "previous_text": F.lag("text", 1),
        "next_start": F.lead("start_ms", 1),
        "next_speaker": F.lead("speaker", 1),
        "previous_speaker": F.lag("speaker", 1),
    }
    differs = lambda name: F.coalesce(F.col(name) != F.col("speaker"), F.lit(False))
    seen = (
        rows.withColumn("words", tokens)
        .withColumns({"n": F.size("words"), "first": F.get("words", F.lit(0)), "last": F.get("words", F.size("words") - 1), "joined": F.array_join("words", " ")})
        .withColumns({name: f.over(w) for name, f in near.items()})
        .withColumns({"pause": F.col("next_start") - F.col("end_ms"), "crossed_after": differs("next_speaker"), "crossed_before": differs("previous_speaker")})
    )
    coded = seen.select(
        "file_id", "ord", F.expr(B.trailing_fragment(B.SPARK)).alias("trailing_issue"), F.expr(B.codes(B.row_rules(B.SPARK))).alias("codes")
    )
    return once(coded, "trailing_issue", "codes").where("trailing_issue <> '' or codes <> ''")
