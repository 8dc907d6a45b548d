"""Splitting rows: timed words, proportional parts, clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import lexicons as L
from scriptloom.functions import text as T


def timed_words(rows: DataFrame) -> DataFrame:
    """Rows as words; time goes by started groups of four letters and is cut at the row's end.

    Words are numbered within their row, so sums run over an array and need no shuffle.
    """
    w = F.regexp_extract_all(T.blank(F.col("text")), F.lit(L.TIMED_WORD), F.lit(0))
    units = lambda x: F.ceil(F.length(x) / 4)
    base = rows.withColumn("w", w).where(F.size("w") > 0)
    base = base.withColumn("unit", (F.col("end_ms") - F.col("start_ms")) / F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + units(x)))
    each = F.transform("w", lambda x: (F.col("unit") * units(x)).cast("long"))
    base = base.withColumn("each", each)
    upto = lambda k: F.least(
        F.col("end_ms"), F.col("start_ms") + F.aggregate(F.slice("each", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)
    )
    return base.select("*", F.posexplode("w").alias("k", "word")).select(
        "file_id", "ord", F.col("k").cast("long").alias("k"), "word", upto(F.col("k")).alias("word_start_ms"), upto(F.col("k") + 1).alias("word_end_ms")
    )


def proportional_parts(rows: DataFrame, separator: str) -> DataFrame:
    """Rows split at a separator; parts share the time by words."""
    parts = rows.withColumn("parts", F.split("text", separator)).select(
        "file_id", "ord", "start_ms", "end_ms", F.posexplode("parts").alias("k", "part")
    )
    w = Window.partitionBy("file_id", "ord")
    weighed = parts.withColumn("weight", F.greatest(F.lit(1), T.word_count(F.col("part"))).cast("long")).withColumns(
        {"upto": F.sum("weight").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("weight").over(w)}
    )
    at = lambda n: F.expr(f"start_ms + (end_ms - start_ms) * ({n}) div total")
    return weighed.select("file_id", "ord", "k", "part", at("upto - weight").alias("part_start_ms"), at("upto").alias("part_end_ms"))


def clauses(rows: DataFrame, column: str = "line") -> DataFrame:
    """Rows as clauses: cut behind marks and before connectives."""
    cut = F.transform(F.split(F.col(column), L.CLAUSE_CUT), lambda x: F.trim(x))
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(F.filter(cut, lambda x: x != "")).alias("k", "clause"))


def n_partitions(words: int, threshold: int = 500) -> int:
    """Pieces a long input is dealt in."""
    return max(1, -(-words // threshold))
