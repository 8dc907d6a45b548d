"""Long files cut at their largest pauses near equal shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows on either side of a target that its cut may move to.
REACH = 30


def parts(rows: DataFrame, threshold: int, reach: int = REACH) -> DataFrame:
    """``file_id, part, first_ord, last_ord, n_rows``: each file in parts of about ``threshold`` words.

    ``rows``: ``file_id, ord, start_ms, end_ms, words``. Targets are multiples of the words of a part,
    taken as row numbers; a cut moves to the longest pause around its target, if there is one that isn't
    negative; of equal pauses the first counts. Targets out of reach of the last row cut nothing. Null
    times make no pause.

    A row names the targets in whose reach it lies, so rows move once, to their file, and only the best
    row of each target is kept. It knows the next row's ``ord``, so cuts aren't joined to rows again.
    """
    w = Window.partitionBy("file_id").orderBy("ord")
    whole = Window.partitionBy("file_id")
    gap, after = F.lead("start_ms").over(w) - F.col("end_ms"), F.lead("start_ms", 2).over(w) - F.lead("end_ms").over(w)
    numbered = rows.select(
        "file_id",
        "ord",
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        gap.alias("gap"),
        (F.coalesce(gap <= F.col("start_ms") - F.lag("end_ms").over(w), F.lit(False)) | F.coalesce(gap < after, F.lit(False))).alias("beaten"),
        F.lead("ord").over(w).alias("next_ord"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.sum("words").over(whole).alias("total"),
    )
    sized = numbered.withColumn("k", F.expr(f"greatest(1, (total + {threshold} - 1) div {threshold})")).withColumn("share", F.expr("total div k"))
    # a row that a neighbour beats is no best one, but where the reach, or the file, ends
    asks = f"abs(i * share - idx) <= {reach} and (not beaten or i * share in (idx, idx + {reach}, idx - {reach} + 1) or idx >= n - 2)"
    near = F.expr(f"filter(sequence(greatest(1, idx div share - {reach} div share - 1), least(k - 1, idx div share + {reach} div share + 1)), i -> {asks})")
    # a file's ends are kept under target 0, where no part is cut
    inside = F.expr(f"k > 1 and n > k and idx div share - {reach} div share - 1 <= k - 1")
    ends = F.when((F.col("idx") == 0) | F.col("next_ord").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    asked = sized.withColumn("i", F.concat(ends, F.when(inside, near).otherwise(F.array().cast("array<bigint>")))).where(F.size("i") > 0)
    target = F.col("i") * F.col("share")
    free = (F.col("i") > 0) & (F.col("idx") >= target - reach) & (F.col("idx") < F.least(F.col("n") - 1, target + reach))
    place = F.struct(F.col("gap").alias("v"), (-F.col("idx")).alias("at"), "ord", "next_ord")
    own = F.struct((-F.col("idx")).alias("at"), "ord", "next_ord")
    best = asked.withColumn("i", F.explode("i")).groupBy("file_id", "i").agg(
        F.max(F.when(free, place)).alias("best"), F.max(F.when(F.col("idx") == target, own)).alias("own"), F.min("ord").alias("low"), F.max("ord").alias("high"), F.max("n").alias("n")
    )
    moved = F.col("best.v") >= 0
    at = lambda name: F.when(moved, F.col(f"best.{name}")).otherwise(F.col(f"own.{name}"))
    cut = F.struct((-at("at")).alias("idx"), at("ord").alias("ord"), at("next_ord").alias("next_ord"))
    is_cut = (F.col("i") > 0) & at("next_ord").isNotNull()
    files = best.groupBy("file_id").agg(
        F.sort_array(F.collect_set(F.when(is_cut, cut))).alias("cuts"), *(F.max(F.when(F.col("i") == 0, F.col(c))).alias(c) for c in ("low", "high", "n"))
    )
    # part p lies behind cut p - 1, up to cut p
    bound = lambda idx, ord_, next_ord: F.struct(idx.cast("long").alias("idx"), ord_.alias("ord"), next_ord.alias("next_ord"))
    opens = F.concat(F.array(bound(F.lit(-1), F.col("low"), F.col("low"))), "cuts")
    closes = F.concat("cuts", F.array(bound(F.col("n") - 1, F.col("high"), F.col("high"))))
    dealt = files.select("file_id", opens.alias("a"), closes.alias("b")).select("file_id", F.posexplode(F.arrays_zip("a", "b")).alias("part", "x"))
    return dealt.select(
        "file_id", F.col("part").cast("long").alias("part"), F.col("x.a.next_ord").alias("first_ord"), F.col("x.b.ord").alias("last_ord"), (F.col("x.b.idx") - F.col("x.a.idx")).alias("n_rows")
    )
