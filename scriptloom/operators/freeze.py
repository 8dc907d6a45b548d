"""Frozen payloads before and after a step: which changed, and where first.

A tree of hashes of three levels: rows, blocks of ``BLOCK`` ordinals, payloads. Hashes of rows of both sides are
added up per block in one pass, with map-side combining, so that a block that stayed the same is zero; rows are
looked at, and moved, for the first unequal block of a payload only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.session import checkpointed

BLOCK = 256
#: First unequal blocks that may be broadcast (some 60 bytes each); with more, rows are shuffled to them.
BROADCAST_BLOCKS = 500_000
KEY = ["file_id", "payload"]


def _sides(before: DataFrame, after: DataFrame, block: int) -> DataFrame:
    side = lambda df, sign: df.select(*KEY, F.col("ord").cast("long").alias("ord"), F.col("value").cast("string").alias("value"), F.lit(sign).alias("side"))
    return side(before, 1).unionByName(side(after, -1)).withColumn("block", F.floor(F.col("ord") / block))


def blocks(before: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file_id, payload, block, n_before, n_after, unequal`` for every block of both sides.

    A block is equal if as many rows of each side have equal ordinals and values, by 96 bits of two hashes.
    """
    rows = _sides(before, after, block)
    first, second = F.xxhash64("ord", "value"), F.shiftrightunsigned(F.xxhash64(F.lit("b"), "value", "ord"), 32)
    sums = rows.groupBy(*KEY, "block").agg(
        F.bit_xor(first).alias("x"),
        F.sum(F.col("side") * second).alias("s"),
        F.sum((F.col("side") > 0).cast("long")).alias("n_before"),
        F.sum((F.col("side") < 0).cast("long")).alias("n_after"),
    )
    unequal = (F.col("x") != 0) | (F.col("s") != 0) | (F.col("n_before") != F.col("n_after"))
    return sums.select(*KEY, "block", "n_before", "n_after", unequal.alias("unequal"))


def first_differences(before: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file_id, payload, n_before, n_after, unequal_blocks, first_ord, value_before, value_after`` of every payload.

    Both sides: ``file_id, payload, ord, value``, the rows of a payload by their ordinals; other columns are
    ignored. ``first_ord`` is null for payloads that stayed the same. A row that one side lacks is a difference, its
    value there null; a null value differs from all others and from a lacking row. Of an ordinal that a side
    repeats, all values are compared and the least is shown. Files and payloads without a name match each other.
    """
    found = blocks(before, after, block)
    sums = found.groupBy(*KEY).agg(
        F.sum("n_before").alias("n_before"),
        F.sum("n_after").alias("n_after"),
        F.sum(F.col("unequal").cast("long")).alias("unequal_blocks"),
        F.min(F.when(F.col("unequal"), F.col("block"))).alias("block"),
    )
    payloads = checkpointed(sums)
    changed = payloads.where("block is not null").select(*(F.col(c).alias(f"at_{c}") for c in [*KEY, "block"]))
    place = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in KEY] + [F.col("block") == F.col("at_block")]
    few = changed.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    near = _sides(before, after, block).join(F.broadcast(changed) if few else changed, place, "left_semi")
    values = lambda sign: F.sort_array(F.collect_list(F.when(F.col("side") == sign, F.struct("value"))))
    pairs = near.groupBy(*KEY, "ord").agg(values(1).alias("b"), values(-1).alias("a")).where("not (b <=> a)")
    one = lambda c: F.get(c, F.lit(0))["value"]
    first = pairs.groupBy(*KEY).agg(F.min(F.struct("ord", one("b").alias("b"), one("a").alias("a"))).alias("d"))
    first = first.select(*(F.col(c).alias(f"at_{c}") for c in KEY), "d")
    rows = payloads.join(first, place[:2], "left")
    shown = {"first_ord": "d.ord", "value_before": "d.b", "value_after": "d.a"}
    return rows.select(*KEY, "n_before", "n_after", "unequal_blocks", *(F.col(c).alias(name) for name, c in shown.items()))


def isolation(before: DataFrame, after: DataFrame, block: int = BLOCK) -> DataFrame:
    """``file_id, passed, changed, differences``: each file's changed payloads by name, and their first differences."""
    rows = first_differences(before, after, block)
    difference = F.when(F.col("unequal_blocks") > 0, F.struct("payload", "first_ord", "value_before", "value_after"))
    found = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(difference)).alias("differences"))
    return found.select("file_id", (F.size("differences") == 0).alias("passed"), F.col("differences.payload").alias("changed"), "differences")
