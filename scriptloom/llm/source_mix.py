"""Mixing sources to target weights with a low-discrepancy schedule.

* Targets: sources by code point weigh 3, 1, 2, repeating; they share ``SHARE`` of all words,
  none above ``EPOCHS`` times its size, the excess going to the others by weight.
* Schedule: the mix has as many slots as blocks fit into the sum of the targets. Slot ``i`` maps
  the golden-ratio point ``frac((i + 1) * phi)`` through the cumulative targets to a source;
  slots are ranked per source. The number of a source's slots is what the mix takes of it:
  near its target, by a few blocks at most, as the sequence is of low discrepancy.
* Blocks: every source's documents in hashed order form one stream of words, repeated for a
  second epoch and cut into blocks of equal numbers of words.
* Slot ``r`` of a source joins block ``r``. Slots behind a source's last block stay empty.

Ranks and running sums are taken in bounded parts and joined with the sums of the parts before,
so a source that holds most rows is spread over many tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import broadcast_if_small, cut, words

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2
BLOCK_WORDS = 128
#: The golden ratio's fraction and the points it yields, in units of 2 ** -40: exact for up to 2 ** 40 slots.
BITS = 40
GOLDEN = 679_535_556_991
#: Documents, and schedule slots, that are summed or ranked in one task.
PART_ROWS = 2_000
#: Sources, and ranges of sources, that may be broadcast.
BROADCAST_SOURCES = 500_000


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, epochs: float = EPOCHS) -> dict[str | None, float]:
    """Words wanted of each source. ``sizes``: source and words; sources are few (one row each)."""
    ordered = sorted(sizes, key=lambda p: (p[0] is None, p[0] or ""))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, (s, _) in enumerate(ordered)}
    cap = {s: epochs * n for s, n in ordered}
    found: dict[str | None, float] = {}
    left = share * sum(n for _, n in ordered)
    open_ = [s for s, _ in ordered]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not full:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            found[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_ = [s for s in open_ if s not in found]
    return found


def _place() -> Column:
    """Place of a document in its source's shuffled stream, from 40 bits of a hash: exact in doubles.

    The text takes part, so rows without an id, or of one id, are spread like others.
    """
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")), 24)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, place`` of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), _place().alias("place")
    )


def golden_point(slot: Column) -> Column:
    """``frac((slot + 1) * phi)`` in units of ``2 ** -BITS``, by halves so that no product overflows."""
    half = BITS // 2
    high, low = GOLDEN >> half, GOLDEN & ((1 << half) - 1)
    k = slot + 1
    return F.pmod(F.shiftleft(F.pmod(k * high, F.lit(1 << half)), half) + k * low, F.lit(1 << BITS))


def schedule(spark, goals: list[tuple[int, int]], block: int, point=golden_point) -> DataFrame:
    """``slot, sid, rank`` from ``(sid, words wanted)``: who gives each block of the mix, in order.

    ``point`` maps a slot to its place in ``[0, 2 ** BITS)``.
    """
    wanted = [(s, n) for s, n in goals if n > 0]
    total = sum(n for _, n in wanted)
    n_slots = -(-total // block)
    # the cumulative targets as ranges of points, each under every cell of a grid that it touches
    cells = max(1, 4 * len(wanted)).bit_length()
    edges, ranges = [0], []
    for s, n in wanted:
        edges.append(edges[-1] + n)
        low, high = (e * (1 << BITS) // total for e in edges[-2:])
        if high > low:
            ranges += [(c, s, low, high) for c in range(low >> (BITS - cells), ((high - 1) >> (BITS - cells)) + 1)]
    # at most nine rows a source
    grid = spark.createDataFrame(ranges or [(0, 0, 0, 0)], "cell long, sid int, low long, high long")
    parts = max(1, -(-n_slots // PART_ROWS))
    slots = (
        spark.range(0, n_slots, 1, min(parts, 4096))
        .withColumn("point", point(F.col("id")))
        .withColumn("cell", F.shiftright("point", BITS - cells))
        .join(broadcast_if_small(grid, BROADCAST_SOURCES)[0], "cell")
        .where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select(F.col("id").alias("slot"), "sid", F.floor(F.col("id") / PART_ROWS).alias("part"))
    )
    counts = slots.groupBy("sid", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        slots.withColumn("k", F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1)
        .join(bases, ["sid", "part"])
        .select("slot", "sid", (F.col("base") + F.col("k")).alias("rank"))
    )


def mix(docs: DataFrame, block: int = BLOCK_WORDS, point=golden_point) -> tuple[DataFrame, DataFrame]:
    """The mix's pieces and the sized documents.

    Pieces: ``slot, sid, rank, row, taken``, the words that a slot takes of a document.
    Documents: ``row, doc_id, source, sid, size, place, source_size, target``.

    Null text has no words; a null source is a source of its own, last in order. Repeated rows
    are documents of their own. An empty table gives empty results. The driver gets one row a
    source.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs)).withColumn("row", F.monotonically_increasing_id())
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([(r["source"], r["size"]) for r in ordered])
    table = [
        (k, r["source"], r["size"], float(goal[r["source"]]), max(1, -(-r["n"] // PART_ROWS))) for k, r in enumerate(ordered)
    ]
    sources = spark.createDataFrame(table, "sid int, source_name string, source_size long, target double, parts int")
    sources, _ = broadcast_if_small(sources, BROADCAST_SOURCES)
    known = rows.join(sources, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    # parts are ranges of the order, so the stream runs through them one after the other
    hashed = known.withColumn("part", F.floor(F.col("place") * F.col("parts") / F.lit(float(1 << 40))).cast("int"))
    per_part = hashed.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    run = Window.partitionBy("sid", "part").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        hashed.where("size > 0")
        .withColumn("within", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(bases, ["sid", "part"])
        .withColumn("first", F.col("base") + F.col("within"))
    )
    epoch = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn(
        "start", F.col("first") + F.col("epoch") * F.col("source_size")
    )
    cutup = (
        epoch.withColumn("end", F.col("start") + F.col("size"))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
        .select(
            "sid",
            "rank",
            "row",
            (F.least("end", (F.col("rank") + 1) * block) - F.greatest("start", F.col("rank") * block)).alias("taken"),
        )
    )
    slots = schedule(spark, [(k, round(t)) for k, _, _, t, _ in table], block, point)
    return slots.join(cutup, ["sid", "rank"]), known.drop("parts")


def taken_words(docs: DataFrame, block: int = BLOCK_WORDS, point=golden_point, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, first_slot`` of every row.

    ``taken`` counts repeats; ``first_slot`` is the first slot of the schedule that reads the
    document (null if none does). ``more``: further columns of the sized documents. Nulls,
    repeated rows and empty tables as in :func:`mix`; rows that tie in a source's order are equal.
    """
    pieces, known = mix(docs, block, point)
    sums = pieces.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return known.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", taken, "first_slot", *more)


def repeat_to_targets(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` in the mix, each as often as the mix reads it, rounded to whole documents.

    Within a source the mix reads a document as often as its neighbours in the stream, once more
    before the place where the source's slots end. So one row per source (times, last place of
    the additional reading) says it all, and texts are not shuffled. Documents without words
    stay out; a null source is a source of its own; rows that are equal in id, source and text
    share their fate; an empty table gives an empty result. Columns are those of ``docs``.
    """
    counted = taken_words(docs.select("doc_id", "source", "text"), block, more=("source", "place")).where("size > 0")
    told = counted.select("source", "place", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times"))
    least = told.groupBy("source").agg(F.min("times").alias("least"), F.max("times").alias("most"))
    last = told.groupBy("source", "times").agg(F.max("place").alias("last"))
    rule = least.alias("l").join(last.alias("m"), F.col("l.source").eqNullSafe(F.col("m.source")) & (F.col("l.most") == F.col("m.times")))
    named = rule.select(*(F.col(f"{side}.{name}").alias(f"__mix_{name}") for side, name in (("l", "source"), ("l", "least"), ("l", "most"), ("m", "last"))))
    named, _ = broadcast_if_small(named, BROADCAST_SOURCES)
    again = F.when(_place() <= F.col("__mix_last"), F.col("__mix_most")).otherwise(F.col("__mix_least"))
    return (
        docs.join(named, F.col("source").eqNullSafe(F.col("__mix_source")))
        .where(n_words(F.col("text")) > 0)
        .withColumn("__mix_times", again)
        .where("__mix_times > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
        .select(*docs.columns)
    )
