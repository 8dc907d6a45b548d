"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Everything is DataFrame functions. Two multinomials over hashed word n-grams (single words and
pairs) are estimated: the raw corpus from every row of the table, the trusted target from all
rows that labels call good. A document's score is the mean log ratio of its n-grams, and every
document is held against one threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import WORD_BREAKS, broadcast_if_small, double_array, let, words

BUCKETS = 65_536
#: Ids of good rows up to this number are broadcast to the texts; beyond it both are shuffled.
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.16
PRIOR = 5.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW_WORDS, REPEAT_PERCENT = 10, 5, 20


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def with_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words``, the words' hashes ``_one`` and those of each with the next one, ``_two``.

    Each step is a column of its own, so that it is computed once however often it is used.
    """
    n = F.greatest(F.size("_one") - 1, F.lit(0))
    return (
        docs.withColumn("_words", words(F.col(text).cast("string")))
        .withColumn("_one", F.transform("_words", lambda x: F.xxhash64(x)))
        .withColumn("_two", F.zip_with(F.slice("_one", F.lit(1), n), F.slice("_one", F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
    )


def _covered(h: Column, n: int) -> Column:
    """Places that windows of ``n`` cover whose hash ``h`` occurs more than once."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def hits(p: Column) -> Column:
        same = lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(p, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    def union(s: Column) -> Column:
        each = F.transform(s, lambda x, k: F.when(k == 0, n).otherwise(F.least(F.lit(n), x - F.get(s, k - 1))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return let(let(placed, hits), union)


def with_base(hashed: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``n_repeat_words`` and ``base_failed`` to :func:`with_hashes`.

    Windows of five words are compared by a 64-bit hash of their first two pairs and their last
    word. A window that occurs twice holds four words that do, so the others' windows of five
    are not built; only rows with an equal pair of windows are sorted.
    """
    n = WINDOW_WORDS
    part = lambda name, at, less: F.slice(name, F.lit(at), F.greatest(F.size("_one") - less, F.lit(0)))
    five = F.zip_with(part("_four", 1, n - 1), part("_one", n, n - 1), lambda a, b: F.xxhash64(a, b))
    repeats = let(five, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, n)).otherwise(F.lit(0)))
    return (
        hashed.withColumn("_four", F.zip_with(part("_two", 1, n - 2), part("_two", 3, n - 2), lambda a, b: F.xxhash64(a, b)))
        .withColumn("n_words", F.size("_one").cast("long"))
        .withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_four")) < F.size("_four"), repeats).otherwise(F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_four")
    )


def with_score(hashed: DataFrame, weights: list[float]) -> DataFrame:
    """Adds ``llr``, the mean log ratio of the words and pairs; 0 without words."""
    table = double_array(weights)
    total = F.aggregate(F.concat("_one", "_two"), F.lit(0.0), lambda a, h: a + F.get(table, _bucket(h)))
    return hashed.withColumn("llr", F.when(F.size("_one") > 0, total / (F.size("_one") + F.size("_two"))).otherwise(F.lit(0.0)))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of each bucket: the count in all rows labelled good over the one that the raw corpus lets expect.

    ``PRIOR`` n-grams are added on both sides, which leaves rare buckets near zero. Without rows
    labelled good all ratios are 0. One pass over all rows of ``docs``; the driver gets
    ``BUCKETS`` rows at most.
    """
    weights = [0.0] * BUCKETS
    if not labels.where("quality = 1").take(1):
        return weights
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct()
    trusted, small = broadcast_if_small(good, BROADCAST_IDS)
    if not small:
        trusted = trusted.hint("shuffle_hash")  # texts needn't be sorted
    seen = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    grams = with_hashes(seen).select(F.col("trusted_id").isNotNull().cast("int").alias("good"), F.explode(F.concat("_one", "_two")).alias("gram"))
    counts = grams.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()
    rate = sum(r.good for r in counts) / max(1, sum(r.raw for r in counts))
    for r in counts:
        weights[r.bucket] = round(log((r.good + PRIOR) / (r.raw * rate + PRIOR)), 9)
    return weights


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base columns, ``llr`` and ``kept`` of every row of ``doc_id, text``.

    Null text has no words, so it fails the base rules and scores 0. A score equal to the
    threshold is kept, and so is a share of repeated words equal to its limit. Without labels of
    good rows all scores are 0 and only the base rules decide. Repeated rows come back as often;
    null ids stay; an empty table gives an empty result; extra columns are ignored.
    """
    plain = _plain(docs)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WORD_BREAKS}]"))
    scored = with_score(with_base(with_hashes(plain)), log_ratios(plain, labels))
    return scored.select(
        "doc_id",
        "n_words",
        (F.length(text) - F.regexp_count(text, F.lit(f"[{WORD_BREAKS}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
        F.round("llr", 6).alias("llr"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that :func:`judge` keeps, decided row by row (no join on ids).

    Null and empty texts go, ties with the threshold stay, repeated rows and null ids stay or go
    by their text, an empty table gives an empty result, and all columns of ``docs`` come back.
    """
    weights = log_ratios(_plain(docs), labels)
    scored = with_score(with_base(with_hashes(docs.select(F.struct(*docs.columns).alias("_row")), "_row.text")), weights)
    good = ~F.col("base_failed") & (F.col("llr") >= threshold)
    # an explode of nothing drops the row; a filter would be pushed below the columns and repeat them
    return scored.select("_row", F.explode(F.when(good, F.array(F.lit(True))))).select("_row.*")
