"""Phrase collocation mining: n-grams as rows, hash-aggregated per language, scored by their cuts.

Every phrase of 1 to ``max_n`` words becomes a row where it may be frequent: single words
everywhere, longer phrases where each pair of neighbours is frequent itself, as a phrase occurs
no more often than a pair in it. Frequent pairs come from a first pass that counts pairs by a
64-bit hash; they reach the second pass as a bit map of fixed size, whose collisions add rows
but lose none. Counts, scores and ranks are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.llm.common import LOWER, UPPER, broadcast_if_small, cut
from scriptloom.session import map_arrow

MAX_N, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of the map of frequent pairs: 16 MB. It holds ten million pairs with few collisions; beyond
#: that more phrases than needed become rows.
FILTER_BITS = 27
#: Rows of one output batch, entries of a worker's memo of word hashes.
OUT_ROWS, MEMO = 50_000, 500_000
#: Parts that one-word keys are dealt to, and those that a language's ranking is prepared in.
SALTS, RANK_PARTS = 8, 64
LANGS = 10_000
_BREAK = b"\n"
_CODES = bytes.maketrans((UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())


class _Hashes(dict):
    """64-bit hashes of words; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = 0 if word == _BREAK else xxhash.xxh64_intdigest(word, 13) | 1
        return value


def _tokens(text: str | None) -> list[bytes]:
    """Lower-cased words in order, with a line feed between pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_CODES)
    return [t for t in data.replace(b"\n", b" \n ").split(b" ") if t]


def _pairs(tokens: list[bytes], hashes: _Hashes, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token with the next one, and whether both are words."""
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 17)))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed, (h[:-1] != 0) & (h[1:] != 0)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for lang, text in zip(batch.column(0), batch.column(1)):
        yield lang.as_py(), _tokens(text.as_py())


def frequent_pairs(docs: DataFrame, min_count: int) -> np.ndarray:
    """Bit map of the pairs of ``lang, text`` that occur ``min_count`` times; no pair is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for lang, tokens in _texts(batch):
                h, both = _pairs(tokens, hashes, lang)
                if len(h := h[both].view(np.int64)):
                    yield from (pa.RecordBatch.from_arrays([pa.array(h[i : i + OUT_ROWS])], names=["h"]) for i in range(0, len(h), OUT_ROWS))

    seen = map_arrow(docs, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = seen.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def phrases(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, phrase`` rows of ``lang, text``: each occurrence of every word and of all phrases that may be frequent."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, min_count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), frequent.value
        for batch in batches:
            for lang, tokens in _texts(batch):
                h, both = _pairs(tokens, hashes, lang)
                at = h >> np.uint64(64 - FILTER_BITS)
                ok = both & ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
                found = [t for t in tokens if t != _BREAK]
                fits = ok
                for n in range(2, max_n + 1):
                    found += [b" ".join(tokens[i : i + n]) for i in np.flatnonzero(fits).tolist()]
                    fits = fits[:-1] & ok[n - 1 :] if len(fits) else fits
                for i in range(0, len(found), OUT_ROWS):
                    part = found[i : i + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())], names=["lang", "phrase"])

    return map_arrow(docs, run, "lang string, phrase string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _part(words: str, start: str, size: str):
    return F.expr(f"array_join(slice({words}, {start}, {size}), ' ')")


def scored(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Candidates of ``counts`` (``lang, phrase, a``) with their lowest-scoring cut: adds ``n, l, r, score``.

    A one-word part may belong to a large share of all candidates; such keys are salted.
    """
    totals, _ = broadcast_if_small(counts.where("instr(phrase, ' ') = 0").groupBy(F.col("lang").alias("of")).agg(F.sum("a").alias("n")), LANGS)
    known = counts.where(F.col("a") >= min_count)
    salts = F.when(F.instr("phrase", " ") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    side = lambda name: known.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part"), F.col("a").alias(name), F.explode(salts).alias("salt_"))

    def with_count(cuts: DataFrame, part: str, name: str) -> DataFrame:
        salt = F.when(F.instr(part, " ") == 0, F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        keys = (F.col("lang") == F.col("lang_")) & (F.col(part) == F.col("part")) & (F.col("salt") == F.col("salt_"))
        return cuts.withColumn("salt", salt).join(side(name), keys).drop("lang_", "part", "salt", "salt_")

    cuts = (
        known.where("instr(phrase, ' ') > 0")
        .withColumn("words", F.split("phrase", " "))
        .withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
        .select("lang", "phrase", "a", "k", _part("words", "1", "k").alias("first"), _part("words", "k + 1", "size(words) - k").alias("rest"))
    )
    cuts = with_count(with_count(cuts, "first", "l"), "rest", "r").join(totals, F.col("lang") == F.col("of"))
    exact = lambda name: f"cast({name} as decimal(19, 0))"
    score = F.expr(f"(cast({exact('a')} * {exact('n')} as decimal(34, 0)) * 1000) div ({exact('l')} * {exact('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def not_contained(found: DataFrame) -> DataFrame:
    """Drops phrases that a longer one contains and that occur no more often than it.

    A phrase between the two occurs as often as both, so extensions by one word are enough.
    """
    words = found.where("instr(phrase, ' ') > 0").withColumn("words", F.split("phrase", " "))
    inner = F.array(_part("words", "1", "size(words) - 1"), _part("words", "2", "size(words) - 1"))
    inside = words.select("lang", F.explode(inner).alias("phrase"), "a").where("instr(phrase, ' ') > 0")
    return found.join(inside, ["lang", "phrase", "a"], "left_anti")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; parts of a language are ranked before they meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Collocations of ``lang, text``: ``lang, rank, phrase, a, l, r, n, score``.

    A null language is ``und``, null and empty texts have no words; repeated rows count as often;
    a language without candidates, and so an empty table, gives no rows; ties go to the more
    frequent and then the smaller phrase; extra columns are ignored. A product ``a * n`` beyond
    34 digits is an error, not a wrong score.
    """
    counts = phrases(_plain(docs), max_n, min_count).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("a"))
    counts = cut(counts.where((F.col("a") >= min_count) | (F.instr("phrase", " ") == 0)))
    return ranked(not_contained(scored(counts, min_count)), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
