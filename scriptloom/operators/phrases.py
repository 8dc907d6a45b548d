"""Phrases looked up in texts by an index of token places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import lexicons as L
from scriptloom.session import checkpointed

#: Rows up to which the phrases' tokens are broadcast; more are joined by a shuffle.
SMALL = 200_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(L.WORD), F.lit(0))


def index(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``text_id, sentence, pos, token`` of the tokens in ``wanted`` (``token``): sentences end at stops and line ends."""
    sentences = texts.select("text_id", F.posexplode(F.split("text", r"[.\n]")).alias("sentence", "s"))
    places = sentences.select("text_id", "sentence", F.posexplode(_tokens(F.col("s"))).alias("pos", "token"))
    return places.join(_few(wanted), "token", "left_semi")


def evidence(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase_id, text_id, hits, sentence, pos``: how often a phrase stands in a text, and where first.

    ``texts``: ``text_id, text``; ``phrases``: ``phrase_id, phrase``. A phrase is a run of tokens
    within a sentence. Its places are those of its rarest token, shifted to its start, that all
    other tokens confirm by equality: neither texts nor common tokens' lists are paired with
    phrases. Null and empty phrases and texts have no places; repeated ids of phrases are one.
    """
    asked = phrases.select("phrase_id", _tokens(F.col("phrase")).alias("tokens")).where(F.size("tokens") > 0).dropDuplicates(["phrase_id"])
    parts = asked.select("phrase_id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("k", "token"))
    places = checkpointed(index(texts, parts.select("token").distinct()))  # read four times below
    counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = parts.join(_few(counts), "token", "left")
    whole = known.groupBy("phrase_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "k", "token", "size")).alias("rare")).where("least > 0")
    rare = whole.select("phrase_id", "rare.k", "rare.token", "rare.size")
    starts = places.join(_few(rare), "token").select("phrase_id", "text_id", "sentence", (F.col("pos") - F.col("k")).alias("start"), "size").where("start >= 0")
    single, longer = starts.where("size = 1"), starts.where("size > 1")
    needed = longer.join(_few(parts.select("phrase_id", F.col("k"), "token")), "phrase_id").withColumn("pos", F.col("start") + F.col("k"))
    met = needed.join(places, ["text_id", "sentence", "pos", "token"]).groupBy("phrase_id", "text_id", "sentence", "start", "size").agg(F.count(F.lit(1)).alias("met"))
    found = single.select("phrase_id", "text_id", "sentence", "start").union(met.where("met = size").select("phrase_id", "text_id", "sentence", "start"))
    first = F.min(F.struct("sentence", "start")).alias("first")
    return found.groupBy("phrase_id", "text_id").agg(F.count(F.lit(1)).alias("hits"), first).select("phrase_id", "text_id", "hits", "first.sentence", F.col("first.start").alias("pos"))
