"""Timed-text views of the standard tables, as DataFrames and as SQL with the same rows.

All arithmetic is on integers. Each SQL text is a list of common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.session import spread

SENTENCE = r"[^.!?]+[.!?]*"
SQL_WORD = r"[A-Za-z]+(?:[-''][A-Za-z]+)?|\d+(?:\.\d+)?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Fixed letters of the made-up translation: one Han character for each of a to z, and stops.
HAN_FROM, HAN_TO = "abcdefghijklmnopqrstuvwxyz.,!?", "在是个了的而把为时他她我们不有就吗这因上来到看大里出。，！？"


def han_translation(text: Column, ord_: Column) -> Column:
    """A made-up Chinese text: two letters of each word, of each third row all letters, as Han characters."""
    short = F.regexp_replace(text, "([A-Za-z]{1,2})[A-Za-z]*", "$1")
    kept = F.translate(F.lower(F.when(ord_ % 3 == 0, text).otherwise(short)), HAN_FROM, HAN_TO)
    return F.concat(
        F.when(ord_ % 7 == 1, "急剧飙升因为").when(ord_ % 7 == 2, "明显改善的").otherwise(""), F.regexp_replace(kept, "[^一-鿿。，！？]", "")
    )


def conv_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue per sentence of each conversation turn, laid end to end with pauses; each eleventh is very short."""
    rows = (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", "role", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("k", "s"))
        .withColumn("text", F.trim(F.regexp_replace("s", r"\s+", " ")))
        .where("text <> ''")
        .select(
            F.col("conv_id").alias("file_id"),
            (F.col("turn") * 1000 + F.col("k") + 1).alias("ord"),
            F.col("role").alias("speaker"),
            "text",
        )
    )
    timed = rows.withColumn("words", T.word_count(F.col("text")).cast("long")).withColumn(
        "dur_ms",
        F.when(F.col("ord") % 11 == 3, F.greatest(F.lit(120).cast("long"), F.col("words") * 45)).otherwise(
            F.greatest(F.lit(300).cast("long"), F.col("words") * 260)
        ),
    )
    timed = timed.withColumn("gap_ms", (F.col("file_id") * 7 + F.col("ord") * 131) % 2600)
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return (
        timed.withColumn("start_ms", F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(before), F.lit(0)))
        .withColumn("end_ms", F.col("start_ms") + F.col("dur_ms"))
        .withColumn("translated_text", F.when(F.col("ord") % 5 == 4, "").otherwise(han_translation(F.col("text"), F.col("ord"))))
    )


CONV_CUES = rf"""cue_lists AS (
  SELECT conv_id, turn, role, regexp_extract_all(text, '{SENTENCE}') AS l FROM conversations),
cue_rows AS (
  SELECT conv_id, turn, role, unnest(l) AS s, unnest(range(len(l))) AS k FROM cue_lists),
cue_text AS (
  SELECT conv_id AS file_id, turn * 1000 + k + 1 AS ord, role AS speaker, trim(regexp_replace(s, '\s+', ' ', 'g')) AS text FROM cue_rows),
cue_dur AS (
  SELECT *, CAST(len(regexp_extract_all(text, '{SQL_WORD}')) AS BIGINT) AS words FROM cue_text WHERE text <> ''),
cue_gap AS (
  SELECT *, CASE WHEN ord % 11 = 3 THEN greatest(120, words * 45) ELSE greatest(300, words * 260) END AS dur_ms, (file_id * 7 + ord * 131) % 2600 AS gap_ms FROM cue_dur),
cue_start AS (
  SELECT *, CAST(coalesce(sum(dur_ms + gap_ms) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM cue_gap),
conv_cues AS (
  SELECT *, start_ms + dur_ms AS end_ms, CASE WHEN ord % 5 = 4 THEN '' ELSE CASE ord % 7 WHEN 1 THEN '急剧飙升因为' WHEN 2 THEN '明显改善的' ELSE '' END || regexp_replace(translate(lower(
    CASE WHEN ord % 3 = 0 THEN text ELSE regexp_replace(text, '([A-Za-z]{{1,2}})[A-Za-z]*', '\1', 'g') END), '{HAN_FROM}', '{HAN_TO}'), '[^一-鿿。，！？]', '', 'g') END AS translated_text FROM cue_start)"""


#: Ends of a cue and starts of the next one that break a boundary rule together, and short cues that are fragments.
SPLICED_PAIRS = [
    ("on wall", "street today"), ("they are forced", "to leave"), ("we left and", "then came"), ("maybe it's", "time"), ("the china's", "market"),
    ("with both", "houses"), ("some structural", "shift came"), ("it helped", "expose it"), ("a skill", "jobs market"), ("an economic", "miracle"),
    ("we look", "at it"), ("straight", "into it"), ("they focus", "on it"), ("at ten p.m.", "to nine"), ("never", "ever again"), ("a few", "days"),
    ("massive economic", "social policy"), ("it was", "an economic and social policy"), ("it was", "late. However, he came"), ("well i", "mean it"),
    ("they were", "working"), ("we", "are here"), ("he makes", "the plan"), ("the", "house"), ("popular", "with it"), ("very clearly", "important"),
    ("seven", "houses"), ("the two", "houses"), ("they rely", "on it"), ("reason of", "it"), ("it was", "of interest"), ("a couple of", "days"),
]
SPLICED_ROWS = [
    "what a day", "never ever", "open the", "put the", "keep this", "take a", "move the", "Exactly.", "However,", "Really?", "Yes sir.", "and.", "it is done", "the big house", "we", "i mean",
    "right", "why", "yeah well", "seven eight", "themselves", "how to",
]


def spliced_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with phrases of the boundary rules at their ends and starts, and each fifth one a short fragment."""
    cues = conv_cues(spark, sf_dir).select("file_id", "ord", "speaker", "start_ms", "end_ms", F.regexp_replace("text", r"\s*[.!?]+\s*$", "").alias("text"))
    listed = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    ord_, at = F.col("ord"), F.col("ord") + F.col("file_id")
    own = F.concat_ws(" ", listed([b for _, b in SPLICED_PAIRS], at - 1), F.col("text"), listed([a for a, _ in SPLICED_PAIRS], at))
    return cues.withColumn("text", F.when(ord_ % 5 == 0, listed(SPLICED_ROWS, F.floor(ord_ / 5) + F.col("file_id"))).otherwise(F.concat(own, F.when(ord_ % 7 == 6, "?").otherwise(""))))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SPLICED_CUES = rf"""{CONV_CUES},
spliced_cues AS (SELECT file_id, ord, speaker, start_ms, end_ms, CASE WHEN ord % 5 = 0 THEN {_sql_list(SPLICED_ROWS)}[(ord // 5 + file_id) % {len(SPLICED_ROWS)} + 1]
  ELSE concat_ws(' ', {_sql_list([b for _, b in SPLICED_PAIRS])}[(ord + file_id - 1) % {len(SPLICED_PAIRS)} + 1], regexp_replace(text, '\s*[.!?]+\s*$', ''),
    {_sql_list([a for a, _ in SPLICED_PAIRS])}[(ord + file_id) % {len(SPLICED_PAIRS)} + 1]) || CASE WHEN ord % 7 = 6 THEN '?' ELSE '' END END AS text FROM conv_cues)"""


def spliced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the spliced cues, timed evenly within a cue, in items of three to eleven words."""
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = spliced_cues(spark, sf_dir).withColumn("s", parts).select("*", F.size("s").alias("n"), F.posexplode("s").alias("k", "surface"))
    at = lambda k: F.expr(f"start_ms + (end_ms - start_ms) * ({k}) div n")
    item = F.col("ord") * 1000 + F.floor(F.col("k") / (3 + F.col("ord") % 9))
    return rows.select("file_id", (F.col("ord") * 1000 + F.col("k")).alias("word_id"), item.alias("item"), "speaker", "surface", at("k").alias("start_ms"), at("k + 1").alias("end_ms"))


SPLICED_WORDS = rf"""{SPLICED_CUES},
spliced_lists AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS s FROM spliced_cues),
spliced_rows AS (SELECT *, len(s) AS n, unnest(range(len(s))) AS k, unnest(s) AS surface FROM spliced_lists),
spliced_words AS (SELECT file_id, ord * 1000 + k AS word_id, ord * 1000 + k // (3 + ord % 9) AS item, speaker, surface,
  start_ms + (end_ms - start_ms) * k // n AS start_ms, start_ms + (end_ms - start_ms) * (k + 1) // n AS end_ms FROM spliced_rows)"""


def cue_word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the cues as a row of a recogniser, with the blank behind it."""
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = conv_cues(spark, sf_dir).select("file_id", "ord", F.posexplode(parts).alias("k", "w"))
    return rows.select("file_id", (F.col("ord") * 10000 + F.col("k")).alias("row_no"), F.concat("w", F.lit(" ")).alias("text"))


def damaged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues as a model may give them back: words dropped, neighbours swapped, some turned round."""
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    ord_ = F.col("ord")
    kept = F.filter("w", lambda x, i: (i + ord_) % 7 != 3)
    swapped = F.transform("w", lambda x, i: F.coalesce(F.get(F.col("w"), (i.bitwiseXOR(F.lit(1)))), x))
    turned = F.transform(F.reverse("w"), F.reverse)
    words = F.when(ord_ % 13 == 5, turned).when(ord_ % 3 == 0, swapped).when(ord_ % 3 == 1, kept).otherwise(F.col("w"))
    return conv_cues(spark, sf_dir).select("file_id", ord_.alias("sentence_no"), "ord", parts.alias("w")).select("file_id", "sentence_no", F.array_join(words, " ").alias("text"))


#: Ends of parts with an anchor each, and what a translation makes of it; every third one is shown otherwise.
PART_ANCHORS = [
    ("over 2,500 people", "超过两千五百人"), ("in New York", "在New York"), ("about 5 million", "约五百万"), ("it was not so", "并不是这样"), ("by 30%", "百分之三十"),
    ("since the 1990s", "自1990年代"), ("of Boeing", "Boeing公司"), ("in 12 months", "十二个月内"), ("they never look like", "他们从不像"), ("with 3.5 hundred", "用350"),
]
UNSAID = "中国城市经济发展研究报告"


def allocated_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, parts and returned texts for ``allocation.validate``: all cues, four of a turn a group, with anchors.

    By rules over all rows texts are empty, repeated, torn, lose their anchor or yield it to the next part,
    ids change, and translations of groups are foreign or say more than their parts.
    """
    k, of = F.col("ord") + F.col("file_id"), len(PART_ANCHORS)
    listed = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % of + 1).cast("int"))
    group = F.floor(F.col("ord") / 1000) * 1000 + F.floor((F.col("ord") % 1000 - 1) / 4)
    cues = conv_cues(spark, sf_dir).withColumns({"group_no": group, "en": listed([a for a, _ in PART_ANCHORS]), "zh": listed([b for _, b in PART_ANCHORS])})
    w = Window.partitionBy("file_id", "group_no").orderBy("ord")
    fault = (F.col("file_id") * 3 + F.col("ord") * 5) % 17
    base = F.translate("translated_text", "不没无非未别勿", "").alias("base")
    rows = cues.select("*", base, fault.alias("fault")).withColumn("whole", F.concat("base", "zh"))
    before = lambda c: F.lag(c).over(w)
    passed = F.when(before("fault").isin(2, 5), before("zh")).otherwise("")
    own = (
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.col("base")).when(F.col("fault") == 3, F.col("base")).when(F.col("fault") == 4, before("whole"))
        .when(F.col("fault") == 5, F.lit("的话")).when(F.col("fault") == 6, F.lit("在")).otherwise(F.col("whole"))
    )
    rows = rows.withColumn("dealt", F.concat(own, F.coalesce(passed, F.lit(""))))
    name = T.subtitle_id(F.col("ord"))
    parts = rows.select("file_id", "group_no", F.col("ord").alias("part_no"), name.alias("part_id"), F.concat_ws(" ", "text", "en").alias("english"))
    given = rows.where("fault <> 9").select("file_id", "group_no", F.col("ord").alias("at"), F.when(F.col("fault") == 11, F.lit("S0000")).otherwise(name).alias("part_id"), F.col("dealt").alias("chinese"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "whole"))), lambda x: x["whole"]), "")
    groups = rows.groupBy("file_id", "group_no").agg(text.alias("t"))
    more = F.concat(F.col("t"), F.repeat(F.lit(UNSAID), F.greatest(F.lit(4), F.length("t"))))
    case = (F.col("file_id") + F.col("group_no")) % 11
    full = F.when(case == 3, F.regexp_replace("t", "[^A-Za-z0-9]+", "x")).when(case == 7, more).otherwise(F.col("t"))
    return groups.select("file_id", "group_no", full.alias("full_translation")), parts, given


#: Letters beyond ASCII are parts of words, which this engine's ``\\b`` doesn't know.
PART_ROWS = f"""{CONV_CUES},
part_plain AS (SELECT file_id, ord AS part_no, concat_ws(' ', text, {_sql_list([a for a, _ in PART_ANCHORS])}[(ord + file_id) % {len(PART_ANCHORS)} + 1]) AS written FROM conv_cues),
part_rows AS (SELECT file_id, part_no, regexp_replace(written, '[\\x{{00C0}}-\\x{{1FFF}}\\x{{3040}}-\\x{{9FFF}}]', '_', 'g') AS english FROM part_plain)"""


def event_segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as intervals of one minute per unit of value."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.col("event_id").alias("ord"),
        start.alias("start_ms"),
        (start + F.col("value").cast("long") * 60000).alias("end_ms"),
        F.col("event_type").alias("text"),
    )


EVENT_SEGS = """event_segs AS (
  SELECT user_id AS file_id, event_id AS ord, epoch_us(ts) // 1000 AS start_ms,
         epoch_us(ts) // 1000 + CAST(trunc(value) AS BIGINT) * 60000 AS end_ms, event_type AS text FROM events)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that hold more than blanks."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
        .where(F.trim("line") != "")
        .select(F.col("doc_id").alias("file_id"), (F.col("k") + 1).cast("long").alias("line_no"), "line")
    )


DOC_LINES = """doc_line_lists AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
doc_line_rows AS (SELECT doc_id AS file_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM doc_line_lists),
doc_lines AS (SELECT * FROM doc_line_rows WHERE trim(line) <> '')"""


def documents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt by their id: texts move instead of their words, which are many times larger as rows."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "text").repartition("doc_id")


def doc_words(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """Words of documents; each gets an equal share of a duration of 60 ms a character. ``by_file``: dealt by file."""
    w = F.regexp_extract_all("text", F.lit(T.L.WORD), F.lit(0))
    docs = documents_by_id(spark, sf_dir) if by_file else table(spark, sf_dir, "documents")
    rows = docs.withColumn("w", w).select("doc_id", "n_chars", F.size("w").alias("n"), F.posexplode("w").alias("k", "surface"))
    at = lambda k: F.expr(f"n_chars * 60 * ({k}) div n")
    return rows.select(
        F.col("doc_id").alias("file_id"),
        F.col("k").cast("long").alias("word_id"),
        "surface",
        F.lower("surface").alias("token"),
        at("k").alias("start_ms"),
        (at("k + 1") - F.col("k") % 7 * 15).alias("end_ms"),
    )


#: Words of a block of :func:`doc_word_blocks`.
WORD_BLOCK = 512


def doc_word_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`doc_words` as arrays: ``file_id, block, words`` of ``word_id, token, start_ms, end_ms``."""
    w = F.regexp_extract_all("text", F.lit(T.L.WORD), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", w.alias("w")).select("*", F.size("w").alias("n"))
    cut = F.expr(f"case when n > 0 then transform(sequence(0, (n - 1) div {WORD_BLOCK}), b -> slice(w, cast(b * {WORD_BLOCK} + 1 as int), {WORD_BLOCK})) end")
    rows = docs.select(F.col("doc_id").alias("file_id"), "n_chars", "n", F.posexplode(cut).alias("block", "w"))
    at = lambda k: f"n_chars * 60 * ({k}) div n"
    place = f"(block * {WORD_BLOCK} + i)"
    word = f"struct(cast({place} as bigint) as word_id, lower(x) as token, {at(place)} as start_ms, {at(place + ' + 1')} - {place} % 7 * 15 as end_ms)"
    return rows.select("file_id", "block", F.expr(f"transform(w, (x, i) -> {word})").alias("words"))


DOC_WORDS = rf"""doc_word_lists AS (SELECT doc_id, n_chars, regexp_extract_all(text, '{SQL_WORD}') AS w FROM documents),
doc_word_rows AS (SELECT doc_id, n_chars, len(w) AS n, unnest(range(len(w))) AS k, unnest(w) AS surface FROM doc_word_lists),
doc_words AS (SELECT doc_id AS file_id, k AS word_id, surface, lower(surface) AS token,
  n_chars * 60 * k // n AS start_ms, n_chars * 60 * (k + 1) // n - k % 7 * 15 AS end_ms FROM doc_word_rows)"""


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"),
        (F.col("user_id") % 10).alias("service"),
        F.to_date("ts").alias("usage_date"),
        F.col("value").cast("long").alias("tokens"),
        "ts",
        "event_id",
    )


USAGE_LOG = """usage_log AS (SELECT event_type AS operation, user_id % 10 AS service, CAST(ts AS DATE) AS usage_date,
  CAST(trunc(value) AS BIGINT) AS tokens, ts, event_id FROM events)"""


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of part names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", r"\s+")).alias("name")).distinct()


def expected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def returned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids, some twice and some unknown, as an unreliable provider would return them."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return ids.union(ids.where("id % 50 = 0")).union(ids.where("id % 70 = 0").select(F.col("id") + 10000000))


RETURNED_IDS = """returned AS (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0
  UNION ALL SELECT doc_id + 10000000 FROM labels WHERE doc_id % 70 = 0)"""
