"""Registered queries of the caption operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.functions import boundary_words as BW
from scriptloom.functions import lexicons as L
from scriptloom.functions import text as T
from scriptloom.operators import audit, intervals, joins, setops, windows
from scriptloom.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_SEMANTIC = r"""sem_a AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER (PARTITION BY file_id ORDER BY ord), '[.!?]\s*$'), true) THEN 1 ELSE 0 END AS o FROM conv_cues),
sem_b AS (SELECT *, sum(o) OVER (PARTITION BY file_id ORDER BY ord) AS island FROM sem_a),
sem_c AS (SELECT *, (row_number() OVER (PARTITION BY file_id, island ORDER BY ord) - 1) // 4 AS k FROM sem_b),
sem AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY island, k) AS group_no FROM sem_c)"""

_CHINESE = rf"""WITH {V.CONV_CUES}, {_SEMANTIC},
broken_rows AS (SELECT file_id, group_no, regexp_replace(translated_text, '[，。！？；：,.!?;:]+$', '') AS z,
  lead(translated_text) OVER (PARTITION BY file_id, group_no ORDER BY ord) AS f FROM sem),
broken AS (SELECT file_id, group_no, bool_or(f IS NOT NULL AND (regexp_matches(z, '(在|通过|因为|对于|关于)$') OR (ends_with(z, '的') AND regexp_matches(f, '^[，。！？；：,.!?;:]')))) AS b
  FROM broken_rows GROUP BY 1, 2),
texts AS (SELECT file_id, group_no, string_agg(text, ' ' ORDER BY ord) AS t, string_agg(translated_text, '' ORDER BY ord) AS z FROM sem GROUP BY 1, 2),
found AS (SELECT file_id, group_no, list_filter([
    CASE WHEN regexp_matches(z, '{"|".join(L.CHINESE_FINDINGS["missing_predicate"])}') THEN 'missing_predicate' END,
    CASE WHEN b OR regexp_matches(z, '{"|".join(L.CHINESE_FINDINGS["dangling_preposition"])}') THEN 'dangling_preposition' END,
    CASE WHEN regexp_matches(z, '{"|".join(L.CHINESE_FINDINGS["english_word_order"])}') THEN 'english_word_order' END], lambda x: x IS NOT NULL) AS c
  FROM texts JOIN broken USING (file_id, group_no) WHERE t <> '' AND z <> '')
SELECT file_id, group_no, unnest(c) AS code, len(c) >= 2 AS high FROM found WHERE len(c) > 0"""


# -- audit ----------------------------------------------------------------------------------------

_LOADED = rf"""loaded AS (
  SELECT *, end_ms - start_ms AS d, words AS w, len(regexp_extract_all(translated_text, '[一-鿿]')) AS h,
    trim(regexp_replace(regexp_replace(lower(text), '[^a-z''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS rkey,
    regexp_replace(translated_text, '[^一-鿿A-Za-z0-9]', '', 'g') AS zkey FROM conv_cues)"""

_ISSUES = rf"""{_LOADED},
issue_flags AS (
  SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY ord) AS gap,
    rkey IN {_in(L.SHORT_ENGLISH_AUDIT)} OR zkey IN {_in(L.SHORT_CHINESE_AUDIT)} AS answer,
    h / (d / 1000) AS cps FROM loaded),
issue_base AS (
  SELECT *, d > 0 AND (d < 150 OR (d < 250 AND NOT answer AND w + h > 4)) AS invalid, d >= 1200 AND h >= 12 AND cps > 11 AS severe FROM issue_flags),
issue_rows AS (
  SELECT file_id, ord, 'warning' AS level, 'coverage_gap_unverified' AS code, CAST(gap AS DOUBLE) AS value FROM issue_base WHERE gap > 1500
  UNION ALL SELECT file_id, ord, 'warning', 'coverage_gap_warning', gap FROM issue_base WHERE gap > 1200 AND gap <= 1500
  UNION ALL SELECT file_id, ord, 'error', 'invalid_timing', d FROM issue_base WHERE d <= 0
  UNION ALL SELECT file_id, ord, 'warning', 'subtitle_duration_too_short', d FROM issue_base WHERE d > 0 AND d < 500 AND NOT invalid
  UNION ALL SELECT file_id, ord, 'error', 'subtitle_duration_invalid', d FROM issue_base WHERE invalid
  UNION ALL SELECT file_id, ord, 'error', 'chinese_speed_error', round(cps, 2) FROM issue_base WHERE severe
  UNION ALL SELECT file_id, ord, 'warning', 'chinese_speed_warning', round(cps, 2) FROM issue_base WHERE d > 0 AND cps > 9 AND NOT severe
  UNION ALL SELECT file_id, ord, 'warning', 'short_duration', d FROM issue_base WHERE d > 0 AND d < 900
  UNION ALL SELECT file_id, ord, 'error', 'overlong_english', w FROM issue_base WHERE w > 16
  UNION ALL SELECT file_id, ord, 'error', 'missing_chinese', w FROM issue_base WHERE text <> '' AND translated_text = ''
  UNION ALL SELECT file_id, ord, 'warning', 'english_speed_warning', round(w / (d / 1000), 2) FROM issue_base WHERE d > 0 AND w / (d / 1000) > 5)"""


@query(f"WITH {V.CONV_CUES}, {_ISSUES} SELECT * FROM issue_rows")
def cue_issue_rows(spark, d):
    return audit.cue_issues(V.conv_cues(spark, d))


@query(
    f"""WITH {V.CONV_CUES}, {_ISSUES},
counts AS (SELECT file_id, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM issue_rows GROUP BY 1),
metrics AS (SELECT file_id, count(*) AS n_cues, max(words) AS max_words, round(avg(words), 2) AS avg_words, round(avg(dur_ms), 2) AS avg_duration_ms FROM conv_cues GROUP BY 1)
SELECT m.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
  CASE WHEN errors > 0 THEN 'ERROR' WHEN warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM metrics m LEFT JOIN counts USING (file_id)"""
)
def cue_audit_rollup(spark, d):
    return audit.rollup(V.conv_cues(spark, d))


@query(
    f"""WITH {V.CONV_CUES}, {_ISSUES} SELECT code, count(*) AS n_issues, count(DISTINCT file_id) AS n_files,
  count(*) FILTER (level = 'error') AS n_error, count(*) FILTER (level = 'warning') AS n_warning FROM issue_rows GROUP BY 1"""
)
def issue_code_counts(spark, d):
    rows = audit.cue_issues(V.conv_cues(spark, d))
    wide = audit.severity_pivot(rows, ["code"], "level", ["error", "warning"])
    total = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n_issues"), F.count_distinct("file_id").alias("n_files"))
    return total.join(wide, "code")


@query(
    f"""WITH {V.CONV_CUES}, {_ISSUES}, per AS (SELECT file_id, count(*) FILTER (level = 'error') AS e FROM issue_rows GROUP BY 1)
SELECT count(*) AS n_files, count(*) FILTER (e > 0) AS error_files, bool_or(e > 0) AS any_error FROM (SELECT DISTINCT file_id FROM conv_cues) LEFT JOIN per USING (file_id)"""
)
def sample_rollup(spark, d):
    r = audit.rollup(V.conv_cues(spark, d))
    return r.agg(
        F.count(F.lit(1)).alias("n_files"), F.count(F.when(F.col("errors") > 0, 1)).alias("error_files"), F.bool_or(F.col("errors") > 0).alias("any_error")
    )


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, words FROM conv_cues WHERE words > 16")
def overlong_english(spark, d):
    return V.conv_cues(spark, d).where(F.col("words") > L.HARD_WORDS).select("file_id", "ord", "words")


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, text FROM conv_cues WHERE trim(translated_text) = ''")
def translation_gaps(spark, d):
    return V.conv_cues(spark, d).where(F.trim("translated_text") == "").select("file_id", "ord", "text")


@query()
def suspicious_recognitions(spark, d):
    return audit.suspicious_words(V.conv_cues(spark, d))


@query(_CHINESE)
def chinese_group_findings(spark, d):
    return audit.chinese_group_findings(V.conv_cues(spark, d))


@query(
    f"""WITH {V.CONV_CUES}, {_LOADED} SELECT file_id, count(*) FILTER (trim(translated_text) = '') AS missing_translation,
  count(*) FILTER (d >= 900 AND h >= 12 AND h / (d / 1000) > 11) AS severe_speed,
  count(*) FILTER (d > 0 AND d < 150) AS duration_errors, count(*) FILTER (w > 16) AS overlong FROM loaded GROUP BY 1"""
)
def guard_counters(spark, d):
    return audit.guard_summary(V.conv_cues(spark, d))


@query(
    f"""WITH {V.CONV_CUES}, {_LOADED}, f AS (SELECT *, greatest(1, d) / 1000 AS sec FROM loaded)
SELECT file_id, ord, rkey NOT IN {_in(L.SHORT_ENGLISH_EDITOR)} AND zkey NOT IN {_in(L.SHORT_CHINESE_EDITOR)} AND ((d <= 900 AND w >= 8 AND h >= 10)
    OR (d <= 800 AND w >= 10) OR (d <= 800 AND w >= 4 AND h >= 16) OR (d <= 900 AND w >= 5 AND h >= 10 AND (w * 1.35::DOUBLE + h) / sec > 24)) AS high_load,
  d >= 900 AND h >= 12 AND h / sec > 11 AS severe_speed, h >= 8 AND h / sec > 9 AS speed_pressure,
  CAST(greatest(4, floor(greatest(0.1, d / 1000) * 8)) AS BIGINT) AS target_chars,
  CAST(greatest(6, floor(greatest(0.1, d / 1000) * 11)) AS BIGINT) AS most_chars,
  CAST(least(1800, greatest(700, ceil(w / 5.0::DOUBLE * 1000), ceil(h / 9.0::DOUBLE * 1000))) AS BIGINT) AS target_ms FROM f"""
)
def high_load_short(spark, d):
    return longs(audit.load_flags(V.conv_cues(spark, d)), "target_chars", "most_chars", "target_ms")


# -- text -----------------------------------------------------------------------------------------


@query(
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{V.SQL_WORD}')) AS BIGINT) AS words,
  CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS letters, length(text) AS chars FROM documents"""
)
def word_count_docs(spark, d):
    t = F.col("text")
    return longs(
        V.table(spark, d, "documents").select(
            "doc_id", T.word_count(t).alias("words"), F.regexp_count(t, F.lit("[A-Za-z]")).alias("letters"), F.length(t).alias("chars")
        ),
        "words",
        "letters",
        "chars",
    )


_LETTERS = L.COUNTED_LETTERS
_BLOCKS = L.CJK_BLOCKS_SPLIT


@query(
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{_LETTERS}')) + len(regexp_extract_all(regexp_replace(text, '{_LETTERS}', ' ', 'g'), '[^\t\n\f\r\x0b ]+')) AS BIGINT) AS mixed_words,
  CAST(len(regexp_extract_all(text, '{L.HAN}')) AS BIGINT) AS han FROM documents"""
)
def mixed_script_count(spark, d):
    t = F.col("text")
    return longs(V.table(spark, d, "documents").select("doc_id", T.mixed_word_count(t).alias("mixed_words"), T.han_count(t).alias("han")), "mixed_words", "han")


@query(
    rf"""SELECT doc_id, CASE WHEN n > 0 THEN round(c / n, 6) ELSE 0 END AS ratio, CASE WHEN n > 0 THEN c / n > 0.5 ELSE false END AS cjk
FROM (SELECT doc_id, len(regexp_extract_all(text, '{_BLOCKS}')) AS c, length(regexp_replace(text, '[\t\n\f\r\x0b ]', '', 'g')) AS n FROM documents)"""
)
def cjk_ratio(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", F.round(T.cjk_ratio(t), 6).alias("ratio"), T.mainly_cjk(t).alias("cjk"))


@query(
    rf"""WITH {V.DOC_LINES} SELECT file_id, avg(CASE WHEN (len(regexp_extract_all(t, '[^\t\n\f\r\x0b ]+')) = 1 AND NOT regexp_matches(t, '[^\x00-\x7f]')) OR length(t) <= 2 THEN 1.0 ELSE 0.0 END) >= 0.8 AS word_level
FROM (SELECT file_id, trim(line) AS t FROM doc_lines) GROUP BY 1"""
)
def word_level_detection(spark, d):
    return V.doc_lines(spark, d).groupBy("file_id").agg((F.avg(F.when(T.is_word_row(F.col("line")), 1.0).otherwise(0.0)) >= 0.8).alias("word_level"))


@query(
    rf"""WITH {V.DOC_LINES} SELECT file_id, line_no, regexp_replace(trim(line), '[，。]+$', '') AS stripped,
  regexp_replace(trim(regexp_replace(line, '[\t\n\f\r\x0b ]+', ' ', 'g')), '[\t\n\f\r\x0b ]+([,.;:!?，。！？；：])', '\1', 'g') AS normal,
  trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) AS signature FROM doc_lines"""
)
def normalize_lines(spark, d):
    t = F.col("line")
    return V.doc_lines(spark, d).select("file_id", "line_no", T.strip_stops(t).alias("stripped"), T.normalize_text(t).alias("normal"), T.signature(t).alias("signature"))


@query(
    rf"""WITH {V.DOC_LINES}, e AS (SELECT file_id, line_no, string_split(trim(line), ' ') AS w FROM doc_lines)
SELECT file_id, line_no, lower(regexp_replace(w[1], '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS first_token,
  lower(regexp_replace(w[len(w)], '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS last_token FROM e"""
)
def boundary_tokens(spark, d):
    w = F.split(F.trim("line"), " ")
    rows = V.doc_lines(spark, d).withColumn("w", w)
    return rows.select(
        "file_id", "line_no", T.boundary_token(F.get("w", 0)).alias("first_token"), T.boundary_token(F.element_at("w", -1)).alias("last_token")
    )


@query(
    f"""WITH {V.EVENT_SEGS}, m AS (SELECT file_id, ord, start_ms % 360000000 AS ms FROM event_segs)
SELECT file_id, ord, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS srt,
  printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 // 10) AS ass,
  printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, ms AS parsed FROM m"""
)
def timestamp_formats(spark, d):
    ms = F.col("start_ms") % 360000000
    rows = V.event_segs(spark, d).withColumn("ms", ms)
    ms = F.col("ms")
    return rows.select(
        "file_id", "ord", T.srt_time(ms).alias("srt"), T.ass_time(ms).alias("ass"), T.clock_time(ms).alias("clock"), T.parse_time(T.srt_time(ms)).alias("parsed")
    )


_RKEY = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z''\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(
    rf"""WITH {V.CONV_CUES}, k AS (SELECT *, {_RKEY} AS k, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS m FROM conv_cues)
SELECT file_id, ord, k IN {_in(L.SHORT_ENGLISH_AUDIT)} AS short_audit, k IN {_in(L.SHORT_ENGLISH_EDITOR)} AS short_editor, k IN {_in(L.BACKCHANNEL)} AS backchannel,
  CASE WHEN m IN {_in(L.DISCOURSE_MARKERS)} THEN m ELSE '' END AS marker,
  regexp_matches(text, '[.!?]\s*$') AS sentence_final, lower(regexp_replace(text, '[.,!?;:\s]+$', '')) IN {_in(L.TAIL_WORDS)} AS tail FROM k"""
)
def short_responses(spark, d):
    t, none = F.col("text"), F.lit("")
    return V.conv_cues(spark, d).select(
        "file_id",
        "ord",
        T.simple_response(t, none, "audit").alias("short_audit"),
        T.simple_response(t, none, "editor").alias("short_editor"),
        T.backchannel(t).alias("backchannel"),
        T.discourse_marker(t).alias("marker"),
        T.sentence_end(t).alias("sentence_final"),
        T.tail_word(t).alias("tail"),
    )


@query(
    r"""SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS short_hash, md5(text || '|{"lang": "' || lang || '"}') AS cache_key FROM documents"""
)
def content_hashes(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select(
        "doc_id",
        F.md5(t).alias("md5"),
        F.sha2(t, 256).alias("sha256"),
        F.substring(F.sha2(t, 256), 1, 16).alias("short_hash"),
        F.md5(F.concat(t, F.lit('|{"lang": "'), F.col("lang"), F.lit('"}'))).alias("cache_key"),
    )


@query()
def content_crc32(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.lpad(F.lower(F.hex(F.crc32("text"))), 8, "0").alias("crc32_hex"))


@query(
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[\\t\\n\\f\\r\\x0b ]+', ' ', 'g')) AS cleaned FROM pages""".replace("\\\\", "\\")
)
def vtt_clean(spark, d):
    t = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z]+;", " ")
    return V.table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("cleaned"))


# -- windows --------------------------------------------------------------------------------------


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, printf('S%04d', row_number() OVER (PARTITION BY file_id ORDER BY ord)) AS subtitle_id FROM conv_cues")
def global_ids(spark, d):
    return windows.global_ids(V.conv_cues(spark, d)).select("file_id", "ord", "subtitle_id")


@query(
    """WITH r AS (SELECT DISTINCT doc_id AS id FROM labels), i AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM r),
a AS (SELECT min(id) AS first, max(id) AS last FROM i GROUP BY g)
SELECT first, last, last - first + 1 AS n, CASE WHEN first = last THEN printf('S%04d', first) ELSE printf('S%04d-S%04d', first, last) END AS label FROM a"""
)
def compact_id_ranges(spark, d):
    return windows.compact_ranges(V.table(spark, d, "labels"), "doc_id")


@query(
    f"""WITH {V.EVENT_SEGS}, n AS (SELECT *, lead(start_ms) OVER w AS ns, lag(end_ms) OVER w AS le FROM event_segs WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, ord))
SELECT file_id, ord,
  CAST(CASE WHEN start_ms - le < 1000 THEN floor((le + start_ms) / 2) + floor((start_ms - le) / 4) ELSE start_ms END AS BIGINT) AS new_start_ms,
  CAST(CASE WHEN ns - end_ms < 1000 THEN floor((end_ms + ns) / 2) + floor((ns - end_ms) / 4) ELSE end_ms END AS BIGINT) AS new_end_ms FROM n"""
)
def timing_blend(spark, d):
    return windows.timing_blend(V.event_segs(spark, d)).select("file_id", "ord", "new_start_ms", "new_end_ms")


_GROUPS = """grouped AS (SELECT *, sum(o) OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS group_id FROM (
  SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, ord) > 3600000 THEN 1 ELSE 0 END AS o FROM event_segs))"""


@query(f"WITH {V.EVENT_SEGS}, {_GROUPS} SELECT file_id, ord, CAST(group_id AS BIGINT) AS group_id FROM grouped")
def gap_groups(spark, d):
    return windows.gap_groups(V.event_segs(spark, d), 3600000).select("file_id", "ord", "group_id")


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS o, event_id, ts FROM events),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT user_id, CAST(min(t) // 1000 AS BIGINT) AS first_ms, count(*) AS n_events FROM g GROUP BY user_id, s"""
)
def gap_sessions(spark, d):
    e = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return s.select("user_id", F.unix_millis("w.start").alias("first_ms"), "n_events")


@query(
    f"""WITH {V.CONV_CUES}, g AS (SELECT file_id, ord, start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY ord) AS gap FROM conv_cues)
SELECT file_id, ord, gap, CASE WHEN gap > 1500 THEN 'coverage_gap_unverified' ELSE 'coverage_gap_warning' END AS code FROM g WHERE gap > 1200"""
)
def coverage_gaps(spark, d):
    return windows.gap_warnings(V.conv_cues(spark, d)).select("file_id", "ord", "gap", "code")


@query(
    f"""WITH {V.EVENT_SEGS}, m AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_end_ms FROM event_segs)
SELECT file_id, ord, start_ms, latest_end_ms FROM m WHERE start_ms < latest_end_ms - 5"""
)
def time_overlaps(spark, d):
    return windows.time_overlaps(V.event_segs(spark, d)).select("file_id", "ord", "start_ms", "latest_end_ms")



@query(
    f"""WITH {V.CONV_CUES}, {_SEMANTIC} SELECT file_id, group_no, min(ord) AS first_ord, count(*) AS n_rows, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
  string_agg(text, ' ' ORDER BY ord) AS text, string_agg(translated_text, '' ORDER BY ord) AS translated_text FROM sem GROUP BY 1, 2"""
)
def semantic_groups_audit(spark, d):
    return windows.group_text(windows.semantic_groups(V.conv_cues(spark, d)))


_REASONS = [
    ("abbreviation_name_split", "abbr"),
    ("preposition_object_split", f"l IN {_in(L.PREPOSITIONS)}"),
    ("determiner_noun_split", f"l IN {_in(L.DETERMINERS)}"),
    ("auxiliary_predicate_split", f"l IN {_in(L.AUXILIARIES)} AND ends_with(r, 'ing')"),
    ("be_complement_split", f"l IN {_in(L.BE_FORMS)} AND r IN ('to', 'forced', 'trying', 'rapidly')"),
    ("to_infinitive_split", "l IN ('forced', 'trying', 'able', 'going') AND r = 'to'"),
    ("phrasal_verb_split", f"ends_with(l, 'ing') AND r IN {_in(L.PARTICLES)}"),
    ("verb_object_split", f"l IN {_in(L.OBJECT_VERBS)} AND r IN {_in([*L.DETERMINERS, *L.ADJECTIVES, *L.COMMON_NOUNS])}"),
    ("verb_preposition_split", f"l IN {_in(L.LOOK_FORMS)} AND r = 'at'"),
    ("modifier_head_split", f"l IN {_in(L.ADJECTIVES)} AND r IN {_in([*L.ADJECTIVES, *L.COMMON_NOUNS])}"),
    ("verb_particle_split", f"l2 IN {_in(L.BE_FORMS)} AND ends_with(l, 'ing') AND r IN {_in(L.PARTICLES)}"),
    ("subject_predicate_split", "r IN ('are', 'is', 'was', 'were') AND subject"),
    ("possessive_head_split", "ends_with(l, '''s') OR ends_with(l, 's''')"),
]


def _syntax_sql(reasons: list[tuple[str, str]]) -> str:
    return rf"""WITH {V.CONV_CUES}, near AS (SELECT file_id, ord, trim(text) AS c, trim(lag(text) OVER (PARTITION BY file_id ORDER BY ord)) AS p FROM conv_cues),
tokens AS (SELECT *, regexp_extract_all(lower(p), '{V.SQL_WORD}') AS a, regexp_extract_all(lower(c), '{V.SQL_WORD}') AS b, regexp_extract_all(p, '\b[A-Za-z][A-Za-z''-]*\b') AS w,
  trim(regexp_replace(regexp_replace(lower(c), '[^a-z''\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k, trim(regexp_replace(lower(p), '[^a-z''\s]', ' ', 'g')) AS pk FROM near WHERE p IS NOT NULL),
edges AS (SELECT *, a[len(a)] AS l, coalesce(a[len(a) - 1], '') AS l2, b[1] AS r, regexp_matches(p, '[.!?]\s*$') AS closed,
  regexp_matches(p, '\b(?:St|Mt|Mr|Mrs|Ms|Dr|Prof|Jr|Sr)\.$') AND regexp_matches(c, '^[A-Z][A-Za-z''-]{{2,}}\b') AS abbr,
  len(w) > 0 AND ((len(w) >= 2 AND regexp_matches(w[len(w)], '^[A-Z]') AND regexp_matches(w[len(w) - 1], '^[A-Z]')) OR lower(w[len(w)]) IN {_in(L.PRONOUNS)}) AS subject FROM tokens),
open_ AS (SELECT * FROM edges WHERE p <> '' AND c <> '' AND len(a) > 0 AND len(b) > 0 AND NOT (NOT abbr AND ((closed AND regexp_matches(k, '^(?:but |wow|what do you mean|well )'))
  OR (closed AND (len(a) <= 5 OR len(b) <= 3)) OR pk IN {_in(L.SAFE_RESPONSES)} OR k IN {_in(L.SAFE_RESPONSES)}))),
found AS (SELECT file_id, ord, list_filter([{", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in reasons)}], lambda x: x IS NOT NULL) AS f FROM open_),
scored AS (SELECT file_id, ord, array_to_string(f, ',') AS reasons, CAST(round(least(0.95, 0.65 + 0.12 * len(f)), 2) AS DOUBLE) AS confidence_score FROM found WHERE len(f) > 0)
SELECT *, CASE WHEN confidence_score >= 0.75 THEN 'high' ELSE 'medium' END AS confidence FROM scored"""


@query(_syntax_sql(_REASONS))
def syntax_boundaries(spark, d):
    rows = windows.boundary_issues(V.conv_cues(spark, d))
    return rows.select("file_id", "ord", F.array_join("reasons", ",").alias("reasons"), "confidence", "confidence_score")


_EDITOR_REASONS = [
    _REASONS[0],
    ("protected_named_phrase_split", f"(l || ' ' || r) IN {_in(BW.NAMED_PAIRS)}"),
    ("protected_phrasal_boundary_split", f"(l || ' ' || r) IN {_in(BW.PHRASAL_PAIRS)}"),
    *_REASONS[1:],
]


@query(_syntax_sql(_EDITOR_REASONS))
def editor_boundaries(spark, d):
    rows = windows.boundary_issues(V.conv_cues(spark, d), editor=True)
    return rows.select("file_id", "ord", F.array_join("reasons", ",").alias("reasons"), "confidence", "confidence_score")


_W = V.SQL_WORD


@query(
    rf"""WITH {V.DOC_LINES}, n AS (SELECT file_id, line_no, line, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS next_line FROM doc_lines),
t AS (SELECT *, regexp_extract_all(lower(line), '{_W}') AS a, regexp_extract_all(lower(next_line), '{_W}') AS b FROM n WHERE next_line IS NOT NULL),
e AS (SELECT file_id, line_no, a[len(a)] AS last_token, b[1] AS first_token FROM t WHERE len(a) > 0 AND len(b) > 0)
SELECT file_id, line_no, last_token, first_token, last_token IN {_in(L.PREPOSITIONS)} AS preposition, last_token IN {_in(L.DETERMINERS)} AS determiner,
  last_token IN {_in(L.AUXILIARIES)} AND ends_with(first_token, 'ing') AS auxiliary FROM e
WHERE last_token IN {_in(L.PREPOSITIONS)} OR last_token IN {_in(L.DETERMINERS)} OR (last_token IN {_in(L.AUXILIARIES)} AND ends_with(first_token, 'ing'))"""
)
def bad_cuts(spark, d):
    w = Window.partitionBy("file_id").orderBy("line_no")
    rows = V.doc_lines(spark, d).withColumn("next_line", F.lead("line").over(w)).where("next_line is not null")
    a, b = T.word_tokens(F.col("line")), T.word_tokens(F.col("next_line"))
    rows = rows.withColumns({"a": a, "b": b}).where((F.size("a") > 0) & (F.size("b") > 0))
    rows = rows.select("file_id", "line_no", F.element_at("a", -1).alias("last_token"), F.get("b", 0).alias("first_token"))
    last, first = F.col("last_token"), F.col("first_token")
    out = rows.withColumns(
        {
            "preposition": T.among(last, L.PREPOSITIONS),
            "determiner": T.among(last, L.DETERMINERS),
            "auxiliary": T.among(last, L.AUXILIARIES) & first.endswith("ing"),
        }
    )
    return out.where("preposition or determiner or auxiliary")


@query(
    f"WITH {V.EVENT_SEGS} SELECT file_id, ord, (row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord) - 1) // 20 AS batch_no FROM event_segs"
)
def fixed_batches(spark, d):
    return windows.fixed_batches(V.event_segs(spark, d), 20).select("file_id", "ord", "batch_no")


@query(f"WITH {V.DOC_WORDS} SELECT file_id, word_id, lead(start_ms) OVER w - end_ms AS pause_ms, lead(token) OVER w AS next_token FROM doc_words WINDOW w AS (PARTITION BY file_id ORDER BY word_id)")
def word_pauses(spark, d):
    return windows.word_pauses(V.doc_words(spark, d)).select("file_id", "word_id", "pause_ms", "next_token")


@query(
    f"""WITH {V.CONV_CUES}, n AS (SELECT file_id, ord AS left_ord, lead(ord) OVER w AS right_ord, text AS left_text, lead(text) OVER w AS right_text, lead(start_ms) OVER w - end_ms AS pause_ms
  FROM conv_cues WINDOW w AS (PARTITION BY file_id ORDER BY ord)) SELECT * FROM n WHERE right_ord IS NOT NULL"""
)
def boundary_records(spark, d):
    return windows.boundary_records(V.conv_cues(spark, d))


@query(
    f"""WITH {V.DOC_WORDS}, a AS (SELECT file_id, word_id AS cut FROM doc_words WHERE word_id % 14 = 0), b AS (SELECT file_id, word_id AS cut FROM doc_words WHERE word_id % 8 = 0)
SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.cut, b.cut) AS cut, CASE WHEN a.cut IS NULL THEN 'added' WHEN b.cut IS NULL THEN 'removed' ELSE 'kept' END AS change
FROM a FULL JOIN b ON a.file_id = b.file_id AND a.cut = b.cut"""
)
def boundary_diff(spark, d):
    words = V.doc_words(spark, d).select("file_id", F.col("word_id").alias("cut"))
    return windows.boundary_diff(words.where("cut % 14 = 0"), words.where("cut % 8 = 0"))


@query(
    f"""WITH {V.DOC_WORDS}, loose AS (SELECT * FROM doc_words WHERE word_id % 40 >= 9),
i AS (SELECT *, word_id - row_number() OVER (PARTITION BY file_id ORDER BY word_id) AS g FROM loose),
p AS (SELECT *, (row_number() OVER (PARTITION BY file_id, g ORDER BY word_id) - 1) // 18 AS k FROM i)
SELECT file_id, min(word_id) AS word_start, max(word_id) AS word_end, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(surface, ' ' ORDER BY word_id) AS text
FROM p GROUP BY file_id, g, k HAVING max(end_ms) - min(start_ms) >= 700"""
)
def restored_word_ranges(spark, d):
    words = V.doc_words(spark, d, by_file=True)
    rows = words.where("word_id % 40 = 0").select("file_id", F.col("word_id").alias("word_start"), (F.col("word_id") + 8).alias("word_end"))
    return windows.restored_words(words, rows)


# -- intervals ------------------------------------------------------------------------------------

_ISLANDS = """isl_a AS (SELECT *, max(end_ms) OVER (PARTITION BY text ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM event_segs WHERE end_ms > start_ms),
isl_b AS (SELECT *, sum(CASE WHEN m >= start_ms THEN 0 ELSE 1 END) OVER (PARTITION BY text ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM isl_a),
isl AS (SELECT text, min(start_ms) AS a, max(end_ms) AS b FROM isl_b GROUP BY text, g)"""


@query(f"WITH {V.EVENT_SEGS}, {_ISLANDS}, h AS (SELECT text, lag(b) OVER (PARTITION BY text ORDER BY a) AS hole_start, a AS hole_end FROM isl) SELECT * FROM h WHERE hole_start IS NOT NULL")
def uncovered_intervals(spark, d):
    return intervals.holes(V.event_segs(spark, d), ["text"])


@query(f"WITH {V.EVENT_SEGS}, {_ISLANDS} SELECT text, CAST(sum(b - a) AS BIGINT) AS covered_ms, max(b) - min(a) AS span_ms, count(*) AS n_islands FROM isl GROUP BY text")
def covered_duration(spark, d):
    return intervals.covered(V.event_segs(spark, d), ["text"])


@query(
    f"""WITH {V.EVENT_SEGS} SELECT a.file_id, a.ord, b.ord AS source_ord FROM event_segs a JOIN event_segs b
ON a.file_id = b.file_id AND a.start_ms <= b.end_ms AND b.start_ms <= a.end_ms AND a.text = 'click' AND b.text <> 'click'"""
)
def interval_source_ids(spark, d):
    e = V.event_segs(spark, d).where("end_ms >= start_ms")
    left = e.where("text = 'click'").select("file_id", "ord", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    right = e.where("text <> 'click'").select("file_id", F.col("ord").alias("source_ord"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    return intervals.overlap_join(left, right, "file_id", 14400000).select("file_id", "ord", "source_ord")


@query(
    f"""WITH {V.EVENT_SEGS}, p AS (SELECT file_id, ord AS at_ord, start_ms + 60000 AS t FROM event_segs)
SELECT p.file_id, p.at_ord, count(*) AS n_open, min(e.ord) AS first_open FROM p JOIN event_segs e ON p.file_id = e.file_id AND e.start_ms <= t AND t < e.end_ms GROUP BY 1, 2"""
)
def active_cue_at_time(spark, d):
    e = V.event_segs(spark, d).where("end_ms > start_ms")
    points = V.event_segs(spark, d).select("file_id", F.col("ord").alias("at_ord"), (F.col("start_ms") + 60000).alias("at"))
    rows = e.select("file_id", "ord", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    hits = intervals.point_in_interval(points, rows, "file_id", 14400000)
    return hits.groupBy("file_id", "at_ord").agg(F.count(F.lit(1)).alias("n_open"), F.min("ord").alias("first_open"))


@query(
    f"""WITH {V.EVENT_SEGS}, c AS (SELECT file_id, start_ms AS t, max(ord) AS card FROM event_segs WHERE text = 'purchase' GROUP BY 1, 2)
SELECT e.file_id, e.ord, c.card FROM event_segs e ASOF LEFT JOIN c ON e.file_id = c.file_id AND e.start_ms >= c.t"""
)
def asof_card(spark, d):
    e = V.event_segs(spark, d)
    cards = e.where("text = 'purchase'").groupBy("file_id", F.col("start_ms").alias("at")).agg(F.max("ord").alias("card"))
    return intervals.as_of(e.select("file_id", F.col("start_ms").alias("at"), "ord"), cards, "file_id", "card").select("file_id", "ord", "card")


# -- joins and sets -------------------------------------------------------------------------------


@query("""SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN d.lang ELSE 'q' || l.quality END AS label FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_default(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    labels = V.table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("label"))
    return joins.with_default(docs, labels, "doc_id", "label", "lang").select("doc_id", "label")


@query(
    """WITH g AS (SELECT doc_id AS id, doc_id // 4 AS group_id FROM documents), r AS (SELECT doc_id AS id, doc_id // 4 AS group_id, 'q' || quality AS t FROM labels)
SELECT g.id, g.group_id, coalesce(r.t, d.lang) AS text FROM documents d JOIN g ON g.id = d.doc_id LEFT JOIN r ON r.id = g.id AND r.group_id = g.group_id"""
)
def id_writeback(spark, d):
    docs = V.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("text"))
    groups = docs.select(F.floor(F.col("doc_id") / 4).alias("group_id"), F.col("doc_id").alias("id"))
    back = V.table(spark, d, "labels").select(
        F.floor(F.col("doc_id") / 4).alias("group_id"), F.col("doc_id").alias("id"), F.concat(F.lit("q"), "quality").alias("text"), F.lit(0).alias("ord")
    )
    return joins.write_back(rows, groups, back)


@query(
    """WITH i AS (SELECT conv_id AS item_id, conv_id * 100 + turn AS id FROM conversations), g AS (SELECT conv_id // 2 AS group_id, conv_id * 100 + turn AS id FROM conversations WHERE turn < 4)
SELECT item_id, count(DISTINCT group_id) AS n_groups, min(group_id) AS group_id, count(*) AS n_ids, count(group_id) AS n_known, count(DISTINCT group_id) = 1 AND count(*) = count(group_id) AS mapped
FROM i LEFT JOIN g USING (id) GROUP BY 1"""
)
def unique_group_mapping(spark, d):
    c = V.table(spark, d, "conversations")
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    return joins.unique_mapping(c.select(F.col("conv_id").alias("item_id"), key), c.where("turn < 4").select(F.floor(F.col("conv_id") / 2).alias("group_id"), key))


@query(
    r"""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS g FROM conversations),
o AS (SELECT g, min(conv_id * 1000 + turn) AS context_id FROM s GROUP BY g HAVING count(*) = 1) SELECT conv_id, turn, context_id FROM s JOIN o USING (g)"""
)
def signature_lookup(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn", T.signature(F.col("text")).alias("signature"))
    contexts = c.select("signature", (F.col("conv_id") * 1000 + F.col("turn")).alias("context_id"))
    return joins.unique_signature(c, contexts).select("conv_id", "turn", "context_id")


@query(
    """WITH a AS (SELECT doc_id AS id, CAST(NULL AS INTEGER) AS quality, n_chars FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS id, quality, CAST(NULL AS BIGINT) AS n_chars FROM labels)
SELECT coalesce(a.id, b.id) AS id, CAST(coalesce(a.quality, b.quality) AS BIGINT) AS quality, coalesce(a.n_chars, b.n_chars) AS n_chars, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b FROM a FULL JOIN b ON a.id = b.id"""
)
def outer_merge_precedence(spark, d):
    a = V.table(spark, d, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("quality"), "n_chars")
    b = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("quality"), F.lit(None).cast("long").alias("n_chars"))
    return joins.merge_fields(a, b, "id", ["quality", "n_chars"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, d):
    return joins.missing(V.table(spark, d, "documents").select("doc_id"), V.table(spark, d, "labels"), "doc_id")


@query(
    "SELECT doc_id, false AS restored FROM labels UNION ALL SELECT doc_id, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
)
def restore_missing(spark, d):
    return joins.restore_missing(V.table(spark, d, "labels").select("doc_id"), V.table(spark, d, "documents").select("doc_id"), "doc_id")


@query(
    f"""WITH {V.RETURNED_IDS}, a AS (SELECT doc_id AS id, count(*) AS ne FROM documents GROUP BY 1), b AS (SELECT id, count(*) AS nr FROM returned GROUP BY 1),
j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN nr IS NULL THEN 'missing' WHEN ne IS NULL THEN 'unknown' WHEN nr > 1 THEN 'duplicate' END AS code, coalesce(nr, 0) AS n_returned FROM a FULL JOIN b ON a.id = b.id)
SELECT * FROM j WHERE code IS NOT NULL"""
)
def id_reconciliation(spark, d):
    return setops.reconcile(V.expected_ids(spark, d), V.returned_ids(spark, d))


@query(
    f"""WITH {V.CONV_CUES}, {_ISSUES}, b AS (SELECT file_id, list(DISTINCT code) AS x FROM issue_rows GROUP BY 1), a AS (SELECT file_id, list(DISTINCT code) AS y FROM issue_rows WHERE ord % 2 = 0 GROUP BY 1)
SELECT file_id, array_to_string(list_sort(list_filter(x, lambda c: NOT list_contains(coalesce(y, []), c) AND c IN ('overlong_english', 'short_duration', 'coverage_gap_warning', 'coverage_gap_unverified'))), ',') AS fixed FROM b LEFT JOIN a USING (file_id)"""
)
def issue_set_algebra(spark, d):
    rows = audit.cue_issues(V.conv_cues(spark, d)).groupBy("file_id").agg(
        F.collect_set("code").alias("x"), F.collect_set(F.when(F.col("ord") % 2 == 0, F.col("code"))).alias("y")
    )
    watched = F.array(*map(F.lit, ["overlong_english", "short_duration", "coverage_gap_warning", "coverage_gap_unverified"]))
    return rows.select("file_id", F.array_join(F.sort_array(setops.fixed_codes(F.col("x"), F.col("y"), watched)), ",").alias("fixed"))


@query(
    rf"""WITH {V.CONV_CUES}, w AS (SELECT file_id, ord, regexp_extract_all(lower(text), '{_W}') AS l FROM conv_cues), u AS (SELECT file_id, ord, unnest(range(len(l))) AS k, unnest(l) AS t FROM w),
f AS (SELECT file_id, ord, t, min(k) AS k FROM u GROUP BY 1, 2, 3) SELECT file_id, ord, string_agg(t, ' ' ORDER BY k) AS tokens FROM f GROUP BY 1, 2"""
)
def ordered_distinct(spark, d):
    t = setops.ordered_distinct(T.word_tokens(F.col("text")))
    return V.conv_cues(spark, d).withColumn("t", t).where(F.size("t") > 0).select("file_id", "ord", F.array_join("t", " ").alias("tokens"))


@query(
    r"""WITH a AS (SELECT doc_id, lang, trim(text) AS text FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, lang, trim(regexp_replace(text, '[\t\n\f\r\x0b ]+', ' ', 'g')) AS text FROM documents WHERE doc_id % 13 <> 0),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'changed' END AS change,
  CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'lang,text' WHEN a.text <> b.text THEN 'text' ELSE '' END AS columns FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT * FROM j WHERE change IS NOT NULL"""
)
def snapshot_diff(spark, d):
    docs = V.table(spark, d, "documents")
    a = docs.where("doc_id % 11 <> 0").select("doc_id", "lang", F.trim("text").alias("text"))
    b = docs.where("doc_id % 13 <> 0").select("doc_id", "lang", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    return setops.snapshot_diff(a, b, "doc_id", ["lang", "text"])


# -- aggregates, sorts ----------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def severity_pivot(spark, d):
    return audit.severity_pivot(V.table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query(
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS first_three FROM r WHERE k <= 3 GROUP BY 1"""
)
def group_first3(spark, d):
    e = V.table(spark, d, "events")
    firsts = audit.first_n(e.select("event_type", "event_id"), ["event_type"], ["event_id"], 3)
    joined = firsts.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("first_three"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(joined, "event_type")


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 8"
)
def topn_per_group(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return longs(audit.first_n(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8), "rank")


@query(
    f"""WITH {V.DOC_WORDS}, x AS (SELECT *, end_ms - start_ms AS d, start_ms - lag(end_ms) OVER w AS gap, max(end_ms) OVER (PARTITION BY file_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late
  FROM doc_words WINDOW w AS (PARTITION BY file_id ORDER BY word_id))
SELECT file_id, count(*) AS n_words, min(d) AS min_ms, max(d) AS max_ms, count(*) FILTER (start_ms < late) AS order_errors, count(*) FILTER (gap > 300) AS gaps_300,
  count(*) FILTER (gap > 500) AS gaps_500, count(*) FILTER (gap > 800) AS gaps_800, max(gap) AS max_gap_ms FROM x GROUP BY 1"""
)
def ledger_comparison(spark, d):
    return audit.ledger_comparison(V.doc_words(spark, d))


@query(
    f"""WITH {V.DOC_WORDS}, p AS (SELECT file_id, length(surface) AS x, row_number() OVER (PARTITION BY file_id ORDER BY length(surface)) - 1 AS k, count(*) OVER (PARTITION BY file_id) AS n FROM doc_words)
SELECT file_id, n AS n_values, CAST(x AS BIGINT) AS quantile FROM p WHERE k = least(n - 1, CAST(floor(n * 0.9::DOUBLE) AS BIGINT))"""
)
def nearest_rank_quantile(spark, d):
    words = V.doc_words(spark, d).select("file_id", F.length("surface").cast("long").alias("x"))
    return audit.rank_quantile(words, "file_id", "x", 0.9)


@query(f"WITH {V.USAGE_LOG} SELECT operation || '_' || service AS key, count(*) AS call_count, CAST(sum(tokens) AS BIGINT) AS token_count FROM usage_log GROUP BY 1")
def usage_counters(spark, d):
    """Calls and tokens per operation and service, keyed by both."""
    u = V.usage_log(spark, d)
    return u.groupBy(F.concat_ws("_", "operation", "service").alias("key")).agg(F.count(F.lit(1)).alias("call_count"), F.sum("tokens").alias("token_count"))


@query(
    f"""WITH {V.USAGE_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY service, usage_date ORDER BY ts, event_id) AS k FROM usage_log)
SELECT event_id, service, k <= 20 AS granted FROM r"""
)
def daily_quota(spark, d):
    """Calls of a day up to the limit."""
    w = Window.partitionBy("service", "usage_date").orderBy("ts", "event_id")
    return V.usage_log(spark, d).select("event_id", "service", (F.row_number().over(w) <= 20).alias("granted"))


@query(f"WITH {V.USAGE_LOG} SELECT service, CAST(usage_date AS VARCHAR) AS usage_date, greatest(0, 20 - count(*)) AS remaining, count(*) < 20 AS available FROM usage_log GROUP BY 1, 2")
def remaining_quota(spark, d):
    """What a day's limit leaves."""
    n = F.count(F.lit(1))
    return V.usage_log(spark, d).groupBy("service", F.col("usage_date").cast("string").alias("usage_date")).agg(
        F.greatest(F.lit(0).cast("long"), 20 - n).alias("remaining"), (n < 20).alias("available")
    )


@query(
    "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1"
)
def dedupe_first_wins(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return joins.first_row(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    r"""WITH n AS (SELECT unnest(string_split(p_name, ' ')) AS name, p_brand, p_partkey FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY p_brand, p_partkey, name) AS k FROM n) SELECT lower(name) AS key, name, p_brand AS category FROM r WHERE k = 1"""
)
def glossary_dedupe(spark, d):
    n = V.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"), "p_brand", "p_partkey").withColumn("key", F.lower("name"))
    return joins.first_row(n, ["key"], ["p_brand", "p_partkey", "name"]).select("key", "name", F.col("p_brand").alias("category"))


@query(
    f"""WITH {V.CONV_CUES}, w AS (SELECT *, CASE WHEN ord % 7 = 0 THEN NULL ELSE words END AS k FROM conv_cues)
SELECT file_id, ord, row_number() OVER (PARTITION BY file_id ORDER BY k NULLS LAST, end_ms, ord) AS place FROM w"""
)
def stable_sort_nulls_last(spark, d):
    k = F.when(F.col("ord") % 7 == 0, None).otherwise(F.col("words"))
    w = Window.partitionBy("file_id").orderBy(F.col("k").asc_nulls_last(), "end_ms", "ord")
    return longs(V.conv_cues(spark, d).withColumn("k", k).select("file_id", "ord", F.row_number().over(w).alias("place")), "place")


@query(
    f"""WITH {V.CONV_CUES}, f AS (SELECT file_id, ord, (ord * 37) % 101 AS frozen FROM conv_cues WHERE ord % 9 <> 0)
SELECT c.file_id, c.ord, row_number() OVER (PARTITION BY c.file_id ORDER BY frozen NULLS LAST, c.ord) AS place FROM conv_cues c LEFT JOIN f USING (file_id, ord)"""
)
def frozen_order(spark, d):
    """Rows by their frozen place, unknown ones last."""
    c = V.conv_cues(spark, d).select("file_id", "ord")
    frozen = c.where("ord % 9 <> 0").withColumn("frozen", (F.col("ord") * 37) % 101)
    w = Window.partitionBy("file_id").orderBy(F.col("frozen").asc_nulls_last(), "ord")
    return longs(c.join(frozen, ["file_id", "ord"], "left").select("file_id", "ord", F.row_number().over(w).alias("place")), "place")


@query(f"WITH {V.DOC_WORDS}, m AS (SELECT *, lag(end_ms + CASE WHEN word_id % 50 = 7 THEN 500 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY word_id) AS le FROM doc_words) SELECT file_id, word_id, start_ms, le FROM m WHERE le > start_ms")
def ledger_monotonic(spark, d):
    w = Window.partitionBy("file_id").orderBy("word_id")
    late = F.col("end_ms") + F.when(F.col("word_id") % 50 == 7, 500).otherwise(0)  # each fiftieth word ends too late
    return V.doc_words(spark, d).withColumn("le", F.lag(late).over(w)).where("le > start_ms").select("file_id", "word_id", "start_ms", "le")


# -- explode --------------------------------------------------------------------------------------


@query(f"WITH {V.DOC_WORDS} SELECT file_id, word_id, surface, start_ms, end_ms FROM doc_words")
def equal_share_words(spark, d):
    return V.doc_words(spark, d).select("file_id", "word_id", "surface", "start_ms", "end_ms")


@query(
    rf"""WITH {V.CONV_CUES}, p AS (SELECT file_id, ord, start_ms, end_ms, string_split(text, ', ') AS parts FROM conv_cues),
u AS (SELECT *, unnest(range(len(parts))) AS k, unnest(parts) AS part FROM p),
w AS (SELECT *, greatest(1, len(regexp_extract_all(part, '{_W}'))) AS weight FROM u),
c AS (SELECT *, sum(weight) OVER (PARTITION BY file_id, ord ORDER BY k) AS upto, sum(weight) OVER (PARTITION BY file_id, ord) AS total FROM w)
SELECT file_id, ord, k, part, CAST(start_ms + (end_ms - start_ms) * (upto - weight) // total AS BIGINT) AS part_start_ms, CAST(start_ms + (end_ms - start_ms) * upto // total AS BIGINT) AS part_end_ms FROM c"""
)
def proportional_parts(spark, d):
    from scriptloom.operators.segment import proportional_parts as split

    return longs(split(V.conv_cues(spark, d), ", "), "k")


@query(
    rf"""SELECT doc_id, start_char, CAST(len(regexp_extract_all(s, '{_W}')) AS BIGINT) AS words FROM (SELECT doc_id, CAST(strpos(text, '. ') AS BIGINT) AS start_char, substr(text, 1, strpos(text, '. ')) AS s FROM documents WHERE strpos(text, '. ') > 0)"""
)
def first_sentence_evidence(spark, d):
    at = F.instr("text", ". ")
    docs = V.table(spark, d, "documents").withColumn("at", at).where("at > 0")
    return longs(
        docs.select("doc_id", F.col("at").alias("start_char"), T.word_count(F.substring("text", F.lit(1), F.col("at"))).alias("words")), "start_char", "words"
    )


@query(
    """SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, CAST(CASE WHEN levenshtein(a.p_name, b.p_name) > 3 THEN 4 ELSE levenshtein(a.p_name, b.p_name) END AS BIGINT) AS distance
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"""
)
def bounded_edit_distance(spark, d):
    from scriptloom.operators.similarity import bounded_distances

    return bounded_distances(V.table(spark, d, "part"), "p_partkey", "p_name", ["p_brand", "p_size"])


@query(
    rf"""WITH g AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_W}')) AS token FROM documents)
SELECT lower(name) AS name, count(token) AS hits FROM g LEFT JOIN w ON w.token = lower(g.name) GROUP BY 1"""
)
def glossary_hits(spark, d):
    g = V.glossary(spark, d).select(F.lower("name").alias("name"))
    w = V.table(spark, d, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("token")).distinct()
    return g.join(w, g.name == w.token, "left").groupBy("name").agg(F.count("token").alias("hits"))


@query(
    rf"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_W}') AS l FROM benchmark), t AS (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS l FROM documents),
ig AS (SELECT item_id, k AS item_pos, array_to_string(l[k + 1:k + 12], ' ') AS g FROM (SELECT item_id, l, unnest(range(len(l) - 11)) AS k FROM i WHERE len(l) >= 12)),
tg AS (SELECT doc_id, k AS text_pos, array_to_string(l[k + 1:k + 12], ' ') AS g FROM (SELECT doc_id, l, unnest(range(len(l) - 11)) AS k FROM t WHERE len(l) >= 12))
SELECT item_id, doc_id AS text_id, item_pos, text_pos FROM ig JOIN tg USING (g)"""
)
def token_ngram_match(spark, d):
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.word_tokens(F.col("text")).alias("tokens"))
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.word_tokens(F.col("text")).alias("tokens"))
    return longs(joins.ngram_matches(items, docs, 12), "item_pos", "text_pos")


# -- sequential, fuzzy, formats ---------------------------------------------------------------------


def _seq(df: DataFrame, columns: list[str], step, schema: str, order=("start_ms", "ord")) -> DataFrame:
    from scriptloom.operators import sequential

    return sequential.stream(df, "file_id", columns, list(order), step, schema)


_TIMED = "ord long, start_ms long, end_ms long"


@query()
def adaptive_gap_groups(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.event_segs(spark, d), ["ord", "start_ms", "end_ms"], S.adaptive_groups(36000000), "ord long, group_id long")


@query(
    f"""WITH RECURSIVE {V.CONV_CUES}, n AS (SELECT file_id, ord, words, regexp_matches(text, '[.!?]\\s*$') AS e, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS r FROM conv_cues),
g AS (SELECT file_id, ord, r, CAST(1 AS BIGINT) AS group_id, CASE WHEN e THEN 0 ELSE greatest(words, 1) END AS load, e FROM n WHERE r = 1
  UNION ALL SELECT n.file_id, n.ord, n.r, g.group_id + CASE WHEN g.e THEN 1 WHEN g.load > 0 AND g.load + n.words > 36 THEN 1 ELSE 0 END,
    CASE WHEN n.e THEN 0 WHEN g.e OR g.load + n.words > 36 THEN greatest(n.words, 1) ELSE g.load + greatest(n.words, 1) END, n.e FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1)
SELECT file_id, ord, group_id FROM g"""
)
def semantic_groups_greedy(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "text"], S.packed_groups(36), "ord long, group_id long", ("ord",))


@query(
    f"""WITH RECURSIVE {V.CONV_CUES}, n AS (SELECT file_id, ord, start_ms, end_ms, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS r FROM conv_cues),
g AS (SELECT file_id, ord, r, CAST(0 AS BIGINT) AS chunk, start_ms AS opened FROM n WHERE r = 1
  UNION ALL SELECT n.file_id, n.ord, n.r, g.chunk + CASE WHEN n.end_ms - g.opened > 30000 THEN 1 ELSE 0 END, CASE WHEN n.end_ms - g.opened > 30000 THEN n.start_ms ELSE g.opened END
    FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1)
SELECT file_id, ord, chunk FROM g"""
)
def duration_chunks(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms"], S.duration_chunks(30000), "ord long, chunk long")


@query(
    f"""WITH RECURSIVE {V.CONV_CUES}, a AS (SELECT file_id, ord, greatest(0, start_ms) AS s, greatest(end_ms, greatest(0, start_ms) + 1) AS e, row_number() OVER w AS r,
  greatest(0, coalesce(lead(start_ms) OVER w, 1000000000000)) AS ns FROM conv_cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, ord)),
n AS (SELECT *, greatest(e, ns - 40) AS room, ns - e > 0 AND ns - e <= CASE WHEN e - s < 700 THEN 2200 ELSE 800 END AS bridged, greatest(0, s - 40) AS early FROM a),
g AS (SELECT file_id, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS x, CAST(-40 AS BIGINT) AS y FROM n WHERE r = 1
  UNION ALL SELECT file_id, ord, r, x, greatest(y, x + 1) FROM (
    SELECT file_id, ord, r, CASE WHEN y - 700 >= free THEN least(x, y - 700) ELSE x END AS x, y FROM (
      SELECT file_id, ord, r, free, x, greatest(CASE WHEN bridged THEN room ELSE least(e + 260, room) END, least(x + 700, room)) AS y FROM (
        SELECT n.*, g.y + 40 AS free, CASE WHEN n.early >= g.y + 40 THEN n.early ELSE n.s END AS x FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1))))
SELECT file_id, ord, x AS start_ms, y AS end_ms FROM g WHERE r > 0"""
)
def display_padding(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms"], S.display_padding, _TIMED)


@query()
def shift_short(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms", "text", "translated_text"], S.shift_loaded_short, _TIMED)


@query()
def high_load_extension(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms", "text", "translated_text"], S.extend_high_load, _TIMED)


@query(
    f"""WITH RECURSIVE {V.EVENT_SEGS}, n AS (SELECT file_id, ord, start_ms, end_ms, row_number() OVER w AS r, lead(start_ms) OVER w AS ns FROM event_segs WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, ord)),
g AS (SELECT file_id, ord, r, start_ms AS s, CASE WHEN ns IS NULL THEN end_ms ELSE least(end_ms, greatest(start_ms + 120, ns - 40)) END AS e FROM n WHERE r = 1
  UNION ALL SELECT file_id, ord, r, s, CASE WHEN ns IS NULL THEN e ELSE least(e, greatest(s + 120, ns - 40)) END FROM (
    SELECT file_id, ord, r, ns, s, CASE WHEN end_ms <= s THEN s + 120 ELSE end_ms END AS e FROM (
      SELECT n.file_id, n.ord, n.r, n.ns, n.end_ms, CASE WHEN n.start_ms <= g.e THEN g.e + 40 ELSE n.start_ms END AS s FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1)))
SELECT file_id, ord, s AS start_ms, e AS end_ms FROM g"""
)
def clip_sequence(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.event_segs(spark, d), ["ord", "start_ms", "end_ms"], S.clip_sequence(), _TIMED)


@query(
    f"""WITH RECURSIVE {V.CONV_CUES}, n AS (SELECT file_id, ord, start_ms, end_ms, row_number() OVER w AS r, lead(start_ms) OVER w AS ns0, lead(end_ms) OVER w AS ne,
  greatest(0, coalesce(lead(start_ms) OVER w, 1000000000000)) AS ns FROM conv_cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, ord)),
g AS (SELECT file_id, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS x, CAST(-40 AS BIGINT) AS y, start_ms AS nxt FROM n WHERE r = 1
  UNION ALL SELECT file_id, ord, r,
    CASE way WHEN 1 THEN low WHEN 2 THEN low WHEN 3 THEN high - 700 WHEN 4 THEN free ELSE s END,
    CASE way WHEN 1 THEN low + 700 WHEN 2 THEN low + 700 WHEN 3 THEN high WHEN 4 THEN room ELSE end_ms END,
    CASE way WHEN 2 THEN low + 740 ELSE ns0 END FROM (
    SELECT *, CASE WHEN high - low >= 700 THEN 0 WHEN low + 740 <= ns THEN 1 WHEN ne - (low + 740) >= 800 THEN 2 WHEN high - 700 >= free THEN 3
      WHEN room - free > high - low THEN 4 ELSE 0 END AS way FROM (
      SELECT *, greatest(high, ns - 40) AS room FROM (
        SELECT *, greatest(low + 1, end_ms) AS high FROM (
          SELECT n.*, g.nxt AS s, greatest(0, g.nxt) AS low, greatest(0, g.y) + CASE WHEN g.r = 0 THEN 0 ELSE 40 END AS free FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1)))))
SELECT file_id, ord, x AS start_ms, y AS end_ms FROM g WHERE r > 0"""
)
def pad_ultra_short(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms"], S.pad_ultra_short(), _TIMED)


@query()
def cluster_repair(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms", "text"], S.repair_clusters(), _TIMED)


@query()
def merge_short_neighbours(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms", "text"], S.merge_short(), f"{_TIMED}, text string")


@query()
def merge_backward(spark, d):
    from scriptloom.operators import sequential as S

    order = [F.desc("start_ms"), F.desc("ord")]
    return _seq(V.conv_cues(spark, d), ["ord", "start_ms", "end_ms", "text"], S.merge_backward, f"{_TIMED}, text string", order)


@query(
    f"""WITH RECURSIVE {V.EVENT_SEGS}, n AS (SELECT file_id, ord, start_ms, end_ms, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS r FROM event_segs),
g AS (SELECT file_id, ord, r, greatest(start_ms, 0) AS s, CASE WHEN end_ms > greatest(start_ms, 0) THEN end_ms ELSE greatest(start_ms, 0) + 500 END AS e FROM n WHERE r = 1
  UNION ALL SELECT n.file_id, n.ord, n.r, greatest(n.start_ms, g.e), CASE WHEN n.end_ms > greatest(n.start_ms, g.e) THEN n.end_ms ELSE greatest(n.start_ms, g.e) + 500 END
    FROM g JOIN n ON n.file_id = g.file_id AND n.r = g.r + 1)
SELECT file_id, ord, s AS start_ms, e AS end_ms FROM g"""
)
def monotone_times(spark, d):
    from scriptloom.operators import sequential as S

    return _seq(V.event_segs(spark, d), ["ord", "start_ms", "end_ms"], S.monotone, _TIMED)


@query()
def rule_split(spark, d):
    from scriptloom.operators import sequential as S

    words = V.doc_words(spark, d).withColumnRenamed("word_id", "ord")
    return _seq(words, ["ord", "start_ms", "end_ms", "surface"], S.rule_split(), f"{_TIMED}, text string")


@query()
def dp_segmentation(spark, d):
    from scriptloom.operators import sequential as S

    c = V.conv_cues(spark, d).select("file_id", "ord", "start_ms", "end_ms", F.posexplode(F.split("text", " ")).alias("k", "surface"))
    n = Window.partitionBy("file_id", "ord")
    words = c.withColumn("n", F.count(F.lit(1)).over(n)).select(
        "file_id",
        (F.col("ord") * 1000 + F.col("k")).alias("word_id"),
        F.expr("start_ms + (end_ms - start_ms) * k div n").alias("start_ms"),
        F.expr("start_ms + (end_ms - start_ms) * (k + 1) div n").alias("end_ms"),
        "surface",
    )
    schema = "word_start long, word_end long, start_ms long, end_ms long, text string"
    return _seq(words, ["word_id", "start_ms", "end_ms", "surface"], S.segment_by_cost(), schema, ("word_id",))


@query()
def greedy_nonoverlap(spark, d):
    from scriptloom.operators import sequential as S

    e = V.event_segs(spark, d).where("end_ms > start_ms").withColumn("score", (F.col("end_ms") - F.col("start_ms")) % 1000003)
    return _seq(e, ["ord", "start_ms", "end_ms"], S.non_overlapping, "ord long, selected boolean", [F.desc("score"), F.asc("ord")])


@query()
def timed_words(spark, d):
    from scriptloom.operators.segment import timed_words as split

    return split(V.conv_cues(spark, d))


@query()
def clause_split(spark, d):
    from scriptloom.operators.segment import clauses

    return longs(clauses(V.doc_lines(spark, d)), "k")


@query()
def token_span_match(spark, d):
    from scriptloom.operators.matching import map_rows

    c = V.conv_cues(spark, d)
    words = c.select("file_id", "ord", "end_ms", F.posexplode(T.word_tokens(F.col("text"))).alias("k", "token")).where("(ord + k) % 17 <> 0")
    words = words.select("file_id", (F.col("ord") * 1000 + F.col("k")).alias("word_id"), "token", "end_ms")
    return map_rows(c.select("file_id", "ord", "end_ms", "text"), words)


@query()
def adjacent_duplicates(spark, d):
    from scriptloom.operators.similarity import adjacent_duplicates as find

    return find(V.conv_cues(spark, d)).select("file_id", "ord", "similarity")


@query()
def variant_buckets(spark, d):
    from scriptloom.operators.similarity import variant_buckets as find

    words = V.conv_cues(spark, d).select("file_id", "ord", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][A-Za-z]{4,}\b"), F.lit(0))).alias("surface"))
    return find(words).select("file_id", "left", "right", "ratio")


@query()
def fuzzy_glossary(spark, d):
    from scriptloom.operators.similarity import glossary_candidates, phrase_windows

    terms = V.glossary(spark, d).select(F.lower("name").alias("term")).distinct().withColumn("tokens", F.size(T.word_tokens(F.col("term"))))
    return glossary_candidates(phrase_windows(V.table(spark, d, "documents"), terms), terms)


@query()
def lcs_bag_coverage(spark, d):
    from scriptloom.operators.similarity import omission

    rows = omission(V.conv_cues(spark, d), "text", "translated_text")
    return rows.select("file_id", "ord", F.round("bag", 6).alias("bag"), F.col("lcs").cast("long").alias("lcs"), "coverage", "omits")


@query(
    """WITH r AS (SELECT doc_id, md5(text || '{}') AS h FROM documents), c AS (SELECT h, min(doc_id) AS id, arg_min(lang, doc_id) AS value FROM (SELECT *, md5(text || '{}') AS h FROM documents WHERE doc_id % 3 = 0) GROUP BY h)
SELECT r.doc_id, c.value, c.value IS NOT NULL AS hit FROM r LEFT JOIN c USING (h)"""
)
def cache_lookup(spark, d):
    from scriptloom.operators import cache

    docs = V.table(spark, d, "documents").withColumn("h", cache.cache_key(F.col("text")))
    known = docs.where("doc_id % 3 = 0").select("h", F.col("lang").alias("value"), F.col("doc_id").alias("id"))
    return cache.lookup(docs.select("doc_id", "h"), known, ["h"], "value").select("doc_id", "value", "hit")


@query(
    """WITH a AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS t, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, v, t AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, n DESC, v DESC) AS r FROM a) WHERE r = 1"""
)
def cache_upsert(spark, d):
    from scriptloom.operators import cache

    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("updated_at"))
    return cache.upsert(o.where("v % 2 = 0"), o.where("v % 2 = 1"), ["k"], ties=("v",)).select("k", "v", "updated_at")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def cache_ttl(spark, d):
    from scriptloom.operators import cache

    e = V.table(spark, d, "events").select("event_id", F.col("ts").alias("created_at"))
    last = e.agg(F.max("created_at").alias("now"))
    return cache.expire(e.join(F.broadcast(last)), F.col("now")).select("event_id")


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, start_ms, end_ms, text, translated_text FROM conv_cues")
def json_roundtrip(spark, d):
    from scriptloom.sources import captions, sinks

    return _restored(V.conv_cues(spark, d), captions.scan_json(sinks.to_json(V.conv_cues(spark, d))))


def _restored(cues: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned rows under the ordinals of the cues they came from."""
    w = Window.partitionBy("file_id")
    ords = cues.select("file_id", "ord", F.row_number().over(w.orderBy("ord")).alias("n"))
    found = scanned.withColumn("n", F.row_number().over(w.orderBy("start_ms", "ord"))).drop("ord")
    return found.join(ords, ["file_id", "n"]).select("file_id", "ord", "start_ms", "end_ms", "text", "translated_text")


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, start_ms, end_ms, text, '' AS translated_text FROM conv_cues")
def srt_roundtrip(spark, d):
    from scriptloom.sources import captions, sinks

    cues = V.conv_cues(spark, d)
    return _restored(cues, captions.scan_srt(sinks.to_srt(cues, "original_only")))


@query(f"WITH {V.CONV_CUES} SELECT file_id, ord, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, text, trim(translated_text) AS translated_text FROM conv_cues")
def ass_roundtrip(spark, d):
    from scriptloom.sources import captions, sinks

    cues = V.conv_cues(spark, d)
    return _restored(cues, captions.scan_ass(sinks.to_ass(cues)))


@query()
def json_repair(spark, d):
    from scriptloom.functions.json_repair import repaired
    from scriptloom.session import ship

    ship(spark)
    e = V.table(spark, d, "events").select("event_id", "props")
    damaged = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", r"\}$", "")).when(F.col("event_id") % 3 == 1, F.replace("props", F.lit('"'), F.lit("'"))).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object(repaired(damaged), "$.k").alias("k"), F.get_json_object("props", "$.k").alias("expected"))


@query(
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS tokens
FROM events GROUP BY 1, 2"""
)
def window_counts(spark, d):
    from scriptloom.streaming.sessions import window_counts as count

    return count(V.table(spark, d, "events"), "1 day").withColumn("start", F.col("start").cast("string"))


@query()
def full_pipeline(spark, d):
    """Cues: missing translations filled, short rows merged, times padded, audited, one row per file."""
    from scriptloom import providers
    from scriptloom.operators import sequential as S

    cues = V.conv_cues(spark, d).select("file_id", "ord", "start_ms", "end_ms", "text", "translated_text")
    merged = _seq(cues, ["ord", "start_ms", "end_ms", "text"], S.merge_short(), f"{_TIMED}, text string")
    padded = _seq(merged.select("file_id", "ord", "start_ms", "end_ms"), ["ord", "start_ms", "end_ms"], S.display_padding, _TIMED)
    texts = merged.select("file_id", "ord", "text").join(cues.select("file_id", "ord", "translated_text"), ["file_id", "ord"])
    filled = providers.fill_missing(texts, providers.create("echo"))
    return audit.rollup(padded.join(filled, ["file_id", "ord"]))
