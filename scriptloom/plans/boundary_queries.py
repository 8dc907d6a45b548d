"""Queries of the boundary and fragment rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptloom.functions import boundaries as B
from scriptloom.operators import boundaries, repair
from scriptloom.plans import views as V
from scriptloom.plans.catalog import query

_SURFACES = r"""surface_lists AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS s FROM documents),
surfaces AS (SELECT doc_id AS file_id, unnest(range(len(s))) AS word_id, unnest(s) AS surface FROM surface_lists),
timed AS (SELECT *, word_id * 400 AS start_ms, word_id * 400 + 390 - (file_id * 7 + word_id * 131) % 600 AS end_ms,
  lower(regexp_replace(surface, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS l FROM surfaces)"""


@query(
    rf"""WITH {_SURFACES},
seen AS (SELECT *, lag(l, 2) OVER w AS l3, lag(l) OVER w AS l2, lead(l) OVER w AS r, lead(l, 2) OVER w AS r2, lead(l, 3) OVER w AS r3,
  lead(start_ms) OVER w - end_ms AS pause, coalesce(regexp_matches(surface, '[.!?]\s*$'), false) AS l_end,
  coalesce(regexp_matches(lag(surface) OVER w, '[.!?]\s*$'), false) AS l2_end, regexp_matches(surface, '[,;:]\s*$') AS l_sep
  FROM timed WINDOW w AS (PARTITION BY file_id ORDER BY word_id)),
coded AS (SELECT file_id, word_id, CASE WHEN l <> '' AND r <> '' THEN {B.codes(B.pair_rules(B.DUCKDB))} ELSE '' END AS codes FROM seen WHERE r IS NOT NULL)
SELECT * FROM coded WHERE codes <> ''"""
)
def boundary_rules(spark, d):
    """Every boundary between two words of all documents against all pair rules."""
    parts = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    words = V.documents_by_id(spark, d).select(F.col("doc_id").alias("file_id"), F.posexplode(parts).alias("word_id", "surface"))
    start = F.col("word_id").cast("long") * 400
    end = start + 390 - (F.col("file_id") * 7 + F.col("word_id") * 131) % 600
    return boundaries.word_boundaries(words.select("file_id", F.col("word_id").cast("long"), "surface", start.alias("start_ms"), end.alias("end_ms")))


@query(
    rf"""WITH {V.CONV_CUES},
listed AS (SELECT *, regexp_extract_all(lower(text), '{V.SQL_WORD}') AS w FROM conv_cues),
firsts AS (SELECT * EXCLUDE (words, w), w AS words, len(w) AS n, w[1] AS first, w[len(w)] AS last, array_to_string(w, ' ') AS joined FROM listed),
seen AS (SELECT *, lead(first) OVER o AS next_first, lead(text) OVER o AS next_text, lag(text) OVER o AS previous_text,
  lead(start_ms) OVER o - end_ms AS pause, coalesce(lead(speaker) OVER o <> speaker, false) AS crossed_after,
  coalesce(lag(speaker) OVER o <> speaker, false) AS crossed_before FROM firsts WINDOW o AS (PARTITION BY file_id ORDER BY ord)),
coded AS (SELECT file_id, ord, {B.trailing_fragment(B.DUCKDB)} AS trailing_issue, {B.codes(B.row_rules(B.DUCKDB))} AS codes FROM seen)
SELECT * FROM coded WHERE trailing_issue <> '' OR codes <> ''"""
)
def fragment_rules(spark, d):
    """Every cue of all conversations against the fragment rules."""
    return boundaries.fragments(V.conv_cues(spark, d))


_ROW_NEIGHBOURS = rf"""listed AS (SELECT *, regexp_extract_all(lower(text), '{V.SQL_WORD}') AS words FROM spliced_cues),
firsts AS (SELECT *, len(words) AS n, words[1] AS first, words[len(words)] AS last, array_to_string(words, ' ') AS joined FROM listed),
seen AS (SELECT *, lead(first) OVER o AS next_first, lead(text) OVER o AS next_text, lag(text) OVER o AS previous_text,
  lead(start_ms) OVER o - end_ms AS pause, coalesce(lead(speaker) OVER o <> speaker, false) AS crossed_after,
  coalesce(lag(speaker) OVER o <> speaker, false) AS crossed_before FROM firsts WINDOW o AS (PARTITION BY file_id ORDER BY ord))"""
_WORD_NEIGHBOURS = r"""tokens AS (SELECT *, lower(regexp_replace(surface, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS l FROM spliced_words),
seen AS (SELECT *, lag(l, 2) OVER w AS l3, lag(l) OVER w AS l2, lead(l) OVER w AS r, lead(l, 2) OVER w AS r2, lead(l, 3) OVER w AS r3,
  lead(start_ms) OVER w - end_ms AS pause, coalesce(regexp_matches(surface, '[.!?]\s*$'), false) AS l_end,
  coalesce(regexp_matches(lag(surface) OVER w, '[.!?]\s*$'), false) AS l2_end, coalesce(regexp_matches(surface, '[,;:]\s*$'), false) AS l_sep,
  coalesce(regexp_matches(surface, '^\p{Lu}'), false) AS upper_start, coalesce(lead(speaker) OVER w <> speaker, false) AS crossed_after,
  l AS last, lead(l) OVER w AS next_first, surface AS text FROM tokens WINDOW w AS (PARTITION BY file_id ORDER BY word_id))"""


@query(
    rf"""WITH {V.SPLICED_WORDS}, {_WORD_NEIGHBOURS},
coded AS (SELECT file_id, word_id, CASE WHEN l <> '' AND r <> '' THEN {B.codes(B.pair_rules(B.DUCKDB))} ELSE '' END AS codes FROM seen WHERE r IS NOT NULL)
SELECT * FROM coded WHERE codes <> ''"""
)
def spliced_boundary_rules(spark, d):
    """All pair rules over cues that carry phrases for each of them."""
    return boundaries.word_boundaries(V.spliced_words(spark, d))


@query(
    rf"""WITH {V.SPLICED_CUES}, {_ROW_NEIGHBOURS},
coded AS (SELECT file_id, ord, {B.trailing_fragment(B.DUCKDB)} AS trailing_issue, {B.codes(B.row_rules(B.DUCKDB))} AS codes FROM seen)
SELECT * FROM coded WHERE trailing_issue <> '' OR codes <> ''"""
)
def spliced_fragment_rules(spark, d):
    """All fragment rules over cues that carry phrases for each of them."""
    return boundaries.fragments(V.spliced_cues(spark, d))


@query(
    rf"""WITH {V.SPLICED_WORDS}, {_WORD_NEIGHBOURS}
SELECT file_id, word_id, item, {repair._mask(repair._kinds(B.DUCKDB).values())} AS kinds,
  CASE WHEN l <> '' AND r <> '' AND (pause IS NULL OR pause < {B.LONG_PAUSE}) THEN {repair._mask(repair.hard_rules(B.DUCKDB).values())} ELSE 0 END AS hard,
  CASE WHEN r IS NULL THEN 0 ELSE {repair.score(B.DUCKDB)} END AS score, {B.trailing_fragment(B.DUCKDB)} AS trailing, l AS token, pause FROM seen"""
)
def repair_marks(spark, d):
    """What the boundary repair sees of every word: broken rules, score, and kinds of word."""
    return repair.marked(V.spliced_words(spark, d))


@query()
def boundary_repair(spark, d):
    """Items of all conversations after the boundary and fragment repair."""
    return repair.repair(V.spliced_words(spark, d))
