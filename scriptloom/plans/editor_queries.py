"""Queries of the editor's algorithms: alignment, partitioning, anchors, phrases, duplication, ids and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptloom.functions.anchors import DUCKDB_ANCHORS
from scriptloom.operators import alignment, allocation, freeze, glossary, nested, partition, phrases
from scriptloom.plans import views as V
from scriptloom.plans.catalog import query


@query()
def sentence_alignment(spark, d):
    """Damaged sentences of all conversations put back onto the words they came from."""
    return alignment.align(V.cue_word_rows(spark, d), V.damaged_sentences(spark, d))


@query()
def glossary_correction(spark, d):
    """Whole texts of all documents corrected by a glossary of word pairs that open the benchmark items."""
    w = F.split(F.trim("text"), r"\s+")
    items = V.table(spark, d, "benchmark").withColumn("w", w).where(F.size("w") >= 4)
    name = F.initcap(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.lit("prime")))
    rules = items.select(
        F.posexplode(F.array(*(F.struct(name.alias("canonical"), F.concat_ws(" ", F.get("w", F.lit(k)), F.get("w", F.lit(k + 1))).alias("alias")) for k in (0, 2)))).alias("k", "r"), "item_id"
    )
    rules = rules.select((F.col("item_id") * 2 + F.col("k")).alias("rule_no"), "r.canonical", "r.alias")
    done = glossary.correct_texts(V.table(spark, d, "documents").select("doc_id", "text"), rules)
    return done.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "replacements")


@query(
    f"""WITH {V.DOC_WORDS},
n AS (SELECT file_id, word_id AS ord, 1 AS words, row_number() OVER w - 1 AS idx, lead(start_ms) OVER w - end_ms AS gap FROM doc_words WINDOW w AS (PARTITION BY file_id ORDER BY word_id)),
s AS (SELECT file_id, count(*) AS n, sum(words)::BIGINT AS total FROM n GROUP BY file_id),
k AS (SELECT *, greatest(1, (total + 99) // 100) AS k FROM s),
t AS (SELECT file_id, n, unnest(range(1, k)) * (total // k) AS target FROM k WHERE k > 1 AND n > k),
b AS (SELECT t.file_id, t.target, max(n.gap) AS best, arg_max(n.idx, (n.gap, -n.idx)) AS at FROM t JOIN n ON n.file_id = t.file_id
  AND n.idx >= greatest(0, t.target - 30) AND n.idx < least(t.n - 1, t.target + 30) GROUP BY ALL),
c AS (SELECT DISTINCT t.file_id, CASE WHEN b.best >= 0 THEN b.at ELSE t.target END AS idx FROM t LEFT JOIN b ON b.file_id = t.file_id AND b.target = t.target),
o AS (SELECT n.*, sum(CASE WHEN c.idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY n.file_id ORDER BY n.idx) AS part FROM n LEFT JOIN c ON c.file_id = n.file_id AND c.idx + 1 = n.idx)
SELECT file_id, part::BIGINT AS part, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_rows FROM o GROUP BY file_id, part"""
)
def pause_parts(spark, d):
    """Words of all documents in parts of about 100, cut at the longest pauses near equal shares."""
    rows = V.doc_words(spark, d, by_file=True).select("file_id", F.col("word_id").alias("ord"), "start_ms", "end_ms", F.lit(1).alias("words"))
    return partition.parts(rows, 100)


@query(
    rf"""WITH phrases AS (SELECT 'b' || item_id AS phrase_id, regexp_extract_all(lower(text), '{V.SQL_WORD}')[1:4] AS p FROM benchmark
  UNION ALL SELECT 'n' || name, regexp_extract_all(lower(name), '{V.SQL_WORD}') FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part)
  UNION ALL SELECT 'w' || w, [w] FROM (VALUES ('the'), ('und'), ('that')) v(w)),
q AS (SELECT phrase_id, len(p) AS size, ' ' || array_to_string(p, ' ') || ' ' AS p FROM phrases WHERE len(p) > 0),
s AS (SELECT doc_id, regexp_split_to_array(text, '[.\n]') AS l FROM documents),
e AS (SELECT doc_id, unnest(range(len(l))) AS sentence, unnest(l) AS t FROM s),
w AS (SELECT doc_id, sentence, regexp_extract_all(lower(t), '{V.SQL_WORD}') AS w FROM e),
h AS (SELECT phrase_id, doc_id, sentence, unnest([i - 1 for i in range(1, len(w) - size + 2) if ' ' || array_to_string(w[i:i + size - 1], ' ') || ' ' = p]) AS pos
  FROM w JOIN q ON contains(' ' || array_to_string(w, ' ') || ' ', p))
SELECT phrase_id, doc_id AS text_id, count(*) AS hits, min(sentence) AS sentence, arg_min(pos, (sentence, pos)) AS pos FROM h GROUP BY phrase_id, doc_id"""
)
def phrase_evidence(spark, d):
    """Openings of the benchmark items, part names and three common words in all documents."""
    items = V.table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("phrase_id"), F.array_join(F.slice(phrases._tokens(F.col("text")), 1, 4), " ").alias("phrase")
    )
    names = V.glossary(spark, d).select(F.concat(F.lit("n"), F.col("name")).alias("phrase_id"), F.col("name").alias("phrase"))
    common = spark.createDataFrame([("the",), ("und",), ("that",)], "w string").select(F.concat(F.lit("w"), F.col("w")).alias("phrase_id"), F.col("w").alias("phrase"))
    texts = V.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return phrases.evidence(texts, items.union(names).union(common)).selectExpr("phrase_id", "text_id", "hits", "cast(sentence as bigint) as sentence", "cast(pos as bigint) as pos")


@query(
    """WITH RECURSIVE p AS (SELECT event_id AS row_id, repeat('{"a": [', CAST(1 + event_id % 12 AS INTEGER)) || '{"subtitle_ids": ["S' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0')
  || '", "x", ["S9999"]], "S' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || '": {"left_subtitle_id": "S0007", "semantic_group_id": "G0042"}, "semantic_group_ids": ["G0001", 5, null, "S0003"], "props": '
  || props || '}' || repeat(']}', CAST(1 + event_id % 12 AS INTEGER)) AS payload FROM events),
t AS (SELECT row_id, '' AS key, '' AS list, payload::JSON AS v FROM p
  UNION ALL
  SELECT row_id, CASE WHEN json_type(v) = 'OBJECT' THEN k ELSE '' END, CASE WHEN json_type(v) = 'ARRAY' THEN key ELSE '' END,
    CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$."' || k || '"') ELSE json_extract(v, '$[' || k || ']') END
  FROM (SELECT row_id, key, v, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE [CAST(i AS VARCHAR) for i in range(CAST(json_array_length(v) AS BIGINT))] END) AS k
    FROM t WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
ids AS (SELECT row_id, key AS id FROM t WHERE regexp_full_match(key, 'S[0-9]{4}')
  UNION SELECT row_id, v ->> '$' FROM t WHERE json_type(v) = 'VARCHAR' AND (key IN ('subtitle_id', 'left_subtitle_id', 'right_subtitle_id', 'semantic_group_id')
    OR list IN ('subtitle_ids', 'expected_subtitle_ids', 'returned_subtitle_ids', 'mapped_subtitle_ids', 'missing_subtitle_ids', 'duplicate_subtitle_ids', 'unknown_subtitle_ids', 'semantic_group_ids')))
SELECT p.row_id, coalesce(string_agg(id, ',' ORDER BY id) FILTER (regexp_full_match(id, 'S[0-9]{4}')), '') AS caption_ids,
  coalesce(string_agg(id, ',' ORDER BY id) FILTER (regexp_full_match(id, 'G[0-9]{4}')), '') AS group_ids
FROM p LEFT JOIN (SELECT DISTINCT row_id, id FROM ids) i ON i.row_id = p.row_id GROUP BY p.row_id"""
)
def nested_payload_ids(spark, d):
    """Ids in payloads that wrap every event's properties one to twelve levels deep."""
    four = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    depth = (1 + F.col("event_id") % 12).cast("int")
    inner = F.concat(
        F.lit('{"subtitle_ids": ["S'), four("event_id"), F.lit('", "x", ["S9999"]], "S'), four("user_id"),
        F.lit('": {"left_subtitle_id": "S0007", "semantic_group_id": "G0042"}, "semantic_group_ids": ["G0001", 5, null, "S0003"], "props": '), F.col("props"), F.lit("}"),
    )
    payload = F.concat(F.repeat(F.lit('{"a": ['), depth), inner, F.repeat(F.lit("]}"), depth))
    found = nested.nested_ids(V.table(spark, d, "events").select(F.col("event_id").alias("row_id"), payload.alias("payload")))
    return found.select("row_id", F.array_join("caption_ids", ",").alias("caption_ids"), F.array_join("group_ids", ",").alias("group_ids"))


@query(
    f"""WITH {V.PART_ROWS}, found AS (SELECT file_id, part_no, {DUCKDB_ANCHORS} AS a FROM part_rows),
each_one AS (SELECT file_id, part_no, unnest(range(len(a))) AS pos, unnest(a) AS x FROM found)
SELECT file_id, part_no, pos, x.type AS type, x.value AS value, x.percent AS percent, x.decade AS decade FROM each_one"""
)
def part_anchors(spark, d):
    """Numbers, negation and names of all parts."""
    return allocation.part_anchors(V.allocated_groups(spark, d)[1]).withColumn("pos", F.col("pos").cast("long"))


@query()
def allocation_codes(spark, d):
    """Faults of all groups' translations as their parts hold them."""
    found = allocation.validate(*V.allocated_groups(spark, d))
    return found.select("file_id", "group_no", "valid", F.array_join("codes", ",").alias("codes"), F.size("issues").cast("long").alias("n_issues"))


_FROZEN = f"""WITH {V.CONV_CUES}, {V.DOC_LINES},
was AS (SELECT file_id, 'text' AS payload, ord, text AS value FROM conv_cues UNION ALL SELECT file_id, 'translation', ord, translated_text FROM conv_cues
  UNION ALL SELECT file_id, 'times', ord, start_ms || '-' || end_ms FROM conv_cues UNION ALL SELECT file_id, 'lines', line_no, line FROM doc_lines),
became AS (SELECT file_id, payload, ord, CASE WHEN (file_id * 31 + ord * 7 + length(payload)) % 97 = 5 AND payload <> 'translation' THEN value || ' ' ELSE value END AS value FROM was
  WHERE (file_id + ord * 11 + length(payload)) % 199 <> 8)"""


@query(
    _FROZEN
    + f""", j AS (SELECT coalesce(w.file_id, b.file_id) AS file_id, coalesce(w.payload, b.payload) AS payload, coalesce(w.ord, b.ord) AS ord, w.ord IS NOT NULL AS was, b.ord IS NOT NULL AS is_now,
  w.value AS value_before, b.value AS value_after FROM was w FULL JOIN became b ON w.file_id = b.file_id AND w.payload = b.payload AND w.ord = b.ord),
d AS (SELECT *, was <> is_now OR value_before IS DISTINCT FROM value_after AS differs FROM j)
SELECT file_id, payload, count(*) FILTER (was) AS n_before, count(*) FILTER (is_now) AS n_after, count(DISTINCT ord // {freeze.BLOCK}) FILTER (differs) AS unequal_blocks,
  min(ord) FILTER (differs) AS first_ord, arg_min(coalesce(value_before, '-'), ord) FILTER (differs) AS value_before, arg_min(coalesce(value_after, '-'), ord) FILTER (differs) AS value_after FROM d GROUP BY 1, 2"""
)
def payload_differences(spark, d):
    """Texts, translations, times and lines before and after a step that changes and drops rows by rules."""
    values = {"text": F.col("text"), "translation": F.col("translated_text"), "times": F.concat_ws("-", "start_ms", "end_ms")}
    listed = F.array(*(F.struct(F.lit(name).alias("payload"), value.alias("value")) for name, value in values.items()))
    was = V.conv_cues(spark, d).select("file_id", "ord", F.inline(listed)).select("file_id", "payload", "ord", "value")
    was = was.union(V.doc_lines(spark, d).select("file_id", F.lit("lines"), "line_no", "line"))
    changed = F.expr("(file_id * 31 + ord * 7 + length(payload)) % 97 = 5 and payload <> 'translation'")
    became = was.where("(file_id + ord * 11 + length(payload)) % 199 <> 8").withColumn("value", F.when(changed, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    shown = F.col("first_ord").isNotNull()
    found = freeze.first_differences(was, became)
    return found.withColumns({c: F.when(shown, F.coalesce(c, F.lit("-"))) for c in ("value_before", "value_after")})
