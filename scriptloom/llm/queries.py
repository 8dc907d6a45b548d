"""Queries and SQL of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from scriptloom.llm import (
    collocations,
    filter_audit,
    html_extract,
    license_scan,
    packing,
    pii,
    quality_llr,
    secret_scan,
    simhash_dedup,
    source_mix,
    token_counts,
    topk_search,
    url_filter,
)
from scriptloom.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: under $TOKENIZERS_DIR, else where the installed package has it."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model"))


def op9_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), read_table(spark, sf_dir, "labels"))


def op12_pii_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_simhash_near_dedup,
        op3_source_mix,
        op4_url_filter,
        op5_license_scan,
        op6_quality_llr,
        op7_nnls_packing,
        op8_prefix_token_counts,
        op9_voronoi_top_k,
        op10_html_extract,
        op11_filter_audit,
        op12_pii_votes,
        op13_collocations,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": """
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
""",
    "op9_voronoi_top_k": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.n <> q.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
""",
    "op11_filter_audit": """
WITH RECURSIVE perms(p) AS (SELECT '' UNION ALL
  SELECT p || f FROM perms, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE strpos(p, f) = 0),
orders AS (SELECT p AS filter_order FROM perms WHERE length(p) = 5),
steps AS (SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS f FROM orders, range(1, 6) t(s)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 2 * length(d.text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > f.first_id THEN 'E' ELSE '' END AS fails
  FROM d JOIN firsts f ON f.text = d.text LEFT JOIN marks m ON m.doc_id = d.doc_id),
sets AS (SELECT part, good, toxic, fails, count(*) AS n FROM flags GROUP BY ALL),
runs AS (SELECT s.part, s.good, s.toxic, s.n, s.fails, o.filter_order, o.step, o.f, contains(s.fails, o.f) AS own,
  len(list_filter(string_split(substr(o.filter_order, 1, o.step - 1), ''), lambda x: x <> '' AND contains(s.fails, x))) > 0 AS gone
  FROM sets s, steps o),
counts AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM runs GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counts
""",
    "op13_collocations": """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
grams AS MATERIALIZED (SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) + 2 - m)]) AS phrase FROM pieces, range(1, 6) t(m)),
counts AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE m = 1 GROUP BY lang),
cands AS MATERIALIZED (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND a >= 100),
cuts AS (SELECT c.lang, c.phrase, c.a, k, f.a AS l, s.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (f.a::HUGEINT * s.a) AS score
  FROM cands c JOIN range(1, 5) x(k) ON k < m JOIN totals t ON t.lang = c.lang
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts s ON s.lang = c.lang AND s.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(w[i:j], ' ') AS phrase, a FROM cands c, range(1, 6) x(i), range(1, 6) y(j) WHERE i < j AND j <= m AND j - i + 1 < m),
kept AS (SELECT b.* FROM best b ANTI JOIN inside s ON s.lang = b.lang AND s.phrase = b.phrase AND s.a >= b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
""",
}
