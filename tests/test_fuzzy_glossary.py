"""Windows of words against glossary terms, by all pairs."""

import re

from scriptloom.functions import lexicons as L
from scriptloom.operators import similarity as S
from scriptloom.plans import catalog

TEXTS = ["We met cyber netics today. Net. Ics came", "a chart reuse house near the char treuse", "spring. Green spring green tea", None, ""]
TERMS = [("cybernetics", 1), ("chartreuse", 1), ("spring green", 2), ("net ics", 2)]


def slow_windows(texts, most):
    found = set()
    for text in texts:
        for sentence in re.split(r"[.!?]+(?=\s|$)", (text or "").lower()):
            w = re.findall(L.WORD, sentence)
            found |= {(" ".join(w[i : i + k]), k) for k in range(1, most + 1) for i in range(len(w) - k + 1)}
    return found


def test_windows_and_candidates(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    terms = spark.createDataFrame(TERMS, "term string, tokens int")
    windows = S.phrase_windows(texts, terms)
    assert sorted(map(tuple, windows.collect())) == sorted(slow_windows(TEXTS, 3))
    got = {(r.phrase, r.term): r for r in S.glossary_candidates(windows, terms).collect()}
    assert got["cyber netics", "cybernetics"].applies and got["char treuse", "chartreuse"].applies
    assert ("spring green", "spring green") in got
    assert ("net ics", "net ics") not in got and ("the char", "chartreuse") not in got


def test_query_sees_terms_heard_as_two_words(spark, tmp_path):
    spark.createDataFrame([(1, "We met cyber netics today")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("cybernetics other",)], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = catalog.QUERIES["fuzzy_glossary"](spark, str(tmp_path)).collect()
    assert [(r.phrase, r.term) for r in rows if r.applies] == [("cyber netics", "cybernetics")]


def test_windows_need_no_sort_and_few_pairs_reach_python(spark):
    """Words aren't shuffled before they are windows, and letters bound the ratio in the JVM."""
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    terms = spark.createDataFrame(TERMS, "term string, tokens int")
    windows = S.phrase_windows(texts, terms)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(windows)
    text = plan(S.glossary_candidates(windows, terms))
    assert text.index("ArrowEvalPython") < text.index("translate(phrase_key")
