import math
import re
from collections import Counter

import pytest
import xxhash

from scriptloom.llm import quality_llr as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int")


def test_base_counts(docs, labels, texts):
    rows = S.judge(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def buckets(text):
    """Buckets of the words and pairs of a text; a pair's hash chains those of its words."""
    digest = xxhash.xxh64_intdigest
    eight = lambda h: h.to_bytes(8, "little")
    one = [digest(x.encode(), 42) for x in WORD.findall(text or "")]
    return [h % S.BUCKETS for h in [*one, *(digest(eight(b), digest(eight(a), 42)) for a, b in zip(one, one[1:]))]]


def test_scores_are_mean_log_ratios(docs, labels, texts):
    """Words and pairs against one raw multinomial, with counts kept in a dictionary."""
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, kept = Counter(), Counter()
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in good:
            kept.update(buckets(t))
    rate = sum(kept.values()) / sum(raw.values())
    ratio = {b: math.log((kept[b] + S.PRIOR) / (n * rate + S.PRIOR)) for b, n in raw.items()}
    for r in S.judge(docs, labels).collect():
        found = buckets(texts[r.doc_id])
        want = sum(ratio[b] for b in found) / len(found) if found else 0.0
        assert r.llr == pytest.approx(want, abs=2e-6)
        assert r.kept == (not r.base_failed and want >= S.THRESHOLD)


def test_labelled_rows(spark):
    """Held-out labels of a larger set: junk goes, good documents stay."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trained = labels.where("doc_id % 2 = 0")
    rows = S.judge(docs, trained).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    junk = [r.kept for r in rows if r.quality == 0]
    fine = [r.kept for r in rows if r.quality == 1]
    assert junk and sum(junk) / len(junk) <= 0.1, sorted((r.llr, r.quality) for r in rows)[:30]
    assert sum(fine) / len(fine) >= 0.98, sorted((r.llr, r.quality) for r in rows)[:30]


def test_windows(spark, no_labels):
    cases = ["a b c d e", "a b c d e f", "x " * 7, "a b c d e a b c d e", "1 2 3 4 5 6 1 2 3 4 5 6 7 1 2 3 4 5", "a b c d e z a b c d e y b c d e z", "", "a", "a b"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in S.judge(df, no_labels).collect()}
    assert got == {k: slow_counts(c)[4] for k, c in enumerate(cases)}


def test_odd_rows(odd_docs, no_docs, labels, no_labels):
    rows = S.judge(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4, 5, 8))
    assert S.judge(no_docs, labels).count() == 0
    assert {r.doc_id for r in S.judge(odd_docs, no_labels).where("kept").collect()} == {1, 6}
    kept = S.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_keep_good_agrees(docs, labels):
    want = {r.doc_id for r in S.judge(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in S.keep_good(docs, labels).collect()} == want


def test_all_good_rows_are_trusted(spark):
    """Where all rows are good, no n-gram is more or less frequent among the good ones."""
    ids = spark.range(20_500)
    docs = ids.selectExpr("id as doc_id", "concat('w', id % 97, ' v', id) as text")
    assert not any(S.log_ratios(docs, ids.selectExpr("id as doc_id", "1 as quality")))


def test_many_good_rows_are_shuffled(docs, labels, monkeypatch):
    few = S.log_ratios(docs, labels)
    monkeypatch.setattr(S, "BROADCAST_IDS", 10)
    assert any(few) and S.log_ratios(docs, labels) == few
