import re
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(pipeline, spark, data, docs, tmp_path):
    """Each stage on what its predecessor kept, against the operators or brute force."""
    from test_near_copies import slow_groups

    from scriptloom.llm import packing, quality_llr, secret_scan, source_mix
    from scriptloom.llm.queries import tokenizer_path

    assert [n for n, _ in pipeline.STAGES] == ["quality", "dedup", "secrets", "mix", "pack"]
    rows = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, rows, data).write.parquet(str(tmp_path / name))
        before, rows = rows, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert rows.columns == docs.columns
        if name == "quality":
            judged = quality_llr.judge(before, spark.read.parquet(f"{data}/labels.parquet"))
            assert ids(rows) == ids(judged.where("kept")) and len(ids(rows)) > 0.7 * docs.count()
        if name == "dedup":
            held = before.orderBy("doc_id").collect()
            assert sorted(r.doc_id for r in rows.collect()) == sorted({held[i].doc_id for i in slow_groups([r.text for r in held])})
        if name == "secrets":
            assert ids(rows) == ids(before) and secret_scan.scan(rows).where("is_secret").count() == 0
        if name == "mix":
            words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in before.collect()}
            times = Counter(r.doc_id for r in rows.collect())
            sizes, got = Counter(), Counter()
            for i, (source, n) in words.items():
                sizes[source] += n
                got[source] += n * times[i]
            goal = source_mix.targets(list(sizes.items()))
            assert max(times.values()) <= 2
            longest = max(n for _, n in words.values())
            assert all(abs(got[s] - goal[s]) <= longest + 3 * source_mix.BLOCK_WORDS for s in sizes)
        if name == "pack":
            assert ids(rows) == ids(before)
            full = rows.groupBy("sequence_id").agg({"length": "sum"}).collect()
            assert all(r[1] <= packing.WINDOW for r in full)
    again = pipeline.run(spark, data)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    assert packing.pack(rows.limit(0).selectExpr("doc_id", "'' as text"), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_odd_rows(pipeline, spark, data, odd_docs, no_docs):
    """Null, empty, long and repeated texts, null ids and clashing columns; then an empty table."""
    clash = odd_docs.withColumns({n: odd_docs["text"] for n in ("_words", "row", "root", "taken", "place")})
    for rows in (clash, no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        columns = rows.columns
        for name, stage in pipeline.STAGES[:4]:
            rows = stage(spark, rows, data)
            assert rows.columns == columns, name
        packed = pipeline.STAGES[4][1](spark, rows, data)
        assert packed.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        assert ids(packed) == ids(rows)
