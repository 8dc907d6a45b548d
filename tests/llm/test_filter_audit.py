"""Operator 11 against a replay in plain Python."""

import re
from itertools import permutations

from scriptloom.llm import filter_audit


def failing(text, first):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (not first)


def brute(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(failing(t, i is None or i == least[t or ""]), i in good and i is not None, i in toxic and i is not None) for i, t, s in docs if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                fails = sum(f in x[0] for x in own)
                rows["".join(order), step] = [len(left), len(gone), fails - len(gone), sum(x[0] == f for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        out |= {(part, o, s): [*v, shapley[o[s - 1]]] for (o, s), v in rows.items()}
    return out


def rows_of(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in frame.collect()}


def test_given_tables(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = rows_of(filter_audit.audit(docs, labels))
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got == want


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (8, 1, None), (None, 1, 1), (99, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    twice = odd_docs.union(odd_docs)
    got = rows_of(filter_audit.audit(twice, labels))
    want = brute([(r.doc_id, r.text, r.source) for r in twice.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert got == want and len(got) == 600 * 4


def test_copies_and_symbols(spark):
    docs = [(i, ["same text", "A#b " * 150, "x y " * 200, "QQQ zz", ""][i % 5], ["p", None, ""][i % 3]) for i in range(60)]
    got = rows_of(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")))
    assert got == brute(docs, [(7, 1, 1)])


def test_empty(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = filter_audit.audit(no_docs, labels)
    assert frame.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert frame.collect() == []
