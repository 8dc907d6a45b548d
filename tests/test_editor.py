"""Partitioning, phrases and nested ids on rows with ties, gaps and odd values, against plain loops."""

import json
import random
import re

import pytest

from scriptloom.functions import lexicons as L
from scriptloom.operators import nested, partition, phrases


def plain_parts(rows, threshold, reach):
    n, total = len(rows), sum(r[3] for r in rows)
    k = max(1, -(-total // threshold))
    if k <= 1 or n <= k:
        return [rows] if rows else []
    cuts = set()
    for i in range(1, k):
        target = i * (total // k)
        best, at = -1, target
        for j in range(max(0, target - reach), min(n - 1, target + reach)):
            gap = rows[j + 1][1] - rows[j][2]
            if gap > best:
                best, at = gap, j
        cuts.add(at)
    out, start = [], 0
    for c in sorted(cuts):
        out.append(rows[start : c + 1])
        start = c + 1
    return [p for p in [*out, rows[start:]] if p]


@pytest.mark.parametrize(("reach", "threshold"), [(30, 40), (3, 7), (1, 2)])
def test_parts(spark, reach, threshold):
    rng, rows = random.Random(reach), []
    for f in range(25):
        t = 0
        for k in range(rng.choice([0, 1, 2, 5, 29, 30, 31, 61, 200])):
            t += rng.choice([-50, 0, 0, 10, 300])
            rows.append((f, k * 3, t, t + 100, rng.randint(0, 3)))
            t += 100
    frame = spark.createDataFrame(rows, "file_id long, ord long, start_ms long, end_ms long, words int")
    got = {}
    for r in partition.parts(frame, threshold, reach).orderBy("file_id", "part").collect():
        got.setdefault(r.file_id, []).append((r.first_ord, r.last_ord, r.n_rows))
    for f in range(25):
        own = [r[1:] for r in rows if r[0] == f]
        assert got.get(f, []) == [(p[0][0], p[-1][0], len(p)) for p in plain_parts(own, threshold, reach)], f
    assert partition.parts(frame.limit(0), threshold).count() == 0


def test_phrases(spark):
    rng = random.Random(2)
    words = ["a", "b", "The", "it's", "x.", "y\n", ",", "3.5", "É"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(90, None), (91, "")]
    asked = [(k, " ".join(rng.choice(words[:4]) for _ in range(rng.randint(1, 4)))) for k in range(30)] + [(50, None), (51, ""), (52, "never seen words"), (53, "a a a")]
    got = {(r.phrase_id, r.text_id): (r.hits, r.sentence, r.pos) for r in phrases.evidence(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(asked, "phrase_id long, phrase string")).collect()}
    want = {}
    for p, phrase in asked:
        q = re.findall(L.WORD, (phrase or "").lower())
        for t, text in texts:
            hits = []
            for s, sentence in enumerate(re.split(r"[.\n]", text or "")):
                w = re.findall(L.WORD, sentence.lower())
                hits += [(s, i) for i in range(len(w) - len(q) + 1) if q and w[i : i + len(q)] == q]
            if hits:
                want[p, t] = (len(hits), *min(hits))
    assert got == want and len(want) > 100


def collect(value, key, out):
    if isinstance(value, dict):
        for k, v in value.items():
            out.add(k if re.fullmatch(r"S\d{4}", k) else None)
            if k in nested.CAPTION_KEYS + nested.GROUP_KEYS and isinstance(v, str):
                out.add(v)
            if k in nested.CAPTION_LISTS + nested.GROUP_LISTS and isinstance(v, list):
                out.update(x for x in v if isinstance(x, str))
            collect(v, k, out)
    elif isinstance(value, list):
        for v in value:
            collect(v, "", out)


def test_nested_ids(spark):
    rng = random.Random(4)
    names = ["subtitle_id", "subtitle_ids", "semantic_group_id", "semantic_group_ids", "a", "S0001", "S00012", "missing_subtitle_ids", "x.y"]

    def value(depth):
        kind = rng.randint(0, 5 if depth else 2)
        if kind <= 1:
            return rng.choice(["S0002", "G0003", "S12", "free S0004 text", "S0005\n", ""])
        if kind == 2:
            return rng.choice([None, 7, True, 1.5, [], {}])
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(names): value(depth - 1) for _ in range(rng.randint(0, 4))}

    rows = [(k, json.dumps(value(12 if k % 3 else 4))) for k in range(150)] + [(500, None), (501, ""), (502, "{broken"), (503, '"S0001"'), (504, '["S0001"]')]
    got = {r.row_id: [r.caption_ids, r.group_ids] for r in nested.nested_ids(spark.createDataFrame(rows, "row_id long, payload string")).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        out = set()
        if k < 500 or k > 502:
            collect(json.loads(text), "", out)
        out = {x for x in out if x}
        assert got[k] == [sorted(x for x in out if re.fullmatch(r"S\d{4}", x)), sorted(x for x in out if re.fullmatch(r"G\d{4}", x))], text
    assert nested.nested_ids(spark.createDataFrame([], "row_id long, payload string")).count() == 0


def test_pause_parts_move_texts_once(spark, data):
    """One exchange, of whole documents: words are neither shuffled nor joined."""
    from scriptloom.plans import catalog, editor_queries  # noqa: F401

    plan = catalog.QUERIES["pause_parts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
