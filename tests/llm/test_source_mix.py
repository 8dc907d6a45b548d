import re

import pytest
import xxhash
from pyspark.sql import functions as F

from scriptloom.llm import source_mix as S


def slow_targets(sizes):
    """The contract read literally: refill until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    out, open_, left = {}, list(order), 1.5 * sum(sizes.values())
    while open_:
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if t[s] > 2 * sizes[s]]
        if not over:
            return out | t
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets():
    for sizes in ({"a": 10, "b": 900, None: 5}, {"x": 1}, {"a": 0, "b": 3}, {str(k): k * k for k in range(12)}):
        assert S.targets(list(sizes.items())) == pytest.approx(slow_targets(sizes))


def check(rows, sizes, near):
    """Contract of the result: sizes, sums near the targets, limits per document."""
    goal = slow_targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - goal[s]) <= near


def test_mix(docs, texts):
    rows = S.taken_words(docs, more=("source",)).collect()
    sizes = {}
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    check(rows, sizes, 3 * S.BLOCK_WORDS)
    again = {r.doc_id: r.taken for r in S.taken_words(docs.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in by.items()}


def slow_mix(rows, block):
    """``doc_id: (taken, first slot)``: the streams as lists of words, read slot by slot."""
    digest = xxhash.xxh64_intdigest

    def place(r):
        h = 42 if r.doc_id is None else digest(r.doc_id.to_bytes(8, "little", signed=True), 42)
        for part in (r.source, r.text):
            h = h if part is None else digest(part.encode(), h)
        return h >> 24

    streams, sizes = {}, {}
    for r in sorted(rows, key=lambda r: (place(r), r.doc_id)):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        streams.setdefault(r.source, []).extend([r.doc_id] * n)
        sizes[r.source] = sizes.get(r.source, 0) + n
    goal = {s: round(t) for s, t in slow_targets(sizes).items()}
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    total = sum(goal.values())
    found, at = {}, dict.fromkeys(order, 0)
    for slot in range(-(-total // block)):
        point, low = (slot + 1) * S.GOLDEN % 2**40, 0
        for s in order:
            high = low + goal[s]
            if low * 2**40 // total <= point < high * 2**40 // total:
                break
            low = high
        for i in (streams[s] * 2)[at[s] : at[s] + block]:
            taken, first = found.get(i, (0, slot))
            found[i] = (taken + 1, first)
        at[s] += block
    return found


def test_mix_against_brute_force(docs):
    few = docs.select("doc_id", "source", "text").orderBy("doc_id").limit(40)
    want = slow_mix(few.collect(), 16)
    got = {r.doc_id: (r.taken, r.first_slot) for r in S.taken_words(few, block=16).collect()}
    assert got == {i: want.get(i, (0, None)) for i in got}


def test_sequence_decides(docs):
    """Another sequence than the golden ratio's gives other rows."""
    golden = {r.doc_id: (r.taken, r.first_slot) for r in S.taken_words(docs).collect()}
    other = lambda slot: F.pmod(slot * 2654435761, F.lit(1 << S.BITS))
    assert golden != {r.doc_id: (r.taken, r.first_slot) for r in S.taken_words(docs, point=other).collect()}


def test_schedule_is_spread(spark):
    rows = S.schedule(spark, [(0, 3000), (1, 1000), (2, 2000)], 10).orderBy("slot").collect()
    assert len(rows) == 600
    for n in (60, 150, 400, 600):  # every stretch follows the weights closely
        for s, share in enumerate((1 / 2, 1 / 6, 1 / 3)):
            assert abs(sum(r.sid == s for r in rows[:n]) - n * share) <= 3
    ranks = [r.rank for r in rows if r.sid == 2]
    assert sorted(ranks) == ranks == list(range(len(ranks)))


def test_odd_rows(odd_docs, no_docs):
    rows = S.taken_words(odd_docs, more=("source",)).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert len(rows) == odd_docs.count() and sizes[None] == 0
    check(rows, sizes, 3 * S.BLOCK_WORDS)
    assert S.taken_words(no_docs).count() == 0
    out = S.repeat_to_targets(odd_docs)
    assert out.columns == odd_docs.columns and 0 < out.count() <= 2 * odd_docs.count()
    assert S.repeat_to_targets(no_docs).count() == 0


def test_whole_documents_follow_the_words(docs):
    counted = {r.doc_id: (r.taken, r.size) for r in S.taken_words(docs).collect()}
    times = {r.doc_id: r["count"] for r in S.repeat_to_targets(docs).groupBy("doc_id").count().collect()}
    for i, (taken, size) in counted.items():
        assert times.get(i, 0) == (int(taken / size + 0.5) if size else 0)
