import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import simhash_dedup as S


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """Least id reachable by links of two bits or fewer."""
    ids = list(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= 2:
                    comp[i] = comp[j]
                    changed = True
    return comp


@given(st.text(alphabet="aBcÄ \n\t\x0b\x1c", max_size=40))
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_like_brute_force(docs, texts):
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    comp = slow_components(fps)
    assert found == {i: (f"{fps[i]:016x}", comp[i]) for i in texts}


def test_chains_and_flips(spark):
    """Chains of links, all pairs of two flipped bits, and unlinked neighbours at three bits."""
    rng = np.random.default_rng(5)
    fps = {}
    for k in range(60):
        base = int(rng.integers(0, 2**63))
        for step in range(6):
            fps[len(fps)] = base
            flips = rng.choice(64, size=int(rng.integers(1, 4)), replace=False)
            for b in flips:
                base ^= 1 << int(b)
    classes = spark.createDataFrame(sorted({(v - (1 << 64) if v >> 63 else v,) for v in fps.values()}), "fp long")
    roots = {r.node: r.root for r in S.components(S.links(classes)).collect()}
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in fps.items()}
    comp = slow_components(fps)
    for i in fps:
        for j in fps:
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (comp[i] == comp[j])


def test_hot_lists(spark):
    """Lists above ``HOT_LIST``: fingerprints that share four bytes, some of them six."""
    rng = np.random.default_rng(8)
    low = rng.integers(0, 2**32, 700, dtype=np.uint64)
    values = np.concatenate([low, low ^ (np.uint64(1) << rng.integers(0, 32, 700, dtype=np.uint64)), np.arange(600, dtype=np.uint64) * np.uint64(97)])
    fps = sorted({int(v) | 0xABCD1234 << 32 for v in values})
    signed = [v - (1 << 64) for v in fps]
    roots = {r.node: r.root for r in S.components(S.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    parent = dict.fromkeys(range(len(fps)))
    a = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    for start in range(len(fps)):  # flood fill
        if parent[start] is None:
            todo = [start]
            while todo:
                i = todo.pop()
                if parent[i] is None:
                    parent[i] = start
                    todo += np.flatnonzero(near[i]).tolist()
    assert [roots.get(v, v) for v in signed] == [signed[parent[i]] for i in range(len(fps))]


def test_count_filter():
    base = np.uint64(0x0102030405060708)
    fps = np.array([base, base ^ np.uint64(1), base ^ np.uint64(0x101), base ^ np.uint64(0x10101), base ^ np.uint64(7)], dtype=np.uint64)
    # the fourth differs from the first in three bytes, the last in three bits of one byte
    assert {tuple(p) for p in S.tallied(fps, 2).tolist()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (1, 4)}


@given(st.lists(st.integers(0, 65535), min_size=257, max_size=330, unique=True))
@settings(max_examples=15, deadline=None)
def test_long_lists_equal_short_ones(values):
    rests = np.sort(np.array(values, dtype=np.uint64))
    flips = S._flips(16, 2)

    def classes(pairs):
        parent = list(range(len(rests)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[root(max(a, b))] = root(min(a, b))
        groups = {}
        for i in range(len(rests)):
            groups.setdefault(root(i), []).append(i)
        return sorted(map(tuple, groups.values()))

    every = [(i, j) for i in range(len(rests)) for j in range(i + 1, len(rests)) if (int(rests[i]) ^ int(rests[j])).bit_count() <= 2]
    assert classes(S.list_links(rests, 2, [0, 1], flips)) == classes(every)


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[1] == by[6] and next(iter(by[1]))[1] == 1
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 8, 8]


def test_hub(spark):
    edges = spark.createDataFrame([(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(200)], "a long, b long")
    roots = {r.node: r.root for r in S.components(edges).collect()}
    assert all(roots[k] == 0 for k in range(3000)) and all(roots[5000 + k] == 5000 for k in range(201))


def test_components_lie_in_parts_of_counted_edges(spark, monkeypatch):
    """A hub, a long chain and repeated edges; parts follow the edges, not the session's shuffle partitions."""
    edges = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 7), (150, 130)]
    want = {k: 0 for k in range(40)} | {k: 100 for k in range(100, 161)}
    rounds, cut = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: rounds.append(cut(df)) or rounds[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for part_edges, most in ((50_000, 1), (30, 5)):
            monkeypatch.setattr(S, "PART_EDGES", part_edges)
            rounds.clear()
            found = S.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()
            assert {r.node: r.root for r in found} == want and len(found) == len(want)
            assert all(r.rdd.getNumPartitions() <= most for r in rounds)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
