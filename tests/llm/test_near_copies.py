import random

import pytest

from scriptloom.llm import near_copies as S


def plain(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_groups(texts):
    """Index of the first member of every text's group, by all pairs."""
    sets, root = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(sets)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(seed=1):
    """Texts with copies of 1 to 12 changed words, chains of edits, and borderline lengths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(25):
        w = [word() for _ in range(rng.choice([3, 9, 24, 60, 200, 700]))]
        out.append(" ".join(w))
        for k in (1, 2, 4, 8, 12):
            v = list(w)
            for at in rng.sample(range(len(v)), min(k, len(v))):
                v[at] = word()
            out.append(" ".join(v))
        for _ in range(4):  # each differs from the one before
            w = w[: len(w) - len(w) // 12] + [word() for _ in range(len(w) // 12)]
            out.append(" ".join(w))
            w = w[len(w) // 12 :]
    return out + [None, "", "  "]


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in S.keep_one(docs).collect()}


def test_edited_copies_like_brute_force(spark):
    texts = edited()
    want = set(slow_groups(texts))
    assert kept(spark, texts) == want and len(want) < len(texts)


def test_stage_like_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {rows[i].doc_id for i in slow_groups([r.text for r in rows])}
    assert {r.doc_id for r in pipeline.dedup(spark, docs, "").collect()} == want


def test_odd_rows(odd_docs, no_docs):
    got = S.keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 5, 7, 8]
    assert S.keep_one(no_docs).count() == 0


def test_forest_and_cells(spark, monkeypatch):
    """A large group of texts that are near each other, but not all near: exact without its pairs."""
    import random

    monkeypatch.setattr(S, "CELL_SHINGLES", 900)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            words[at] = f"e{rng.randrange(40)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    want = {min(k for k, r in enumerate(roots) if r == root) for roots in [slow_groups(texts)] for root in set(roots)}
    assert kept == want and 1 < len(kept) < 70


def test_index_of_fingerprints_comes_first(spark):
    """The byte-position index finds what is within two bits, also where the bands find nothing."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:1500], "other", *base[1501:]]), " ".join(base[:-1]), "nothing like it at all"]
    prints = [S.signature(S.shingles(t))[1] for t in texts]
    assert all(0 < (prints[0] ^ p).bit_count() <= 2 or prints[0] == p for p in prints[1:3])
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    classes = spark.createDataFrame(
        [(k, *(x - (1 << 64) if x >> 63 else x for x in S.signature(S.shingles(t))[:2]), []) for k, t in enumerate(texts)], "row long, digest long, fp long, bands array<long>"
    )
    found = S.groups(classes, rows).collect()
    digests = [r.digest for r in classes.orderBy("row").collect()]
    assert {r.node for r in found} == set(digests[:3]) and len({r.root for r in found}) == 1
