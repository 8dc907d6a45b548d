"""Operator 13 against counting in plain Python."""

import re
from collections import Counter

import pytest

from scriptloom.llm import collocations

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=5, least=100, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in cands.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(a, inside.get((lang, p[i:j]), 0))
    out = []
    for (lang, p), a in cands.items():
        if 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranks, result = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], p.decode(), -a, left, right, total[lang], -score))
    return sorted(result)


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize(("max_n", "least", "top"), [(5, 100, 2000), (3, 20, 50), (5, 8, 2000)])
def test_given_table(spark, docs, max_n, least, top):
    want = brute([(r.lang, r.text) for r in docs.collect()], max_n, least, top)
    assert want and rows_of(collocations.mine(docs, max_n, least, top)) == want


def test_pieces_ties_and_repeats(spark):
    rows = [("en", "A b, a B.\nc\td e f; g h g h É É"), (None, "a b a b a b a"), ("und", "a b! c d"), ("", "x x x x x"), ("en", None), ("fr", ""), ("fr", " \t. , ")] * 3
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, rank int, phrase string")
    for least in (1, 3, 6):
        assert rows_of(collocations.mine(frame, 5, least, 1000)) == brute(rows, 5, least, 1000)


def test_odd_rows(spark, odd_docs, no_docs):
    assert rows_of(collocations.mine(odd_docs, 5, 2, 2000)) == brute([(r.lang, r.text) for r in odd_docs.collect()], 5, 2, 2000)
    assert collocations.mine(no_docs).collect() == []


def test_products_past_64_bits(spark):
    """Counts of a corpus of 10^13 words: a * n * 1000 needs 86 bits."""
    n, a = 10**13, 4 * 10**9 + 1
    counts = spark.createDataFrame([("en", "x", a + 5), ("en", "y", n - a - 5), ("en", "x y", a)], "lang string, phrase string, a long")
    row = collocations.scored(counts).collect()[0]
    assert (row.n, row.score) == (n, 1000 * a * n // ((a + 5) * (n - a - 5)))
