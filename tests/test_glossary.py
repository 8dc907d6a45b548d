"""Glossary correction against a loop over terms, one pattern each."""

import random
import re
import time

import pytest

from scriptloom.operators import glossary as G


def loop(text, rules):
    """Term by term: a pattern with apostrophe classes over the whole text, hits replaced from left to right."""
    count = 0
    for canonical, alias in rules:
        body = "".join("['’‘`ʼ]" if c in "'’‘`ʼ" else re.escape(c) for c in alias)
        pattern = re.compile(rf"(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])", re.IGNORECASE)
        parts, at, start = [], 0, 0
        while m := pattern.search(text, start):
            start = m.start() + 1
            if m.start() < at or m[0] == canonical:
                continue
            a, b = G.with_edges(text, at, m.start(), m.end(), canonical)
            parts += [text[at:a], G.carried(canonical, text[a:b])]
            at, count, start = b, count + 1, max(start, b)
        text = "".join([*parts, text[at:]])
    return text, count


RULES = [
    ("SK Hynix", "es kay hynix"), ("SK Hynix", "SK Highnix"), ("New York City", "new york"), ("O'Brien", "o’brian"), ("York Peppermint", "york pepper"),
    ("Hynix Group", "sk hynix"), ("A", "b"), ("b c", "A"), ("c", "b c"), ("Jensen Huang", "jensen wong"), ("ab", "a b"), ("x", "ab x"),
]


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_the_loop(seed):
    rng = random.Random(seed)
    words = ["es", "kay", "hynix", "SK", "Highnix", "new", "York", "city", "o'brian", "o’Brian", "pepper", "a", "b", "c", "x", "jensen", "Wong", ",", ".", "the", "groups", "group", "New", "Jensen"]
    rules = RULES if seed % 2 else rng.sample(RULES, len(RULES))
    names = G.Glossary(rules)
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        assert names.correct(text) == loop(text, rules), text


def test_edges_and_marks():
    names = G.Glossary([("Jensen Huang", "jensen wong"), ("New York City", "new yorc")])
    assert names.correct("Then Jensen jensen wong Huang, came.") == ("Then Jensen Huang, came.", 1)
    assert names.correct("in New new yorc, City") == ("in New York City, City", 1)
    assert names.correct("JENSEN WONGs and xjensen wong") == ("JENSEN WONGs and xjensen wong", 0)


def test_time_is_linear():
    names = G.Glossary([(f"Term {k}", f"alias{k} of") for k in range(20_000)])
    text = "some words alias17 of the text that goes on and on without an end " * 30_000
    began = time.time()
    made, n = names.correct(text)
    assert n == 30_000 and "alias17" not in made and time.time() - began < 30


def test_frames(spark):
    texts = spark.createDataFrame([(1, "a new york b", "k"), (2, None, "k"), (3, "", None)], "id long, text string, replacement string")
    rules = spark.createDataFrame([(2, "NYC", "New York City"), (1, "New York City", "new york"), (3, None, "b"), (4, "x", None), (5, "y", " ")], "rule_no long, canonical string, alias string")
    got = {r.id: (r.text, r.replacements) for r in G.correct_texts(texts, rules).collect()}
    assert got == {1: ("a NYC b", 2), 2: (None, 0), 3: ("", 0)}
    assert {r.id: r.replacements for r in G.correct_texts(texts, rules.limit(0)).collect()} == {1: 0, 2: 0, 3: 0}
    G.PASS_TERMS, kept = 1, G.PASS_TERMS
    try:
        assert {r.id: (r.text, r.replacements) for r in G.correct_texts(texts, rules).collect()} == got
    finally:
        G.PASS_TERMS = kept
