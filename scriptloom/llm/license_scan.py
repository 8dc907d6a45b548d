"""Licence scan: a trained paragraph classifier confirmed by template comparison.

Paragraphs are blocks of lines: a line break inside a sentence, before a lower-case letter, is a
wrap. Sparse word n-gram logistic regression, one model per licence family and one for "unknown",
scores the words and word pairs of each paragraph. Calibration on held-out examples fits the
softmax's temperature, the unknown class's intercept and the least confidence that counts; a
paragraph below is unknown. A prediction stands only if the paragraph also covers enough of one of
the family's templates.

Training happens on the driver from sentences built out of the templates below and from plain
word salads: a fixed, small set, no rows of a table. Scoring is DataFrame functions only.
"""

from __future__ import annotations

import random
from functools import lru_cache
from math import exp, log
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import double_array, let

#: Short notices of public licence families.
TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "this project is released under the apache software license",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "this software is released under the bsd 3 clause license",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "spdx license identifier bsd 3 clause",
    ],
    "cc": [
        "this work is licensed under a creative commons attribution 4 0 international license",
        "licensed under the creative commons attribution sharealike license",
        "licensed under cc by sa 4 0",
        "licensed under cc by nc 4 0",
        "available under the creative commons attribution license",
    ],
    "gpl": [
        "is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "licensed under the gnu general public license version 2 or later",
        "spdx license identifier gpl 3 0 or later",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1",
        "this library is free software you can redistribute it under the terms of the gnu lesser general public license",
        "spdx license identifier lgpl 2 1 or later",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "released under the mit license",
        "licensed under the mit license",
        "the software is provided as is without warranty of any kind express or implied",
        "spdx license identifier mit",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "proprietary": [
        "all rights reserved unauthorized copying of this file is strictly prohibited",
        "proprietary and confidential all rights reserved",
        "copyright all rights reserved",
        "all rights reserved",
    ],
}
FAMILIES = [*sorted(TEMPLATES), "unknown"]
#: Words of everyday sentences that the unknown class is trained with.
FILLER = (
    "the a of and to in is was for on with that it as by this from are be at or not you we can may has use used new file "
    "version license licensed public general copy free software source code terms rights program work under released "
    "driver driving medical business marriage party city year time people data model house water school music history"
).split()
EXAMPLES_PER_TEMPLATE, UNKNOWN_EXAMPLES, EPOCHS, RATE, SHRINK = 12, 900, 12, 0.5, 4e-4
MIN_WEIGHT, MIN_COVER = 0.05, 0.55
#: Share of held-out unknown paragraphs that may count as a licence by confidence alone.
FALSE_SHARE = 0.005


def tokens_of(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(" ") if w]


def _grams(words: list[str]) -> list[str]:
    """Features of a paragraph: its words and pairs."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]))


def examples(seed: int = 7, templates: dict[str, list[str]] = TEMPLATES, filler: list[str] = FILLER) -> list[tuple[str, str]]:
    """Labelled paragraphs: cut, mixed and padded templates; for "unknown" salads of everyday words
    and, in every third, of the templates' words."""
    rng = random.Random(seed)
    found = []
    for family, notices in templates.items():
        for notice in notices:
            w = notice.split()
            for _ in range(EXAMPLES_PER_TEMPLATE):
                cut = w[: max(4, len(w) - rng.randint(0, 3))]
                pad = [f"x{rng.randint(0, 99)}" for _ in range(rng.randint(0, 4))]
                found.append((family, " ".join([*pad, *cut] if rng.random() < 0.7 else [*cut, *pad])))
    legal = [*filler, *sorted({w for notices in templates.values() for t in notices for w in t.split()})]
    for k in range(UNKNOWN_EXAMPLES):
        n = rng.randint(3, 30)
        common = rng.random()
        pool = filler if k % 3 else legal
        found.append(("unknown", " ".join(rng.choice(pool) if rng.random() < common else f"x{rng.randint(0, 99)}" for _ in range(n))))
    rng.shuffle(found)
    return found


class Model(NamedTuple):
    weights: dict[str, list[float]]  # of each n-gram, one number per family
    bias: list[float]
    temperature: float
    least: float  # confidence


def fit(rows: list[tuple[str, str]]) -> tuple[dict[str, list[float]], list[float]]:
    """Weights and intercepts by stochastic gradient with L1 shrinkage."""
    data = [(FAMILIES.index(f), _grams(tokens_of(t))) for f, t in rows]
    weights: dict[str, list[float]] = {}
    bias = [0.0] * len(FAMILIES)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.1 * epoch)
        for label, grams in data:
            p = softmax(scores(grams, weights, bias))
            grad = [rate * ((k == label) - x) for k, x in enumerate(p)]
            bias = [b + 0.1 * d for b, d in zip(bias, grad)]
            for g in grams:
                w = weights.setdefault(g, [0.0] * len(FAMILIES))
                for k, d in enumerate(grad):
                    v = w[k] + d / len(grams) ** 0.5
                    w[k] = max(0.0, v - SHRINK) if v > 0 else min(0.0, v + SHRINK)
    # sparse: n-grams that matter; padding words of the examples (x and digits) carry no meaning
    kept = {
        g: [round(v, 4) for v in w]
        for g, w in weights.items()
        if max(map(abs, w)) >= MIN_WEIGHT and not any(p[0] == "x" and p[1:].isdigit() for p in g.split())
    }
    return dict(sorted(kept.items())), [round(b, 4) for b in bias]


def scores(grams: list[str], weights: dict[str, list[float]], bias: list[float]) -> list[float]:
    out = list(bias)
    for g in grams:
        if g in weights:
            out = [s + w for s, w in zip(out, weights[g])]
    return out


def softmax(s: list[float], temperature: float = 1.0) -> list[float]:
    e = [exp((x - max(s)) / temperature) for x in s]
    return [x / sum(e) for x in e]


def calibrate(weights: dict[str, list[float]], bias: list[float], rows: list[tuple[str, str]]) -> Model:
    """Temperature and unknown intercept of least log loss on ``rows``, which the fit hasn't seen;
    then the confidence that only ``FALSE_SHARE`` of the unknown rows exceed in a licence family."""
    unknown = FAMILIES.index("unknown")
    held = [(FAMILIES.index(f), scores(_grams(tokens_of(t)), weights, bias)) for f, t in rows]

    def moved(s: list[float], shift: float) -> list[float]:
        return [x + shift * (k == unknown) for k, x in enumerate(s)]

    def loss(temperature: float, shift: float) -> float:
        return -sum(log(max(1e-12, softmax(moved(s, shift), temperature)[label])) for label, s in held)

    temperature, shift = min(((0.125 * 2 ** (k / 2), j / 2) for k in range(13) for j in range(-8, 17)), key=lambda c: loss(*c))
    wrong = []
    for label, s in held:
        p = softmax(moved(s, shift), temperature)
        if label == unknown and max(p) > p[unknown]:
            wrong.append(max(p))
    allowed = int(FALSE_SHARE * sum(label == unknown for label, _ in held))
    over = sorted(wrong, reverse=True)[allowed:]
    return Model(weights, [round(x, 4) for x in moved(bias, shift)], temperature, round(max([0.5, *over]) + 1e-4, 4))


@lru_cache(maxsize=1)
def model() -> Model:
    """The model of all templates, calibrated on examples of another seed and of another kind:
    of each second licence notice only a part is left, of two words or more from any place."""
    rng = random.Random(11)
    held = []
    for k, (family, text) in enumerate(examples(seed=23)):
        w = text.split()
        if family != "unknown" and k % 2:
            at = rng.randrange(len(w) - 2)
            w = w[at : at + rng.randint(2, len(w))]
        held.append((family, " ".join(w)))
    return calibrate(*fit(examples()), held)


def gram_hash(gram: str) -> int:
    """XXH64 of a word, chained over the words of a pair, as a signed number."""
    h, *rest = [xxhash.xxh64_intdigest(w.encode(), 42) for w in gram.split()]
    for x in rest:
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
    return h - (1 << 64) if h >> 63 else h


class Table(NamedTuple):
    """Perfect hash of the model's n-grams: an n-gram's slot is a part of its hash, moved by what
    its group of hashes is moved by."""

    shift: int
    moves: list[int]
    slots: list[int]  # the hash that a slot holds, 0 if none
    numbers: list[int]  # the n-gram that a slot holds, -1 if none


GROUPS, SLOTS = 256, 2048


@lru_cache(maxsize=1)
def table() -> Table:
    hashes = [gram_hash(g) for g in model().weights]
    groups: dict[int, list[int]] = {}
    for k, h in enumerate(hashes):
        groups.setdefault(h % GROUPS, []).append(k)
    for shift in range(8, 50):
        found = Table(shift, [0] * GROUPS, [0] * SLOTS, [-1] * SLOTS)
        for group, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            for move in range(SLOTS):
                at = {((hashes[k] >> shift) + move) % SLOTS: k for k in members}
                if len(at) == len(members) and all(found.numbers[s] < 0 for s in at):
                    break
            else:
                break
            found.moves[group] = move
            for s, k in at.items():
                found.slots[s], found.numbers[s] = hashes[k], k
        else:
            return found
    raise ValueError("no perfect hash: the model has too many n-grams for the table")


def _constant(values: list, kind: str) -> Column:
    """A constant array; one literal for the optimizer to fold, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def known_slots(hashes: Column) -> Column:
    """Slots of the model's n-grams among the hashes, each once."""
    t = table()
    moves, slots = _constant(t.moves, "bigint"), _constant(t.slots, "bigint")
    low = lambda x, n: x.bitwiseAND(F.lit(n - 1).cast("long"))
    slot = lambda h: low(low(F.shiftright(h, t.shift), SLOTS) + F.get(moves, low(h, GROUPS).cast("int")), SLOTS).cast("int")
    return F.array_distinct(F.transform(F.filter(hashes, lambda h: F.get(slots, slot(h)) == h), slot))


def paragraphs(text: Column) -> Column:
    """Blocks of lines: breaks after a sentence's end, before a blank line, or before a line that
    doesn't go on in lower case."""
    return F.split(text, r"(?<=[.!?:;])\s*\n|\n(?![ \t#*/]*[a-z(])")


def scan(docs: DataFrame) -> DataFrame:
    """One row per licence paragraph: ``doc_id, paragraph, family, confidence, cover, text``.

    Null and empty texts have no paragraphs. Repeated rows are scanned as often; null ids stay;
    an empty table gives an empty result; extra columns are ignored. Equal scores go to the
    family first in alphabet.
    """
    m = model()
    n = F.greatest(F.size("_one") - 1, F.lit(0))
    weights = list(m.weights.values())
    weight = [double_array([weights[i][k] if i >= 0 else 0.0 for i in table().numbers]) for k in range(len(FAMILIES))]
    add = lambda w: lambda a, i: a + F.get(w, i)
    score = [F.aggregate("_known", F.lit(b), add(w)) for b, w in zip(m.bias, weight)]
    soft = F.transform("_scores", lambda s: F.exp((s - F.array_max("_scores")) / m.temperature))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    unknown = FAMILIES.index("unknown") + 1
    # a column for each step: it is computed once; an explode of nothing drops the row, where a
    # filter, also one on what comes later, would be pushed below the columns and repeat them
    scored = (
        docs.select(F.col("doc_id").cast("long"), F.posexplode(paragraphs(F.col("text").cast("string"))).alias("paragraph", "text"))
        .withColumn("_words", F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), ""))
        .withColumn("_one", F.transform("_words", lambda x: F.xxhash64(x)))
        .withColumn("_two", F.zip_with(F.slice("_one", F.lit(1), n), F.slice("_one", F.lit(2), n), lambda a, b: F.xxhash64(a, b)))
        .withColumn("_grams", F.concat("_one", "_two"))
        .withColumn("_known", known_slots(F.col("_grams")))
        .withColumn("_scores", F.array(*score))
        .withColumn("_best", F.array_position("_scores", F.array_max("_scores")).cast("int"))
        .withColumn("_confidence", let(soft, lambda p: 1 / total(p)))
    )
    likely = (F.col("_best") != unknown) & (F.col("_confidence") >= m.least)
    row = F.struct("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text", "_grams", "_best", "_confidence")
    picked = scored.select(F.explode(F.when(likely, F.array(row))).alias("p")).select("p.*")
    cover = F.lit(0.0)
    for family, notices in TEMPLATES.items():
        per = []
        for notice in notices:
            grams_of = sorted(map(gram_hash, _grams(tokens_of(notice))))
            per.append(F.size(F.array_intersect("_grams", _constant(grams_of, "bigint"))) / len(grams_of))
        cover = F.when(F.col("_best") == FAMILIES.index(family) + 1, F.greatest(*per)).otherwise(cover)
    return (
        picked.withColumn("cover", cover)
        .where(F.col("cover") >= MIN_COVER)
        .select(
            "doc_id",
            "paragraph",
            F.get(F.array(*map(F.lit, FAMILIES)), F.col("_best") - 1).alias("family"),
            F.round("_confidence", 4).alias("confidence"),
            F.round("cover", 4).alias("cover"),
            "text",
        )
    )


def families(docs: DataFrame) -> DataFrame:
    """``doc_id, families, n_paragraphs, confidence`` of the documents that hold licence paragraphs.

    Rows of one id are one document, and so are those without an id; documents without licence
    paragraphs, null and empty texts among them, have no row; an empty table gives an empty result.
    """
    return scan(docs).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.max("confidence").alias("confidence"),
    )
