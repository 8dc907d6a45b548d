"""Anchors and the dealing of translations to parts, against plain loops; longest common substrings."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import numerals
from scriptloom.functions.anchors import anchors
from scriptloom.operators import allocation
from scriptloom.operators.similarity import common_of, longest_common

STOPS = "，。！？；：、,.!?;:"
CODES = """translation_group_cardinality_mismatch full_translation_quality_issue group_allocation_information_omission unnatural_chinese_fragment
adjacent_chinese_semantic_duplication number_allocation_mismatch negation_allocation_mismatch entity_allocation_mismatch cross_id_semantic_leakage""".split()


@pytest.mark.parametrize(
    ("english", "expected"),
    [
        ("It cost 2.5 million in the 1990s", [("number", "2500000"), ("number", "1990"), ("entity", "It")]),
        ("1,200,300 people, 30% and 12 345", [("number", "1200300"), ("number", "30%"), ("number", "12345")]),
        ("they can't and never do", [("negation", "negation")]),
        ("I saw New York-Boston, This and AI", [("entity", "New York-Boston")]),
        ("5% million, 1,5 thousand", [("number", "5%"), ("number", "15000")]),
        ("9" * 30 + " hundred", [("number", "9" * 30)]),
        ("x5 Erü naïve isn't", []),
        ("", []),
        (None, []),
    ],
)
def test_anchors(spark, english, expected):
    row = spark.createDataFrame([(english,)], "t string").select(anchors(F.col("t")).alias("a")).first()
    assert [(a.type, a.value) for a in row.a] == expected


def test_decades_and_shares(spark):
    row = spark.createDataFrame([("the 1990s and 5% of 20 s",)], "t string").select(anchors(F.col("t")).alias("a")).first()
    assert [(a.value, a.percent, a.decade) for a in row.a] == [("1990", False, True), ("5%", True, False), ("20", False, True)]


# -- the plain loop ---------------------------------------------------------------------------


def key(text):
    return re.sub("[^一-鿿A-Za-z0-9]", "", text)


def torn(z, i, n):
    flat = re.sub(r"\s", "", z)
    bare = flat.rstrip(STOPS)
    if not bare:
        return True
    if flat[-1] in "。！？.!?" and len(bare) >= 4:
        return False
    if n > 1:
        if len(bare) <= 2 and bare not in allocation.SHORT_ANSWERS.split():
            return True
        if bare.startswith(tuple(allocation.OPEN_STARTS.split())) or (i < n - 1 and bare.endswith(tuple(allocation.OPEN_ENDS.split()))):
            return False
    if bare in "好的 没错 对 是的 真的 真的吗 在哪里 为什么 什么问题 那么 而且 然后 所以 不过 但是 此外".split():
        return False
    if (bare.startswith("如果") and re.search("[就会要能可必须]", bare)) or bare.endswith("你懂的"):
        return False
    return bare.startswith(tuple("而若 若 如果 因为 对于 在 将 把 意味着 以及".split())) or bare.endswith(tuple("的 以及 因为 如果 对于 在 将 把 意味着".split()))


def shows(kind, value, text):
    if kind == "number":
        flat = re.sub(r"[,，\s]", "", text)
        return any(form in flat for form in [value, *numerals.variants(value)])
    if kind == "negation":
        return bool(re.search("不|没|无|非|未|别|勿|直到.+才|对吧|是吧|难道", text))
    low = lambda x: re.sub("[^0-9A-Za-z]", "", x).lower()
    return value in text or low(value) in low(text)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain(full, parts, given, found):
    """Codes of a group: ``parts`` are ids and English, ``given`` maps ids to Chinese, ``found`` lists the anchors of a part."""
    ids, codes = [i for i, _ in parts], []
    n, texts = len(parts), [" ".join(given.get(i, "").split()) for i, _ in parts]
    keys = [key(t) for t in texts]
    if set(ids) != set(given):
        codes.append(CODES[0])
    if full.strip() and not re.search("[一-鿿]", full):
        codes.append(CODES[1])
    codes += [CODES[3] if t else CODES[2] for i, t in enumerate(texts) if not t or torn(t, i, n)]
    for a, b in zip(keys, keys[1:]):
        inside = a == b or (len(a) >= 8 and a in b) or (len(b) >= 8 and b in a)
        if a and b and (inside or common_of(a, b)):
            codes.append(CODES[4])
    whole, joined = key(full), "".join(keys)
    if whole and joined:
        if len(whole) < 10:
            lost = whole not in joined
        else:
            bag = sum(min(whole.count(c), joined.count(c)) for c in set(whole)) / len(whole)
            lost = bag < 0.82 and subsequence(whole, joined) / len(whole) < 0.5
        codes += [CODES[2]] if lost else []
    first = {}
    for at, (_, english) in enumerate(parts):
        for kind, value in found[english]:
            first.setdefault(value, (kind, at))
    for value, (kind, at) in first.items():
        on = [i for i in given if shows(kind, value, given[i])]
        follows, near = at + 1 < n and ids[at + 1] in on, any(0 <= k < n and ids[k] in on for k in (at - 1, at + 1))
        same = keys[at] in [key(given[i]) for i in on]
        if not on:
            bad = kind != "entity" or shows(kind, value, full)
        elif ids[at] in on:
            bad = False
        elif kind == "number":
            bad = not follows or not keys[at] or same or torn(texts[at], at, n)
        elif kind == "negation":
            bad = not near or not re.search(r"\b(like|as|to|of|for|with|that|which|who|when|if)$", parts[at][1].strip().lower())
        elif not keys[at] or same or (len(keys[at]) <= (3 if near else 6)):
            codes.append(CODES[8])
            continue
        else:
            bad = False
        codes += [f"{kind}_allocation_mismatch"] if bad else []
    return list(dict.fromkeys(codes))


ENGLISH = ["we had 2,500 of it", "it was not that", "in Paris", "and 30% like", "no one", "he saw New York in 1990", "they go", "3 million that", "not as", ""]
CHINESE = [
    "我们有两千五百个人在这里", "不是这样的事情", "在巴黎Paris", "百分之三十", "没有人", "他在1990年看见New York", "去吧", "三百万", "的", "", "因为这样", "好的",
    "我们有两千五百个人在这里生活", "这是城市经济发展的研究报告内容全文", "那是城市经济发展的研究报告内容吗朋友", "在", "意味着", "他们。", "NEW-YORK", "如果你会来",
]


def test_validate_like_plain_loop(spark):
    rng, groups, parts, returned, plain_groups = random.Random(5), [], [], [], {}
    for g in range(500):
        n = rng.choice([1, 1, 2, 3, 4, 5])
        own = [(f"S{i:04d}", rng.choice(ENGLISH)) for i in range(n)]
        given = {i: rng.choice(CHINESE) for i, _ in own if rng.random() < 0.96}
        if rng.random() < 0.05:
            given["S9999"] = rng.choice(CHINESE)
        full = rng.choice(["".join(given.values()), "".join(rng.choices(CHINESE, k=4)), "no Paris", "", rng.choice(CHINESE)])
        plain_groups[g] = (full, own, given)
        groups.append((g // 7, g, full or None, "x"))
        parts += [(g // 7, g, k, i, e or None, "y") for k, (i, e) in enumerate(own)]
        returned += [(g // 7, g, k, i, z or None, "z") for k, (i, z) in enumerate(given.items())]
        if given and rng.random() < 0.2:  # an earlier answer for the same id doesn't count
            returned.append((g // 7, g, -1, next(iter(given)), "不", "z"))
    for rows in (parts, returned):
        rng.shuffle(rows)
    found = {
        r.e: [(a.type, a.value) for a in r.a] for r in spark.createDataFrame([(e,) for e in ENGLISH], "e string").select("e", anchors(F.col("e")).alias("a")).collect()
    }
    ours = allocation.validate(
        spark.createDataFrame(groups, "file_id long, group_no long, full_translation string, at string"),
        spark.createDataFrame(parts, "file_id long, group_no long, part_no int, part_id string, english string, full string"),
        spark.createDataFrame(returned, "file_id long, group_no long, at int, part_id string, chinese string, parts string"),
    )
    seen = {r.group_no: (list(r.codes), r.valid) for r in ours.collect()}
    want = {g: plain(*args, found) for g, args in plain_groups.items()}
    assert {g: c for g, (c, _) in seen.items()} == want
    assert all(valid == (not set(c) - {CODES[1]}) for c, valid in seen.values())
    assert {c for cs in want.values() for c in cs} == set(CODES)


def test_validate_empty(spark):
    tables = [
        spark.createDataFrame([], f"file_id long, group_no long, {c}")
        for c in ("full_translation string", "part_no int, part_id string, english string", "at int, part_id string, chinese string")
    ]
    assert allocation.validate(*tables).count() == 0


def test_every_code_on_the_tables(spark, data):
    from scriptloom.plans import catalog, editor_queries  # noqa: F401

    rows = catalog.QUERIES["allocation_codes"](spark, data).toPandas()
    counts = rows["codes"].str.split(",").explode().value_counts()
    assert all(counts.get(c, 0) >= 10 for c in CODES) and rows["valid"].sum() >= 10


def test_longest_common_like_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abc"[: rng.choice([1, 2, 3])], k=rng.randrange(14))) for _ in range(2))
        size = max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)
        first = next(i for i in range(len(a) + 1) if a[i : i + size] in b)
        assert longest_common(a, b) == a[first : first + size]
        m = SequenceMatcher(None, a, b).find_longest_match()
        assert m.size == size and m.a == first


def test_longest_common_is_linear():
    rng, took = random.Random(4), []
    for n in (50_000, 100_000):
        a, b = ("".join(rng.choices("ab", k=n)) for _ in range(2))
        start = time.process_time()
        b = b[: n // 2] + a[n // 3 : n // 3 + 500] + b[n // 2 :]
        found = longest_common(a, b)
        assert len(found) >= 500 and found in a and found in b
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0] + 1


def test_common_phrase():
    assert common_of("城市经济发展研究报告全文一二", "甲乙城市经济发展研究报告全文丙") == "城市经济发展研究报告全文"
    assert common_of("这个那个他们我们因为所以甲乙", "这个那个他们我们因为所以丙丁") == ""
    assert common_of("城市经济发展研究", "城市经济发展研究") == ""


def test_lambdas_replace_nothing_for_pairs():
    """Texts are prepared once; what is asked of each part, or of each anchor and text, holds no replacement."""
    asked = allocation.bad_part() + allocation.present("x", "forms", "g")
    assert "regexp_replace" not in asked


def test_common_phrase_looks_for_short_runs_first(monkeypatch):
    from scriptloom.operators import similarity

    rng = random.Random(3)
    texts = ["".join(rng.choice("在是个了") for _ in range(rng.choice([5, 12, 14, 30]))) for _ in range(60)]
    plain = lambda a, b: (lambda x: x if min(len(a), len(b)) >= 12 and len(x) >= max(10, int(min(len(a), len(b)) * 0.35)) else "")(longest_common(a, b))
    pairs = [*zip(texts, texts[1:]), *((a, b[:3] + a[1:12] + b) for a, b in zip(texts, texts[2:]))]
    assert [common_of(a, b) for a, b in pairs] == [plain(a, b) for a, b in pairs] and any(common_of(a, b) for a, b in pairs)
    monkeypatch.setattr(similarity, "longest_common", None)
    assert common_of("在是个了" * 5, "他她我们不有" * 4) == ""
