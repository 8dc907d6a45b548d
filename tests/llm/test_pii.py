"""Operator 12: base spans against plain Python, added spans on planted cases and false alarms."""

import hashlib
import random
import re

import numpy as np
import pytest

from scriptloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    found = {k: [] for k in PLAIN}
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found[kind].append((m.start(), m.end()))
    return found


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for r, (i, text) in zip(rows, texts):
        want = base(text)
        assert r.doc_id == i
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in PLAIN], text
        told = [f"{k}:{a}:{b}" for k in PLAIN for a, b in want[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest(), text
        listed = [x for x in r.spans.split(",") if x]
        assert set(told) <= set(listed)
        order = [(list(PLAIN).index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in listed)]
        assert order == sorted(order)
        for (k, _, b), (k2, a, _) in zip(order, order[1:]):
            assert k != k2 or b <= a


def digest(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pii.digest(pii.detect(frame)).orderBy("doc_id").collect()


def test_given_table(spark, docs):
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = pii.digest(pii.detect(docs)).orderBy("doc_id").collect()
    check_base(rows, texts)
    assert all(sum(getattr(r, f"n_{k}") for r in rows) for k in PLAIN)
    clean = [r for r, (_, t) in zip(rows, texts) if not re.search("[0-9@]", t or "")]
    assert len(clean) > 50 and not any(r.spans for r in clean)


def test_hostile_texts(spark):
    rng = random.Random(5)
    bits = ["1", "22", "255", "256", "0", "007", ".", "..", "-", " ", "  ", "+", "(", ")", "@", "a", "b.c", "_", "%", "4111111111111111", "é", "𝒳", "\n", "com", "x@y.z", "1.2.3.4", "+1 (523) 555-1055", "at", " at ", "[at]", "::"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    check_base(digest(spark, texts), list(enumerate(texts)))


def test_long_and_many(spark):
    texts = lambda n: ["a" * 60 * n, "1" * 60 * n, "1 " * 20 * n, "+1" + "(" * 20 * n, "1.2.3.4 " * n, "a.b-" * 20 * n, "x@y.z " * n + "é", None, "", "x at " * 10 * n]
    check_base(digest(spark, texts(40)), list(enumerate(texts(40))))  # the plain patterns take quadratic time
    rows = digest(spark, texts(5000))
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(5000 * (k == 6), 5000 * (k == 4), 0, 0) for k in range(10)]
    assert rows[4].spans.endswith(f"ip:{8 * 4999}:{8 * 4999 + 7}") and rows[6].spans.endswith(f"email:{6 * 4999}:{6 * 4999 + 5}")


def card(rng):
    d = rng.choice(["4", "51", "37"]) + "".join(rng.choice("0123456789") for _ in range(13))
    d = d[:15] if d[0] != "3" else d[:14]
    return next(d + c for c in "0123456789" if luhn(d + c))


def planted(rng, n=300):
    """Texts whose items touch each other, so that base patterns run over their borders."""
    words = ["thing", "over", "ndre", "las", "und", "que", "Ertion"]
    make = {
        "card": lambda: card(rng),
        "phone": lambda: f"+1 ({rng.randint(201, 989)}) 555-{rng.randint(1000, 9999)}",
        "ip": lambda: ".".join(str(rng.randint(1, 223)) for _ in range(4)),
        "email": lambda: f"{rng.choice(words)}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com",
    }
    out = []
    for _ in range(n):
        text, want = " ".join(rng.choices(words, k=6)), []
        for kind in rng.sample(list(make), rng.randint(1, 3)):
            item = make[kind]()
            want.append((kind, len(text) + 1, len(text) + 1 + len(item)))
            text += " " + item
        out.append((text + " " + " ".join(rng.choices(words, k=6)), want))
    return out


FALSE_ALARMS = [
    "see version 10.2.33 and order 4565410125667262 now",
    "isbn 9783161484100 in the list of books",
    "page 12, section 4.5.6, build 20240101",
    "sum 1234567890123456 and 9999999999999999 of rows",
    "std::vec::abc and a::b at the dot of it",
    "look at the dots; meet at noon.",
    "chapter 555 123 and 12-34-56",
    "ratio 16:9:4 at 12:30:45",
    "the hash 1234567890123 of part 0000000000000000000",
]


def test_touching_items_are_found_and_false_alarms_are_not(spark):
    cases = planted(random.Random(11))
    rows = digest(spark, [t for t, _ in cases] + FALSE_ALARMS * 5)
    lost = at_base = total = 0
    for r, (text, want) in zip(rows, cases):
        listed = {tuple(x.split(":")) for x in r.spans.split(",") if x}
        for kind, a, b in want:
            total += 1
            at_base += (a, b) in base(text)[kind]
            covered = any(k == kind and int(x) <= a and int(y) >= b for k, x, y in listed)
            lost += not covered
    assert at_base < 0.93 * total and lost == 0
    for r, text in zip(rows[len(cases) :], FALSE_ALARMS * 5):
        want = base(text)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in want[k]), text


def test_wider_forms(spark):
    texts = ["write to jane.doe [at] example [dot] com today", "host 10[.]11[.]12[.]13 is down", "client 2001:db8:0:1:2:3:4:5 logged in", "call (523) 555-1055 after six", "tel 523-555-1055."]
    rows = digest(spark, texts)
    kinds = ["email", "ip", "ip", "phone", "phone"]
    for r, t, k in zip(rows, texts, kinds):
        assert r.spans.startswith(f"{k}:"), (t, r.spans)
        a, b = map(int, r.spans.split(":")[1:])
        assert t[a:b] in ("jane.doe [at] example [dot] com", "10[.]11[.]12[.]13", "2001:db8:0:1:2:3:4:5", "(523) 555-1055", "523-555-1055")


def test_em_finds_the_bad_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = [0.9, 0.95, 0.5, 0.85, 0.9, 0.6]
    votes = np.array([[2 if (t == (rng.random() < p)) else 1 for p in right] for t in truth])
    table, share, posterior = pii.em(votes, np.ones(len(votes)))
    assert abs(share - 0.4) < 0.05 and ((posterior > 0.5) == truth).mean() > 0.97
    assert abs(table[2, 0, 2] - table[2, 1, 2]) < 0.1 < table[1, 0, 2] - table[1, 1, 2]


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 1000])
def test_starts(spark, n):
    from pyspark.sql import functions as F

    sizes = [(k * 7) % 13 for k in range(n)]
    got = spark.createDataFrame([(sizes,)], "s array<int>").select(pii._starts(F.col("s"))).collect()[0][0]
    assert got == [sum(sizes[:k]) for k in range(n)]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = pii.digest(pii.detect(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert pii.digest(pii.detect(no_docs)).collect() == []
    found = pii.spans(spark.createDataFrame([(7, "mail a@b.cd now")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.kind, r.start, r.end, r.base) for r in found] == [(7, "email", 5, 11, True)]
