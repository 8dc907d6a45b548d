"""Boundary repair against a loop over whole lists, which holds a file's items at once and counts its steps as one."""

import os
import random
from collections import Counter, defaultdict

import pytest

from scriptloom.operators import repair as R
from scriptloom.plans import boundary_queries, catalog  # noqa: F401
from scriptloom.plans import views as V

NAMES = ["word_id", "item", "n_items", "kinds", "hard", "score", "trailing", "token", "pause"]


def with_count(rows):
    n = sum(not k or rows[k - 1][1] != r[1] for k, r in enumerate(rows))
    return [(*r[:2], n, *r[2:]) for r in rows]


class Book:
    """A file's words by place."""

    def __init__(self, rows):
        self.rows = rows

    def __getitem__(self, k):
        return self.rows[k][3:]

    own, has, any, joins, inner_transition = R.Words.own, R.Words.has, R.Words.any, R.Words.joins, R.Words.inner_transition


def whole_list(rows, most=R.MAX_WORDS):
    """The two loops as written down: a list, an index, a guard of max(1000, 8 n) steps."""
    book, items = Book(rows), []
    for k, row in enumerate(rows):
        if k and rows[k - 1][1] == row[1]:
            items[-1] = (items[-1][0], k)
        else:
            items.append((k, k))
    given = set(items)
    cut = []
    for a, b in items:
        t = book.inner_transition((a, b))
        cut += [(a, b)] if t is None else [(a, t - 1), (t, b)]
    stopped = False
    for loop in ("boundaries", "fragments"):
        index = steps = 0
        while index < len(cut):
            steps += 1
            if steps > max(1000, 8 * len(items)):
                stopped = True
                break
            if loop == "boundaries":
                if index >= len(cut) - 1:
                    break
                at, (issues, _) = index, R.evaluate(book, cut[index], cut[index + 1], index > 0)
            else:
                issues = R.fragment(book, cut[index], index > 0, index + 1 < len(cut))
                at = index if index + 1 < len(cut) else index - 1
            made = R.mended(book, cut, at, issues, most) if issues and at >= 0 else None
            if made is None:
                index += 1
                continue
            a, b, new = made
            cut[a:b] = new
            index = max(0, a - 1)
    return [(n, rows[a][0], rows[b][0], len(book.own((a, b))), (a, b) not in given) for n, (a, b) in enumerate(cut, 1)], stopped


def streamed(rows, most=R.MAX_WORDS):
    return list(R.repaired(most)(iter(rows)))


@pytest.fixture(scope="module")
def files(spark, data):
    found = defaultdict(list)
    for r in R.marked(V.spliced_words(spark, data)).orderBy("file_id", "word_id").collect():
        found[r.file_id].append((r.word_id, r.item, *(r[n] for n in NAMES[3:])))
    return {f: with_count(rows) for f, rows in found.items()}


def test_equal_to_the_whole_list(spark, data, files):
    got = defaultdict(list)
    for r in catalog.QUERIES["boundary_repair"](spark, data).orderBy("file_id", "item_no").collect():
        got[r.file_id].append(tuple(r)[1:])
    assert set(got) == set(files)
    changed = ended = 0
    for file_id, rows in files.items():
        want, stopped = whole_list(rows)
        assert got[file_id] == want, file_id
        changed += sum(r[4] for r in want)
        ended += stopped
    assert changed > 100 and ended < len(files)  # where changes undo each other, the guard ends the loop


def test_items_cover_all_words_and_issues_get_fewer(files):
    before, after = Counter(), Counter()
    for rows in files.values():
        book, place = Book(rows), {r[0]: k for k, r in enumerate(rows)}
        out = streamed(rows)
        spans = [(place[a], place[b]) for _, a, b, _, _ in out]
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(len(rows)))
        old = [k for k in range(len(rows) - 1) if rows[k][1] != rows[k + 1][1]]
        before.update(n for k in old for j, n in enumerate(R.HARD) if rows[k][4] >> j & 1)
        after.update(n for _, k in spans[:-1] for j, n in enumerate(R.HARD) if rows[k][4] >> j & 1)
    assert sum(after.values()) < 0.5 * sum(before.values())


def test_random_items(files):
    """Other items over the same words: short, long, and of one word."""
    rng = random.Random(3)
    for rows in list(files.values())[:12]:
        for most_in_item in (2, 6, 14):
            item, out = 0, []
            for row in rows:
                item += rng.random() < 1 / most_in_item
                out.append((row[0], item, *row[3:]))
            out = with_count(out)
            assert streamed(out) == whole_list(out)[0]


def test_many_items_in_bounded_memory(files):
    rows, n = [r for f in files.values() for r in f], 60_000
    kept = []

    def source():
        for k in range(n):
            r = rows[k % len(rows)]
            yield (k, k // 4, n // 4, *r[3:])

    original = R.Words.forget

    def watch(self, before):
        original(self, before)
        kept.append(len(self.rows))

    R.Words.forget = watch
    try:
        total = sum(b - a + 1 for _, a, b, _, _ in R.repaired()(source()))
    finally:
        R.Words.forget = original
    assert total == n and kept and max(kept) < 8000


def test_cases(spark):
    """Cases of single rules: a determiner, a preposition, a named phrase, a lone pronoun, other speakers, a pause."""
    texts = [
        ("a", ["we walked to the", "old house near"], ["we walked", "to the old house near"]),
        ("a", ["they moved to wall", "street in may"], ["they moved", "to wall street in may"]),
        ("x", ["we walked to the", "old house near"], ["we walked to the", "old house near"]),
        ("p", ["we walked to the", "old house near"], ["we walked to the", "old house near"]),
    ]
    rows = []
    for f, (mode, items, _) in enumerate(texts):
        t = k = 0
        for i, item in enumerate(items):
            for w in item.split():
                rows.append((f, k, i, "b" if mode == "x" and i else "a", w, t, t + 200))
                t, k = t + 200, k + 1
            t += 500 if mode == "p" else 0
    frame = spark.createDataFrame(rows, "file_id long, word_id long, item long, speaker string, surface string, start_ms long, end_ms long")
    got = defaultdict(list)
    surface = {(r[0], r[1]): r[4] for r in rows}
    for r in R.repair(frame).orderBy("file_id", "item_no").collect():
        got[r.file_id].append(" ".join(surface[r.file_id, k] for k in range(r.word_start, r.word_end + 1)))
    for f, (_, items, want) in enumerate(texts):
        if want == items:
            assert got[f] == want
        else:
            assert got[f] != items and not any(x.split()[-1] in ("the", "wall", "to") for x in got[f]), got[f]
    assert R.repair(frame.limit(0)).count() == 0


def test_every_code_fires(spark, data):
    from scriptloom.functions import boundaries as B

    larger = data.replace("sf0.001", "sf0.01")
    data = larger if os.path.isdir(larger) else data
    pairs = Counter(c for r in catalog.QUERIES["spliced_boundary_rules"](spark, data).collect() for c in r.codes.split(","))
    assert set(B.pair_rules(B.SPARK)) <= set(pairs), set(B.pair_rules(B.SPARK)) - set(pairs)
    rows = catalog.QUERIES["spliced_fragment_rules"](spark, data).collect()
    found = Counter(c for r in rows for c in r.codes.split(","))
    assert set(B.row_rules(B.SPARK)) <= set(found), set(B.row_rules(B.SPARK)) - set(found)
    assert len({r.trailing_issue for r in rows} - {""}) == 7


def test_parts_are_judged_once(monkeypatch):
    """A window's cuts share their parts: each is judged once, and cuts that break a hard rule judge none."""
    words = R.Words()
    for k in range(9):
        words.add((R.WORD | R.KINDS["predicate"], 1 if k == 3 else 0, 0, "", f"w{k}", 10))
    judged, plain = [], R.evaluate
    monkeypatch.setattr(R, "evaluate", lambda w, left, right, before: judged.append((left, right is None)) or plain(w, left, right, before))
    window = [(0, 2), (3, 5), (6, 8)]
    assert R.repartition(words, window, 16) == window
    assert len(judged) == len(set(judged)) and all(left[1] != 3 for left, _ in judged)
