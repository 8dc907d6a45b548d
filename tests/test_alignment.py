"""Sentence alignment against a plain scan of all windows with difflib."""

import difflib
import random
from collections import defaultdict

import pytest

from scriptloom.operators import alignment as A
from scriptloom.operators.sequential import mixed_words
from scriptloom.operators.similarity import ratio_of
from scriptloom.plans import views as V


def scan(rows, sentences):
    """Every window, every ratio; rows and sentences as lists of (number, text)."""
    out, at, shift, lost, failed = [], 0, 30, 0, False
    texts = [t for _, t in rows]
    for no, sentence in sentences:
        if failed:
            out.append((no, "failed", None, None, None))
            continue
        want = A.plain(sentence)
        n = mixed_words(want)
        best, found = 0.0, None
        for size in sorted(range(max(1, n // 2), min(2 * n, len(texts) - at) + 1), key=lambda x: abs(x - n)):
            for start in range(at, min(at + shift + 1, len(texts) - size + 1)):
                ratio = difflib.SequenceMatcher(None, want, A.plain("".join(texts[start : start + size]))).ratio()
                if ratio > best:
                    best, found = ratio, (start, size)
                if ratio == 1.0:
                    break
            if best == 1.0:
                break
        if best >= 0.5:
            start, size = found
            out.append((no, "matched", rows[start][0], rows[start + size - 1][0], round(best, 6)))
            at, shift = start + size, 30
        else:
            lost += 1
            failed = lost > 5
            out.append((no, "failed" if failed else "unmatched", None, None, None))
            at, shift = max(0, min(at + 1, len(texts) - 1)), 100
    return out


@pytest.fixture(scope="module")
def files(spark, data):
    rows, sentences = defaultdict(list), defaultdict(list)
    for r in V.cue_word_rows(spark, data).orderBy("file_id", "row_no").collect():
        rows[r.file_id].append((r.row_no, r.text))
    for r in V.damaged_sentences(spark, data).orderBy("file_id", "sentence_no").collect():
        sentences[r.file_id].append((r.sentence_no, r.text))
    return rows, sentences


@pytest.fixture(scope="module")
def got(spark, data):
    from scriptloom.plans import catalog, editor_queries  # noqa: F401

    found = defaultdict(list)
    for r in catalog.QUERIES["sentence_alignment"](spark, data).orderBy("file_id", "sentence_no").collect():
        found[r.file_id].append(tuple(r)[1:])
    return found


def test_equal_to_plain_scan(files, got):
    rows, sentences = files
    small = sorted(sentences, key=lambda f: sum(len(t) for _, t in sentences[f]))[:10]
    for f in small:
        assert [r[:5] for r in got[f]] == scan(rows[f], sentences[f]), f


def test_damaged_sentences_are_found_again(files, got):
    _, sentences = files
    assert {f: len(r) for f, r in got.items()} == {f: len(s) for f, s in sentences.items()}
    rows = [r for file in got.values() for r in file]
    found = [r for r in rows if r[1] == "matched" and r[0] * 10000 <= r[2] <= r[3] < (r[0] + 1) * 10000]
    alive = [r for r in rows if r[1] != "failed" and r[0] % 13 != 5]
    assert len(found) > 0.9 * len(alive)
    share = sum(r[6] for r in rows) / sum(r[5] for r in rows)
    print(f"share of ratios computed: {share:.3f}")
    assert share < 0.05


def test_hard_cases():
    rng = random.Random(9)
    words = ["ab ", "abc ", "bd ", "e", " f ", "ab", "", "中文 ", "中", None]
    for case in range(60):
        rows = [(k, rng.choice(words) or "") for k in range(rng.randint(0, 40))]
        sentences = [(k, "".join(rng.choice(words) or "" for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(0, 12))]
        n = len(rows)
        merged = [(A.ROW, no, t, n) for no, t in rows] + [(A.SENTENCE, no, t, n) for no, t in sentences]
        rng.shuffle(merged)
        merged.sort(key=lambda x: x[1] / max(1, n if x[0] == A.ROW else len(sentences)))
        assert [r[:5] for r in A.aligned()(iter(merged))] == scan(rows, sentences), case


def test_one_side_missing(spark):
    rows = spark.createDataFrame([(1, 1, "a "), (1, 2, None), (3, 1, "x ")], "file_id long, row_no long, text string")
    sentences = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "b")], "file_id long, sentence_no long, text string")
    got = {(r.file_id, r.sentence_no): (r.status, r.first_row) for r in A.align(rows, sentences).collect()}
    assert got == {(1, 1): ("matched", 1), (1, 2): ("unmatched", None), (2, 1): ("unmatched", None)}
    assert A.align(rows.limit(0), sentences.limit(0)).count() == 0


def test_long_sentences_without_a_match_cost_few_ratios(monkeypatch):
    rng = random.Random(4)
    letters = "eeeettaao" * 4 + "nshrdlu" + "vkxqjz"
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) + " ") for k in range(80)]
    whole = "".join(t for _, t in rows[:48])
    sentences = [(0, whole[::-1]), (1, " ".join(rng.sample(whole.split(), 44))), (2, "".join(t for k, t in rows[20:70] if k % 5))]
    done = []
    monkeypatch.setattr(A, "ratio_of", lambda *x: done.append(x) or ratio_of(*x))
    merged = [(A.SENTENCE, no, t, len(rows)) for no, t in sentences] + [(A.ROW, no, t, len(rows)) for no, t in rows]
    assert [r[:5] for r in A.aligned()(iter(merged))] == scan(rows, sentences)
    windows = A.best_window(A.plain(sentences[0][1]), [t for _, t in rows], 30, 48)[3:]
    done.clear()
    assert A.best_window(A.plain(sentences[0][1]), [t for _, t in rows], 30, 48)[:3] == (0, 0, 0.0)
    assert windows[1] > 1000 and len(done) < windows[1] / 2, (windows, len(done))


def test_ratio_equals_difflib():
    rng = random.Random(5)
    for case in range(2000):
        letters = "abcdefghijklmnopqrstuvwxyz中"[: rng.choice([2, 4, 9, 27])]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 20, 90, 230])))
        b = a[: len(a) // 2] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + a[len(a) // 3 :] * (case % 3)
        want = difflib.SequenceMatcher(None, a, b).ratio() if a and b else float(a == b)
        assert ratio_of(a, b) == want
        assert ratio_of(a, b, 0.6) in ((want,) if want >= 0.6 else (want, 0.0))


def test_long_ratios_equal_difflib_without_it(monkeypatch):
    """Frequent and rare letters, swapped pieces, dropped letters and other texts against ``LONG_TEXT`` letters and more."""
    from scriptloom.operators import similarity as S

    rng = random.Random(6)
    cases = []
    for case in range(600):
        letters = ["eeeettaao" * 4 + "nshrdlu" + "vkxqjz", "ab", "abcdefghijklmnopqrstuvwxyz", "aaaaabcd中é"][case % 4]
        b = "".join(rng.choice(letters) for _ in range(rng.choice([200, 210, 700])))
        pieces = [b[i : i + 7] for i in range(0, len(b), 7)]
        a = [
            "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 400]))), "".join(rng.sample(pieces, len(pieces))), "".join(c for c in b if rng.random() < 0.9),
            b[rng.randint(0, 40) : rng.randint(60, 200)] + "".join(rng.choice(letters) for _ in range(20)) + b[: rng.randint(0, 50)],
        ][case // 4 % 4]
        cases.append((a, b, difflib.SequenceMatcher(None, a, b).ratio(), rng.random()))

    def unwanted(*_):
        raise AssertionError("difflib")

    monkeypatch.setattr(S, "SequenceMatcher", unwanted)
    for a, b, want, least in cases:
        assert S.ratio_of(a, b) == want
        assert S.ratio_of(a, b, least) in ((want,) if want >= least else (want, 0.0))


def test_many_rare_pairs_are_left_to_difflib(monkeypatch):
    from scriptloom.operators import similarity as S

    monkeypatch.setattr(S, "RARE_PAIRS", 3)
    a, b = "xyz" + "ab" * 150, "ba" * 150 + "zyxx"
    assert S.rare_matched(a, b) is None
    assert S.ratio_of(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_bounds_of_all_windows(monkeypatch):
    """Each window's longest common subsequence, also with blank rows and states counted in blocks."""
    from scriptloom.operators.similarity import lcs_of

    rng = random.Random(8)
    words = ["ab ", "abc ", " bd ", "e", " f ", "ab", "", " ", "中文 ", "x\n"]
    for case in range(300):
        texts = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        sentence = A.plain("".join(rng.choice(words) for _ in range(rng.choice([0, 4, 40]))))
        size = rng.randint(1, 8)
        widths = range(max(1, size // 2), min(2 * size, len(texts)) + 1)
        starts = min(rng.choice([4, 31]), len(texts) - widths.start + 1) if widths else 0
        if starts < 1:
            continue
        if case == 200:
            monkeypatch.setattr(A, "BLOCK_BYTES", 100)
        at, wide, lengths, limits = A._bounds(sentence, A._joined(texts[: starts + widths.stop - 2]), starts, widths)
        assert list(zip(at.tolist(), wide.tolist())) == [(k, w) for k in range(starts) for w in widths if k + w <= len(texts[: starts + widths.stop - 2])]
        for k, w, n, limit in zip(at.tolist(), wide.tolist(), lengths.tolist(), limits.tolist()):
            window = A.plain("".join(texts[k : k + w]))
            assert n == len(window) and limit == 2.0 * lcs_of(sentence, window) / max(1, len(sentence) + n)
