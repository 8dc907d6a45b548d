"""Sentences of a model put back onto the rows they came from.

Rows and sentences of a file stream side by side, ordered by the words before them, through a
cursor. A window of rows is compared by the Ratcliff-Obershelp ratio only if the longest common
subsequence, which one pass of bit rows gives for all windows, allows a better one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.operators.sequential import Step, mixed_words, stream
from scriptloom.operators.similarity import LONG_TEXT, ratio_of

LEAST_RATIO, SHIFT, LOST_SHIFT, MOST_UNMATCHED = 0.5, 30, 100, 5
ROW, SENTENCE = 0, 1
#: A text of rows, and where each row begins and the text up to it ends.
Joined = tuple[str, list[int], list[int]]
#: Windows of a sentence that are decided without closer bounds.
EASY = 8
#: Bytes of bit rows held at once.
BLOCK_BYTES = 1 << 22


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def _joined(texts: list[str]) -> tuple[str, list[int], list[int]]:
    """Plain text of all rows, where each row's first letter stands in it, and where the text up to each row ends."""
    out, firsts, ends = [], [], []
    size, blank = 0, False
    for row in texts:
        low = row.lower()
        if words := " ".join(low.split()):
            if size and (blank or low[0].isspace()):
                out.append(" ")
                size += 1
            firsts += [size] * (len(ends) + 1 - len(firsts))  # blank rows before begin here too
            out.append(words)
            size += len(words)
            blank = low[-1].isspace()
        else:
            blank = blank or bool(low)
        ends.append(size)
    firsts += [size] * (len(ends) - len(firsts))
    return "".join(out), firsts, ends


@lru_cache(256)
def _windows(starts: int, low: int, high: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and widths, from ``low`` to below ``high``, of all windows that ``rows`` hold; not to be changed."""
    start, width = (x.ravel() for x in np.meshgrid(np.arange(starts), np.arange(low, high), indexing="ij"))
    held = start + width <= rows
    return start[held], width[held]


def _bounds(sentence: str, joined: Joined, starts: int, widths: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, widths, lengths and upper bounds of the ratio of a sentence with all windows of rows.

    No matching is longer than the longest common subsequence. Its rows of bits go on from width to
    width, and those of all starts lie side by side in one number, a spare bit apart. All take the
    letters of the text together, each from its own first one, and windows end where rows do, so one
    pass over the text serves all windows and leaves as many numbers as it has rows.
    """
    text, firsts, ends = joined
    size = len(sentence)
    start, width = _windows(starts, widths.start, widths.stop, len(ends))
    ends_, firsts_ = np.array(ends), np.array(firsts)
    lengths = np.maximum(0, ends_[start + width - 1] - firsts_[start])
    lane = size // 64 * 8 + 8
    bytes_ = lane * starts
    masks: dict[str, int] = {}
    for i, c in enumerate(sentence):
        masks[c] = masks.get(c, 0) | 1 << i
    each = int.from_bytes((b"\1" + bytes(lane - 1)) * starts, "little")  # the first bit of every lane
    hits = {c: mask * each for c, mask in masks.items()}
    one = (1 << size) - 1
    full, free, opened, at = one * each, 0, 0, 0
    states: list[bytes] = []
    counts = []

    def onward(free: int, part: str) -> int:
        for c in part:
            if hit := free & hits.get(c, 0):
                free = (free + hit | free - hit) & full
        return free

    def count() -> None:
        rows = np.frombuffer(b"".join(states), dtype=np.uint64).reshape(len(states), starts, lane // 8)
        counts.append(np.bitwise_count(rows).sum(axis=2, dtype=np.int64))
        states.clear()

    for end in ends:
        while opened < starts and firsts[opened] < end:
            free = onward(free, text[at : firsts[opened]]) | one << 8 * lane * opened
            at, opened = firsts[opened], opened + 1
        free, at = onward(free, text[at:end]), end
        states.append(free.to_bytes(bytes_, "little"))
        if len(states) * bytes_ > BLOCK_BYTES:
            count()
    if states:
        count()
    common = np.where(lengths > 0, size - np.concatenate(counts)[start + width - 1, start], 0)
    return start, width, lengths, 2.0 * common / np.maximum(1, size + lengths)


def _rare_bounds(sentence: str, joined: Joined, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Closer bounds for windows of ``LONG_TEXT`` letters or more, infinite for others.

    Every matching block of such a window holds a letter that is rare in it, but for one that may
    open both texts. So no matching is longer than the longest runs through the sentence's rare
    letters, as many of each as the window has, and the run that opens both.
    """
    text, firsts, _ = joined
    out = np.full(len(start), np.inf)
    long = np.flatnonzero(lengths >= LONG_TEXT)
    if not len(long):
        return out
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (sentence, text))
    # lengths of the equal runs that begin at each letter, from the last row of the table to its first
    reach, ahead = np.zeros(len(a), dtype=np.int64), np.zeros(len(b) + 1, dtype=np.int64)
    before = ahead[:-1]
    for i in range(len(a) - 1, -1, -1):
        before = np.where(b == a[i], ahead[1:] + 1, 0)
        ahead[:-1] = before
        reach[i] = before.max(initial=0)
    span = np.zeros(len(a), dtype=np.int64)  # the longest run through each letter
    for i, n in enumerate(reach.tolist()):
        np.maximum(span[i : i + n], n, out=span[i : i + n])
    size, low = lengths[long], np.array(firsts)[start[long]]
    most = size // 100 + 1
    letters = before[low]
    for c in np.unique(a):
        longest = np.concatenate(([0], np.cumsum(np.sort(span[a == c])[::-1])))
        count = np.concatenate(([0], np.cumsum(b == c)))
        n = count[low + size] - count[low]
        letters += np.where(n <= most, longest[np.minimum(n, len(longest) - 1)], 0)
    out[long] = 2.0 * letters / (len(a) + size)
    return out


def _equal(sentence: str, texts: list[str], starts: int, widths: range, size: int) -> tuple[int, int, int] | None:
    """The first window, in order, whose plain text is the sentence."""
    found = []
    for start in range(starts):
        if not sentence.startswith(plain(texts[start])):
            continue
        raw = ""
        for width, row in enumerate(texts[start : start + widths.stop - 1], 1):
            raw += row
            if len(raw) >= len(sentence):
                text = plain(raw)
                if len(text) > len(sentence):
                    break
                if width >= widths.start and text == sentence:
                    found.append((abs(width - size), width, start))
    return min(found, default=None)


def best_window(sentence: str, texts: list[str], shift: int, size: int) -> tuple[int, int, float, int, int]:
    """Start, size and ratio of the rows most like a plain sentence; also the numbers of windows and of
    those that the common subsequence leaves to the ratio or, for long texts, to a closer bound. ``texts``: the rows from the cursor on. Ratio 0 if none reaches ``LEAST_RATIO``.

    A window that equals the sentence ends the search. Of equal ratios the window first in the order of sizes near ``size``, then starts, counts. Windows
    are tried by their bound, greatest first, until no bound reaches the best.
    """
    widths = range(max(1, size // 2), min(2 * size, len(texts)) + 1)
    starts = min(shift + 1, len(texts) - widths.start + 1) if widths else 0
    if sentence and (same := _equal(sentence, texts, starts, widths, size)):
        return same[2], same[1], 1.0, 1, 1
    if not starts:
        return 0, 0, 0.0, 0, 0
    # a final sigma is told from others by its neighbours, which differ from window to window
    text, *edges = _joined(texts[: starts + widths.stop - 2])
    plain_sigma = text.replace("ς", "σ"), sentence.replace("ς", "σ")
    joined = plain_sigma[0], *edges
    at, wide, lengths, limits = _bounds(plain_sigma[1], joined, starts, widths)
    off = np.abs(wide - size)
    hopeful = np.flatnonzero(limits >= LEAST_RATIO)
    hopeful = hopeful[np.lexsort((at[hopeful], wide[hopeful], off[hopeful], -limits[hopeful]))]
    best, found, computed = 0.0, (0, 0, 0), 0
    closer: dict[int, float] = {}
    for k in hopeful.tolist():
        limit, rank = float(limits[k]), (int(off[k]), int(wide[k]), int(at[k]))
        if limit < max(best, LEAST_RATIO):
            break
        if limit == best and rank > found:
            continue
        computed += 1
        if computed == EASY and "σ" not in text + sentence and "ς" not in text + sentence:
            closer = dict(zip(hopeful.tolist(), _rare_bounds(sentence, joined, at[hopeful], lengths[hopeful]).tolist()))
        if closer.get(k, 1.0) < max(best, LEAST_RATIO):
            continue
        _, width, start = rank
        ratio = ratio_of(sentence, plain("".join(texts[start : start + width])), max(best, LEAST_RATIO))
        if ratio > best or ratio == best and rank < found:
            best, found = ratio, rank
    if best < LEAST_RATIO:
        return 0, 0, 0.0, len(at), computed
    return found[2], found[1], best, len(at), computed


def aligned(most_unmatched: int = MOST_UNMATCHED) -> Step:
    """Rows and sentences ``kind, no, text, n_rows`` in order: ``sentence_no, status, first_row, last_row,
    ratio, windows, computed`` for each sentence.

    Status: ``matched``, ``unmatched``, or ``failed`` from the sentence on that is one too many
    without a match. Memory holds the rows in reach and what one side is ahead of the other.
    """

    def step(items: Iterator[tuple]) -> Iterator[tuple]:
        rows: deque[tuple[int, str]] = deque()
        sentences: deque[tuple[int, str]] = deque()
        total = first = 0  # rows of the file; place of the first row held
        more = True

        def read() -> None:
            nonlocal total, more
            item = next(items, None)
            if item is None:
                more = False
                return
            kind, no, text, total = item
            (sentences if kind == SENTENCE else rows).append((no, text or ""))

        cursor, shift, unmatched, failed = 0, SHIFT, 0, False
        while True:
            while more and not sentences:
                read()
            if not sentences:
                return
            no, text = sentences.popleft()
            if failed:
                yield no, "failed", None, None, None, 0, 0
                continue
            sentence = plain(text)
            size = mixed_words(sentence)
            reach = cursor + shift + 2 * size + 1
            pull = True
            while pull:
                while first < min(cursor, total - 1) and rows:  # the last row may be tried again
                    rows.popleft()
                    first += 1
                if pull := more and (not total or first + len(rows) < min(total, reach)):
                    read()
            ahead = [t for _, t in islice(rows, cursor - first, reach - first)]
            start, width, ratio, windows, computed = best_window(sentence, ahead, shift, size)
            if width:
                at = cursor - first + start
                yield no, "matched", rows[at][0], rows[at + width - 1][0], round(ratio, 6), windows, computed
                cursor, shift = cursor + start + width, SHIFT
                continue
            unmatched += 1
            failed = unmatched > most_unmatched
            yield no, "failed" if failed else "unmatched", None, None, None, windows, computed
            # one row on, but not behind the last row
            cursor, shift = max(0, min(cursor + 1, total - 1)), LOST_SHIFT

    return step


def align(rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """``file_id, sentence_no, status, first_row, last_row, ratio, windows, computed`` of every sentence.

    ``rows``: ``file_id, row_no, text``, texts with their blanks; ``sentences``: ``file_id,
    sentence_no, text``. Null texts are empty: such rows add nothing, such sentences are unmatched.
    Files without rows match nothing; a file without sentences has no result.
    """
    n = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    before = lambda no: F.sum(n).over(Window.partitionBy("file_id").orderBy(no).rowsBetween(Window.unboundedPreceding, -1))
    side = lambda df, no, kind: df.select("file_id", F.lit(kind).alias("kind"), F.col(no).cast("long").alias("no"), F.coalesce(before(no), F.lit(0)).alias("at"), "text")
    both = side(rows, "row_no", ROW).unionByName(side(sentences, "sentence_no", SENTENCE))
    total = F.sum((F.col("kind") == ROW).cast("long")).over(Window.partitionBy("file_id"))
    schema = "sentence_no long, status string, first_row long, last_row long, ratio double, windows long, computed long"
    return stream(both.withColumn("n_rows", total), "file_id", ["at", "kind", "no", "text", "n_rows"], ["at", "kind", "no"], _without_place(aligned()), schema, heavy=True)


def _without_place(step: Step) -> Step:
    return lambda rows: step(row[1:] for row in rows)
