"""Glossary correction of whole texts: one automaton for all aliases.

Terms are applied in order, each on what the earlier ones have made. Instead of one pattern per
term and text, an Aho-Corasick automaton finds all aliases in one pass; only stretches around
hits are rewritten, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.session import map_arrow

#: Terms of one pass. Longer glossaries take several passes, in order; the automaton of one stays small.
PASS_TERMS = 50_000
_APOSTROPHES = str.maketrans({"’": "'", "‘": "'", "`": "'", "ʼ": "'"})
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_MARKS = re.compile(r"[,.;:!?]+$")


def folded(text: str) -> str:
    """Lower case and plain apostrophes, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(_APOSTROPHES)


def _solid(c: str) -> bool:
    return c.isascii() and c.isalnum()


class Glossary:
    """Rules ``(canonical, alias)`` in order, behind one automaton."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(canonical, folded(alias)) for canonical, alias in rules]
        self.first: dict[str, list[int]] = {}
        self.longest = 1
        self.trie = ahocorasick.Automaton()
        for k, (canonical, alias) in enumerate(self.rules):
            self.first.setdefault(alias, []).append(k)
            self.longest = max(self.longest, len(alias), len(canonical))
        for alias, places in self.first.items():
            self.trie.add_word(alias, (len(alias), places))
        if self.first:
            self.trie.make_automaton()

    def hits(self, low: str) -> list[tuple[int, int, list[int]]]:
        """``start, end, rules`` of every alias that stands as words of its own."""
        if not self.first:
            return []
        found = ((end - size + 1, end + 1, rules) for end, (size, rules) in self.trie.iter(low))
        return [(a, b, r) for a, b, r in found if not (a and _solid(low[a - 1])) and not (b < len(low) and _solid(low[b]))]

    def rewrite(self, text: str) -> tuple[str, int, int, int]:
        """All rules in order on one stretch: text, replacements, and the untouched characters at both ends."""
        done, count, left, right = -1, 0, len(text), len(text)
        while True:
            low = folded(text)
            waiting = [(k, a, b) for a, b, rules in self.hits(low) for k in rules if k > done and text[a:b] != self.rules[k][0]]
            if not waiting:
                return text, count, left, right
            done = min(k for k, _, _ in waiting)
            canonical, parts, at = self.rules[done][0], [], 0
            for _, a, b in sorted(h for h in waiting if h[0] == done):
                if a < at:
                    continue
                a, b = with_edges(text, at, a, b, canonical)
                parts += [text[at:a], carried(canonical, text[a:b])]
                left, at, count = min(left, a), b, count + 1
            right = min(right, len(text) - at)
            text = "".join([*parts, text[at:]])

    def correct(self, text: str) -> tuple[str, int]:
        """The corrected text and the number of replacements.

        Hits nearer to each other than a rule can reach form one stretch; a stretch whose changes
        come near its border is widened and done anew, so stretches do not touch.
        """
        reach = 4 * self.longest + 4
        spans = [[max(0, a - reach), min(len(text), b + reach)] for a, b, _ in sorted(self.hits(folded(text)))]
        parts, at, count, k = [], 0, 0, 0
        while k < len(spans):
            a, b = spans[k]
            k += 1
            while True:
                while k < len(spans) and spans[k][0] <= b:
                    b, k = max(b, spans[k][1]), k + 1
                made, n, left, right = self.rewrite(text[a:b])
                near_start, near_end = n and left < reach // 2 and a > at, n and right < reach // 2 and b < len(text)
                if not near_start and not near_end:
                    break
                a, b = (max(at, a - reach) if near_start else a), (min(len(text), b + reach) if near_end else b)
            parts += [text[at:a], made]
            at, count = b, count + n
        return "".join([*parts, text[at:]]), count


def with_edges(text: str, low: int, a: int, b: int, canonical: str) -> tuple[int, int]:
    """The hit ``a, b`` with the words around it that the canonical name begins or ends with."""
    name = [w.lower() for w in _WORD.findall(canonical)]
    before = [m for m in _WORD.finditer(text, max(low, a - 2 * len(canonical) - 2), a)]
    after = [m for m in _WORD.finditer(text, b, min(len(text), b + 2 * len(canonical) + 2))]
    blank = lambda words, x, y: all(not text[p.end() : q.start()].strip() for p, q in zip(words, words[1:])) and not text[x:y].strip()
    start, end = a, b
    for k in range(min(len(name) - 1, len(before)), 0, -1):
        tail = before[-k:]
        if [m[0].lower() for m in tail] == name[:k] and blank(tail, tail[-1].end(), a):
            start = tail[0].start()
            break
    for k in range(min(len(name) - 1, len(after)), 0, -1):
        head = after[:k]
        if [m[0].lower() for m in head] == name[-k:] and blank(head, b, head[0].start()):
            end = head[-1].end()
            break
    return start, end


def carried(canonical: str, old: str) -> str:
    """The canonical name with the marks at the end of what it replaces."""
    marks = _MARKS.search(old)
    return canonical + marks[0] if marks and not _MARKS.search(canonical) else canonical


def correct_texts(texts: DataFrame, glossary: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with column ``text`` corrected, and ``replacements``, their number.

    ``glossary``: ``rule_no, canonical, alias``; rules go by number. Null texts stay null with 0
    replacements; blank or null aliases and names, and aliases that equal their name, are no
    rules; an empty glossary changes nothing. A glossary is read in passes of ``PASS_TERMS``.
    """
    rules = glossary.where("trim(alias) <> '' and canonical rlike '[A-Za-z0-9]' and alias <> canonical").orderBy("rule_no", "alias", "canonical")
    names = [*texts.columns, "replacements"]
    at = texts.columns.index(text)
    out = texts.withColumn("replacements", F.lit(0).cast("long"))

    def run(part: list[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Glossary(part)
        for batch in batches:
            done = [(None, 0) if v is None else words.correct(v) for v in batch.column(at).to_pylist()]
            counts = [n + k for n, (_, k) in zip(batch.column(len(names) - 1).to_pylist(), done)]
            columns = list(batch.columns)
            columns[at], columns[-1] = pa.array([t for t, _ in done], columns[at].type), pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    part: list[tuple[str, str]] = []
    for r in rules.toLocalIterator():
        part.append((r.canonical, r.alias))
        if len(part) == PASS_TERMS:
            out, part = map_arrow(out, partial(run, part), out.schema), []
    return map_arrow(out, partial(run, part), out.schema) if part else out
