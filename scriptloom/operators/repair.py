"""Boundary repair of display items: evaluate, search a window, repartition, step back.

Everything that depends on a few words around a boundary is computed in the JVM, once for every
word: which hard rules a cut behind it breaks, its score, why an item can't end there, and what
kinds of word it is, as bits. The loop itself reads its own results, so it streams: a file's
words pass in order through a generator that holds the items around its place and nothing else.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import boundaries as B
from scriptloom.functions import boundary_words as W
from scriptloom.functions import lexicons as L
from scriptloom.operators.boundaries import clean_token
from scriptloom.operators.sequential import Step, stream
from scriptloom.session import compile_long_rules

MAX_WORDS = 16
#: Items kept behind the place of the repair; steps a loop may take: so many, or so many an item.
KEPT, LEAST_STEPS, STEPS_AN_ITEM = 64, 1000, 8
_SPARK = B.SPARK

#: Pair rules that forbid a cut, in the order of their report.
HARD = [
    "preposition_object", "determiner_number_noun", "quantifier_phrase", "numeric_unit", "auxiliary_predicate", "subject_finite_verb",
    "determiner_head", "particle_complement", "time_range", "stranded_complement", "negation_emphasis", "adverb_adjective",
    "modifier_chain", "modifier_head_pair", "protected_named_phrase", "protected_phrasal", "coordinated_modifier", "transition_attached",
]
#: Fragment codes that a plain merge of two items may mend.
WEAK = frozenset(
    "weak_subject_fragment standalone_transition_fragment incomplete_short_fragment pronoun_only_fragment incomplete_interrogative_fragment "
    "negation_emphasis standalone_connector_fragment trailing_reflexive_fragment trailing_connector_fragment trailing_auxiliary_fragment "
    "trailing_possessive_fragment trailing_quantifier_fragment trailing_modifier_fragment trailing_protected_named_phrase_fragment "
    "trailing_protected_phrasal_fragment".split()
)


def _kinds(d: B.Dialect) -> dict[str, str]:
    """Kinds of word: name and predicate over a word's columns."""
    own = lambda words: B.among("l", words)
    return {
        "word": "l <> ''",
        "pronoun": own(W.PRONOUNS),
        "determiner": own(W.DETERMINERS),
        "connector": own(W.TRAILING_CONNECTORS),
        "reflexive": own(W.REFLEXIVES),
        "numeric": B.numeric("l", d),
        "finite": own(W.FINITE_OR_AUXILIARY),
        "predicate": f"{own(W.FINITE_OR_AUXILIARY)} OR {own(W.COMMON_VERBS)} OR l LIKE '%n''t'",
        "opener": own(W.OPENERS),
        "demonstrative": own(W.DEMONSTRATIVES),
        "subject": own(W.SUBJECT_PRONOUNS),
        "short_start": own(W.SHORT_SUBJECT_STARTS),
        "question": own(W.QUESTION_WORDS),
        "asking": own(W.QUESTION_AUXILIARIES),
        "never": own("never ever not"),
        "bare": own(W.BARE_VERBS),
        "answer": own(W.INDEPENDENT),
        "marker": own(W.ONE_WORD_MARKERS),
        "ended": "l_end",
        "separated": "l_sep",
        "dependent": f"{own(W.TRAILING_CONNECTORS)} OR {own(W.DETERMINERS)} OR {own(W.TRAILING_AUXILIARIES)}",
        "inner_transition": f"{own(W.TRANSITIONS)} AND l2 IS NOT NULL AND (upper_start OR l2_end)",
        "modifies_next": f"r <> '' AND {B.adjective_before_noun('l', 'r')}",
        "splits_marker": B.pair_rules(d)["discourse_marker"],
        "behind_to": "l2 = 'to' AND r <> ''",
        "crossed": "crossed_after",
    }


KINDS = {name: 1 << k for k, name in enumerate(_kinds(_SPARK))}
WORD = KINDS["word"]


def _mask(rules: Iterable[str]) -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(rules))


def hard_rules(d: B.Dialect) -> dict[str, str]:
    rules = B.pair_rules(d) | {"preposition_object": B.among("l", L.PREPOSITIONS)}
    rules["stranded_complement"] = f"NOT coalesce({rules['time_range']}, false) AND ({rules['stranded_complement']})"
    return {name: rules[name] for name in HARD}


def score(d: B.Dialect) -> str:
    """D06 without its rule on ``to``, which depends on where the item starts."""
    relative, clause = B.among("r", "which who that"), B.among("r", "but however yet because although though if when where while")
    terms = [
        "CASE WHEN pause >= 450 THEN -28 WHEN pause >= 260 THEN -12 WHEN pause <= 80 THEN 6 ELSE 0 END",
        "CASE WHEN l_end THEN -52 WHEN l_sep THEN -18 ELSE 0 END",
        f"CASE WHEN {clause} THEN -10 ELSE 0 END",
        f"CASE WHEN {relative} AND NOT l_sep THEN 20 ELSE 0 END",
        f"CASE WHEN {B.among('l', W.DANGEROUS_ENDS)} THEN 60 ELSE 0 END",
        f"CASE WHEN {B.among('r', W.DANGEROUS_STARTS)} AND NOT (l_sep AND {relative}) THEN 36 ELSE 0 END",
        f"CASE WHEN {B.pair_rules(d)['bad_pair']} THEN 160 ELSE 0 END",
        f"CASE WHEN {B.adjective_before_noun('l', 'r')} THEN 140 ELSE 0 END",
        f"CASE WHEN {d.matches.format('l', '^[0-9]+$')} THEN 70 ELSE 0 END",
        f"CASE WHEN l_end AND {B.among('l', 'right yeah yes yep exactly okay ok')} THEN 24 ELSE 0 END",
    ]
    return " + ".join(terms)


def marked(words: DataFrame) -> DataFrame:
    """``file_id, word_id, item`` and ``kinds, hard, score, trailing, token, pause`` of every word.

    ``words``: ``file_id, word_id, item, speaker, surface, start_ms, end_ms``. One window over a
    file's words serves all rules.
    """
    compile_long_rules(words.sparkSession)
    w = Window.partitionBy("file_id").orderBy("word_id")
    near = {"l3": F.lag("l", 2), "l2": F.lag("l", 1), "r": F.lead("l", 1), "r2": F.lead("l", 2), "r3": F.lead("l", 3)}
    near |= {"next_start": F.lead("start_ms", 1), "before": F.lag("surface", 1), "next_speaker": F.lead("speaker", 1)}
    ended = lambda c: F.coalesce(c.rlike(r"[.!?]\s*$"), F.lit(False))
    seen = words.withColumn("l", clean_token(F.col("surface"))).withColumns({name: f.over(w) for name, f in near.items()})
    seen = seen.withColumns(
        {
            "pause": F.col("next_start") - F.col("end_ms"),
            "l_end": ended(F.col("surface")),
            "l2_end": ended(F.col("before")),
            "l_sep": F.coalesce(F.col("surface").rlike(r"[,;:]\s*$"), F.lit(False)),
            "upper_start": F.coalesce(F.col("surface").rlike(r"^\p{Lu}"), F.lit(False)),
            "crossed_after": F.coalesce(F.col("next_speaker") != F.col("speaker"), F.lit(False)),
        }
    ).withColumns({"last": F.col("l"), "next_first": F.col("r"), "text": F.col("surface")})
    hard = f"CASE WHEN l <> '' AND r <> '' AND (pause IS NULL OR pause < {B.LONG_PAUSE}) THEN {_mask(hard_rules(_SPARK).values())} ELSE 0 END"
    return seen.select(
        "file_id",
        "word_id",
        "item",
        F.expr(_mask(_kinds(_SPARK).values())).alias("kinds"),
        F.expr(hard).alias("hard"),
        F.expr(f"CASE WHEN r IS NULL THEN 0 ELSE {score(_SPARK)} END").alias("score"),
        F.expr(B.trailing_fragment(_SPARK)).alias("trailing"),
        F.col("l").alias("token"),
        "pause",
    )


# -- the loop ---------------------------------------------------------------------------------

Span = tuple[int, int]


def kinds_of(words: Words, span: Span) -> list[int]:
    """The bits of every place in a span."""
    return [words[k][0] for k in range(span[0], span[1] + 1)]


class Words:
    """Marks of the words in reach, by their place in the file; earlier ones are forgotten."""

    def __init__(self) -> None:
        self.rows: deque[tuple] = deque()
        self.first = 0

    def __getitem__(self, k: int) -> tuple:
        return self.rows[k - self.first]

    def add(self, row: tuple) -> int:
        self.rows.append(row)
        return self.first + len(self.rows) - 1

    def forget(self, before: int) -> None:
        while self.first < before:
            self.rows.popleft()
            self.first += 1

    def has(self, k: int, kind: str) -> bool:
        return bool(self[k][0] & KINDS[kind])

    def any(self, span: Span, kind: str) -> bool:
        bit = KINDS[kind]
        return any(x & bit for x in kinds_of(self, span))

    def own(self, span: Span) -> list[int]:
        """Places in a span that hold words, not marks alone."""
        return [k for k, x in enumerate(kinds_of(self, span), span[0]) if x & WORD]

    def joins(self, k: int) -> bool:
        """Items on both sides of the boundary behind ``k`` may be joined: same speaker, no long pause."""
        pause = self[k][5]
        return not self.has(k, "crossed") and not (pause is not None and pause >= B.LONG_PAUSE)

    def inner_transition(self, span: Span) -> int | None:
        bit = KINDS["inner_transition"]
        return next((k for k, x in enumerate(kinds_of(self, (span[0] + 1, span[1])), span[0] + 1) if x & bit), None)


def fragment(words: Words, item: Span, has_previous: bool, has_next: bool) -> list[str]:
    """Why an item can't stand alone (D36); empty if it can, or if no neighbour could take it."""
    a, b = item
    kinds = kinds_of(words, item)
    own = [x for x in kinds if x & WORD]
    n = len(own)
    if not n:
        return []
    first, last, end, bits = own[0], own[-1], kinds[-1], KINDS
    if n == 1 and first & bits["answer"] and end & bits["ended"]:
        return []
    if has_previous and words.has(a - 1, "crossed") or has_next and end & bits["crossed"]:
        return []
    onward = has_next and words.joins(b)
    if not onward and not (has_previous and words.joins(a - 1)):
        return []
    either = reduce(or_, kinds)
    only = lambda kind: n == 1 and first & bits[kind]
    predicate = either & bits["predicate"]
    subject = not either & bits["finite"] and (
        (first & bits["opener"] and n >= 2) or first & bits["demonstrative"] or last & bits["subject"] or first & bits["short_start"]
    )
    bare = (
        onward
        and n <= 4
        and first & bits["bare"]
        and not end & bits["ended"]
        and (last & bits["determiner"] or (end & bits["separated"] and not predicate) or end & bits["modifies_next"])
    )
    found = [
        ("pronoun_only_fragment", only("pronoun")),
        ("incomplete_short_fragment", only("determiner")),
        ("standalone_transition_fragment", n <= 4 and " ".join(words[k][4] for k in words.own(item)) in W.TRANSITION_PHRASES),
        ("standalone_connector_fragment", only("connector")),
        ("trailing_reflexive_fragment", only("reflexive")),
        ("transition_attached", either & bits["inner_transition"] and words.inner_transition(item) is not None),
        ("incomplete_short_fragment", n == 1 and not first & bits["answer"] and not first & bits["connector"]),
        ("incomplete_short_fragment", n <= 2 and all(x & bits["numeric"] for x in own)),
        ("weak_subject_fragment", n <= 3 and not predicate and subject),
        ("incomplete_interrogative_fragment", n <= 4 and first & bits["question"] and not either & bits["asking"]),
        ("negation_emphasis", all(x & bits["never"] for x in own)),
        ("incomplete_short_fragment", bare),
        (words[b][3], has_next and bool(words[b][3])),
    ]
    return list(dict.fromkeys(code for code, holds in found if holds))


def evaluate(words: Words, left: Span, right: Span | None, has_previous: bool) -> tuple[list[str], int]:
    """Hard issues and score of the boundary behind ``left``."""
    codes: list[str] = []
    total = 0
    if right is not None:
        _, hard, total, _, _, _ = words[left[1]]
        codes = [name for k, name in enumerate(HARD) if hard >> k & 1]
        total += 90 if words.has(left[1], "behind_to") and left[1] > left[0] else 0
    return list(dict.fromkeys([*codes, *fragment(words, left, has_previous, right is not None)])), total


def repartition(words: Words, window: list[Span], most: int) -> list[Span]:
    """The window cut anew into as many items: of the cuts without an issue the least by spread of the
    sizes, score, and distance from the wanted size (O08); empty if there is none."""
    start, end = window[0][0], window[-1][1]
    cuts = [(k,) for k in range(start, end)] if len(window) == 2 else [(i, j) for i in range(start, end - 1) for j in range(i + 1, end)]
    kinds = kinds_of(words, (start, end))
    before = [0, *accumulate(1 if x & WORD else 0 for x in kinds)]  # words before a place
    splits = KINDS["splits_marker"]
    turns = [k for k, x in enumerate(kinds, start) if x & KINDS["inner_transition"]]
    barred = {k for k, x in enumerate(kinds, start) if x & splits or words[k][1]}  # a hard rule is an issue of its cut
    # of the part behind a boundary only its presence counts, so a part is judged once for all cuts that make it
    seen = cache(lambda part, last: evaluate(words, part, None if last else part, part[0] > start))
    best: tuple | None = None
    for cut in cuts:
        if not barred.isdisjoint(cut):
            continue
        edges = [start, *(k + 1 for k in cut), end + 1]
        sizes = [before[y - start] - before[x - start] for x, y in zip(edges, edges[1:])]
        if not all(sizes) or max(sizes) > most:
            continue
        parts = [(x, y - 1) for x, y in zip(edges, edges[1:])]
        if any(n == 1 and not words.has(words.own(p)[0], "marker") for n, p in zip(sizes, parts)):
            continue
        if any(x < k <= y for k in turns for x, y in parts):
            continue
        total = 0
        for p in parts:
            issues, one = seen(p, p[1] == end)
            if issues:
                break
            total += one
        else:
            rank = (max(sizes) - min(sizes), total, sum(abs(n - most * 0.72) for n in sizes))
            if best is None or rank < best[0]:
                best = (rank, parts)
    return best[1] if best else []


def mended(words: Words, items: list[Span], at: int, issues: list[str], most: int) -> tuple[int, int, list[Span]] | None:
    """The first of four windows around the boundary ``at`` that can be merged or cut anew."""
    before = max(0, at - 1)
    for a, b in dict.fromkeys([(at, at + 2), (before, at + 1), (before, at + 2), (at, min(len(items), at + 3))]):
        window = items[a:b]
        if not 2 <= len(window) <= 3 or len(window) != b - a or not all(words.joins(x[1]) for x in window[:-1]):
            continue
        whole = (window[0][0], window[-1][1])
        if len(window) == 2 and not WEAK.isdisjoint(issues) and len(words.own(whole)) <= most and words.inner_transition(whole) is None:
            if words.has(whole[1], "ended") or not words.has((words.own(whole) or [whole[1]])[-1], "dependent"):
                return a, b, [whole]
        if parts := repartition(words, window, most):
            return a, b, parts
    return None


class _Turns:
    """Finds a worklist that goes in a circle: the same items around the same place, and no new place since."""

    def __init__(self, farthest: int = 0):
        self.farthest, self.lowest, self.seen = farthest, farthest, {}

    def on(self, at: int) -> None:
        if at > self.farthest:
            self.__init__(at)

    def back(self, at: int, items: list[Span], steps: int) -> int:
        """After a change, now at ``at``: the number of steps since the same state, 0 if it is new."""
        if at < self.lowest:
            self.lowest, self.seen = at, {}
        state = (at, *items[max(0, self.lowest - 1) : self.farthest + 4])
        if state in self.seen:
            period = steps - self.seen[state]
            self.seen = {}
            return period
        self.seen[state] = steps
        return 0


def settle(words: Words, source: Iterator[Span], check, most: int, limit: Callable[[], int], forgets: bool = False) -> Iterator[Span]:
    """A worklist over ``source``: each item is checked, mended with its neighbours, and after a change
    the place steps back by one. ``check(items, at)`` gives the boundary to mend and its issues.
    After ``limit()`` steps the rest passes as it is; where changes undo each other, the rounds up to
    the limit are counted, not walked. With
    ``forgets`` words that lie behind all kept items are dropped."""
    items: list[Span] = []
    at = steps = 0
    more = True
    turns = _Turns()
    while True:
        while more and len(items) < at + 4:
            if (item := next(source, None)) is None:
                more = False
            else:
                items.append(item)
        if at >= len(items):
            break
        steps += 1
        if steps > limit():
            break
        found = check(items, at)
        made = mended(words, items, *found, most) if found else None
        if made:
            a, b, new = made
            items[a:b] = new
            at = max(0, a - 1)
            if period := turns.back(at, items, steps):
                steps += (limit() - steps) // period * period
            continue
        at += 1
        turns.on(at)
        if at > 2 * KEPT:
            done = at - KEPT
            yield from items[:done]
            del items[:done]
            at = KEPT
            turns = _Turns(at)
            if forgets:
                words.forget(items[0][0] - 1)
    yield from items
    for item in source:
        if forgets:
            words.forget(item[0] - 1)
        yield item


def repaired(most: int = MAX_WORDS) -> Step:
    """Rows ``word_id, item, n_items, kinds, hard, score, trailing, token, pause``: the items after both loops.

    Gives ``item_no, word_start, word_end, n_words, changed``. Items with a transition inside are
    split before. Memory holds some 200 items. ``n_items`` is the number of the file's items; each
    loop takes eight steps an item at most, or 1000.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = Words()
        ids: deque[int] = deque()
        given: set[Span] = set()
        n_given = 0

        def limit() -> int:
            return max(LEAST_STEPS, STEPS_AN_ITEM * n_given)

        def read() -> Iterator[Span]:
            nonlocal n_given
            start = last = item = None
            for word_id, own, n_given, *marks in rows:
                k = words.add(tuple(marks))
                ids.append(word_id)
                if start is not None and own != item:
                    yield from split((start, last))
                    start = None
                if start is None:
                    start, item = k, own
                last = k
            if start is not None:
                yield from split((start, last))

        def split(span: Span) -> Iterator[Span]:
            given.add(span)
            k = words.inner_transition(span)
            yield from [span] if k is None else [(span[0], k - 1), (k, span[1])]

        def boundaries(items: list[Span], at: int):
            if at + 1 < len(items):
                issues, _ = evaluate(words, items[at], items[at + 1], at > 0)
                return (at, issues) if issues else None
            return None

        def fragments(items: list[Span], at: int):
            last = at + 1 == len(items)
            issues = fragment(words, items[at], at > 0, not last)
            boundary = at - 1 if last else at
            return (boundary, issues) if issues and boundary >= 0 else None

        settled = settle(words, settle(words, read(), boundaries, most, limit), fragments, most, limit, forgets=True)
        passed = 0
        for no, (a, b) in enumerate(settled, 1):
            while passed < a:
                ids.popleft()
                passed += 1
            yield no, ids[0], ids[b - a], len(words.own((a, b))), (a, b) not in given
            given.discard((a, b))

    return step


SCHEMA = "item_no long, word_start long, word_end long, n_words long, changed boolean"


def repair(words: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """``file_id, item_no, word_start, word_end, n_words, changed`` of the items of ``words``.

    Words of an item follow each other. Null times leave pauses unknown, null speakers never
    change; a file without words has no items, an empty table gives an empty result.
    """
    w = Window.partitionBy("file_id")
    opens = F.coalesce(F.lag("item").over(w.orderBy("word_id")) != F.col("item"), F.lit(True)).cast("long")
    counted = marked(words).withColumn("opens", opens).withColumn("n_items", F.sum("opens").over(w))
    columns = ["word_id", "item", "n_items", "kinds", "hard", "score", "trailing", "token", "pause"]
    return stream(counted, "file_id", columns, ["word_id"], repaired(most), SCHEMA, heavy=True)
