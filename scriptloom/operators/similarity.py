"""Similarity of short texts, Arrow-batched where Spark has no such function."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptloom.functions import lexicons as L
from scriptloom.functions import text as T
from scriptloom.session import ship


#: Letters of a second text from which on difflib starts no run at the frequent ones: over 1 % of the text, and one.
LONG_TEXT = 200
#: Bits of the table of equal letters of two texts; larger ones are left to difflib.
TABLE_BITS = 1 << 22


def matched_letters(a: str, b: str, least: float = 0.0) -> int:
    """Letters in the matching blocks that difflib finds for two short texts, from a table of equal
    letters; 0 as soon as a ratio of ``least`` is out of reach.

    The table is one number, a row of bits for each letter of ``a``. Anded with itself a diagonal
    step on, it keeps the starts of runs; its lowest bit is the run first in ``a``, then in ``b``.
    """
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    wide = len(b) // 8 + 1  # bytes of a row; at least one bit at its end stays free
    row, step = wide * 8, wide * 8 + 1
    rows = {c: m.to_bytes(wide, "little") for c, m in places.items()}
    none = bytes(wide)
    table = int.from_bytes(b"".join([rows.get(c, none) for c in a]), "little")
    each = int.from_bytes((b"\1" + bytes(wide - 1)) * len(a), "little")  # the first bit of every row
    todo, total, hope = [(0, len(a), 0, len(b))], 0, min(len(a), len(b))
    while todo:
        if 2.0 * hope / (len(a) + len(b)) < least:
            return 0
        i0, i1, j0, j1 = todo.pop()
        n = i1 - i0
        hope -= min(n, j1 - j0)  # what is found or may still be
        # rows i0 to i1, columns j0 to j1
        part = table >> i0 * row & (each & (1 << n * row) - 1) * ((1 << j1) - (1 << j0))
        if not part:
            continue
        runs, size, jumps = part, 1, [part]
        while longer := runs & runs >> size * step:
            runs, size = longer, 2 * size
            jumps.append(runs)
        # starts of runs of ``size``; try each smaller power of two more
        for k in range(len(jumps) - 2, -1, -1):
            if longer := runs & jumps[k] >> size * step:
                runs, size = longer, size + (1 << k)
        i, j = divmod((runs & -runs).bit_length() - 1, row)
        i += i0
        total += size
        hope += size
        if i > i0 and j > j0:
            todo.append((i0, i, j0, j))
            hope += min(i - i0, j - j0)
        if i + size < i1 and j + size < j1:
            todo.append((i + size, i1, j + size, j1))
            hope += min(i1 - i, j1 - j) - size
    return total


#: Pairs of equal rare letters of two texts; more are left to difflib.
RARE_PAIRS = 1 << 16


@lru_cache(16)
def _places(text: str) -> dict[str, list[int]]:
    """Where each letter of a text stands; not to be changed."""
    places: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    return places


def rare_matched(a: str, b: str, least: float = 0.0) -> int | None:
    """Letters in the matching blocks that difflib finds where ``b`` is long; 0 as soon as a ratio of
    ``least`` is out of reach, nothing if there are too many pairs of rare letters.

    Blocks begin as the longest run of letters that are rare in ``b``, first in ``a``, then in ``b``,
    and grow by equal letters of any kind; without such a run only equal beginnings match. The runs of
    rare letters are listed once, and each part of the texts takes those inside it, cut at its edges.
    Most are single letters, which are in a part or not.
    """
    most, wide = len(b) // 100 + 1, len(b) + 1
    pairs: set[int] = set()
    for c, own in _places(a).items():
        if 0 < (n := b.count(c)) <= most:
            if len(pairs) + len(own) * n > RARE_PAIRS:
                return None
            j = -1
            for _ in range(n):
                j = b.index(c, j + 1)
                pairs.update([i * wide + j for i in own])
    step = wide + 1  # to the next pair of a run
    ones, longer = [], []
    for p in pairs:
        if p - step not in pairs:
            n = 1
            while p + n * step in pairs:
                n += 1
            (ones.append(divmod(p, wide)) if n == 1 else longer.append((n, *divmod(p, wide))))
    ones.sort()
    todo, total, hope = [(0, len(a), 0, len(b), ones, longer)], 0, min(len(a), len(b))
    while todo:
        if 2.0 * hope / (len(a) + len(b)) < least:
            return 0
        i0, i1, j0, j1, ones, longer = todo.pop()
        hope -= min(i1 - i0, j1 - j0)  # what is found or may still be
        (i, j), size = (ones[0], 1) if ones else ((i0, j0), 0)
        for n, x, y in longer:
            if n > size or n == size and (x, y) < (i, j):
                i, j, size = x, y, n
        end, edge = i + size, j + size
        while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end < i1 and edge < j1 and a[end] == b[edge]:
            end, edge = end + 1, edge + 1
        total += end - i
        hope += end - i
        if i > i0 and j > j0:
            some = [r for r in ones[: bisect_left(ones, (i,))] if r[1] < j]
            more = [(min(n, i - x, j - y), x, y) for n, x, y in longer if x < i and y < j]
            if some or more or a[i0] == b[j0]:
                todo.append((i0, i, j0, j, some, more))
                hope += min(i - i0, j - j0)
        if end < i1 and edge < j1:
            some = [r for r in ones[bisect_left(ones, (end,)) :] if r[1] >= edge]
            more = [(n - k, x + k, y + k) for n, x, y in longer if (k := max(0, end - x, edge - y)) < n]
            if some or more:  # equal beginnings belong to the block before
                todo.append((end, i1, edge, j1, some, more))
                hope += min(i1 - end, j1 - edge)
    return total


def ratio_of(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio; pairs that cannot match skip the search, a ratio below ``least`` may be 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(b) >= LONG_TEXT:
        found = rare_matched(a, b, least)
    else:
        found = matched_letters(a, b, least) if len(a) * (len(b) + 8) <= TABLE_BITS else None
    return SequenceMatcher(None, a, b).ratio() if found is None else 2.0 * found / (len(a) + len(b))


def lcs_of(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def bag_of(a: str, b: str) -> float:
    """Share of the letters of ``a`` that ``b`` holds, repeats counted."""
    return sum((Counter(a) & Counter(b)).values()) / len(a) if a else 0.0


def longest_common(a: str, b: str) -> str:
    """Longest common substring, the first one in ``a``, by a suffix automaton of ``a``: time linear in both lengths."""
    length, link, first, ahead = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(a):
        new = len(length)
        length.append(length[last] + 1), link.append(0), first.append(i), ahead.append({})
        p, last = last, new
        while p >= 0 and c not in ahead[p]:
            ahead[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = ahead[p][c]
        if length[q] > length[p] + 1:
            twin = len(length)
            length.append(length[p] + 1), link.append(link[q]), first.append(first[q]), ahead.append(dict(ahead[q]))
            while p >= 0 and ahead[p].get(c) == q:
                ahead[p][c] = twin
                p = link[p]
            link[q] = q = twin
        link[new] = q
    state = size = 0
    best = (0, 0)
    for c in b:
        while state and c not in ahead[state]:
            state = link[state]
            size = length[state]
        if c in ahead[state]:
            state, size = ahead[state][c], size + 1
            best = min(best, (-size, first[state] + 1))
    return a[best[1] + best[0] : best[1]]


#: Fixed value: words of which a common phrase says nothing.
EMPTY_PHRASE = re.compile("(?:这个|那个|他们|我们|因为|所以|但是|而且|就是|一个|一种|问题|事情)+")


def common_of(a: str, b: str) -> str:
    """Long common phrase of two rows, or nothing (X07, W08): 10 characters and 35 % of the shorter row at least.

    All characters of long rows count, also frequent ones.
    """
    a, b = "".join(a.split()), "".join(b.split())
    if min(len(a), len(b)) < 12:
        return ""
    least = 10
    runs = {a[i : i + least] for i in range(len(a) - least + 1)}
    if not any(b[i : i + least] in runs for i in range(len(b) - least + 1)):
        return ""
    found = longest_common(a, b)
    return found if len(found) >= max(least, int(min(len(a), len(b)) * 0.35)) and not EMPTY_PHRASE.fullmatch(found) else ""


def may_reach(a: str, b: str, low: float) -> bool:
    """Upper bound of the ratio by shared letters: can it reach ``low``?"""
    if not a or not b:
        return False
    return 2 * sum(min(n, b.count(c)) for c, n in Counter(a).items()) >= low * (len(a) + len(b))


def _pairwise(f, kind: str):
    def over(a: Column, b: Column) -> Column:
        @F.pandas_udf(kind)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(p or "", q or "") for p, q in zip(x, y)])

        return run(a, b)

    return over


ratio = _pairwise(ratio_of, "double")
lcs_length = _pairwise(lcs_of, "int")
bag_overlap = _pairwise(bag_of, "double")
common_phrase = _pairwise(common_of, "string")


def adjacent_duplicates(rows: DataFrame, column: str = "translated_text", least: float = 0.88) -> DataFrame:
    """Rows whose text repeats that of the last row with one."""
    ship(rows.sparkSession)
    key = F.regexp_replace(T.blank(F.col(column)), r"[^一-鿿A-Za-z0-9]", "")
    w = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn("key", F.nullif(key, F.lit("")))
    pairs = keyed.withColumn("last_key", F.last("key", ignorenulls=True).over(w)).where("key is not null and last_key is not null")
    # a ratio above the limit needs lengths that allow it
    a, b = F.length("key"), F.length("last_key")
    near = pairs.where((F.col("key") == F.col("last_key")) | ((F.least(a, b) >= 6) & (2 * F.least(a, b) >= least * (a + b))))
    scored = near.withColumn("similarity", ratio(F.col("last_key"), F.col("key")))
    return scored.where(F.col("similarity") >= least).withColumn("similarity", F.round("similarity", 3))


def omission(rows: DataFrame, full: str, merged: str) -> DataFrame:
    """Adds bag overlap, subsequence coverage and the verdict on lost information."""
    ship(rows.sparkSession)
    keyed = rows.withColumns({"a": T.chinese_key(F.col(full)), "b": T.chinese_key(F.col(merged))})
    scored = keyed.withColumns({"bag": bag_overlap(F.col("a"), F.col("b")), "lcs": lcs_length(F.col("a"), F.col("b"))})
    coverage = F.col("lcs") / F.greatest(F.lit(1), F.length("a"))
    bad = F.when((F.col("a") == "") | (F.col("b") == ""), False).when(F.length("a") < 10, ~F.contains("b", "a")).otherwise(
        (F.col("bag") < 0.82) & (coverage < 0.5)
    )
    return scored.withColumns({"coverage": F.round(F.greatest("bag", coverage), 6), "omits": bad}).drop("a", "b")


def variant_buckets(words: DataFrame) -> DataFrame:
    """Similar capitalised words with one beginning: pairs with ratio 0.62 up to below 1.

    ``words``: ``file_id, ord, surface``. Distinct spellings per file are paired within their
    four-letter bucket by equality, a bounded set per bucket for real spellings.
    """
    ship(words.sparkSession)
    names = words.where(F.col("surface").rlike("^[A-Z][A-Za-z]{4,}$")).groupBy("file_id", "surface").agg(F.min("ord").alias("ord"))
    names = names.withColumn("bucket", F.lower(F.substring("surface", 1, 4)))
    a = names.select("file_id", "bucket", F.col("surface").alias("left"), F.col("ord").alias("left_ord"))
    b = names.select("file_id", "bucket", F.col("surface").alias("right"), F.col("ord").alias("right_ord"))
    pairs = a.join(b, ["file_id", "bucket"]).where(F.col("left") < F.col("right"))
    # an upper bound of the ratio from the lengths alone drops most pairs before Python
    x, y = F.length("left"), F.length("right")
    pairs = pairs.where(2 * F.least(x, y) >= 0.62 * (x + y))
    scored = pairs.withColumn("ratio", ratio(F.lower("left"), F.lower("right")))
    return scored.where((F.col("ratio") >= 0.62) & (F.col("ratio") < 1.0)).withColumn("ratio", F.round("ratio", 3))


#: Keys of one text that stand together in a row.
KEYS_A_ROW = 256


def bounded_distances(rows: DataFrame, key: str, text: str, on: list[str], most: int = 3) -> DataFrame:
    """``a_key, b_key, distance``: all pairs of rows that agree on ``on``, those above ``most`` edits as ``most + 1``.

    The keys of one text stand in rows of up to ``KEYS_A_ROW``, so that a distance is computed once for
    each two rows of keys, and the pairs are exploded, not joined. Null texts have null distances.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.row_number().over(Window.partitionBy(*on, text).orderBy(key)) - 1
    numbered = rows.select(*on, F.col(text).alias("text"), F.col(key).alias("key"), F.floor(place / KEYS_A_ROW).alias("chunk"))
    lists = numbered.groupBy(*on, "text", "chunk").agg(F.collect_list("key").alias("keys")).withColumn("id", F.struct("text", "chunk"))
    # a few bytes make many pairs: a number that is given isn't merged
    dealt = lists.repartition(parts, *on)
    a, b = dealt.alias("a"), dealt.alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [F.col("a.id") <= F.col("b.id")])
    distance = F.pmod(F.levenshtein("a.text", "b.text", most), F.lit(most + 2))  # above the bound it is -1
    one = met.select(distance.cast("long").alias("distance"), (F.col("a.id") == F.col("b.id")).alias("own"), F.col("b.keys").alias("others"), F.explode("a.keys").alias("x"))
    both = one.select("distance", "own", "x", F.explode("others").alias("y")).where("x < y or (x > y and not own)")
    return both.select(F.least("x", "y").alias("a_key"), F.greatest("x", "y").alias("b_key"), "distance")


#: Words that a window longer than the term neither begins nor ends with.
BOUNDARY_FILLERS = "right yeah yes yep okay ok well so and or but on in at to from with by for of the a an based".split()
MAX_WINDOW = 8


def phrase_windows(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct windows ``phrase, size`` of consecutive words that stay within a sentence.

    ``texts``: ``text``; ``terms``: ``term, tokens``. Sizes reach the longest term's number of tokens
    plus one, ``MAX_WINDOW`` at most. A word with ``.``, ``!`` or ``?`` at its end closes its sentence.
    """
    longest = terms.agg(F.max("tokens").alias("n")).first().n or 0
    parts = F.regexp_extract_all(F.lower(T.blank(F.col("text"))), F.lit(rf"(?:{L.WORD})|[.!?]+(?=\s|$)"), F.lit(0))
    # a mark or the end of the text is null, and so is every window that holds it
    words = F.transform(parts, lambda x: F.when(~x.rlike("^[.!?]"), x))
    sizes = range(1, min(MAX_WINDOW, longest + 1) + 1)
    glued = lambda i, k: F.concat(*[x for j in range(k) for x in (F.lit(" "), F.get("w", i + j))][1:])
    found = F.transform("w", lambda _, i: F.array(*[F.struct(glued(i, k).alias("phrase"), F.lit(k).alias("size")) for k in sizes]))
    return texts.select(words.alias("w")).select(F.explode(F.flatten(found)).alias("f")).select("f.*").where("phrase is not null").distinct()


def glossary_candidates(phrases: DataFrame, terms: DataFrame, least: float = L.REVIEW_CONFIDENCE) -> DataFrame:
    """Phrases that may be misheard terms.

    ``phrases``: ``phrase, size`` (distinct); ``terms``: ``term, tokens``. Joined on a number of
    tokens that differs by one at most; bounds of the ratio by lengths and letters filter before Python.
    """
    from scriptloom.operators.joins import near_sizes

    ship(phrases.sparkSession)
    keys = lambda c: {f"{c}_key": T.compact_text(F.col(c)), f"{c}_sound": T.phonetic_key(F.col(c))}
    pairs = near_sizes(phrases.withColumns(keys("phrase")), terms.withColumns(keys("term")))
    ends = [F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)]
    pairs = pairs.where((F.col("size") <= F.col("tokens")) | ~(ends[0].isin(BOUNDARY_FILLERS) | ends[1].isin(BOUNDARY_FILLERS)))
    # letters of one that the other holds at all: as many as common ones at least
    held = lambda a, b: F.length(a) - F.length(F.expr(f"translate({a}, {b}, '')"))
    reach = lambda n, a, b, low: 2 * n >= low * (F.length(a) + F.length(b))
    bound = lambda a, b, low: reach(F.least(F.length(a), F.length(b)), a, b, low) & reach(held(a, b), a, b, low) & reach(held(b, a), a, b, low)
    near = pairs.where(bound("phrase_key", "term_key", least) | bound("phrase_sound", "term_sound", least / 0.98))

    @F.pandas_udf("spelling double, sound double")
    def both(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        hits = [
            (ratio_of(p, q), ratio_of(r, s)) if may_reach(p, q, least) or may_reach(r, s, least / 0.98) else (0.0, 0.0)
            for p, q, r, s in zip(a, b, x, y)
        ]
        return pd.DataFrame(hits, columns=["spelling", "sound"])

    scored = near.withColumn("r", both("phrase_key", "term_key", "phrase_sound", "term_sound")).withColumns(
        {"spelling": F.col("r.spelling"), "sound": F.col("r.sound")}
    )
    final = F.greatest(F.col("spelling"), F.col("sound") * 0.98)
    conditions = (
        F.lit(1)
        + (F.col("phrase_key") == F.col("term_key")).cast("int")
        + (F.col("spelling") >= 0.78).cast("int")
        + (F.col("sound") >= 0.82).cast("int")
    )
    apply = (final >= L.APPLY_CONFIDENCE) & (conditions >= 2) & (F.lower("phrase") != F.lower("term"))
    return (
        scored.withColumns({"confidence": F.round(final, 4), "applies": apply})
        .where(F.col("confidence") >= least)
        .select("phrase", "term", F.round("spelling", 4).alias("spelling"), F.round("sound", 4).alias("sound"), "confidence", "applies")
    )
