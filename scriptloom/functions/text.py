"""Column expressions over caption text and times; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions import boundary_words as BW
from scriptloom.functions import lexicons as L


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def blank(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def among(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


# -- times (F01-F05, F25) -----------------------------------------------------------------------


def srt_time(ms: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    )


def ass_time(ms: Column) -> Column:
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.floor((ms % 1000) / 10)
    )


def clock_time(ms: Column) -> Column:
    at = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(at / 3600000), F.floor(at / 60000) % 60, F.floor(at / 1000) % 60, at % 1000
    )


def lrc_time(ms: Column) -> Column:
    return F.format_string("%02d:%.2f", F.floor(ms / 60000), (ms % 60000) / 1000)


def parse_time(text: Column) -> Column:
    """Milliseconds of ``H:MM:SS`` with a fraction after ``.`` or ``,``; null if it isn't a time."""
    p = r"^(\d+):(\d{2}):(\d{1,2})[.,](\d{2,3})$"
    part = lambda k: F.regexp_extract(text, p, k).cast("long")
    fraction = F.rpad(F.regexp_extract(text, p, 4), 3, "0").cast("long")
    return F.when(text.rlike(p), part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + fraction)


def fade_alpha(at: Column, start: Column, end: Column, fade: float = 0.18) -> Column:
    """Smoothstep opacity 0-255 of a cue at a time in seconds."""
    edge = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / fade))
    x = F.least(edge(at - start), edge(end - at))
    return F.floor(255 * x * x * (3 - 2 * x)).cast("int")


# -- normalisation (F06-F17, F20, F23, F24, X10-X14, X24, X25, X45, X46, S20) ---------------------


def normalize_text(text: Column) -> Column:
    one = F.trim(F.regexp_replace(blank(text), r"\s+", " "))
    return F.regexp_replace(one, r"\s+([,.;:!?，。！？；：])", "$1")


def boundary_token(token: Column) -> Column:
    return F.lower(F.regexp_replace(blank(token), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def chinese_key(text: Column) -> Column:
    return F.regexp_replace(blank(text), r"[^一-鿿A-Za-z0-9]", "")


def signature(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(text)), r"[^a-z0-9]+", " "))


def response_key(text: Column) -> Column:
    """Lower-case letters, apostrophes and single blanks."""
    kept = F.regexp_replace(F.lower(blank(text)), r"[^a-z'\s]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def strip_stops(text: Column) -> Column:
    return F.regexp_replace(F.trim(blank(text)), "[，。]+$", "")


def split_bilingual(lines: Column) -> Column:
    """``english, chinese`` of a cue's lines: the first line with Chinese starts the Chinese part."""
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    chinese = lambda x: x.rlike(L.HAN) | (x.rlike(r"[　-〿＀-￯]") & ~x.rlike("[A-Za-z]"))
    at = F.array_position(F.transform(kept, chinese), True)
    n = F.size(kept)
    join = lambda part, by: F.trim(F.array_join(part, by))
    one = F.when(F.get(kept, 0).rlike("[A-Za-z]"), F.struct(F.get(kept, 0).alias("english"), F.lit("").alias("chinese"))).otherwise(
        F.struct(F.lit("").alias("english"), F.get(kept, 0).alias("chinese"))
    )
    many = F.when(
        at > 0,
        F.struct(
            join(F.slice(kept, F.lit(1), (at - 1).cast("int")), " ").alias("english"),
            join(F.slice(kept, at.cast("int"), n), "").alias("chinese"),
        ),
    ).otherwise(F.struct(join(kept, " ").alias("english"), F.lit("").alias("chinese")))
    return (
        F.when(n == 0, F.struct(F.lit("").alias("english"), F.lit("").alias("chinese"))).when(n == 1, one).otherwise(many)
    )


def align_stop(original: Column, translated: Column) -> Column:
    """The translation with its last mark following that of the original."""
    o, t = F.trim(blank(original)), F.trim(blank(translated))
    last = F.right(o, F.lit(1))
    marks = "[。！？；，、：…]+$"
    return (
        F.when((o == "") | (t == "") | last.isin(".", "!", "?", "…"), t)
        .when(last == ",", F.regexp_replace(t, marks, "，"))
        .when(last == ";", F.regexp_replace(t, marks, "；"))
        .when(last == ":", F.regexp_replace(t, marks, "："))
        .otherwise(F.trim(F.regexp_replace(t, marks, "")))
    )


_LEADING = r"^([，,、。！？!?；;：:]+)\s*(\S[\s\S]*)$"


def move_leading_marks(previous: Column, current: Column) -> Column:
    """``previous, current`` after leading marks of ``current`` went to the end of ``previous``."""
    p, c = F.trim(blank(previous)), F.trim(blank(current))
    marks, rest = F.regexp_extract(c, _LEADING, 1), F.trim(F.regexp_extract(c, _LEADING, 2))
    moves = (p != "") & c.rlike(_LEADING) & (rest != "")
    mark = F.when(marks.rlike("[，,、]"), F.lit("，")).otherwise(F.right(marks, F.lit(1)))
    closed = F.right(p, F.lit(1)).isin(*"。！？!?；;：:")
    return F.struct(
        F.when(moves & ~closed, F.concat(p, mark)).otherwise(p).alias("previous"),
        F.when(moves, rest).otherwise(c).alias("current"),
    )


def fix_initials(text: Column) -> Column:
    for pattern, to in ((r"\bU\.\s*S\.", "U.S."), (r"\bU\.\s*K\.", "U.K."), (r"\bA\.\s*I\.", "AI")):
        text = F.regexp_replace(text, pattern, to)
    return text


def unify_marks(text: Column) -> Column:
    """Typographic quotes and dashes as plain ones."""
    return F.replace(F.translate(blank(text), "‘’“”–— ", "''\"\"-- "), F.lit("…"), F.lit("..."))


def layout_texts(text: Column, translated: Column, layout: Column) -> Column:
    """``primary, secondary`` lines of a layout: original_top, translation_top, original_only, translation_only."""
    t = blank(translated)
    return (
        F.when(layout == "translation_top", F.struct(F.when(t != "", t).otherwise(text).alias("primary"), F.when(t != "", text).otherwise("").alias("secondary")))
        .when(layout == "original_only", F.struct(text.alias("primary"), F.lit("").alias("secondary")))
        .when(layout == "translation_only", F.struct(F.when(t != "", t).otherwise(text).alias("primary"), F.lit("").alias("secondary")))
        .otherwise(F.struct(text.alias("primary"), t.alias("secondary")))
    )


def id_number(subtitle_id: Column) -> Column:
    return F.regexp_extract(subtitle_id, r"S(\d+)", 1).try_cast("int")


def subtitle_id(n: Column) -> Column:
    return F.format_string("S%04d", n)


def compact_text(text: Column) -> Column:
    return F.array_join(_all(F.lower(blank(text)), r"[a-z0-9]+"), "")


def article_tokens(text: Column) -> Column:
    return _all(blank(text), r"[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)?")


def word_tokens(text: Column) -> Column:
    return _all(F.lower(blank(text)), L.WORD)


def surface_tokens(text: Column) -> Column:
    return _all(blank(text), r"\S+")


def normal_word(text: Column) -> Column:
    return F.coalesce(F.nullif(F.get(word_tokens(text), 0), F.lit("")), F.lower(F.trim(blank(text))))


def join_words(words: Column) -> Column:
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+([,.;:!?])", "$1"))


def keep_ending(original: Column, canonical: Column) -> Column:
    """The replacement with the original's possessive and closing marks."""
    marks = F.regexp_extract(original, r"([,.;:!?]+)$", 1)
    bare = F.regexp_replace(original, r"[,.;:!?]+$", "")
    own = F.when(bare.rlike("(?i)['’]s$") & ~canonical.rlike("(?i)['’]s$"), "'s").otherwise("")
    return F.concat(canonical, own, marks)


def short_month(text: Column) -> Column:
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return F.regexp_replace(F.trim(blank(text)), rf"(?i)^(?=(?:{months})\b)([A-Za-z]{{3}})[A-Za-z]*", "$1")


def entity_token(token: Column) -> Column:
    bare = F.regexp_replace(blank(token), r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    return F.lower(F.regexp_replace(bare, "(?i)['’]s$", ""))


def clean_article(text: Column, most: int = 20000) -> Column:
    t = F.replace(F.replace(F.replace(blank(text), F.lit("﻿"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.substring(F.trim(t), 1, most)


def phonetic_key(text: Column) -> Column:
    """Spelling-insensitive key: digraphs folded, vowels one class, runs collapsed."""
    t = compact_text(text)
    for a, b in (("ph", "f"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("c", "k"), ("w", "v"), ("gh", "g")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, "[aeiouy]+", "a"), r"(.)\1+", "$1")


# -- counts and ratios (A01-A04, P04-P11, X21, X19, X20) ------------------------------------------


def word_count(text: Column) -> Column:
    return _count(blank(text), L.WORD)


def han_count(text: Column) -> Column:
    return _count(blank(text), L.HAN)


def mixed_word_count(text: Column) -> Column:
    """Letters of scripts without blanks count one each, the rest by blanks."""
    rest = F.regexp_replace(blank(text), L.COUNTED_LETTERS, " ")
    return _count(blank(text), L.COUNTED_LETTERS) + _count(rest, r"\S+")


def word_and_han_count(text: Column) -> Column:
    """Runs of word characters plus Han letters; Han runs count in both."""
    return _count(blank(text), r"(?U)\b\w+\b") + han_count(text)


def blank_split_count(text: Column) -> Column:
    """Han letters plus blank-separated words of the rest."""
    return han_count(text) + _count(F.regexp_replace(blank(text), L.HAN, " "), r"\S+")


def cjk_ratio(text: Column) -> Column:
    n = F.length(F.regexp_replace(blank(text), r"\s", ""))
    return F.when(n > 0, _count(blank(text), L.CJK_BLOCKS_SPLIT) / n).otherwise(0.0)


def mainly_cjk(text: Column, threshold: float = 0.5) -> Column:
    return cjk_ratio(text) > threshold


def has_english(text: Column) -> Column:
    return blank(text).rlike("[A-Za-z]")


def has_chinese(text: Column) -> Column:
    return blank(text).rlike(L.HAN)


def has_chinese_marks(text: Column) -> Column:
    return blank(text).rlike(r"[　-〿＀-￯]")


def is_english(text: Column) -> Column:
    return _count(blank(text), "[A-Za-z]") > han_count(text)


def is_word_row(text: Column) -> Column:
    t = F.trim(blank(text))
    return ((_count(t, r"\S+") == 1) & ~t.rlike(r"[^\x00-\x7f]")) | (F.length(t) <= 2)


def only_marks(text: Column) -> Column:
    """No letter, digit or underscore in any script."""
    return ~blank(text).rlike(r"(?U)\w")


def text_width(text: Column, size: int) -> Column:
    wide = _count(blank(text), L.CJK_BLOCKS_SPLIT)
    return F.floor(wide * size + (F.length(blank(text)) - wide) * size * 0.5).cast("int")


def target_chinese(duration_ms: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(F.greatest(F.lit(0.1), duration_ms / 1000) * 8).cast("int"))


def most_chinese(duration_ms: Column) -> Column:
    return F.greatest(F.lit(6), F.floor(F.greatest(F.lit(0.1), duration_ms / 1000) * L.CHINESE_CPS_ERROR).cast("int"))


def target_duration(words: Column, han: Column) -> Column:
    return F.least(
        F.lit(1800),
        F.greatest(
            F.lit(L.MIN_DISPLAY_MS), F.ceil(words / L.ENGLISH_WPS * 1000).cast("int"), F.ceil(han / L.CHINESE_CPS * 1000).cast("int")
        ),
    )


# -- predicates on text (P12-P27, X36, X37) -------------------------------------------------------


def simple_response(english: Column, chinese: Column, profile: str = "audit") -> Column:
    en = L.SHORT_ENGLISH_AUDIT if profile == "audit" else L.SHORT_ENGLISH_EDITOR
    zh = L.SHORT_CHINESE_AUDIT if profile == "audit" else L.SHORT_CHINESE_EDITOR
    return among(response_key(english), en) | among(chinese_key(chinese), zh)


def backchannel(text: Column) -> Column:
    return among(response_key(text), L.BACKCHANNEL)


def bridge(text: Column) -> Column:
    return (response_key(text) == "though") | backchannel(text)


def discourse_marker(text: Column) -> Column:
    """The marker if the text is nothing else, or the empty string."""
    key = F.trim(F.regexp_replace(F.lower(blank(text)), "[^a-z]+", " "))
    return F.when(among(key, L.DISCOURSE_MARKERS), key).otherwise("")


def trailing_marker(text: Column) -> Column:
    return normalize_text(text).rlike(r"(?i)(?:^|[,;:\s])(?:i\s+mean|you\s+know|i\s+guess|well\s+i\s+mean)[,;:.!?]*$")


def weak_edge_marker(text: Column) -> Column:
    """A marker with at most one word behind it."""
    joined = F.concat(F.lit(" "), F.array_join(word_tokens(text), " "), F.lit(" "))
    found = joined.rlike(r" (?:i mean|you know|i guess|well i mean) (?:\S+ )?$")
    return trailing_marker(text) | found


def lone_word(text: Column) -> Column:
    return (word_count(text) == 1) & (discourse_marker(text) == "") & ~backchannel(text)


def sentence_end(text: Column) -> Column:
    return blank(text).rlike(r"[.!?]\s*$")


def tail_word(text: Column) -> Column:
    return among(F.lower(F.regexp_replace(blank(text), r"[.,!?;:\s]+$", "")), L.TAIL_WORDS)


def year_range(text: Column) -> Column:
    return F.trim(blank(text)).rlike(r"(?i)^(?:from\s+)?\d{4}\s+(?:to|through|-)\s+\d{4}[.,]?$")


def wants_preposition(text: Column) -> Column:
    return F.trim(blank(text)).rlike(
        r"(?i)\b(?:preference|translation|corners?|effect|legacy|ratio|number|figure|stack|source material)\.?$"
    )


def high_load(text: Column, translated: Column, start_ms: Column, end_ms: Column) -> Column:
    """Too much text for a short display time."""
    d = F.greatest(F.lit(1), end_ms - start_ms)
    w, h = word_count(normalize_text(text)), han_count(normalize_text(translated))
    loaded = (
        ((d <= 900) & (w >= 8) & (h >= 10))
        | ((d <= 800) & (w >= 10))
        | ((d <= 800) & (w >= 4) & (h >= 16))
        | ((d <= 900) & (w >= 5) & (h >= 10) & ((w * 1.35 + h) / (d / 1000) > 24))
    )
    return ~simple_response(text, translated, "editor") & loaded


def severe_chinese_speed(translated: Column, start_ms: Column, end_ms: Column) -> Column:
    d, h = F.greatest(F.lit(1), end_ms - start_ms), han_count(translated)
    return (d >= 900) & (h >= 12) & (h / (d / 1000) > L.CHINESE_CPS_ERROR)


def chinese_pressure(translated: Column, start_ms: Column, end_ms: Column) -> Column:
    d, h = F.greatest(F.lit(1), end_ms - start_ms), han_count(translated)
    return (h >= 8) & (h / (d / 1000) > L.CHINESE_CPS)


def translation_too_fast(translated: Column, start_ms: Column, end_ms: Column) -> Column:
    d, h = F.greatest(F.lit(1), end_ms - start_ms), han_count(translated)
    return (h >= 12) & (h / (d / 1000) > L.CHINESE_CPS_ERROR)


def word_subsequence(text: Column, source: Column) -> Column:
    """Do the words of ``text`` occur in ``source`` in this order?"""
    want = word_tokens(text)
    seen = F.aggregate(word_tokens(source), F.lit(0), lambda i, w: F.when(F.get(want, i) == w, i + 1).otherwise(i))
    return (F.size(want) > 0) & (seen == F.size(want))


def edge_overlap(tokens: Column, canonical: Column, prefix: bool) -> Column:
    n = F.size(tokens)
    edge = F.slice(canonical, F.lit(1), n) if prefix else F.slice(canonical, F.size(canonical) - n + 1, n)
    return (n > 0) & (n < F.size(canonical)) & (edge == tokens)


# -- boundary rules (B-codes of the audit profile, W13) -------------------------------------------


def abbreviation_boundary(previous: Column, current: Column) -> Column:
    """A title or abbreviation before a name."""
    return F.trim(blank(previous)).rlike(r"(?<![A-Za-z0-9_])(?:St|Mt|Mr|Mrs|Ms|Dr|Prof|Jr|Sr)\.$") & F.trim(blank(current)).rlike(
        rf"^[A-Z][A-Za-z'-]{{2,}}{L.EDGE}"
    )


def safe_boundary(previous: Column, current: Column) -> Column:
    """Two rows that may part here whatever the neighbouring words."""
    p, c = F.trim(blank(previous)), F.trim(blank(current))
    key = response_key(c)
    ends = sentence_end(p)
    opens = key.rlike("^(?:but |wow|what do you mean|well )")
    few = (word_count(p) <= 5) | (word_count(c) <= 3)
    answers = among(F.trim(F.regexp_replace(F.lower(p), r"[^a-z'\s]", " ")), L.SAFE_RESPONSES) | among(key, L.SAFE_RESPONSES)
    return ~abbreviation_boundary(p, c) & ((ends & opens) | (ends & few) | answers)


def looks_like_subject(text: Column) -> Column:
    """Ends with a name of two words or a pronoun."""
    words = _all(blank(text), rf"{L.EDGE}[A-Za-z][A-Za-z'-]*{L.EDGE}")
    n = F.size(words)
    last, before = F.get(words, n - 1), F.get(words, n - 2)
    names = (n >= 2) & last.rlike("^[A-Z]") & F.coalesce(before.rlike("^[A-Z]"), F.lit(False))
    return F.coalesce((n > 0) & (names | among(F.lower(last), L.PRONOUNS)), F.lit(False))


def boundary_reasons(previous: Column, current: Column, editor: bool = False) -> Column:
    """Codes of the syntax that a boundary between two rows would break, in fixed order.

    The editor's profile also protects names and phrasal verbs (W12).
    """
    p, c = F.trim(blank(previous)), F.trim(blank(current))
    left, right = word_tokens(p), word_tokens(c)
    last, first = F.get(left, F.size(left) - 1), F.get(right, 0)
    second = F.when(F.size(left) > 1, F.get(left, F.size(left) - 2)).otherwise("")
    rules = [
        ("abbreviation_name_split", abbreviation_boundary(p, c)),
        ("preposition_object_split", among(last, L.PREPOSITIONS)),
        ("determiner_noun_split", among(last, L.DETERMINERS)),
        ("auxiliary_predicate_split", among(last, L.AUXILIARIES) & first.endswith("ing")),
        ("be_complement_split", among(last, L.BE_FORMS) & among(first, ["to", "forced", "trying", "rapidly"])),
        ("to_infinitive_split", among(last, ["forced", "trying", "able", "going"]) & (first == "to")),
        ("phrasal_verb_split", last.endswith("ing") & among(first, L.PARTICLES)),
        ("verb_object_split", among(last, L.OBJECT_VERBS) & among(first, [*L.DETERMINERS, *L.ADJECTIVES, *L.COMMON_NOUNS])),
        ("verb_preposition_split", among(last, L.LOOK_FORMS) & (first == "at")),
        ("modifier_head_split", among(last, L.ADJECTIVES) & among(first, [*L.ADJECTIVES, *L.COMMON_NOUNS])),
        ("verb_particle_split", among(second, L.BE_FORMS) & last.endswith("ing") & among(first, L.PARTICLES)),
        ("subject_predicate_split", among(first, ["are", "is", "was", "were"]) & looks_like_subject(p)),
        ("possessive_head_split", last.endswith("'s") | last.endswith("s'")),
    ]
    if editor:
        pair = F.concat_ws(" ", last, first)
        rules[1:1] = [
            ("protected_named_phrase_split", among(pair, BW.NAMED_PAIRS)),
            ("protected_phrasal_boundary_split", among(pair, BW.PHRASAL_PAIRS)),
        ]
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    open_ = (p != "") & (c != "") & (F.size(left) > 0) & (F.size(right) > 0) & ~safe_boundary(p, c)
    return F.when(open_, codes).otherwise(F.array().cast("array<string>"))
