"""Editor's boundary rules as SQL predicates, one a code (B01-B28, B45), and fragment rules of rows.

A rule is text, so the same table serves ``F.expr`` and any other SQL engine: the few functions that
engines name differently go through :class:`Dialect`.

Pair rules see a boundary between two words by the columns ``l3 l2 l r r2 r3`` (lower-case tokens
around it, null beyond the file's ends), ``pause`` (milliseconds, null if unknown), ``l2_end`` and
``l_end`` (the surface closes a sentence) and ``l_sep`` (it ends with a comma, semicolon or colon).

Row rules see a row by ``words`` (lower-case tokens), ``text``, ``joined`` (tokens by blanks),
``next_first, next_text, previous_text``, ``pause`` and ``crossed_before, crossed_after`` (the speaker changes).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions import boundary_words as W


class Dialect(NamedTuple):
    matches: str
    any_of: str
    array: str


SPARK = Dialect("({0} rlike r'{1}')", "arrays_overlap({0}, array({1}))", "array({0})")
DUCKDB = Dialect("regexp_matches({0}, '{1}')", "list_has_any({0}, [{1}])", "[{0}]")
#: Pauses from which a boundary stands whatever the words.
LONG_PAUSE, ADVERB_PAUSE = 450, 180


def quoted(words: str | list[str]) -> str:
    """A list of SQL strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in (words.split() if isinstance(words, str) else words))


def among(x: str, words: str | list[str]) -> str:
    return f"{x} IN ({quoted(words)})"


def ends(x: str, endings: str) -> str:
    return "(" + " OR ".join(f"{x} LIKE '%" + e.replace("'", "''") + "'" for e in endings.split()) + ")"


def pair(pairs: list[str], a: str = "l", b: str = "r") -> str:
    return among(f"({a} || ' ' || {b})", pairs)


def noun_like(x: str) -> str:
    """A token that may be a noun."""
    return f"({x} <> '' AND {x} NOT LIKE '%ly' AND {x} NOT IN ({quoted(W.NOT_NOUNS)}))"


def digits(x: str, d: Dialect) -> str:
    return d.matches.format(x, r"^[0-9]+([.,][0-9]+)?$")


def numeric(x: str, d: Dialect) -> str:
    """Digits or a numeral."""
    return f"({among(x, W.NUMERALS)} OR {digits(x, d)})"


def adjective_before_noun(a: str, b: str) -> str:
    """``a`` modifies ``b``, by endings and word lists."""
    adjective, noun = W.HEAD_ADJECTIVES, W.HEAD_NOUNS
    return (
        f"({a} <> '' AND {b} <> '' AND {b} NOT IN ({quoted(W.NOT_HEADS)}) AND (({a} LIKE '%-%' AND {noun_like(b)})"
        f" OR ({among(a, adjective)} AND {among(b, adjective)}) OR ({among(b, noun)} AND"
        f" ({among(a, adjective)} OR {among(a, W.NOUN_MODIFIERS)} OR {ends(a, W.ADJECTIVE_ENDINGS)}))))"
    )


def pair_rules(d: Dialect) -> dict[str, str]:
    """Code and predicate of each pair rule."""
    near = f"(pause IS NULL OR pause < {LONG_PAUSE})"
    infinitive = f"({among('r2', W.INFINITIVES)} OR r2 LIKE '%e')"
    takes_with = f"({among('l', W.TAKES_WITH)} OR l LIKE '%ed')"
    determined = lambda a, b, c: f"({among(a, W.DETERMINERS)} AND {numeric(b, d)} AND {noun_like(c)})"
    few = lambda a, b: f"({a} IN ('a', 'one') AND {b} = 'few')"
    public = "public private global local massive major"
    return {
        "auxiliary_predicate": f"{among('l', W.AUXILIARIES)} AND ({among('r', W.PREDICATE_STARTS)} OR {ends('r', 'ed ing')})",
        "subject_finite_verb": f"{among('l', W.SHORT_SUBJECTS)} AND {among('r', W.FINITE_VERBS)}",
        "short_verb_object": f"({among('l', W.TRANSITIVE)} OR l LIKE '%ed') AND {among('r', W.OBJECT_STARTS)}",
        "verb_complement": f"({among('l', W.CATENATIVE)} AND ({among('r', W.COMPLEMENT_HEADS)} OR r LIKE '%ly')) OR (l LIKE '%s' AND {among('r', W.COMPLEMENT_ADJECTIVES)})",
        "compound_noun": f"{among('r', W.COMPOUND_HEADS)} AND ({among('l', W.COMPOUND_MODIFIERS)} OR l LIKE '%-%' OR l LIKE '%ing')",
        "modifier_noun_head": adjective_before_noun("l", "r"),
        "modifier_head_pair": f"{pair(W.MODIFIER_PAIRS)} OR l LIKE '%''s' OR l LIKE '%s'''",
        "protected_named_phrase": pair(W.NAMED_PAIRS),
        "protected_phrasal": pair(W.PHRASAL_PAIRS),
        "determiner_head": f"{among('l', W.DETERMINERS)} AND {noun_like('r')}",
        "particle_complement": f"{among('l', W.DIRECTION_ADVERBS)} AND {among('r', W.DIRECTIONS)}",
        "phrasal_verb_particle": pair(W.PARTICLE_PAIRS),
        "time_range": f"r = 'to' AND {among('l', W.HALF_DAYS)} AND {numeric('r2', d)}",
        "stranded_complement": f"{near} AND NOT l_end AND ((r = 'to' AND {infinitive}) OR (r = 'with' AND {takes_with}) OR (r IN ('of', 'about') AND {noun_like('l')}))",
        "infinitive_phrase": f"r = 'to' AND {infinitive}",
        "takes_with": f"r = 'with' AND {takes_with}",
        "negation_emphasis": pair(W.EMPHASIS_PAIRS),
        "quantifier_phrase": (
            f"({few('l', 'r')} AND r2 IS NOT NULL) OR {few('l2', 'l')} OR (l = 'a' AND r = 'couple' AND r2 = 'of' AND r3 IS NOT NULL)"
            f" OR (l2 = 'a' AND l = 'couple' AND r = 'of' AND r2 IS NOT NULL) OR (l3 = 'a' AND l2 = 'couple' AND l = 'of') OR {pair(W.QUANTIFIED)}"
        ),
        "determiner_number_noun": f"{determined('l', 'r', 'r2')} OR {determined('l2', 'l', 'r')}",
        "adverb_adjective": f"(pause IS NULL OR pause <= {ADVERB_PAUSE}) AND l LIKE '%ly' AND ({among('r', W.ADVERB_ADJECTIVES)} OR {ends('r', W.ADVERB_ENDINGS)})",
        "numeric_unit": f"{noun_like('r')} AND {numeric('l', d)}",
        "modifier_chain": f"{near} AND {among('l', W.CHAIN_MODIFIERS)} AND {among('r', W.CHAIN_MODIFIERS)} AND ({among('r2', W.CHAIN_MODIFIERS)} OR r2 IN ('and', 'or') OR {noun_like('r2')})",
        "coordinated_modifier": (
            f"{near} AND r IN ('and', 'or') AND l <> '' AND r2 NOT IN ({quoted(W.DETERMINERS)})"
            f" AND ({adjective_before_noun('l', 'r2')} OR {among('l', W.COORDINATED_LEFT)} OR r2 LIKE '%-%')"
            f" AND ({among('r2', W.COORDINATED_LEFT)} OR {among('r2', public)} OR {noun_like('r2')})"
        ),
        "transition_attached": f"{near} AND {among('l', W.TRANSITIONS)} AND l2 IS NOT NULL AND (l2_end OR l_sep)",
        "bad_pair": f"{among('l', W.BAD_LEFT)} OR {pair(W.BAD_PAIRS)}",
        "dangerous_end": among("l", W.DANGEROUS_ENDS),
        "dangerous_start": among("r", W.DANGEROUS_STARTS),
        "discourse_marker": (
            "(l = 'i' AND r IN ('mean', 'guess')) OR (l = 'you' AND r = 'know') OR (l = 'well' AND r = 'i' AND r2 = 'mean')"
        ),
    }


def codes(rules: dict[str, str]) -> str:
    """The codes of the rules that hold, by commas in the table's order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules.items()) + ")"


def pair_codes() -> Column:
    return F.expr(f"CASE WHEN l <> '' AND r <> '' THEN {codes(pair_rules(SPARK))} ELSE '' END")


def trailing_fragment(d: Dialect) -> str:
    """Why a row's last word can't stay behind, in order of precedence; empty if it can."""
    last, first = "last", "next_first"
    ladder = [
        (pair(W.NAMED_PAIRS, last, first), "trailing_protected_named_phrase_fragment"),
        (pair(W.PHRASAL_PAIRS, last, first), "trailing_protected_phrasal_fragment"),
        (among(last, W.TRAILING_CONNECTORS), "trailing_connector_fragment"),
        (among(last, W.TRAILING_AUXILIARIES), "trailing_auxiliary_fragment"),
        (f"{last} LIKE '%''s' AND {noun_like(first)}", "trailing_possessive_fragment"),
        (f"{among(last, W.TRAILING_QUANTIFIERS)} AND ({among(first, W.DETERMINERS)} OR {noun_like(first)})", "trailing_quantifier_fragment"),
        (f"{adjective_before_noun(last, first)} AND last NOT IN ({quoted(W.FINAL_ADJECTIVES)})", "trailing_modifier_fragment"),
    ]
    when = " ".join(f"WHEN {rule} THEN '{code}'" for rule, code in ladder)
    return f"CASE WHEN {_continues(d)} THEN CASE {when} ELSE '' END ELSE '' END"


def _continues(d: Dialect) -> str:
    """The row goes on in the next one: same speaker, short pause, no sentence's end."""
    ended = d.matches.format("text", r"[.!?]\s*$")
    return f"(next_first IS NOT NULL AND NOT crossed_after AND (pause IS NULL OR pause < {LONG_PAUSE}) AND NOT {ended})"


def row_rules(d: Dialect) -> dict[str, str]:
    """Code and predicate of each fragment rule."""
    has = lambda words: d.any_of.format("words", quoted(words))
    predicate = f"({has(W.FINITE_OR_AUXILIARY)} OR {has(W.COMMON_VERBS)} OR (joined || ' ') LIKE '%n''t %')"
    ended, asks = r"[.!?]\s*$", r"\?\s*$"
    plain = "trim(regexp_replace(lower(text), '[^a-z]+', ' '{}))".format(", 'g'" if d is DUCKDB else "")
    return {
        "finite_predicate": predicate,
        "subject_without_predicate": (
            f"n > 0 AND NOT {has(W.FINITE_OR_AUXILIARY)} AND (({among('first', W.OPENERS)} AND n >= 2) OR {among('first', W.DEMONSTRATIVES)}"
            f" OR {among('last', W.SUBJECT_PRONOUNS)} OR (n <= 3 AND {among('first', W.SHORT_SUBJECT_STARTS)}))"
        ),
        "incomplete_interrogative": f"{among('first', W.QUESTION_WORDS)} AND NOT {has(W.QUESTION_AUXILIARIES)}",
        "negation_only": d.matches.format("joined", "^(never|ever|not)( (never|ever|not))*$"),
        "bare_verb": (
            f"{_continues(d)} AND n BETWEEN 1 AND 4 AND {among('first', W.BARE_VERBS)} AND ({among('last', W.DETERMINERS)}"
            f" OR ({d.matches.format('text', '[,;:] *$')} AND NOT {predicate}) OR {adjective_before_noun('last', 'next_first')})"
        ),
        "independent_short": f"({among(plain, W.INDEPENDENT)} AND {d.matches.format('text', ended)}) OR crossed_before OR crossed_after",
        "standalone_transition": among(plain, W.TRANSITION_PHRASES),
        "independent_answer": (
            f"{d.matches.format('text', ended)} AND (coalesce({d.matches.format('previous_text', asks)}, false) OR coalesce({d.matches.format('next_text', asks)}, false))"
        ),
    }


def dangling_han(d: Dialect, x: str = "translated_text") -> str:
    """A Chinese text that surely doesn't end here."""
    every = ", 'g'" if d is DUCKDB else ""
    bare = f"regexp_replace(regexp_replace({x}, '[ \t\r\n]+', ''{every}), '[。！？!?…]+$', '')"
    before = "(" + "|".join(W.HAN_BEFORE_TIME.split()) + ")$"
    return f"({ends(bare, W.HAN_DANGLING)} OR ({bare} LIKE '%在' AND length({bare}) <= 18) OR ({bare} LIKE '%时' AND NOT {d.matches.format(bare, before)}))"
