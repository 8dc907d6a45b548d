"""Anchors of a text: numbers with what scales them, negation, names (X17), and where a translation shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptloom.functions.text import blank

# Fixed values.
NUMBER = r"\b[0-9]{1,3}(?:[ ,][0-9]{3})+(?:\.[0-9]+)?%?|\b[0-9]+(?:[.,][0-9]+)?%?"
SCALES = {"hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000}
NEGATION = r"(?i)\b(?:not|n't|never|no|without|cannot|can't|doesn't|don't|didn't)\b"
NAME = r"\b[A-Z][A-Za-z0-9]*(?:[- ][A-Z][A-Za-z0-9]*){0,3}\b"
NO_NAMES = "i ai the this that"
HAN_NEGATION = "不|没|无|非|未|别|勿|直到.+才|对吧|是吧|难道"

#: A number and the word or ending behind it that belongs to it.
SCALED = rf"(?:{NUMBER})(?i:\s*(?:{'|'.join(SCALES)})\b|\s*s\b)?"
AT_START = rf"^(?:{NUMBER})"
#: Numbers that are scaled have 18 digits before and 6 behind the point at most; others stay as they are.
EXACT = "decimal(24,6)"


def _number(found: Column) -> Column:
    raw = F.regexp_extract(found, AT_START, 0)
    tail = F.lower(F.regexp_replace(found, AT_START + r"\s*", ""))
    plain = F.regexp_replace(raw, "[ ,]", "")
    factor = F.lit(None).cast("decimal(10,0)")
    for word, by in SCALES.items():
        factor = F.when(tail == word, F.lit(by).cast("decimal(10,0)")).otherwise(factor)
    scaled = F.round(plain.try_cast(EXACT) * factor, 0).cast("decimal(35,0)").cast("string")
    return _anchor("number", F.coalesce(scaled, plain), raw.endswith("%"), tail == "s")


def _anchor(kind: str, value: Column, percent: Column | None = None, decade: Column | None = None) -> Column:
    no = F.lit(False)
    marks = {"percent": no if percent is None else percent, "decade": no if decade is None else decade}
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), *(m.alias(name) for name, m in marks.items()))


def anchors(english: Column) -> Column:
    """``array<struct<type, value, percent, decade>>``: numbers in order, one negation, names in order.

    A scale word behind a number multiplies it, exactly and rounded half up; thousands marks go. Null gives an
    empty array.
    """
    text = blank(english)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(SCALED), F.lit(0)), _number)
    negation = F.when(text.rlike(NEGATION), F.array(_anchor("negation", F.lit("negation"))))
    named = F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda x: ~F.lower(x).isin(NO_NAMES.split()))
    return F.concat(numbers, F.coalesce(negation, F.slice(F.array(_anchor("negation", F.lit(""))), 1, 0)), F.transform(named, lambda x: _anchor("entity", x)))


def letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]+", ""))


def readings(text: Column) -> list[Column]:
    """What ``present`` compares: the text as it is, without separators, and its ASCII letters and digits."""
    return [text.alias("zh"), F.regexp_replace(text, r"[,，\s]", "").alias("compact"), letters(text).alias("letters")]


def present(anchor: str, forms: str, text: str) -> str:
    """SQL: does ``text`` show an anchor, a number also in one of its Chinese ``forms`` (X18)? ``text`` is a struct of
    ``readings``; the anchor has the ``letters`` of its value, so nothing is replaced for a pair of them."""
    return (
        f"CASE {anchor}.type WHEN 'number' THEN contains({text}.compact, {anchor}.value) OR exists({forms}, form -> contains({text}.compact, form))"
        f" WHEN 'negation' THEN {text}.zh rlike '{HAN_NEGATION}'"
        f" ELSE contains({text}.zh, {anchor}.value) OR contains({text}.letters, {anchor}.letters) END"
    )


#: The anchors of ``english`` in DuckDB, as a list of structs.
DUCKDB_ANCHORS = rf"""list_concat(
    [{{'type': 'number', 'value': coalesce(CAST(CAST(round(TRY_CAST(regexp_replace(regexp_extract(m, '{AT_START}'), '[ ,]', '', 'g') AS DECIMAL(24,6)) * CASE lower(regexp_replace(m, '{AT_START}\s*', ''))
      {" ".join(f"WHEN '{word}' THEN {by}::DECIMAL(10,0)" for word, by in SCALES.items())} END, 0) AS DECIMAL(35,0)) AS VARCHAR), regexp_replace(regexp_extract(m, '{AT_START}'), '[ ,]', '', 'g')),
      'percent': ends_with(regexp_extract(m, '{AT_START}'), '%'), 'decade': lower(regexp_replace(m, '{AT_START}\s*', '')) = 's'}} FOR m IN regexp_extract_all(english, '{SCALED}')],
    CASE WHEN regexp_matches(english, '{NEGATION.replace("'", "''")}') THEN [{{'type': 'negation', 'value': 'negation', 'percent': false, 'decade': false}}] ELSE [] END,
    [{{'type': 'entity', 'value': m, 'percent': false, 'decade': false}} FOR m IN regexp_extract_all(english, '{NAME}') IF lower(m) NOT IN ({", ".join(f"'{w}'" for w in NO_NAMES.split())})])"""
