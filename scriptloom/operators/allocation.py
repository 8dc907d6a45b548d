"""A group's translation dealt to its parts: is it whole, and does each part hold what is its own (P29, W08, X17, X18, C17-C19)?"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import boundaries as B
from scriptloom.functions import numerals
from scriptloom.functions import quality as Q
from scriptloom.functions import text as T
from scriptloom.functions.anchors import anchors, letters, present, readings
from scriptloom.operators.similarity import bag_of, common_of, lcs_of
from scriptloom.session import ship

# Fixed values.
SHORT_ANSWERS = "好的 没错 对 是的 真的"
OPEN_ENDS = "意味着 因为 如果 对于 以及 将 把 在 的"
OPEN_STARTS = "因为 如果 对于 在 将 把 以及 而 但 并"
CARRIES_ON = r"\b(?:like|as|to|of|for|with|that|which|who|when|if)$"
HARMLESS = "full_translation_quality_issue"
ENOUGH_LETTERS, ENOUGH_ORDER, SHORT_FULL, SHORT_PART, SMALL_PART, CONTAINED = 0.82, 0.5, 10, 6, 3, 8

EXTRA = "forms array<array<string>>, common array<string>, omission string"


def bad_part() -> str:
    """SQL: is the text of part ``i`` of ``n`` no piece of a sentence (P29)? Open ends and starts are none inside a group.

    ``z`` has the text as ``text``, compact, and ``bare``: lambdas compute an expression wherever it stands, so each is
    computed before.
    """
    text, bare = "z.text", "z.bare"
    return (
        f"CASE WHEN {bare} = '' THEN true WHEN {text} rlike '[。！？.!?]$' AND length({bare}) >= 4 THEN false"
        f" WHEN n > 1 AND length({bare}) <= 2 AND {bare} NOT IN ({B.quoted(SHORT_ANSWERS)}) THEN true"
        f" WHEN n > 1 AND ({Q.starts(bare, OPEN_STARTS)} OR (i < n - 1 AND {B.ends(bare, OPEN_ENDS)})) THEN false"
        f" ELSE {Q.bad_fragment(bare, B.SPARK)} END"
    )


def omission_of(full: str, merged: str) -> str | None:
    """What the parts together lack of the group's translation; both are compare keys."""
    if not full or not merged:
        return None
    if len(full) < SHORT_FULL:
        return None if full in merged else "short_full_translation_not_preserved"
    lost = bag_of(full, merged) < ENOUGH_LETTERS and lcs_of(full, merged) / len(full) < ENOUGH_ORDER
    return "low_full_translation_coverage" if lost else None


#: Numbers repeat from group to group.
forms = lru_cache(4096)(numerals.variants)


def _extra(values: pd.Series, keys: pd.Series, full: pd.Series) -> pd.DataFrame:
    rows = [
        ([forms(v) for v in numbers], [common_of(a, b) for a, b in zip(parts, parts[1:])], omission_of(whole, "".join(parts)))
        for numbers, parts, whole in zip(values, keys, full)
    ]
    return pd.DataFrame(rows, columns=["forms", "common", "omission"])


def _issue(code: str, part_id: str = "cast(null as string)", reason: str = "''", anchor: str = "''", found: str = "cast(array() as array<string>)") -> str:
    return f"named_struct('code', {code}, 'part_id', {part_id}, 'reason', {reason}, 'anchor', {anchor}, 'found_on', {found})"


def _anchor_code() -> str:
    """SQL over an anchor ``a``: the code of its fault, or null."""
    ids = "transform(a.shown, g -> g.id)"
    at = lambda k: f"coalesce(array_contains({ids}, get(parts, a.at {k}).id), false)"
    own, same, near = "keys[a.at]", "exists(a.shown, g -> g.key = keys[a.at])", f"({at('- 1')} OR {at('+ 1')})"
    mismatch = "concat(a.type, '_allocation_mismatch')"
    return (
        f"CASE WHEN size(a.shown) = 0 THEN CASE WHEN a.type <> 'entity' OR a.in_full THEN {mismatch} END"
        f" WHEN {at('+ 0')} THEN null"
        f" WHEN a.type = 'number' THEN CASE WHEN NOT ({at('+ 1')} AND {own} <> '' AND NOT {same} AND NOT bad[a.at]) THEN {mismatch} END"
        f" WHEN a.type = 'negation' THEN CASE WHEN NOT ({near} AND lower(trim(parts[a.at].english)) rlike r'{CARRIES_ON}') THEN {mismatch} END"
        f" WHEN {own} = '' OR {same} OR (length({own}) <= {SMALL_PART} AND {near}) OR (length({own}) <= {SHORT_PART} AND NOT {near})"
        f" THEN 'cross_id_semantic_leakage' END"
    )


def _gathered(groups: DataFrame, parts: DataFrame, returned: DataFrame) -> DataFrame:
    """One row a group, by one shuffle: ``full, parts, given``."""
    key = ["file_id", "group_no"]
    name = lambda c: F.trim(T.blank(F.col(c))).alias("id")
    part = F.struct("part_no", name("part_id"), T.blank(F.col("english")).alias("english"), anchors(F.col("english")).alias("anchors"))
    got = F.struct("at", name("part_id"), T.blank(F.col("chinese")).alias("zh"))
    rows = groups.select(*key, T.blank(F.col("full_translation")).alias("full"))
    for side, c in ((parts.select(*key, part.alias("part")), "part"), (returned.select(*key, got.alias("got")), "got")):
        rows = rows.unionByName(side, allowMissingColumns=True)
    packed = rows.groupBy(*key).agg(F.max("full").alias("full"), F.sort_array(F.collect_list("part")).alias("p"), F.sort_array(F.collect_list("got")).alias("g"))
    # of repeated ids the first part and the last text count
    once = "filter(p, (x, i) -> NOT exists(slice(p, 1, i), y -> y.id = x.id))"
    last = "filter(g, (x, i) -> NOT exists(slice(g, i + 2, size(g)), y -> y.id = x.id))"
    # what a lambda uses more than once is a field: lambdas compute an expression wherever it stands
    given = F.transform(F.expr(last), lambda g: F.struct(g["id"].alias("id"), g["zh"].alias("zh"), T.normalize_text(g["zh"]).alias("text")))
    given = F.transform(given, lambda g: F.struct(g["id"].alias("id"), g["text"].alias("text"), T.chinese_key(g["text"]).alias("key"), *readings(g["zh"])))
    return packed.select(*key, F.expr("coalesce(full, '')").alias("full"), F.expr(once).alias("parts"), given.alias("given"))


def validate(groups: DataFrame, parts: DataFrame, returned: DataFrame) -> DataFrame:
    """``file_id, group_no, valid, codes, issues`` of every group.

    ``groups``: ``file_id, group_no, full_translation``; ``parts``: ``file_id, group_no, part_no, part_id, english``;
    ``returned``: ``file_id, group_no, at, part_id, chinese``, in any order. ``issues`` are structs of ``code, part_id,
    reason, anchor, found_on``; ``codes`` are distinct, in order of appearance.

    Nulls count as empty texts. Of repeated ids the first part and, by ``at``, the last text count; of groups listed
    twice the greater translation. A group without parts has no issue but unknown ids. The parts of one group meet in
    one row, as they do in the prompt that they come from; extra columns are ignored.
    """
    ship(groups.sparkSession)
    take = lambda c: F.expr(f"transform(parts, p -> coalesce(get(filter(given, g -> g.id = p.id), 0).{c}, ''))")
    listed = "flatten(transform(parts, (p, i) -> transform(p.anchors, a -> named_struct('type', a.type, 'value', a.value, 'at', i))))"
    rows = _gathered(groups, parts, returned).withColumns({"texts": take("text"), "keys": take("key"), "n": F.size("parts"), "a": F.expr(listed)})
    rows = rows.withColumns(
        {
            "flat": F.expr(f"transform(texts, z -> {Q.compact('z', B.SPARK)})"),
            "a": F.expr("filter(a, (x, k) -> NOT exists(slice(a, 1, k), y -> y.value = x.value))"),
            "full_key": T.chinese_key(T.normalize_text(F.col("full"))),
            "whole": F.struct(*readings(F.col("full"))),
        }
    )
    rows = rows.withColumn("a", F.transform("a", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"), x["at"].alias("at"), letters(x["value"]).alias("letters"))))
    rows = rows.withColumn("flat", F.expr(f"transform(flat, z -> named_struct('text', z, 'bare', {Q.unstopped('z', B.SPARK)}))"))
    rows = rows.withColumn("bad", F.expr(f"transform(flat, (z, i) -> {bad_part()})"))
    numbers = F.expr("transform(a, x -> CASE WHEN x.type = 'number' THEN x.value END)")
    rows = rows.withColumn("extra", F.pandas_udf(_extra, EXTRA)(numbers, F.col("keys"), F.col("full_key")))
    shown = lambda text: present("x", "extra.forms[k]", text)
    seen = f"named_struct('type', x.type, 'value', x.value, 'at', x.at, 'shown', filter(given, g -> {shown('g')}), 'in_full', {shown('whole')})"
    rows = rows.withColumn("a", F.expr(f"transform(a, (x, k) -> {seen})"))
    issues = F.filter(F.concat(*map(F.expr, _issues())), lambda x: x["code"].isNotNull())
    rows = rows.withColumn("issues", issues).withColumn("codes", F.array_distinct(F.col("issues.code")))
    return rows.select("file_id", "group_no", (F.size(F.array_remove("codes", HARMLESS)) == 0).alias("valid"), "codes", "issues")


def _issues() -> list[str]:
    """SQL: arrays of issues in the order of the codes; those without a code are null."""
    ids, given = "transform(parts, p -> p.id)", "transform(given, g -> g.id)"
    uneven = f"size(array_except({ids}, {given})) + size(array_except({given}, {ids})) > 0"
    foreign = "trim(full) <> '' AND NOT full rlike '[一-鿿]'"
    part = "CASE WHEN z = '' THEN 'group_allocation_information_omission' WHEN bad[i] THEN 'unnatural_chinese_fragment' END"
    l, r = "keys[i]", "keys[i + 1]"  # noqa: E741
    holds = f"{l} = {r} OR (length({l}) >= {CONTAINED} AND contains({r}, {l})) OR (length({r}) >= {CONTAINED} AND contains({l}, {r}))"
    twin = f"CASE WHEN {l} = '' OR {r} = '' THEN null WHEN {holds} THEN 'adjacent_duplicate_or_containment' WHEN extra.common[i] <> '' THEN 'adjacent_long_common_phrase' END"
    twin_code = f"CASE WHEN {twin} IS NOT NULL THEN 'adjacent_chinese_semantic_duplication' END"
    place = "CASE WHEN size(a.shown) = 0 THEN 'anchor_missing' ELSE 'anchor_present_on_different_subtitle_id' END"
    lost = "CASE WHEN extra.omission IS NOT NULL THEN 'group_allocation_information_omission' END"
    return [
        f"array({_issue(f"CASE WHEN {uneven} THEN 'translation_group_cardinality_mismatch' END")})",
        f"array({_issue(f"CASE WHEN {foreign} THEN '{HARMLESS}' END")})",
        f"transform(texts, (z, i) -> {_issue(part, 'parts[i].id', "CASE WHEN z = '' THEN 'empty_chinese' ELSE 'fragment' END")})",
        f"transform(slice(keys, 1, greatest(n - 1, 0)), (x, i) -> {_issue(twin_code, 'parts[i].id', f"coalesce({twin}, '')", 'extra.common[i]', 'array(parts[i + 1].id)')})",
        f"array({_issue(lost, reason="coalesce(extra.omission, '')")})",
        f"transform(a, a -> {_issue(_anchor_code(), 'parts[a.at].id', place, 'a.value', 'transform(a.shown, g -> g.id)')})",
    ]


def part_anchors(parts: DataFrame) -> DataFrame:
    """``file_id, part_no, pos, type, value, percent, decade``: every anchor of every part."""
    return parts.select("file_id", "part_no", F.posexplode(anchors(F.col("english"))).alias("pos", "a")).select("file_id", "part_no", "pos", "a.*")
