"""Chinese text quality as SQL predicates (P06, P28, P30-P34, C12, C16), for any dialect of ``boundaries``."""

from __future__ import annotations

from scriptloom.functions.boundaries import DUCKDB, Dialect, ends, quoted

# Fixed values.
STOPS = "，。！？；：、,.!?;:"
ANSWERS = "好的 没错 对 是的 真的 真的吗 在哪里 为什么 什么问题"
SOFT_ANSWERS = "对吧 是吧 好吧 嗯 啊 哦 哇"
CONNECTIVES = "那么 而且 然后 所以 不过 但是 此外"
BAD_PREFIXES = "而若 若 如果 因为 对于 在 将 把 意味着 以及"
BAD_SUFFIXES = "的 以及 因为 如果 对于 在 将 把 意味着"
DANGLING = "时 之后 以后 的 因为 如果"
ACTION = "[想看问说让使成为带来引发面临解释思考知道打破拿走是有能会要必须开始讨论设计关注]"
ENGLISH_ORDER = ["被.+通过", "由.+定义", "是.+的.+问题", "它.+是.+的", "如果你追踪.+类别在[0-9]"]
TRANSLATIONESE = [
    ("deep_dive", "深度挖掘"),
    ("municipal_coffers", "市政府的金库|市政金库"),
    ("manifestation", "实体体现|具体的、实体的体现"),
    ("mission_to_examine", "我们的任务是审视"),
    ("defined_by", "由.*定义"),
]
PLACED = "(锚定|定位|归入|投入|放入|置于|固定|连接|链接)(它|其|这|那|这个|这一点)$"
PLACE_STARTS, PRONOUN_ENDS, PRONOUN_STARTS = "到 在 于 向 至", "它 其 这个 这一点", "到一 到某 到古 到新 到旧 在一 于一"
MODIFIER_SUFFIXES = "的 之 对于 关于 如果 因为 在"
MARKERS = [
    ("ponder", "想 思考 琢磨"),
    ("think", "想 思考"),
    ("question", "问题 疑问 质疑"),
    ("not ", "不 没 无"),
    ("because", "因为 因 所以"),
    ("but", "但 不过 而"),
]
HAN_MARKERS = ["思考 想 琢磨", "问题 疑问 质疑"]
BLOCKER = (
    "missing_translation overlong_english invalid_timing subtitle_duration_invalid translation_id_missing translation_id_duplicate "
    "translation_id_unknown translation_group_cardinality_mismatch final_translation_id_mismatch allocation_quality_unresolved"
)
REVIEW = (
    "coverage_gap_unverified reading_speed_error suspicious_cut translationese reading_speed_warning subtitle_duration_short_warning "
    "duplicate_chinese asr_suspicious discourse_marker_orphan syntax_boundary_audit chinese_semantic_group_warning"
)
CJK = "[一-鿿぀-ゟ゠-ヿ가-힯]"


def replaced(x: str, pattern: str, d: Dialect) -> str:
    """``x`` without what matches."""
    return f"regexp_replace({x}, '{pattern}', ''" + (", 'g')" if d is DUCKDB else ")")


def starts(x: str, prefixes: str) -> str:
    return "(" + " OR ".join(f"{x} LIKE '{p}%'" for p in prefixes.split()) + ")"


def contains(x: str, words: str) -> str:
    return "(" + " OR ".join(f"{x} LIKE '%{w}%'" for w in words.split()) + ")"


def compact(x: str, d: Dialect) -> str:
    return replaced(x, "[ \t\r\n]+", d)


def unstopped(x: str, d: Dialect) -> str:
    return replaced(x, f"[{STOPS}]+$", d)


def bare(x: str, d: Dialect) -> str:
    return unstopped(compact(x, d), d)


def bad_fragment(z: str, d: Dialect) -> str:
    """P28 over a bare text."""
    return (
        f"{z} NOT IN ({quoted(f'{ANSWERS} {CONNECTIVES}')}) AND NOT ({z} LIKE '如果%' AND {d.matches.format(z, '[就会要能可必须]')}) AND {z} NOT LIKE '%你懂的'"
        f" AND ({starts(z, BAD_PREFIXES)} OR {ends(z, BAD_SUFFIXES)})"
    )


def rules(d: Dialect) -> dict[str, str]:
    """Code and predicate over ``text, z`` (translation) and ``next_z`` of the row behind (null: none)."""
    z, right = bare("z", d), replaced(compact("next_z", d), f"^[{STOPS}]+", d)
    match = d.matches.format
    marker = " OR ".join(f"(lower(text) LIKE '%{en}%' AND NOT {contains('whole', zh)})" for en, zh in MARKERS)
    soft = f"{z} IN ({quoted(f'{ANSWERS} {SOFT_ANSWERS}')}) OR {match(z, '[吗呢吧啊]$')} OR {z} LIKE '%你懂的'"
    return {
        "bad_fragment": bad_fragment(z, d),
        "incomplete_group": f"{z} = '' OR (NOT ({soft}) AND ({ends(z, DANGLING)} OR NOT {match(z, ACTION)}))",
        "english_order": " OR ".join(match(compact("z", d), p) for p in ENGLISH_ORDER),
        "adjacent_boundary": (
            f"next_z IS NOT NULL AND {z} <> '' AND {right} <> '' AND (({match(z, PLACED)} AND {starts(right, PLACE_STARTS)})"
            f" OR ({ends(z, PRONOUN_ENDS)} AND {starts(right, PRONOUN_STARTS)}))"
        ),
        "modifier_break": f"next_z IS NOT NULL AND ({ends(z, MODIFIER_SUFFIXES)} OR ({z} LIKE '%时' AND NOT {match('next_z', '[想看说问引发导致]')}))",
        "semantic_loss": f"{marker}".replace("whole", compact("z", d)),
    }


def translationese(d: Dialect) -> str:
    """The first pattern that a translation shows; empty if none."""
    return "CASE " + " ".join(f"WHEN {d.matches.format('z', p)} THEN '{code}'" for code, p in TRANSLATIONESE) + " ELSE '' END"


def severity(code: str = "code", level: str = "level") -> str:
    """What a finding means for the review."""
    return (
        f"CASE WHEN {code} IN ({quoted(BLOCKER)}) OR {code} LIKE 'translation!_id!_%' ESCAPE '!' THEN 'BLOCKER'"
        f" WHEN {code} IN ({quoted(REVIEW)}) OR {level} = 'warning' THEN 'REVIEW' ELSE 'INFO' END"
    )
