"""Numbers as Chinese text: one numeral, and the forms that a table lists.

Numbers are strings of digits throughout, so their length has no bound.
"""

from __future__ import annotations

import re
from typing import NamedTuple

DIGITS, PLACES = "零一二三四五六七八九", ("千", "百", "十", "")


def _group(four: str) -> str:
    """Four digits, without marks of zeros at their ends."""
    read = "".join(DIGITS[int(d)] + (place if d != "0" else "") for d, place in zip(four, PLACES))
    return re.sub("^一十", "十", re.sub("零+", "零", read).strip("零"))


def numeral(digits: str) -> str:
    """A whole number, read in groups of four digits.

    Groups carry 万 by turns; behind each second one stands 亿, even if it is empty. One 零 stands
    before a group that starts with a zero or follows an empty one of the same 亿.
    """
    groups = [g[::-1].zfill(4) for g in re.findall(".{1,4}", digits.lstrip("0")[::-1])]
    read, empty = "", False
    for k in reversed(range(len(groups))):
        if groups[k] != "0000":
            gap = "零" if read and (empty or groups[k][0] == "0") else ""
            read += gap + _group(groups[k]) + ("万" if k % 2 else "")
        closes = k > 0 and k % 2 == 0
        read += "亿" if closes else ""
        empty = groups[k] == "0000" and not closes
    return read or "零"


class Form(NamedTuple):
    """Ways to write the numbers from ``least`` to ``most`` that end with so many zeros and, if ``exactly``, no more."""

    least: int
    most: float
    zeros: int
    exactly: bool
    patterns: str


ANY = float("inf")
#: Forms beside the numeral.
FORMS = [
    Form(10**8, ANY, 7, False, "{of8}亿 {of8}亿美元 {of8}亿人民币"),
    Form(10**4, ANY, 4, False, "{whole4}万"),
    Form(10**4, ANY, 3, True, "{of4}万 {of4}万美元"),
    Form(10**3, ANY, 3, False, "{whole3}千"),
    Form(1000, 2099, 0, False, "{each} {each}年 {digits}年"),
    Form(1000, 2099, 1, False, "{century}世纪{decade}年代 {century_read}世纪{decade_read}年代"),
    Form(1000, 2099, 2, False, "{century}世纪 {century_read}世纪 {century}世纪初 {century_read}世纪初"),
]
#: Of shares: numbers up to 100 may be one without a sign.
SHARE, WHOLE, SHARES_TO = "百分之", "百", 100


def _shifted(digits: str, places: int) -> str:
    """The number divided by a power of ten, six figures where it is short."""
    if len(digits) <= 15:
        return f"{int(digits) / 10**places:g}"
    whole, rest = digits[:-places], digits[-places:].rstrip("0")
    return f"{whole}.{rest}" if rest else whole


def variants(value: str | None) -> list[str]:
    """Ways to write a number, or a percentage, in Chinese; longest first. None for fractions and other texts."""
    digits, _, sign = (value or "").strip().partition("%")
    if sign or not (digits.isascii() and digits.isdigit()):
        return []
    percent = "%" in value
    digits = digits.lstrip("0") or "0"
    size = int(digits) if len(digits) <= 15 else ANY
    zeros = len(digits) - len(digits.rstrip("0")) if digits != "0" else 0
    years = 1000 <= size <= 2099
    century, decade = (digits[:2], digits[2] + "0") if years else ("0", "0")
    century = str(int(century) + 1)
    fields = {
        "digits": digits,
        "each": "".join(DIGITS[int(d)] for d in digits),
        "century": century,
        "century_read": numeral(century),
        "decade": str(int(decade)),
        "decade_read": numeral(decade),
    }
    read = numeral(digits)
    found = {read, re.sub("二(?=[百千万])", "两", read)}
    for form in FORMS:
        if form.least <= size <= form.most and (zeros == form.zeros if form.exactly else zeros >= form.zeros):
            shifts = {"of8": _shifted(digits, 8), "of4": _shifted(digits, 4), "whole4": digits[:-4], "whole3": digits[:-3]}
            found.update(form.patterns.format(**fields, **shifts).split(" "))
    if percent:
        found |= {SHARE + x for x in found}
    elif size <= SHARES_TO:
        found.add(SHARE + read)
    if size == SHARES_TO:
        found.add(SHARE + WHOLE)
    return sorted(found, key=lambda x: (-len(x), x))
