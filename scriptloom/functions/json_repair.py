"""Tolerant JSON: broken objects and arrays as models return them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_CLOSERS = {'"': '"', "'": "'", "“": "”"}


class Reader:
    """Reads one value at a time and never fails: what is missing is supplied, what is stray is passed."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blank(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, inside: str = ""):
        c = self.blank()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in _CLOSERS:
            return self.quoted()
        m = _NUMBER.match(self.text, self.at)
        if m and (m.end() == len(self.text) or self.text[m.end()] in ",]} \n\t\r"):
            self.at = m.end()
            return json.loads(m[0])
        return self.bare(inside)

    def object(self) -> dict:
        self.at += 1
        found: dict = {}
        while (c := self.blank()) and c != "}":
            if c in ",:":
                self.at += 1
                continue
            if c == "]":
                break  # the array around it ends: this object was not closed
            before = self.at
            key = self.quoted() if c in _CLOSERS else self.until(":,}\n").strip()
            if self.blank() == ":":
                self.at += 1
                found[key] = "" if self.blank() in ("", ",", "}") else self.value("}")
            elif key:
                found[key] = ""
            if self.at == before:
                self.at += 1
        self.at += self.blank() == "}"
        return found

    def array(self) -> list:
        self.at += 1
        found: list = []
        while (c := self.blank()) and c != "]":
            if c in ",":
                self.at += 1
                continue
            if c == "}":
                break
            before = self.at
            found.append(self.value("]"))
            if self.at == before:
                self.at += 1
        self.at += self.blank() == "]"
        return found

    def quoted(self) -> str:
        close = _CLOSERS[self.text[self.at]]
        self.at += 1
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                n = self.text[self.at + 1]
                if n == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(n, n))
                self.at += 2
                continue
            self.at += 1
            if c == close:
                # a quote inside the text is followed by more text, not by JSON's marks
                rest = self.text[self.at : self.at + 64].lstrip()
                if not rest or rest[0] in ",:]}" or re.match(r"\"[^\"]*\"\s*:", rest):
                    break
                if close == '"' and '"' in self.text[self.at :]:
                    out.append(c)
                    continue
                break
            out.append(c)
        return "".join(out)

    def until(self, stops: str) -> str:
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at].strip("\"'")

    def bare(self, inside: str):
        word = self.until("," + (inside or "") + "\n").strip()
        return {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}.get(word, word)


def repair(text: str | None):
    """The value of a JSON text, whole or damaged; a list if there are several documents; "" if none."""
    raw = re.sub(r"^\s*```(?:json)?|```\s*$", "", text or "")
    try:
        return json.loads(raw)
    except ValueError:
        pass
    reader, found = Reader(raw), []
    while True:
        at = min((k for k in (raw.find("{", reader.at), raw.find("[", reader.at)) if k >= 0), default=-1)
        if at < 0:
            break
        reader.at = at
        found.append(reader.value())
    return found[0] if len(found) == 1 else found or ""


def repaired(text: Column) -> Column:
    """JSON text of a column: valid texts stay in the JVM as they are, the others are repaired."""

    @F.pandas_udf("string")
    def mend(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(repair(t), ensure_ascii=False))

    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(mend(text))


def first_array(text: Column) -> Column:
    return F.regexp_extract(text, r"(\[[\s\S]*\])", 1)
