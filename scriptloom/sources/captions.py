"""Caption formats as DataFrames: scans parse in the JVM, one row per cue.

Every scan takes ``file_id, content`` (see :func:`read_files`) and returns
``file_id, ord, start_ms, end_ms, text, translated_text``; blank texts are dropped.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.session import ship

CUE = ["file_id", "ord", "start_ms", "end_ms", "text", "translated_text"]
_TIME = r"(\d{2}):(\d{2}):(\d{1,2})[.,](\d{3})"
#: Name of the generator whose ASS files hold pairs of lines.
PAIRED_MARK = "Script generated by "


def _ms(text: Column, pattern: str, first: int) -> Column:
    part = lambda k: F.regexp_extract(text, pattern, first + k).try_cast("long")
    return part(0) * 3600000 + part(1) * 60000 + part(2) * 1000 + part(3)


def _finish(rows: DataFrame) -> DataFrame:
    return rows.withColumn("translated_text", T.blank(F.col("translated_text"))).where(F.trim("text") != "").select(*CUE)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, suffix, content`` of text files: UTF-8, and GBK where that fails.

    Valid UTF-8 is decoded in the JVM; only other files pass through Python.
    """
    @F.pandas_udf("string")
    def decode_other(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))

    ship(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    content = F.when(utf8, F.col("content").cast("string")).otherwise(decode_other(F.col("content")))
    return raw.select(
        F.col("path").alias("file_id"),
        F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("suffix"),
        F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), "^﻿", "").alias("content"),
    )


def newest_file(spark: SparkSession, path: str) -> DataFrame:
    """The newest of the files at a path by modification time, of equal times the last path."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path"))


def _blocks(files: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")), r"\n\s*\n")
    return files.select("file_id", F.posexplode(parts).alias("k", "block")).withColumn("lines", F.split("block", "\n"))


def scan_srt(files: DataFrame) -> DataFrame:
    """SRT: time on the second line, text on the third, a translation on the fourth if nearly all
    blocks have one (S02, S28)."""
    w = Window.partitionBy("file_id")
    n = F.size("lines")
    paired = (F.max(n).over(w) <= 4) & (F.avg(F.when(n == 4, 1.0).otherwise(0.0)).over(w) >= 0.98)
    p = rf"^{_TIME}\s-->\s{_TIME}"
    at = F.get("lines", 1)
    rows = _blocks(files).withColumn("paired", paired).where((n >= 3) & at.rlike(p))
    return _finish(
        rows.select(
            "file_id",
            (F.col("k") + 1).cast("long").alias("ord"),
            _ms(at, p, 1).alias("start_ms"),
            _ms(at, p, 5).alias("end_ms"),
            F.get("lines", 2).alias("text"),
            F.when(F.col("paired"), F.get("lines", 3)).otherwise("").alias("translated_text"),
        )
    )


def scan_audit_srt(files: DataFrame) -> DataFrame:
    """SRT as the audit reads it: time line anywhere, body split by language."""
    p = r"(\d{2}):(\d{2}):(\d{2}),(\d{3})\s+-->\s+(\d{2}):(\d{2}):(\d{2}),(\d{3})"
    kept = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")
    rows = _blocks(files).withColumn("lines", kept)
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True).cast("int")
    rows = rows.withColumn("at", at).where((F.size("lines") >= 3) & (F.col("at") > 0)).withColumn("time", F.get("lines", F.col("at") - 1))
    body = T.split_bilingual(F.slice("lines", F.col("at") + 1, F.size("lines")))
    index = F.when(F.col("at") > 1, F.get("lines", 0).try_cast("long"))
    return (
        rows.where(F.col("time").rlike(p))
        .withColumn("body", body)
        .select(
            "file_id",
            F.coalesce(index, F.col("k") + 1).cast("long").alias("ord"),
            _ms(F.col("time"), p, 1).alias("start_ms"),
            _ms(F.col("time"), p, 5).alias("end_ms"),
            F.col("body.english").alias("text"),
            F.col("body.chinese").alias("translated_text"),
        )
    )


def scan_vtt(files: DataFrame) -> DataFrame:
    """WebVTT with cue ids: the first two blocks are the header."""
    p = r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})\.(\d{3})"
    blocks = files.select("file_id", F.posexplode(F.split("content", "\n\n")).alias("k", "block")).where("k >= 2")
    lines = F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")
    rows = blocks.withColumn("lines", lines)
    at = F.get("lines", 1)
    text = F.array_join(F.slice("lines", F.lit(3), F.greatest(F.size("lines"), F.lit(1))), " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"<\d{2}:\d{2}:\d{2}\.\d{3}>", ""), "</?c>", ""))
    return _finish(
        rows.where(at.rlike(p)).select(
            "file_id",
            (F.col("k") - 1).cast("long").alias("ord"),
            _ms(at, p, 1).alias("start_ms"),
            _ms(at, p, 5).alias("end_ms"),
            clean.alias("text"),
            F.lit("").alias("translated_text"),
        )
    )


def scan_word_vtt(files: DataFrame) -> DataFrame:
    """WebVTT with times inside the text: one row per word."""
    stamp = r"(\d{2}):(\d{2}):(\d{2})\.(\d{3})"
    p = rf"^{stamp}\s*-->\s*{stamp}"
    blocks = files.select("file_id", F.posexplode(F.split("content", r"\n\n+")).alias("k", "block")).withColumn(
        "lines", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n")
    )
    tagged = F.get(F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1))), lambda x: x.rlike("<c>.*</c>")), 0)
    rows = blocks.where(F.get("lines", 0).rlike(p)).withColumn("body", tagged).where("body is not null")
    head = F.get("lines", 0)
    whole = F.concat(
        F.lit("<"),
        F.regexp_extract(head, rf"^({stamp})", 1),
        F.lit(">"),
        F.regexp_replace("body", "</?c>", ""),
        F.lit("<"),
        F.regexp_extract(head, rf"-->\s*({stamp})", 1),
        F.lit(">"),
    )
    piece = r"<(\d{2}:\d{2}:\d{2}\.\d{3})>([^<]*)"
    rows = rows.withColumns({"at": F.regexp_extract_all(whole, F.lit(piece), F.lit(1)), "w": F.regexp_extract_all(whole, F.lit(piece), F.lit(2))})
    words = rows.select("file_id", "k", "at", F.posexplode("w").alias("i", "text")).where(F.col("i") < F.size("at") - 1)
    ms = lambda c: _ms(c, rf"^{stamp}$", 1)
    return _finish(
        words.select(
            "file_id",
            (F.col("k") * 10000 + F.col("i")).cast("long").alias("ord"),
            ms(F.get("at", F.col("i"))).alias("start_ms"),
            ms(F.get("at", F.col("i") + 1)).alias("end_ms"),
            F.trim("text").alias("text"),
            F.lit("").alias("translated_text"),
        )
    )


def scan_ass(files: DataFrame, original_style: str = "Secondary") -> DataFrame:
    """ASS dialogue lines; generated files pair two lines of equal time by style.

    The line in ``original_style`` is the original. Files without the generator's mark give one
    row per line.
    """
    p = r"^Dialogue: \d+,(\d+:\d{2}:\d{2}\.\d{2}),(\d+:\d{2}:\d{2}\.\d{2}),(.*?),.*?,\d+,\d+,\d+,.*?,(.*)$"
    lines = files.select("file_id", F.col("content").contains(PAIRED_MARK).alias("paired"), F.posexplode(F.split("content", "\n")).alias("k", "line"))
    hits = lines.where(F.col("line").rlike(p))
    g = lambda k: F.regexp_extract("line", p, k)
    text = F.trim(F.replace(F.regexp_replace(g(4), r"\{[^}]*\}", ""), F.lit("\\N"), F.lit("\n")))
    rows = hits.select(
        "file_id", "paired", "k", T.parse_time(g(1)).alias("start_ms"), T.parse_time(g(2)).alias("end_ms"), F.trim(g(3)).alias("style"), text.alias("text")
    ).where("text <> ''")
    w = Window.partitionBy("file_id", "start_ms", "end_ms").orderBy("k")
    pair = F.when(F.col("paired"), F.floor((F.row_number().over(w) - 1) / 2)).otherwise(F.col("k"))
    mine = F.col("style") == original_style
    return _finish(
        rows.withColumn("pair", pair)
        .groupBy("file_id", "start_ms", "end_ms", "pair")
        .agg(
            F.min("k").cast("long").alias("ord"),
            F.count(F.lit(1)).alias("n"),
            F.min_by("text", F.struct(F.when(mine, 0).otherwise(1), F.col("k"))).alias("text"),
            F.max_by("text", F.struct(F.when(mine, 0).otherwise(1), F.col("k"))).alias("other"),
        )
        .withColumn("translated_text", F.when(F.col("n") > 1, F.col("other")).otherwise(""))
    )


_JSON = "map<string,struct<start_time:bigint,end_time:bigint,original_subtitle:string,translated_subtitle:string>>"


def scan_json(files: DataFrame) -> DataFrame:
    """JSON keyed by ordinals."""
    rows = files.select("file_id", F.explode(F.from_json("content", _JSON)).alias("key", "v"))
    return _finish(
        rows.select(
            "file_id",
            F.col("key").cast("long").alias("ord"),
            F.col("v.start_time").alias("start_ms"),
            F.col("v.end_time").alias("end_ms"),
            F.col("v.original_subtitle").alias("text"),
            F.col("v.translated_subtitle").alias("translated_text"),
        )
    )


def scan(files: DataFrame) -> DataFrame:
    """Any supported file by suffix."""
    of = lambda s: files.where(F.col("suffix") == s)
    words = F.col("content").contains("<c>")
    return (
        scan_srt(of(".srt"))
        .unionByName(scan_word_vtt(of(".vtt").where(words)))
        .unionByName(scan_vtt(of(".vtt").where(~words)))
        .unionByName(scan_ass(of(".ass")))
        .unionByName(scan_json(of(".json")))
    )


# -- recogniser payloads (S09-S16, S31, S32) ------------------------------------------------------

_WORDS = "array<struct<label:string,text:string,start_time:bigint,end_time:bigint>>"
_UTTERANCES = f"array<struct<transcript:string,text:string,start_time:bigint,end_time:bigint,words:{_WORDS}>>"


def payload_utterances(payloads: DataFrame, words: bool = True, nested: bool = False) -> DataFrame:
    """Utterance payloads as word or utterance rows; ``nested`` ones lie under ``data``."""
    schema = f"struct<data:struct<utterances:{_UTTERANCES}>>" if nested else f"struct<utterances:{_UTTERANCES}>"
    path = "v.data.utterances" if nested else "v.utterances"
    u = payloads.select("file_id", F.from_json("content", schema).alias("v")).select("file_id", F.posexplode(path).alias("k", "u"))
    if not words:
        rows = u.select("file_id", F.col("k").cast("long").alias("ord"), "u.start_time", "u.end_time", F.coalesce("u.transcript", "u.text").alias("text"))
    else:
        rows = u.select("file_id", "k", F.posexplode("u.words").alias("i", "w")).select(
            "file_id", (F.col("k") * 10000 + F.col("i")).cast("long").alias("ord"), "w.start_time", "w.end_time", F.coalesce("w.label", "w.text").alias("text")
        )
    return _finish(rows.withColumnsRenamed({"start_time": "start_ms", "end_time": "end_ms"}).withColumn("translated_text", F.lit("")))


def payload_segments(payloads: DataFrame, unit: str = "s") -> DataFrame:
    """Segment payloads in seconds (truncated to ms) or milliseconds, clamped; text alone is one row."""
    schema = "struct<segments:array<struct<text:string,start:double,end:double,start_time:double,end_time:double>>,text:string,duration_ms:double>"
    v = payloads.select("file_id", F.from_json("content", schema).alias("v"))
    whole = F.array(
        F.struct(
            F.col("v.text").alias("text"), F.lit(0.0).alias("start"), F.col("v.duration_ms").alias("end"), F.lit(0.0).alias("start_time"), F.col("v.duration_ms").alias("end_time")
        )
    )
    rows = v.select("file_id", F.posexplode(F.when(F.coalesce(F.size("v.segments"), F.lit(0)) > 0, F.col("v.segments")).otherwise(whole)).alias("k", "s"))
    factor = 1000 if unit == "s" else 1
    start = F.greatest(F.lit(0).cast("long"), (F.coalesce("s.start", "s.start_time") * factor).cast("long"))
    end = (F.coalesce("s.end", "s.end_time") * factor).cast("long")
    return _finish(
        rows.select(
            "file_id", F.col("k").cast("long").alias("ord"), start.alias("start_ms"), F.greatest(end, start + 1).alias("end_ms"), F.col("s.text").alias("text"), F.lit("").alias("translated_text")
        )
    )


def without_noise(rows: DataFrame) -> DataFrame:
    """Without bracketed music and noise lines."""
    return rows.where(~F.substring(F.trim("text"), 1, 1).isin("【", "[", "(", "（"))


def proportional_words(payloads: DataFrame) -> DataFrame:
    """Words of ``text`` sharing ``duration_ms`` equally."""
    w = F.regexp_extract_all("text", F.lit(T.L.WORD), F.lit(0))
    rows = payloads.withColumn("w", w).select("file_id", "duration_ms", F.size("w").alias("n"), F.posexplode("w").alias("k", "word"))
    at = lambda k: F.floor(F.col("duration_ms") * k / F.col("n"))
    return _finish(
        rows.select(
            "file_id", F.col("k").cast("long").alias("ord"), at(F.col("k")).alias("start_ms"), at(F.col("k") + 1).alias("end_ms"), F.col("word").alias("text"), F.lit("").alias("translated_text")
        )
    )


def ass_header(files: DataFrame) -> DataFrame:
    """``play_res_x`` and a map of style to font size of ASS headers."""
    lines = F.split("content", "\n")
    style_lines = F.filter(lines, lambda x: x.startswith("Style:"))
    fields = F.transform(F.split(F.regexp_replace(F.get(F.filter(lines, lambda x: x.rlike("^Format:.*Fontsize")), 0), "^Format:", ""), ","), lambda x: F.trim(x))
    at = F.array_position(fields, "Fontsize").cast("int") - 1
    values = lambda x: F.transform(F.split(F.regexp_replace(x, "^Style:", ""), ","), lambda y: F.trim(y))
    sizes = F.map_from_entries(F.transform(style_lines, lambda x: F.struct(F.get(values(x), 0), F.get(values(x), at).try_cast("int"))))
    return files.select("file_id", F.regexp_extract("content", r"PlayResX:\s*(\d+)", 1).try_cast("int").alias("play_res_x"), sizes.alias("font_sizes"))


def media_info(probes: DataFrame) -> DataFrame:
    """Fields of a captured media probe text (S26): ``file_id, content``."""
    x = lambda p, k=1: F.regexp_extract("content", p, k)
    clock = r"Duration: (\d+):(\d+):(\d+\.\d+)"
    seconds = x(clock, 1).try_cast("double") * 3600 + x(clock, 2).try_cast("double") * 60 + x(clock, 3).try_cast("double")
    return probes.select(
        "file_id",
        seconds.alias("duration_s"),
        x(r"bitrate: (\d+) kb/s").try_cast("int").alias("bitrate_kbps"),
        x(r"Video: (\w+)").alias("video_codec"),
        x(r"Video:.*?(\d{2,5})x(\d{2,5})", 1).try_cast("int").alias("width"),
        x(r"Video:.*?(\d{2,5})x(\d{2,5})", 2).try_cast("int").alias("height"),
        x(r"(\d+(?:\.\d+)?) fps").try_cast("double").alias("fps"),
        x(r"Audio: (\w+)").alias("audio_codec"),
        x(r"Audio:.*?(\d+) Hz").try_cast("int").alias("sample_rate"),
    )
