"""Caption rows as files: one text per ``file_id``, rendered in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.functions import text as T
from scriptloom.sources.captions import PAIRED_MARK

LAYOUTS = ("original_top", "translation_top", "original_only", "translation_only")


def _joined(rows: DataFrame, piece: Column, between: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("ord", piece.alias("piece"))))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(items, lambda x: x["piece"]), between).alias("content"))


def _numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("n", F.row_number().over(Window.partitionBy("file_id").orderBy("ord")))


def _lines(layout: str) -> Column:
    both = T.layout_texts(F.col("text"), F.col("translated_text"), F.lit(layout))
    return F.when(both["secondary"] != "", F.concat_ws("\n", both["primary"], both["secondary"])).otherwise(both["primary"])


def to_srt(rows: DataFrame, layout: str = "original_top", stable: bool = False) -> DataFrame:
    """SRT texts (K01); ``stable`` ones start with a byte order mark and hold no blank rows."""
    kept = rows.where(F.trim(_lines(layout)) != "") if stable else rows
    piece = F.concat(
        F.col("n").cast("string"), F.lit("\n"), T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")), F.lit("\n"), _lines(layout), F.lit("\n")
    )
    out = _joined(_numbered(kept), piece, "\n")
    return out.withColumn("content", F.concat(F.lit("﻿"), "content")) if stable else out


def to_txt(rows: DataFrame, layout: str = "original_top") -> DataFrame:
    """Plain texts without times."""
    return _joined(rows, _lines(layout), "\n")


def to_json(rows: DataFrame) -> DataFrame:
    """JSON keyed by ordinals from 1."""
    value = F.struct(
        F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.col("text").alias("original_subtitle"), F.col("translated_text").alias("translated_subtitle")
    )
    entries = F.sort_array(F.collect_list(F.struct("n", value.alias("v"))))
    keyed = F.map_from_entries(F.transform(entries, lambda x: F.struct(x["n"].cast("string"), x["v"])))
    return _numbered(rows).groupBy("file_id").agg(F.to_json(keyed).alias("content"))


def to_ass(rows: DataFrame, layout: str = "original_top") -> DataFrame:
    """ASS texts with one or two dialogue lines a row; the original is in style Secondary where both show."""
    head = (
        f"[Script Info]\n; {PAIRED_MARK}scriptloom\nScriptType: v4.00+\nPlayResX: 1280\nPlayResY: 720\n\n[V4+ Styles]\n"
        "Format: Name, Fontname, Fontsize\nStyle: Default, Arial, 48\nStyle: Secondary, Arial, 36\n\n[Events]\n"
        "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    )
    line = lambda style, text: F.concat(
        F.lit("Dialogue: 0,"), T.ass_time(F.col("start_ms")), F.lit(","), T.ass_time(F.col("end_ms")), F.lit(f",{style},,0,0,0,,"), F.replace(text, F.lit("\n"), F.lit("\\N"))
    )
    t, o = F.col("translated_text"), F.col("text")
    has = T.blank(t) != ""
    if layout == "original_only":
        piece = line("Secondary", o)
    elif layout == "translation_only":
        piece = F.when(has, line("Default", t)).otherwise(line("Secondary", o))
    else:
        first, second = (line("Secondary", o), line("Default", t)) if layout == "original_top" else (line("Default", t), line("Secondary", o))
        piece = F.when(has, F.concat_ws("\n", first, second)).otherwise(line("Secondary", o))
    return _joined(rows, piece, "\n").withColumn("content", F.concat(F.lit(head), "content"))


_WRITERS = {".srt": to_srt, ".txt": to_txt, ".ass": to_ass}


def render(rows: DataFrame, suffix: str, layout: str = "original_top") -> DataFrame:
    """Texts in the format of a suffix; LRC and WebVTT are not written."""
    if suffix == ".json":
        return to_json(rows)
    if suffix not in _WRITERS:
        raise NotImplementedError(f"{suffix} output is not supported")
    return _WRITERS[suffix](rows, layout)


def save(rows: DataFrame, path: str, suffix: str, layout: str = "original_top") -> None:
    """One text file per caption file under ``path/file_id=...``."""
    render(rows, suffix, layout).write.partitionBy("file_id").mode("overwrite").option("lineSep", "\n").text(path)


def save_outputs(rows: DataFrame, status: DataFrame, path: str) -> DataFrame:
    """The four layouts of all files that the audit does not block, and a manifest row per file."""
    open_files = status.where("status <> 'ERROR'").select("file_id")
    passed = rows.join(open_files, "file_id", "left_semi")
    for layout in LAYOUTS:
        to_srt(passed, layout, stable=True).write.partitionBy("file_id").mode("overwrite").text(f"{path}/{layout}")
    return status.select("file_id", "status", (F.col("status") == "ERROR").alias("render_blocked"), *[F.lit(f"{path}/{x}").alias(x) for x in LAYOUTS])


def top_report(issues: DataFrame, n: int = 80) -> DataFrame:
    """Markdown per file: the first ``n`` issues of each level."""
    from scriptloom.operators.audit import first_n

    kept = first_n(issues, ["file_id", "level"], ["ord", "code"], n)
    line = F.format_string("- [%s] %s at %d", F.col("level"), F.col("code"), F.col("ord"))
    items = F.sort_array(F.collect_list(F.struct("level", "rank", line.alias("line"))))
    return kept.groupBy("file_id").agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("content"))
