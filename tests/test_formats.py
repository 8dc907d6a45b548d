import pytest
from pyspark.sql import functions as F

from scriptloom.functions.json_repair import repair
from scriptloom.sources import captions, sinks


def files(spark, **texts):
    return spark.createDataFrame([(k, "." + k.split("_")[0], v) for k, v in texts.items()], "file_id string, suffix string, content string")


def rows(df):
    return [tuple(r)[2:] for r in df.orderBy("file_id", "ord").collect()]


def test_srt(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\nHello\n你好\n\n2\n00:00:03.000 --> 00:00:04,000\nBye\n再见\n"
    assert rows(captions.scan_srt(files(spark, srt=text))) == [(1000, 2500, "Hello", "你好"), (3000, 4000, "Bye", "再见")]
    assert rows(captions.scan_audit_srt(files(spark, srt=text.replace(".", ",")))) == [(1000, 2500, "Hello", "你好"), (3000, 4000, "Bye", "再见")]
    plain = "1\n00:00:01,000 --> 00:00:02,500\nHello\nmore\nlines\n\nbroken\n"
    assert rows(captions.scan_srt(files(spark, srt=plain))) == [(1000, 2500, "Hello", "")]
    assert rows(captions.scan_srt(files(spark, srt=""))) == []


def test_vtt(spark):
    text = "WEBVTT\n\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\nHi <00:00:01.500><c>there</c>\n\n"
    assert rows(captions.scan_vtt(files(spark, vtt=text))) == [(1000, 2000, "Hi there", "")]
    words = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000 align:start\nplain\nOne<00:00:01.500><c> two</c><00:00:02.000><c> three</c>\n"
    assert rows(captions.scan_word_vtt(files(spark, vtt=words))) == [(1000, 1500, "One", ""), (1500, 2000, "two", ""), (2000, 3000, "three", "")]


def test_all_suffixes(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\n"
    ass = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\b1}Hello\\Nyou\n"
    json = '{"1": {"start_time": 0, "end_time": 900, "original_subtitle": "a", "translated_subtitle": "b"}}'
    found = captions.scan(files(spark, srt=srt, ass=ass, json=json))
    assert rows(found) == [(1000, 2500, "Hello\nyou", ""), (0, 900, "a", "b"), (1000, 2500, "Hello", "")]


def test_encodings_and_newest(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,500\n你好\n".encode("gbk"))
    (tmp_path / "b.srt").write_bytes("﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n好的\r\n".encode())
    found = captions.scan(captions.read_files(spark, str(tmp_path)))
    assert sorted(r.text for r in found.collect()) == ["你好", "好的"]
    assert captions.newest_file(spark, str(tmp_path)).first().path.endswith("b.srt")


def test_payloads(spark):
    u = '{"utterances":[{"transcript":"a b","start_time":0,"end_time":9,"words":[{"label":"a","start_time":0,"end_time":4},{"label":"b","start_time":4,"end_time":9}]}]}'
    assert rows(captions.payload_utterances(files(spark, p=u))) == [(0, 4, "a", ""), (4, 9, "b", "")]
    assert rows(captions.payload_utterances(files(spark, p=u), words=False)) == [(0, 9, "a b", "")]
    s = '{"segments":[{"text":"x","start":1.2345,"end":1.0}]}'
    assert rows(captions.payload_segments(files(spark, p=s))) == [(1234, 1235, "x", "")]
    whole = '{"segments":[],"text":"all","duration_ms":70}'
    assert rows(captions.payload_segments(files(spark, p=whole), "ms")) == [(0, 70, "all", "")]


def test_layouts_and_limits(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "Hi", "你好"), (1, 2, 1000, 2000, "Yo", "")], "file_id long, ord long, start_ms long, end_ms long, text string, translated_text string")
    assert sinks.to_txt(cues, "translation_top").first().content == "你好\nHi\nYo"
    assert sinks.to_txt(cues, "translation_only").first().content == "你好\nYo"
    assert sinks.to_srt(cues).first().content.startswith("1\n00:00:00,000 --> 00:00:01,000\nHi\n你好\n\n2\n")
    with pytest.raises(NotImplementedError):
        sinks.render(cues, ".lrc")


def test_outputs(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 0, 1000, "Hi", "你好"), (2, 1, 0, 1000, "Yo", "")], "file_id long, ord long, start_ms long, end_ms long, text string, translated_text string")
    status = spark.createDataFrame([(1, "PASS"), (2, "ERROR")], "file_id long, status string")
    manifest = sinks.save_outputs(cues, status, str(tmp_path)).orderBy("file_id").collect()
    assert [m.render_blocked for m in manifest] == [False, True]
    assert spark.read.text(str(tmp_path / "original_top")).select("file_id").distinct().count() == 1


def test_headers(spark):
    ass = "[Script Info]\nPlayResX: 1920\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,40\n"
    r = captions.ass_header(files(spark, ass=ass)).first()
    assert r.play_res_x == 1920 and r.font_sizes == {"Default": 40}
    probe = "Duration: 00:01:02.50, start: 0, bitrate: 900 kb/s\n Video: h264 (High), yuv420p, 1280x720, 25 fps\n Audio: aac, 44100 Hz"
    m = captions.media_info(files(spark, p=probe)).first()
    assert (m.duration_s, m.width, m.height, m.fps, m.audio_codec) == (62.5, 1280, 720, 25.0, "aac")


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": 1}', {"a": 1}),
        ("{'a': 'b'", {"a": "b"}),
        ('{"a": [1, 2', {"a": [1, 2]}),
        ('{"a": "x" "b": 2}', {"a": "x", "b": 2}),
        ("{a: yes, b: 3}", {"a": "yes", "b": 3}),
        ('text before {"a": true} after', {"a": True}),
        ('{"a": 1} {"b": 2}', [{"a": 1}, {"b": 2}]),
        ('```json\n{"a": null}\n```', {"a": None}),
        ('{"a": 1,}', {"a": 1}),
        ("", ""),
        (None, ""),
    ],
)
def test_repair(text, value):
    assert repair(text) == value


def test_repair_query(spark, data):
    from scriptloom.plans import catalog

    assert catalog.QUERIES["json_repair"](spark, data).where(~F.col("k").eqNullSafe(F.col("expected"))).count() == 0
