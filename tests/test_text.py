import pytest
from pyspark.sql import functions as F

from scriptloom.functions import text as T


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "left, right, code, expected",
    [
        ("dumping sulfur dioxide into", "the air.", "preposition_object_split", True),
        ("Everyone is hunkering", "down for the next phase.", "phrasal_verb_split", True),
        ("Stardust Solutions", "are trying something similar.", "subject_predicate_split", True),
        ("pump water in.", "But the next part matters.", "preposition_object_split", False),
        ("much further than that.", "What do you mean?", "determiner_noun_split", False),
        ("We met Dr.", "Watson there today at noon", "abbreviation_name_split", True),
    ],
)
def test_boundary_reasons(spark, left, right, code, expected):
    found = one(spark, T.boundary_reasons(F.col("a"), F.col("b")), a=left, b=right)
    assert (code in found) == expected


def test_times(spark):
    assert one(spark, T.srt_time(F.col("a")), a=3_723_004) == "01:02:03,004"
    assert one(spark, T.ass_time(F.col("a")), a=3_723_049) == "1:02:03.04"
    assert one(spark, T.clock_time(F.col("a")), a=-5) == "00:00:00.000"
    assert one(spark, T.parse_time(F.col("a")), a="1:02:03.04") == 3_723_040
    assert one(spark, T.parse_time(F.col("a")), a="x") is None


def test_bilingual_body(spark):
    body = T.split_bilingual(F.col("a"))
    assert tuple(one(spark, body, a=["Hello", "there", "你好", "啊"])) == ("Hello there", "你好啊")
    assert tuple(one(spark, body, a=["只有"])) == ("", "只有")
    assert tuple(one(spark, body, a=["only", "english"])) == ("only english", "")
    assert tuple(one(spark, body, a=[])) == ("", "")


def test_marks(spark):
    assert one(spark, T.align_stop(F.col("a"), F.col("b")), a="and so,", b="所以。") == "所以，"
    assert one(spark, T.align_stop(F.col("a"), F.col("b")), a="and so", b="所以。") == "所以"
    moved = T.move_leading_marks(F.col("a"), F.col("b"))
    assert tuple(one(spark, moved, a="第一", b="，第二")) == ("第一，", "第二")
    assert tuple(one(spark, moved, a="第一。", b="，第二")) == ("第一。", "第二")
    assert one(spark, T.normalize_text(F.col("a")), a=" a  b , c ") == "a b, c"


def test_words(spark):
    assert one(spark, T.word_count(F.col("a")), a="state-of-the-art 3.5 don't") == 4
    assert one(spark, T.mixed_word_count(F.col("a")), a="hello 世界 привет") == 9
    assert one(spark, T.mainly_cjk(F.col("a")), a="世界 ab") is False
    assert one(spark, T.mainly_cjk(F.col("a")), a="世界界 ab") is True
    assert one(spark, T.weak_edge_marker(F.col("a")), a="that was you know good") is True
    assert one(spark, T.weak_edge_marker(F.col("a")), a="you know that was good") is False
    assert one(spark, T.word_subsequence(F.col("a"), F.col("b")), a="one three", b="one two three") is True
    assert one(spark, T.fix_initials(F.col("a")), a="the U. S. and A. I.") == "the U.S. and AI"
    assert one(spark, T.short_month(F.col("a")), a="February 3, 2026") == "Feb 3, 2026"


def test_load(spark):
    loaded = T.high_load(F.col("a"), F.col("b"), F.lit(0), F.col("c"))
    assert one(spark, loaded, a="one two three four five six seven eight nine ten", b="", c=800) is True
    assert one(spark, loaded, a="yeah", b="", c=100) is False
    assert one(spark, T.target_chinese(F.col("a")), a=2000) == 16


def test_restored_words_of_overlapping_ranges(spark):
    """Words outside of nested, touching, empty and endless ranges; ranges aren't spelled out, however long."""
    from scriptloom.operators import windows

    words = spark.createDataFrame([(f, k, f"w{k}", k * 1000, k * 1000 + 900) for f in (1, 2, 3) for k in range(12)], "file_id long, word_id long, surface string, start_ms long, end_ms long")
    rows = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 4, 5), (1, 9, 8), (2, 10, 10**15), (2, -(10**15), 0), (4, 1, 2), (1, None, 3)], "file_id long, word_start long, word_end long")
    got = {(r.file_id, r.word_start, r.word_end) for r in windows.restored_words(words, rows).collect()}
    assert got == {(1, 6, 11), (2, 1, 9), (3, 0, 11)}
