import pytest
from pyspark.sql import functions as F

from scriptloom.functions import boundaries as B
from scriptloom.functions import numerals
from scriptloom.functions import quality as Q
from scriptloom.operators import quality as O

RULES = [
    # translation, next translation, text, codes that must be there, codes that must not
    ("如果他来", None, "", {"bad_fragment"}, set()),
    ("如果他来就会好", None, "", set(), {"bad_fragment"}),
    ("好的。", None, "", set(), {"bad_fragment", "incomplete_group"}),
    ("所以，", None, "", {"incomplete_group"}, {"bad_fragment"}),
    ("漂亮的", None, "", {"bad_fragment", "incomplete_group"}, set()),
    ("红色天空", None, "", {"incomplete_group"}, {"bad_fragment"}),
    ("他会知道", None, "", set(), {"incomplete_group"}),
    ("这样吗？", None, "", set(), {"incomplete_group"}),
    ("他被人通过", None, "", {"english_order"}, set()),
    ("把目光定位它", "在这里", "", {"adjacent_boundary"}, set()),
    ("我们看到它", "到古代", "", {"adjacent_boundary"}, set()),
    ("我们看到它", "今天", "", set(), {"adjacent_boundary"}),
    ("关于", "他说", "", {"modifier_break"}, set()),
    ("他来时", "他说好", "", set(), {"modifier_break"}),
    ("他来时", "他走了", "", {"modifier_break"}, set()),
    ("他来了", None, "I think so", {"semantic_loss"}, set()),
    ("他想来", None, "I think so", set(), {"semantic_loss"}),
    ("他想来", None, "I think, but no", {"semantic_loss"}, set()),
]


def test_rules(spark):
    rows = []
    for k, (z, following, text, _, _) in enumerate(RULES):
        rows.append((k, 1, text, z))
        if following is not None:
            rows.append((k, 2, "", following))
    frame = spark.createDataFrame(rows, "file_id long, ord long, text string, translated_text string")
    got = {r.file_id: set(r.codes.split(",")) for r in O.chinese_quality(frame).where("ord = 1").collect()}
    for k, (z, _, _, must, must_not) in enumerate(RULES):
        found = got.get(k, set())
        assert must <= found and not must_not & found, (z, found)


def test_translationese_and_severity(spark):
    frame = spark.createDataFrame([("进行深度挖掘",), ("由法律定义",), ("很好",)], "z string")
    assert [r[0] for r in frame.select(F.expr(Q.translationese(B.SPARK))).collect()] == ["deep_dive", "defined_by", ""]
    codes = [("overlong_english", "error"), ("translation_id_new", "info"), ("suspicious_cut", "info"), ("other", "warning"), ("other", "error")]
    frame = spark.createDataFrame(codes, "code string, level string")
    assert [r[0] for r in frame.select(F.expr(Q.severity())).collect()] == ["BLOCKER", "BLOCKER", "REVIEW", "REVIEW", "INFO"]


@pytest.mark.parametrize(
    "value, must",
    [
        ("0", {"零", "百分之零"}),
        ("10", {"十"}),
        ("110", {"一百一十"}),
        ("1005", {"一千零五", "一零零五年"}),
        ("2200", {"二千二百", "两千两百"}),
        ("20000", {"二万", "两万", "2万"}),
        ("100000001", {"一亿零一"}),
        ("123456789", {"一亿二千三百四十五万六千七百八十九"}),
        ("300000000", {"三亿", "3亿", "3亿美元"}),
        ("150000000", {"1.5亿"}),
        ("15000", {"1.5万", "15千", "一万五千"}),
        ("1980", {"一九八零年", "20世纪80年代", "二十世纪八十年代"}),
        ("1900", {"20世纪", "20世纪初"}),
        ("50%", {"百分之五十"}),
        ("100%", {"百分之一百", "百分之百"}),
        ("10000000000000005", {"一亿亿零五"}),
        ("1" + "0" * 5000, {"1" + "0" * 4992 + "亿"}),
        ("3.5", set()),
        ("x", set()),
    ],
)
def test_numerals(value, must):
    found = numerals.variants(value)
    assert must <= set(found) and found == sorted(found, key=len, reverse=True)
    assert bool(found) == bool(must)


def test_coverage(spark):
    sources = spark.createDataFrame([(1, 1, 0, 10000), (1, 2, 10000, 20000), (1, 3, 20000, 21000), (2, 1, 0, 5000)], "file_id long, source_id long, start_ms long, end_ms long")
    rows = spark.createDataFrame([(1, 1500, 4000), (1, 3000, 6000), (1, 8000, 14000), (1, 14500, 18400)], "file_id long, start_ms long, end_ms long")
    got = {(r.file_id, r.source_id): (r.n_gaps, r.missing_ms) for r in O.coverage_report(sources, rows).collect()}
    assert got == {(1, 1): (2, 2000), (1, 2): (1, 1600), (2, 1): (1, 5000)}


def test_small_transformations(spark):
    frame = spark.createDataFrame([("...",), (" Hello ",), ("naïve",), ("—",), ("B2",)], "text string")
    assert sorted(r.text for r in O.preprocessed(frame).collect()) == ["b2 ", "hello ", "naïve"]
    frame = spark.createDataFrame([("watch A Adrift in Time now",), ("A apple",)], "text string")
    assert [r[0] for r in frame.select(O.without_accidental_article(F.col("text"))).collect()] == ["watch Adrift in Time now", "A apple"]
    frame = spark.createDataFrame([("one two three four five",), ("one",), ("",), ("a-b c, d",)], "text string")
    assert [r[0] for r in frame.select(O.packed_words(F.col("text"), 2)).collect()] == [["one two", "three four", "five"], ["one"], [], ["a-b c,", "d"]]
    words = spark.createDataFrame([("a", 0.0005, 0.0015), (" ", 0.0, 1.0), ("b", 1.0, 0.5)], "text string, start double, end double")
    assert [(r.text, r.start_ms, r.end_ms) for r in O.word_rows(words).collect()] == [("a", 0, 2), ("b", 1000, 1120)]


def test_mapped_words(spark):
    s = spark.createDataFrame([(1, k, t, k * 100, k * 100 + 90) for k, t in enumerate("a b c d e".split())], "file_id long, ord long, token string, start_ms long, end_ms long")
    a = spark.createDataFrame([(1, k, t, k * 1000, k * 1000) for k, t in enumerate("a x x b e c".split())], "file_id long, word_id long, token string, start_ms long, end_ms long")
    got = [(r.ord, r.start_ms, r.end_ms, r.matched) for r in O.mapped_words(s, a).orderBy("ord").collect()]
    assert got == [(0, 0, 120, True), (1, 3000, 3120, True), (2, 5000, 5120, True), (3, 300, 390, False), (4, 400, 490, False)]


def test_uses_and_candidates(spark):
    frame = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [3, 4]), (4, [])], "id long, sources array<long>")
    assert [r.id for r in O.single_use(frame).collect()] == [1]
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "code string, ord long, level string")
    assert sorted(map(tuple, O.first_candidates(frame, ["code"], ["ord"]).select("code", "ord", "level").collect())) == [("a", 1, "y"), ("b", 5, "z")]


def test_mapped_words_like_a_plain_loop(spark):
    """Also files of which one side has no words, and an empty table."""
    import random

    rng = random.Random(2)
    words = lambda n: [rng.choice("abcde") if rng.random() < 0.95 else None for _ in range(n)]
    files = {f: (words(rng.randint(1, 60)), words(rng.randint(1, 60))) for f in range(30)} | {30: (["a"], []), 31: ([], ["a"])}
    want = []
    for f, (source, found) in files.items():
        cursor = 0
        for k, t in enumerate(source):
            hit = next((i for i in range(cursor, min(cursor + 8, len(found))) if t and found[i] == t), None)
            want.append((f, k, k * 100, k * 100 + 120, False) if hit is None else (f, k, hit * 1000, hit * 1000 + 300, True))
            cursor = cursor if hit is None else hit + 1
    s = spark.createDataFrame([(f, k, t, k * 100, k * 100) for f, (x, _) in files.items() for k, t in enumerate(x)], "file_id long, ord long, token string, start_ms long, end_ms long")
    a = spark.createDataFrame([(f, 7 * k, t, k * 1000, k * 1000 + 300) for f, (_, x) in files.items() for k, t in enumerate(x)], "file_id long, word_id long, token string, start_ms long, end_ms long")
    got = O.mapped_words(s, a)
    assert got.columns == ["file_id", "ord", "start_ms", "end_ms", "matched"] and sorted(map(tuple, got.collect())) == sorted(want)
    assert O.mapped_words(s.limit(0), a.limit(0)).count() == 0


def _blocks(spark, files, size):
    """Files of plain tuples ``(ord, token, start, end)`` and ``(token, start, end)`` as blocks of ``size`` words a side."""
    rows = []
    for f, (source, found) in files:
        for k in range(max(1, -(-max(len(source), len(found)) // size))):
            rows.append((f, k, source[k * size : (k + 1) * size] or None, found[k * size : (k + 1) * size]))
    word = "token: string, start_ms: bigint, end_ms: bigint"
    schema = f"file_id long, block int, sources array<struct<ord: bigint, {word}>>, aligned array<struct<{word}>>"
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_mapped_blocks_like_mapped_words(spark):
    """Sides that run ahead of each other, repeated ids, missing sides and times; blocks of one word and more."""
    import random

    rng = random.Random(3)
    words = lambda n: [rng.choice("abcde") if rng.random() < 0.95 else None for _ in range(n)]
    files = {f: (words(rng.randint(0, 60)), words(rng.randint(0, 60))) for f in range(30)}
    files = {f: ([(k, t, k * 100, k * 100) for k, t in enumerate(x)], [(t, k * 1000, k * 1000 + 300) for k, t in enumerate(y)]) for f, (x, y) in files.items()}
    sides = "file_id long, ord long, token string, start_ms long, end_ms long", "file_id long, word_id long, token string, start_ms long, end_ms long"
    s = spark.createDataFrame([(f, *w) for f, (x, _) in files.items() for w in x], sides[0])
    a = spark.createDataFrame([(f, k, *w) for f, (_, x) in files.items() for k, w in enumerate(x)], sides[1])
    want = sorted(map(tuple, O.mapped_words(s, a).collect()))
    for size in (1, 7, 100):
        assert sorted(map(tuple, O.mapped_blocks(_blocks(spark, files.items(), size), 8).collect())) == want, size
    twice = [(5, ([(0, "a", 0, 50)], [("a", 7, 9)])), (5, ([(0, "a", None, 50), (1, "b", 3, 3)], [("a", 8, None)]))]
    got = [tuple(r) for r in O.mapped_blocks(_blocks(spark, twice, 1)).collect()]
    assert got == [(5, 0, 7, 9, True), (5, 0, 8, None, True), (5, 1, 3, 123, False)]
    assert O.mapped_blocks(_blocks(spark, twice, 1).limit(0)).count() == 0


def test_words_are_mapped_where_they_are_made(spark, data):
    """No word is shuffled or sorted, and blocks hold the words of the rows."""
    from scriptloom.plans import catalog, quality_queries  # noqa: F401
    from scriptloom.plans import views as V

    plan = catalog.QUERIES["mapped_words"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan and "MapInArrow" in plan
    flat = V.doc_word_blocks(spark, data).select("file_id", F.inline("words"))
    rows = V.doc_words(spark, data).select(flat.columns)
    assert flat.count() == rows.count() and flat.exceptAll(rows).count() == 0
