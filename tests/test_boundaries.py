import pytest

from scriptloom.functions import boundaries as B
from scriptloom.operators import boundaries as O

PAIRS = [
    # words with | at the boundary, pause, codes that must be there, codes that must not
    ("they have | automated", 0, {"auxiliary_predicate", "dangerous_end"}, {"bad_pair"}),
    ("so we | are", 0, {"subject_finite_verb"}, set()),
    ("he issued | the", 0, {"short_verb_object"}, set()),
    ("it helped | build", 0, {"verb_complement"}, set()),
    ("a career | market", 0, {"compound_noun"}, set()),
    ("the structural | shift", 0, {"modifier_noun_head"}, set()),
    ("the healthy | cash", 0, {"modifier_head_pair"}, set()),
    ("china's | economy", 0, {"modifier_head_pair"}, set()),
    ("on Wall | Street", 0, {"protected_named_phrase"}, set()),
    ("people hunkering | down", 0, {"protected_phrasal"}, {"phrasal_verb_particle"}),
    ("we look | at", 0, {"protected_phrasal", "phrasal_verb_particle", "bad_pair"}, set()),
    ("in the | house", 0, {"determiner_head", "bad_pair", "dangerous_end"}, set()),
    ("in the | slowly", 0, {"bad_pair"}, {"determiner_head"}),
    ("go straight | through", 0, {"particle_complement"}, set()),
    ("from 8 p.m. | to 9", 0, {"time_range", "dangerous_start"}, set()),
    ("he wants | to build", 0, {"infinitive_phrase", "stranded_complement"}, {"time_range"}),
    ("he wants | to build", 450, {"infinitive_phrase"}, {"stranded_complement"}),
    ("it ended. | With", 0, {"takes_with"}, {"stranded_complement"}),
    ("never | ever", 0, {"negation_emphasis"}, set()),
    ("only a | few days", 0, {"quantifier_phrase"}, set()),
    ("only a | few", 0, set(), {"quantifier_phrase"}),
    ("a couple | of years", 0, {"quantifier_phrase"}, set()),
    ("a couple of | years", 0, {"quantifier_phrase"}, set()),
    ("these | two houses", 0, {"determiner_number_noun"}, set()),
    ("these two | houses", 0, {"determiner_number_noun", "numeric_unit"}, set()),
    ("3.5 | kilometres", 0, {"numeric_unit"}, set()),
    ("really | important", 180, {"adverb_adjective"}, set()),
    ("really | important", 181, set(), {"adverb_adjective"}),
    ("massive | economic change", 449, {"modifier_chain"}, set()),
    ("massive | economic change", 450, set(), {"modifier_chain"}),
    ("economic | and social pressure", 0, {"coordinated_modifier"}, set()),
    ("it ended. However | they", 0, {"transition_attached"}, set()),
    ("it however | they", 0, set(), {"transition_attached"}),
    ("well | I mean", 0, {"discourse_marker"}, set()),
    ("you | know", 0, {"discourse_marker"}, set()),
    ("green | apples", 0, set(), {"modifier_noun_head", "bad_pair", "dangerous_end", "determiner_head"}),
]


def test_pair_rules(spark):
    rows = []
    for k, (text, pause, _, _) in enumerate(PAIRS):
        left, right = (side.split() for side in text.split("|"))
        for i, w in enumerate([*left, *right]):
            rows.append((k, i, w, i * 1000, i * 1000 + 1000 - (pause if i == len(left) - 1 else 0)))
    words = spark.createDataFrame(rows, "file_id long, word_id long, surface string, start_ms long, end_ms long")
    got = {(r.file_id, r.word_id): set(r.codes.split(",")) for r in O.word_boundaries(words).collect()}
    for k, (text, _, must, must_not) in enumerate(PAIRS):
        found = got.get((k, len(text.split("|")[0].split()) - 1), set())
        assert must <= found and not must_not & found, (text, found)
    named = {code for _, _, must, _ in PAIRS for code in must}
    assert named == set(B.pair_rules(B.SPARK))


ROWS = [
    ("a", "on wall", "street today", "trailing_protected_named_phrase_fragment", set()),
    ("a", "they are forced", "to leave", "trailing_protected_phrasal_fragment", {"finite_predicate"}),
    ("a", "we left and", "then came", "trailing_connector_fragment", set()),
    ("a", "maybe it's", "time", "trailing_auxiliary_fragment", set()),
    ("a", "the china's", "market", "trailing_possessive_fragment", {"subject_without_predicate"}),
    ("a", "with both", "houses", "trailing_quantifier_fragment", set()),
    ("a", "some structural", "shift came", "trailing_modifier_fragment", set()),
    ("a", "it is clear", "policy", "", {"finite_predicate"}),
    ("a", "what a day", "it was", "", {"incomplete_interrogative"}),
    ("a", "never ever", "again", "", {"negation_only"}),
    ("a", "open the", "door", "", {"bare_verb"}),
    ("a", "Exactly.", "so", "", {"independent_short"}),
    ("a", "However,", "it went", "", {"standalone_transition"}),
    ("a", "Yes sir.", "Really?", "", {"independent_answer"}),
    ("a", "and.", "then", "", {"standalone_transition"}),
]


@pytest.mark.parametrize("pause", [0, 450])
def test_row_rules(spark, pause):
    rows = []
    for k, (speaker, text, after, _, _) in enumerate(ROWS):
        rows += [(k, 1, speaker, 0, 1000 - pause, text), (k, 2, speaker, 1000, 2000, after)]
    frame = spark.createDataFrame(rows, "file_id long, ord long, speaker string, start_ms long, end_ms long, text string")
    got = {r.file_id: (r.trailing_issue, set(r.codes.split(","))) for r in O.fragments(frame).where("ord = 1").collect()}
    for k, (_, text, _, trailing, must) in enumerate(ROWS):
        found = got.get(k, ("", set()))
        assert found[0] == (trailing if pause < 450 else ""), (text, found)
        assert (must - ({"bare_verb"} if pause else set())) <= found[1], (text, found)


def test_speakers_and_nulls(spark):
    rows = [(1, 1, "a", 0, 9, "we left and"), (1, 2, "b", 9, 20, "then came"), (2, 1, None, None, None, None), (2, 2, None, 1, 2, "")]
    frame = spark.createDataFrame(rows, "file_id long, ord long, speaker string, start_ms long, end_ms long, text string")
    got = {(r.file_id, r.ord): r for r in O.fragments(frame).collect()}
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1].trailing_issue == "" and "independent_short" in got[1, 2].codes
    assert O.fragments(frame.limit(0)).count() == 0


def test_dangling_han(spark):
    texts = {"他说这是因为": True, "我们在": True, "这" * 18 + "在": False, "当他来时": True, "事情发生时": True, "这是好的。": False, "意味着…": True, "": False}
    frame = spark.createDataFrame([(t,) for t in texts], "translated_text string").selectExpr("translated_text", f"{B.dangling_han(B.SPARK)} as bad")
    assert {r.translated_text: r.bad for r in frame.collect()} == texts


def test_profiles(spark):
    from scriptloom.functions import text as T

    cases = [("they met on wall", "street today it was late", "protected_named_phrase_split"), ("the people were forced", "to leave the town at once", "protected_phrasal_boundary_split")]
    frame = spark.createDataFrame(cases, "p string, c string, code string")
    for r in frame.select("code", T.boundary_reasons(frame.p, frame.c, True).alias("editor"), T.boundary_reasons(frame.p, frame.c).alias("audit")).collect():
        assert r.code in r.editor and r.code not in r.audit


@pytest.mark.parametrize("name", ["syntax_boundaries", "editor_boundaries"])
def test_words_end_at_letters_beyond_ascii(name, spark, tmp_path, same):
    """Names and pronouns that touch an umlaut give the rows of the SQL."""
    import duckdb

    from scriptloom.plans import catalog

    texts = ["St. Dasötzte kam heute. Dr. Müller came. Prof. Dürer came. ÖSt. Gallen lies there.", "so they saw öhe. Are there more? it said Süd John Ött", "are you there? old Köln Ömit was here", "was it"]
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert (found.reasons == "abbreviation_name_split").any()
    same(found, con.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize(("name", "code"), [("spliced_boundary_rules", "auxiliary_predicate"), ("spliced_fragment_rules", "standalone_transition"), ("chinese_quality", "modifier_break"), ("repair_marks", None)])
def test_rules_are_compiled_and_run_once(spark, data, name, code):
    from scriptloom.plans import boundary_queries, catalog, quality_queries  # noqa: F401
    from scriptloom.session import HUGE_METHOD

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == HUGE_METHOD
    assert code is None or plan.count(f"THEN {code}") == 1
