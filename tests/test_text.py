"""Truth tables of text primitives, word forms and clause features."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import morphology as M
from turnwise.functions import text as X
from turnwise.operators import classify as C
from turnwise.operators import segment as S


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Open the gate. Close the hatch.", ["Open the gate.", "Close the hatch."]), ("Mr. Smith left. Go!", ["Mr. Smith left.", "Go!"]), ("at 5 p.m. we go", ["at 5 p.m. we go"]), ("a|b", ["a", "b"]), ("", []), ("Jump and then wait", ["Jump", "wait"]), ("Go? No! Yes", ["Go?", "No!", "Yes"]), ("I left, did you see it?", ["I left", "did you see it?"])],
)
def test_split_clauses(spark, text, want):
    assert one(spark, text, lambda c: S.split_clauses(X.normalize(c))) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("carries", "carry"), ("running", "run"), ("opening", "open"), ("tried", "try"), ("opened", "open"), ("stopped", "stopp"), ("focus", "focus"), ("doors", "door"), ("glass", "glass"), ("was", "be"), ("taken", "take"), ("its", "its"), ("being", "being")],
)
def test_lemma(spark, word, want):
    assert one(spark, word, M.lemma) == want


@pytest.mark.parametrize(
    ("span", "want"),
    [("the small box!!!", "small box"), ("door to the hall", "door"), ("the", "the"), ("back my book, you had it", "book"), ("onto them", "them"), ("onto the mat", "onto the mat"), ("box back", "box"), ("locker shut", "locker"), ("shut", "shut"), ("", "")],
)
def test_trim_target(spark, span, want):
    assert one(spark, span, X.trim_target) == want


@pytest.mark.parametrize(("span", "want"), [("me the lamp", ("the lamp", "user")), ("me", ("", "user")), ("lamp to him", ("lamp", "him")), ("them by the door", ("them by the door", "")), ("lamp", ("lamp", ""))])
def test_recipient(spark, span, want):
    assert (one(spark, span, lambda c: X.split_recipient(c)[0]), one(spark, span, lambda c: X.split_recipient(c)[1])) == want


@pytest.mark.parametrize(
    ("clause", "want"),
    [("Open the gate.", "request"), ("Can you open it", "request"), ("Did you open it", "question"), ("I opened it", "statement"), ("flurbulate the lamp", "request"), ("*smiles*", "statement"), ("May I take it?", "request"), ("Where is it", "question"), ("oh, close the door", "request"), ("", "fragment")],
)
def test_speech_act(spark, clause, want):
    rows = C.prepared(spark.createDataFrame([(1, 1, clause)], "turn_id int, clause_no int, clause string")).withColumn("a", C.speech_act())
    assert rows.first()["a"] == want


@pytest.mark.parametrize(("clause", "predicate", "thing", "who"), [("give the lamp to me", "give", "lamp", "me"), ("carefully clean the rug", "clean", "rug", ""), ("get rid of the box", "get rid of", "box", ""), ("put the cup in the box", "put", "cup", "")])
def test_roles(spark, clause, predicate, thing, who):
    rows = C.prepared(spark.createDataFrame([(1, 1, clause)], "turn_id int, clause_no int, clause string")).withColumn("speech_act", C.speech_act())
    row = C.with_roles(rows).first()
    assert (row["predicate_lemma"], row["object"], row["recipient_or_direction"]) == (predicate, thing, who)


@pytest.mark.parametrize(
    ("clause", "negated", "condition", "retracts"),
    [("not you open it", True, "", False), ("never you mind", True, "", False), ("don't you open it", False, "", False), ("i didn't take it", True, "", False), ("when the bell rings", False, "", False), ("assuming it rains", False, "explicit", False), ("would you open it", False, "modal", False), ("unless it rains", False, "explicit", False), ("ok, not now", True, "", True), ("actually - cancel this", False, "", True), ("well, never mind", True, "", False), ("cancel the order", False, "", False)],
)
def test_classes(spark, clause, negated, condition, retracts):
    t = lambda c: X.tokenize(c)
    assert (one(spark, clause, lambda c: C.negated(t(c))), one(spark, clause, lambda c: C.condition_kind(t(c))), one(spark, clause, C.is_retraction)) == (negated, condition, retracts)


def test_long_texts_take_time_in_proportion(spark):
    """Long runs of stops, letters and spaces, which patterns must not try again and again."""
    import time

    rows = [(1, "a." * 100_000), (2, "x" * 200_000 + " . " + "\n" * 200_000 + "b"), (3, "Open the gate. " * 20_000)]
    start = time.time()
    cut = spark.createDataFrame(rows, "turn_id long, text string").select("turn_id", F.size(S.split_clauses(F.col("text"))).alias("n")).collect()
    assert {r["turn_id"]: r["n"] for r in cut} == {1: 1, 2: 2, 3: L.MAX_FRAMES + 1} and time.time() - start < 20


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab .!?,;|\n\r\"'", max_size=40), min_size=1, max_size=20))
def test_properties(spark, texts):
    """Places are those of the clauses; tokens hold no separating sign; normalization is idempotent; all within limits."""
    t = spark.createDataFrame(list(enumerate(texts)), "turn_id long, text string")
    for r in S.clauses(t).join(t.select("turn_id", X.normalize(F.col("text")).alias("n")), "turn_id").collect():
        assert r["n"][r["start_index"] : r["end_index"]].lower() == r["clause"].lower()
    for r in t.select(X.tokenize(F.col("text")).alias("t"), X.normalize(F.col("text")).alias("n"), X.normalize(X.normalize(F.col("text"))).alias("m"), F.size(S.split_clauses(F.col("text"))).alias("k")).collect():
        assert not any(c in w for w in r["t"] for c in L.TOKEN_SIGNS) and r["n"] == r["m"] and r["k"] <= L.MAX_FRAMES + 1


def test_limits_and_nulls(spark):
    from turnwise.plans import analysis

    rows = [(1, "x" * 8193), (2, "go " * 1025), (3, "Go! " * 34), (4, None), (5, ""), (6, "Go.")]
    got = {r["turn_id"]: (r["diagnostic_code"], r["language_status"]) for r in analysis.limits(spark.createDataFrame(rows, "turn_id long, text string")).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["NTA_LIMIT_EXCEEDED", "NTA_TOKEN_LIMIT_EXCEEDED", "NTA_CLAUSE_LIMIT_EXCEEDED"]
    assert got[4][1] == got[5][1] == "empty" and got[6] == ("", "english")
