"""Whole turns: truth tables, and what must hold for any turn."""

import pytest

from turnwise.operators import frames, match
from turnwise.plans import analysis
from turnwise.streaming import dialogue

CASES = {
    "Open the gate.": [("world_action", "open", "gate")],
    "Can you open the gate?": [("world_action", "open", "gate")],
    "Can you jump?": [("state_query", "jump", "")],
    "Did you open the gate?": [("state_query", "open", "")],
    "Do not open the gate.": [("conversation", "", "")],
    "Open it.": [("clarification", "open", "it")],
    "Open the gate and close the hatch.": [("world_action", "open", "gate"), ("world_action", "close", "hatch")],
    "Open the gate and close it.": [("world_action", "open", "gate"), ("world_action", "close", "gate")],
    "Open the gate then close the hatch.": [("world_action", "open", "gate"), ("world_action", "close", "hatch")],
    "Jump 3 times.": [("world_action", "jump", "")] * 3,
    "Do two jumps.": [("world_action", "jump", "")] * 2,
    "Open the gate. Never mind.": [("conversation", "open", "gate"), ("conversation", "", "")],
    "Wait; open the gate.": [("conversation", "wait", ""), ("world_action", "open", "gate")],
    "Fetch the lamp for me.": [("inventory_action", "pickup", "lamp"), ("inventory_action", "give", "lamp")],
    "Would you mind closing the hatch?": [("world_action", "close", "hatch")],
    "Can you open doors?": [("state_query", "open", "")],
    "Hand me the cup.": [("inventory_action", "give", "cup")],
    "She was closing the hatch yesterday.": [("conversation", "close", "")],
    "I saw the gate and walk home.": [("conversation", "", "")],
    "Leave the hatch closed.": [("conversation", "", "")],
    "Only open the gate if I say so.": [("conversation", "open", "")],
    "Put the cup in the box.": [("world_action", "insert", "cup")],
    "High five!": [("world_action", "gesture", "user")],
    "Throw the lamp. Do two throws.": [("world_action", "throw", "lamp")] * 3,
    "Throw the lamp. Do 2 throws, land on the mat.": [("world_action", "throw", "lamp")] * 2 + [("world_action", "throw", "mat")],
    "Do 2 throws.": [("clarification", "throw", "")] * 2,
    "Do 2 throws, land on the mat!": [("clarification", "throw", ""), ("world_action", "throw", "mat")],
    "Do 40 throws.": [],
    "Do two lifts.": [("clarification", "", "")],
    "Break free.": [("conversation", "break", "")],
    "Sam opened the gate.": [("conversation", "open", "")],
    "Open windows make the room cold.": [("conversation", "open", "")],
    "Open the box and examine if the lamp moves.": [("world_action", "open", "box"), ("world_action", "examine", "box")],
    "": [],
    "   ": [],
}


@pytest.fixture(scope="module")
def compiled(spark):
    turns = spark.createDataFrame(list(enumerate(CASES)), "turn_id long, text string").withColumnRenamed("_", "_")
    return analysis.compiled(spark, turns).collect()


def test_truth_table(compiled):
    got = {}
    for r in sorted(compiled, key=lambda r: r["frame_no"]):
        got.setdefault(r["turn_id"], []).append((r["frame_type"], r["action"], r["object"]))
    assert {t: got.get(i, []) for i, t in enumerate(CASES)} == CASES


def test_dependencies_point_back_and_spans_hold(compiled):
    for r in compiled:
        assert r["depends_on"] is None or r["depends_on"] < r["frame_no"] <= 32
        text = list(CASES)[r["turn_id"]]
        assert r["raw"].lower().startswith(text[r["start_index"] : r["end_index"]].lower())
        assert r["end_index"] - r["start_index"] == (len("I saw the gate") if " and walk" in text else len(r["raw"]))


def test_names_of_kept_columns_do_not_clash(spark):
    turns = spark.createDataFrame([(1, "Open the gate.", "a")], "turn_id long, text string, kind string")
    assert analysis.compiled(spark, turns, "kind").first()["kind"] == "a"


def test_no_turns(spark):
    assert analysis.compiled(spark, spark.createDataFrame([], "turn_id long, text string")).count() == 0


def test_registry_is_a_parameter(spark):
    turns = spark.createDataFrame([(1, "Zap the gate."), (2, "Open the gate.")], "turn_id long, text string")
    registry, known = match.aliases(spark, [("zap", "zap")]), match.actions(spark, [("zap", "required", "manipulation")])
    got = {r["turn_id"]: r["frame_type"] for r in frames.compile_frames(turns, registry, known).collect()}
    assert got == {1: "world_action", 2: "conversation"}


TALK = [(1, 0, 10, "Open it."), (1, 1, 11, "I meant the north gate."), (1, 2, 12, "I meant the south gate."), (2, 0, 20, "Open it."), (2, 1, 21, "I meant the gate or the hatch."), (2, 2, 22, "Use the hatch as the target."), (3, 0, 30, "I meant the lamp.")]


@pytest.fixture(scope="module")
def talk(spark):
    turns = spark.createDataFrame(TALK, "conv_id long, turn long, turn_id long, text string")
    return dialogue.outcomes(turns, analysis.compiled(spark, turns.select("turn_id", "text")))


WANT = {10: (False, "", ""), 11: (True, "world_action", "north gate"), 12: (False, "", ""), 20: (False, "", ""), 21: (True, "clarification", ""), 22: (True, "world_action", "hatch"), 30: (False, "", "")}


def test_pending_fold(talk):
    assert {r["turn_id"]: (r["resolved"], r["frame_type"], r["object"]) for r in dialogue.fold(talk).collect()} == WANT


def test_stream_equals_fold(spark, talk, tmp_path):
    """Turn by turn, each in a batch of its own."""
    rows = talk.toPandas()
    for turn in sorted(rows.turn.unique()):
        spark.createDataFrame(rows[rows.turn == turn], talk.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"turn={turn}_"))
    source = spark.readStream.schema(talk.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    done = dialogue.stream(source).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    done.awaitTermination(300)
    assert {r["turn_id"]: (r["resolved"], r["frame_type"], r["object"]) for r in spark.table("answers").collect()} == WANT


def test_late_surfaces_split(spark, monkeypatch):
    """However many surfaces there are, none is left out of the splitting of coordinations."""
    monkeypatch.setattr(match, "BROADCAST_ROWS", 3)
    turns = spark.createDataFrame([(1, "Open the gate and wave.")], "turn_id long, text string")
    assert [r["action"] for r in analysis.compiled(spark, turns).sort("frame_no").collect()] == ["open", "wave"]


def test_fold_goes_on_from_batch_to_batch(spark):
    """Rows of many conversations, an open question in each, in batches of two; no call for each conversation."""
    n = 50
    rows = [(c, t, 10 * c + t, "lamp" if t == 2 else "", None if t == 1 else False, "open" if t == 0 else "", False, False) for c in range(n) for t in (2, 0, 1)]
    rows += [(None, t, -t, "lamp" if t == 2 else "", False, "give" if t == 1 else "", False, False) for t in (2, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, turn_id long, answer string, asks_again boolean, opens string, closes boolean, conditional boolean").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        folded = dialogue.fold(df)
        assert "InPandas" not in folded._jdf.queryExecution().executedPlan().toString()
        got = {r["turn_id"]: (r["resolved"], r["frame_type"], r["action"], r["object"], r["pending"]) for r in folded.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {10 * c + t: w for c in range(n) for t, w in enumerate([(False, "", "", "", "open"), (False, "", "", "", "open"), (True, "world_action", "open", "lamp", "")])}
    assert got == want | {-1: (False, "", "", "", "give"), -2: (True, "inventory_action", "give", "lamp", "")}
