"""Clarifications carried from turn to turn of a conversation: the same step as a batch fold and as a stream.

A turn's outcome (what its frames would be on their own) and its answer (the target it names, if it answers an open
question) are computed first, as columns. Only the step that depends on earlier turns is stateful: a clarification with
an action opens a question, an executable frame closes it, a target answers it."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import text as X
from turnwise.sources.tables import by_turn

USE = r"(?s)^.*?use (.*?) as the target.*$"
ASKING = ("which one", "which target", "two possible targets", "still have not named the target")


def answer(text: Column) -> dict[str, Column]:
    """target named by a turn as an answer, and whether it leaves the question open."""
    lower = F.lower(X.normalize(text))
    named = F.lit("")
    for marker in reversed(L.PENDING_MARKERS):
        named = F.when(lower.contains(marker), X.strip_edges(F.substring(lower, F.instr(lower, marker) + len(marker), F.length(lower)))).otherwise(named)
    named = F.when((named == "") & lower.rlike(USE), X.strip_edges(F.regexp_extract(lower, USE, 1))).otherwise(named)
    target, _, _ = X.split_place(X.trim_target(named))
    competing = target.rlike(" (?:or|but|not) ")
    return {"answer": F.when(competing, "").otherwise(target), "asks_again": competing | lower.rlike(f"(?:{L.any_of(ASKING)})")}


def outcomes(turns: DataFrame, frames: DataFrame) -> DataFrame:
    """conv_id, turn, turn_id, text, answer, asks_again, opens (the action a clarification asks about), closes, and whether
    the turn set a condition."""
    done = frames.groupBy("turn_id").agg(
        F.max_by(F.when(F.col("frame_type") == "clarification", F.col("action")), "frame_no").alias("opens"),
        F.bool_or(F.col("frame_type").isin("world_action", "inventory_action")).alias("closes"),
        F.bool_or(F.col("query_kind") == "conditional_request").alias("conditional"),
    )
    rows = by_turn(turns.select("conv_id", "turn", "turn_id", "text")).withColumns(answer(F.col("text"))).join(done, "turn_id", "left")
    return rows.select("conv_id", "turn", "turn_id", "answer", "asks_again", F.coalesce("opens", F.lit("")).alias("opens"), F.coalesce("closes", F.lit(False)).alias("closes"), F.coalesce("conditional", F.lit(False)).alias("conditional"))


OUT = "conv_id long, turn long, turn_id long, resolved boolean, frame_type string, action string, object string, pending string"


def after(pending: str, conditional: bool, r) -> tuple[tuple, str, bool]:
    """One turn (answer, asks_again, opens, closes, conditional): its result and the question that is then open."""
    resolved = bool(pending) and bool(r.answer or r.asks_again)
    kind, action, target = "", "", ""
    if resolved:
        action, target = pending, r.answer
        kind = "clarification" if r.asks_again or conditional else "inventory_action" if pending in L.INVENTORY_ACTIONS else "world_action"
        if kind != "clarification":
            pending, conditional = "", False
    elif r.opens:
        pending, conditional = r.opens, bool(r.conditional)
    elif r.closes:
        pending, conditional = "", False
    return (resolved, kind, action, target, pending), pending, conditional


def step(pending: str, conditional: bool, rows: pd.DataFrame) -> tuple[list[tuple], str, bool]:
    """One conversation's next turns, in order: their results and the question that is then open."""
    out = []
    for r in rows.sort_values("turn").itertuples():
        result, pending, conditional = after(pending, conditional, r)
        out.append((r.conv_id, r.turn, r.turn_id, *result))
    return out, pending, conditional


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "turn", "turn_id", "resolved", "frame_type", "action", "object", "pending"])


Turn = namedtuple("Turn", "conv_id turn turn_id answer asks_again opens closes conditional")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and turn; only the open question is held, from row to row and batch to batch."""
    conv, pending, conditional, begun = None, "", False, False
    for batch in batches:
        results = []
        for r in map(Turn._make, zip(*(batch.column(k).to_pylist() for k in Turn._fields))):
            if not begun or r.conv_id != conv:
                conv, pending, conditional, begun = r.conv_id, "", False, True
            result, pending, conditional = after(pending, conditional, r)
            results.append(result)
        made = list(zip(*results)) or [()] * 5
        columns = [batch.column(k).cast(pa.int64()) for k in Turn._fields[:3]] + [pa.array(made[0], pa.bool_())] + [pa.array(m, pa.string()) for m in made[1:]]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in OUT.split(", ")])


def fold(rows: DataFrame) -> DataFrame:
    """Batch: each conversation from its first turn on. Conversations are dealt over all partitions, however few bytes they
    are, and follow one another through a task: no call is made for each, and none has to fit in memory."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select(*Turn._fields).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"))
    return ordered.mapInArrow(_folded, OUT)


def stream(rows: DataFrame) -> DataFrame:
    """The same over a stream of outcomes; turns of a conversation come in order from batch to batch. State: the action
    asked about and whether it waits for a condition."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, conditional = state.get if state.exists else ("", False)
        out, pending, conditional = step(pending, conditional, pd.concat(list(batches)))
        state.update((pending, conditional))
        yield _frame(out)

    return rows.groupBy("conv_id").applyInPandasWithState(update, OUT, "pending string, conditional boolean", "append", GroupStateTimeout.NoTimeout)
