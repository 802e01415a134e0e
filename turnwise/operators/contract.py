"""Validators as error columns: an array of what is wrong with a row, empty if nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.operators.link import RELATIONS, STATUSES

ANALYSIS_KEYS = ("analysis_version", "supported_language", "raw_input", "normalized_input", "language_status", "request_count", "segments", "global_flags", "structural_confidence", "segmentation_status")


def errors(**tests: Column) -> Column:
    """Names of the tests that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in tests.items())))


def validate_analysis(rows: DataFrame) -> DataFrame:
    """errors of packed analyses: keys without a value, another version."""
    tests = {k: F.col(k).isNull() if k in rows.columns else F.lit(True) for k in ANALYSIS_KEYS}
    return rows.withColumn("errors", errors(**tests, version=F.col("analysis_version") != "4" if "analysis_version" in rows.columns else F.lit(True)))


def validate_graph(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row an error: entry_surface:i, candidate_action:i:j, candidate_relation:i:j, candidate_confidence:i:j.
    entries: i, surface; candidates: i, j, action, relation, confidence."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    top = entries.where(blank(F.col("surface"))).select(F.concat(F.lit("entry_surface:"), F.col("i")).alias("error"))
    c = candidates.withColumn("bad", errors(candidate_action=blank(F.col("action")), candidate_relation=~F.col("relation").isin(*RELATIONS), candidate_confidence=~F.col("confidence").between(0, 1)))
    return top.unionByName(c.select(F.explode("bad").alias("e"), "i", "j").select(F.concat_ws(":", "e", "i", "j").alias("error")))


def validate_links(asked: DataFrame, ranked: DataFrame, known: DataFrame) -> DataFrame:
    """One row an error of link results: blank ids and surfaces out of their spans, candidates of what may not be acted
    on, actions that the registry lacks, fields that would claim authority."""
    span = F.length("clause") != F.col("end_index") - F.col("start_index")
    bad = asked.withColumn("e", errors(source_span=span, clause_index=F.col("clause_no") < 1))
    out = bad.select("turn_id", F.explode("e").alias("error"))
    idle = asked.where("not (speech_act = 'request' and not negated and not quoted and not reported)").select("turn_id", "clause_no")
    out = out.unionByName(ranked.join(idle, ["turn_id", "clause_no"], "left_semi").select("turn_id", F.lit("non_actionable_candidates").alias("error")))
    out = out.unionByName(ranked.join(F.broadcast(known.select("action")) if known.limit(10_001).count() <= 10_000 else known.select("action"), "action", "left_anti").select("turn_id", F.concat(F.lit("action_not_in_snapshot:"), F.col("action")).alias("error")))
    claims = [c for c in ("execute", "selected_action") if c in asked.columns or c in ranked.columns]
    return out.unionByName(asked.select("turn_id", F.lit("forbidden_authority_field").alias("error"))) if claims else out


def status_valid(c: Column) -> Column:
    return c.isin(*STATUSES)


def valid_span(text: Column, first: Column, end: Column) -> Column:
    return F.length(text) == end - first


def build_info() -> dict[str, str | int]:
    return {"engine": "turnwise", "analysis_version": "4", "schema_contract": "deterministic_turn_compiler_v2", "max_chars": L.MAX_CHARS, "max_tokens": L.MAX_TOKENS, "max_frames": L.MAX_FRAMES}
