"""Plans over whole turns: analysis records, compiled packets, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import text as X
from turnwise.operators import classify as C
from turnwise.operators import frames, link, match
from turnwise.operators.segment import clauses, split_clauses
from turnwise.sources.tables import by_turn


def limits(turns: DataFrame) -> DataFrame:
    """turns with n_chars, n_tokens, n_clauses (one more than allowed at most; null if the text is too long) and the
    diagnostic of a turn over a limit."""
    found = X.once(turns, normalized=X.normalize(F.coalesce("text", F.lit(""))))
    within = F.length("normalized") <= L.MAX_CHARS  # nothing is cut or counted in a text that is too long
    found = X.once(found, n_chars=F.length("normalized"), n_tokens=F.when(within, F.size(X.tokenize(F.col("normalized")))), n_clauses=F.when(within, F.size(split_clauses(F.col("normalized")))))
    code = F.when(F.col("n_chars") > L.MAX_CHARS, "NTA_LIMIT_EXCEEDED").when(F.col("n_tokens") > L.MAX_TOKENS, "NTA_TOKEN_LIMIT_EXCEEDED").when(F.col("n_clauses") > L.MAX_FRAMES, "NTA_CLAUSE_LIMIT_EXCEEDED").otherwise("")
    return found.withColumn("diagnostic_code", code).withColumn("language_status", F.when(F.col("normalized") == "", "empty").otherwise("english"))


def features(turns: DataFrame, *keep: str) -> DataFrame:
    """One row a clause with its tokens and features."""
    c = X.once(C.prepared(clauses(turns, *keep)), speech_act=C.speech_act())
    t = F.col("tokens")
    c = c.withColumns({"question": F.col("clause").endswith("?"), "negated": C.negated(t), "conditional": F.arrays_overlap(t, F.array(F.lit("if"), F.lit("would"))), "condition_kind": C.condition_kind(t), "modal": C.modal(t), "references": C.references(t)})
    return c


def analyze(turns: DataFrame) -> DataFrame:
    """One analysis record a turn. Turns over a limit, and empty ones, have no clauses."""
    base = limits(turns)
    usable = base.where("diagnostic_code = '' and language_status = 'english'")
    f = features(usable)
    f = f.withColumn("clause_id", F.format_string("clause_%03d", "clause_no"))
    own = f.groupBy("turn_id").agg(
        F.count_if(F.col("speech_act") == "request").alias("request_count"),
        F.when(F.bool_or(F.col("speech_act") == "request"), "request").when(F.bool_or(F.col("speech_act") == "question"), "question").otherwise("statement").alias("segment_surface"),
        F.sort_array(F.collect_list(F.struct("clause_no", "clause_id", "clause", "start_index", "end_index", "tokens", "speech_act", "question", "negated", "conditional", "condition_kind", "modal", "references"))).alias("linguistic_clauses"),
    )
    out = base.join(own, "turn_id", "left")
    return out.select("turn_id", F.lit("4").alias("analysis_version"), F.lit("en").alias("supported_language"), F.col("text").alias("raw_input"), F.col("normalized").alias("normalized_input"), "language_status", F.coalesce("request_count", F.lit(0)).alias("request_count"), F.coalesce("segment_surface", F.lit("")).alias("segments"), F.array().cast("array<string>").alias("global_flags"), F.when(F.col("language_status") == "empty", 1.0).when(F.col("diagnostic_code") != "", 0.0).otherwise(0.88).alias("structural_confidence"), F.when(F.col("diagnostic_code") != "", "fallback").otherwise("complete").alias("segmentation_status"), "diagnostic_code", "linguistic_clauses")


def compiled(spark: SparkSession, turns: DataFrame, *keep: str) -> DataFrame:
    return frames.compile_frames(turns, match.aliases(spark), match.actions(spark), *keep)


def packets(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One packet a turn: its frames in order, metrics, validation."""
    base = limits(turns)
    f = compiled(spark, turns)
    grouped = f.groupBy("turn_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "frame_type", "query_kind", "speech_act", "action", "object", "destination", "recipient", "evidence", "depends_on"))).alias("frames"))
    out = base.join(grouped, "turn_id", "left").withColumn("frames", F.coalesce("frames", F.array().cast(grouped.schema["frames"].dataType)))
    over = F.col("diagnostic_code") != ""
    return out.select("turn_id", F.lit("native_turn_packet_v1").alias("packet_version"), "diagnostic_code", F.when(over, "LIMIT_EXCEEDED").otherwise("").alias("terminal_result"), (over | (F.size("frames") > 0)).alias("valid"), "n_tokens", "n_clauses", F.size("frames").alias("n_frames"), (F.size("frames") == 0).alias("abstained"), "frames")


def linked(spark: SparkSession, turns: DataFrame) -> dict[str, DataFrame]:
    """requests, ranked candidates, filtered codes and the status of each turn."""
    c = clauses(by_turn(turns))
    asked = link.requests(c, link.entries(spark), match.aliases(spark))
    ranked, lacking = link.proposals(asked, link.candidates(spark), match.actions(spark))
    return {"requests": link.numbered(asked), "ranked": ranked, "filtered": lacking, "status": link.link_status(asked, ranked)}
