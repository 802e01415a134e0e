"""Linking predicates to actions through a graph of surfaces: proposals with confidence, never anything executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import morphology as M
from turnwise.functions import text as X
from turnwise.operators import classify as C
from turnwise.operators import match
from turnwise.operators.segment import words_of

RELATIONS = ("EQUIVALENT", "SPECIALIZATION", "APPROXIMATE_EFFECT", "ENABLES", "ENTAILS", "CONFLICTS")
STATUSES = ("INVALID", "AMBIGUOUS", "CANDIDATES", "NOT_NEEDED", "NO_LINK")
#: Two candidates closer than this are ambiguous.
GAP = "0.20"
#: Characters between a verb and its particle, at most.
PARTICLE_WINDOW = 40

#: surface, lemma, particle
ENTRIES = (("carve", "carve", ""), ("paint", "paint", ""), ("get rid of", "get rid of", ""), ("carry", "carry", ""), ("mop up", "mop", "up"), ("bring", "bring", ""), ("cook", "cook", ""), ("hide", "hide", ""))
#: surface, action, relation, confidence, role compatibility
CANDIDATES = (
    ("carve", "break", "APPROXIMATE_EFFECT", "0.62", "0.90"), ("paint", "clean", "CONFLICTS", "0.35", "0.80"), ("get rid of", "destroy", "SPECIALIZATION", "0.70", "1.00"), ("get rid of", "drop", "APPROXIMATE_EFFECT", "0.60", "1.00"),
    ("carry", "pickup", "ENTAILS", "0.80", "1.00"), ("carry", "teleport", "ENABLES", "0.50", "0.70"), ("mop up", "clean", "EQUIVALENT", "0.95", "1.00"), ("bring", "give", "SPECIALIZATION", "0.75", "1.00"), ("bring", "pickup", "ENABLES", "0.45", "1.00"), ("cook", "boil", "SPECIALIZATION", "0.55", "1.00"),
)


def entries(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "surface string, lemma string, particle string, entry_ord int")


def candidates(spark: SparkSession, rows=CANDIDATES) -> DataFrame:
    made = spark.createDataFrame(list(rows), "surface string, action string, relation string, confidence string, role_compatibility string")
    return made.withColumns({c: F.col(c).cast("decimal(3,2)") for c in ("confidence", "role_compatibility")})


def phrase_words(c: Column) -> Column:
    """Words as the linking step sees them: an apostrophe bounds a word."""
    return X.tokenize(c, L.LINK_SIGNS, None)


def _apart(lower: Column, end: Column, particle: Column) -> Column:
    """The particle follows the word that ends there, near enough, with no comma or conjunction between."""
    rest = F.substring(lower, end + 1, F.length(lower))
    sought = F.concat(F.lit(" "), particle, F.lit(" "))
    gap = F.instr(F.concat(rest, F.lit(" ")), sought) - 1
    gap = F.when(gap >= 0, gap).otherwise(F.instr(F.regexp_replace(rest, r"[.!?]+$", " "), sought) - 1)
    between = F.substring(rest, F.lit(1), gap)
    return (gap >= 1) & (gap < PARTICLE_WINDOW) & ~between.contains(",") & ~X.has_any_word(between, ["and", "then", "but", "or"])


def found_entries(clauses: DataFrame, graph: DataFrame) -> DataFrame:
    """Where an entry stands in a clause: whole, with its particle apart, or by the lemma of a word."""
    grams = match.ngrams(clauses)
    whole = grams.join(match.small(graph), "surface").select("turn_id", "clause_no", "surface", "lemma", "particle", "entry_ord", "first", (F.col("first") + F.length("surface")).alias("end"))
    lower = clauses.select("turn_id", "clause_no", F.lower("clause").alias("lower"))
    split = graph.where("particle != ''").withColumn("head", F.expr("substring(surface, 1, length(surface) - length(particle) - 1)"))
    apart = match.ngrams(clauses, 1).withColumnRenamed("surface", "head").join(match.small(split), "head").join(lower, ["turn_id", "clause_no"])
    apart = apart.where(_apart(F.col("lower"), F.col("end"), F.col("particle")))
    apart = apart.select("turn_id", "clause_no", "surface", "lemma", "particle", "entry_ord", "first", (F.col("first") + F.length("surface")).alias("end"))
    words = match.ngrams(clauses, 1).withColumn("lemma", M.lemma(F.col("surface"))).drop("surface", "end")
    byword = words.join(match.small(graph), "lemma").select("turn_id", "clause_no", "surface", "lemma", "particle", "entry_ord", "first", (F.col("first") + F.length("surface")).alias("end"))
    return whole.unionByName(apart).unionByName(byword).distinct()


def without_overlap(hits: DataFrame, direct: DataFrame) -> DataFrame:
    """Hits that no registry surface of the clause overlaps: an anti-join on intervals within the clause."""
    d = direct.select("turn_id", "clause_no", F.col("first").alias("a"), F.col("end").alias("b"))
    return hits.join(d, (hits["turn_id"] == d["turn_id"]) & (hits["clause_no"] == d["clause_no"]) & (hits["first"] < d["b"]) & (d["a"] < hits["end"]), "left_anti")


def unit_at(hits: DataFrame, units: DataFrame) -> DataFrame:
    """The predicate unit whose [start, end) holds a hit's place."""
    u = units.select("turn_id", "clause_no", "unit_no", F.col("first").alias("unit_first"), F.col("end").alias("unit_end"))
    return hits.join(u, ["turn_id", "clause_no"]).where((F.col("first") >= F.col("unit_first")) & (F.col("first") < F.col("unit_end")))


def whole_at(lower: Column, words: Column) -> Column:
    """Place where a column's words first stand whole in lower-cased text; -1 if they do not or there are none."""
    return F.when(words != "", F.regexp_instr(lower, F.concat(F.lit(f"(?<![{L.WORD_CLASS}])\\Q"), words, F.lit(f"\\E(?![{L.WORD_CLASS}])"))) - 1).otherwise(-1)


def link_act(lower: Column, act: Column, place: Column, surface: Column) -> Column:
    """What a clause does for the linking step: a request stays one only if it opens like one, its predicate stands at the
    start, is the clause's own, or follows a name or an "and"; told futures are statements. place: of the predicate, -1
    if it is not found; surface: the clause's own predicate as it stands."""
    head, tail = F.regexp_extract(lower, "(?s)^(.*?)you will", 1), X.strip_edges(F.regexp_extract(lower, "(?s)^.*?you will(.*)$", 1))
    told = lower.contains("you will") & (F.arrays_overlap(X.tokenize(head), F.array(*map(F.lit, L.TEMPORAL))) | X.starts_any(tail, L.LIKELIHOOD))
    before = F.substring(lower, F.lit(1), F.greatest(place, F.lit(0)))
    stays = X.starts_any(lower, L.LINK_REQUESTS) | (place == 0) | ((place > 0) & ((whole_at(lower, F.lower(surface)) == place) | X.leading_vocative(before) | before.contains(" and ")))
    return F.when(act != "request", F.when(act.isin("question", "fragment"), act).otherwise("statement")).when(told, "statement").when(stays, "request").otherwise("statement")


def standing(clauses: DataFrame, graph: DataFrame, registry: DataFrame) -> DataFrame:
    """clauses with direct (the intervals of the registry's surfaces in them) and hits (the entries that stand in them, as
    found_entries has them). All words and runs are laid out in the row, joined once and put together where the rows are:
    partitioned by turn_id, which is unique, nothing is shuffled."""
    entry = F.struct("surface", "lemma", "particle", "entry_ord").alias("entry")
    head = F.expr("substring(surface, 1, length(surface) - length(particle) - 1)")
    row = lambda df, how, key, e=entry: df.select(F.lit(how == "lemma").alias("by_lemma"), F.lit(how).alias("how"), key.alias("key"), e)
    # an entry of a registry surface is null
    table = row(graph, "whole", F.col("surface")).unionByName(row(graph, "lemma", F.col("lemma"))).unionByName(row(graph.where("particle != ''"), "apart", head))
    table = table.unionByName(row(registry.select("surface").distinct(), "direct", F.col("surface"), F.lit(None).cast(table.schema["entry"].dataType).alias("entry")))
    d = X.once(clauses, low=F.lower("clause"), w=words_of(F.col("clause")))
    w = F.col("w")
    run = lambda n: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.struct(x["first"].alias("first"), F.get(w, i + (n - 1))["end"].alias("end"), F.lit(n).alias("n")))
    lone = F.transform(w, lambda x: F.struct(x["first"].alias("first"), x["end"].alias("end"), F.lit(0).alias("n")))  # by its lemma
    d = d.select(*clauses.columns, "low", F.posexplode_outer(F.concat(lone, *map(run, (1, 2, 3)))).alias("g_no", "g"))
    word = F.substring("low", F.col("g.first") + 1, F.col("g.end") - F.col("g.first"))
    by_lemma = F.coalesce(F.col("g.n") == 0, F.lit(False))
    d = d.withColumn("by_lemma", by_lemma).withColumn("key", F.when(by_lemma, M.lemma(word)).otherwise(word)).join(match.small(table), ["by_lemma", "key"], "left")
    # of what is no surface one row a clause is enough
    d = d.where(F.col("how").isNotNull() | (F.coalesce("g_no", F.lit(0)) == 0))
    apart = (F.col("g.n") == 1) & _apart(F.col("low"), F.col("g.end"), F.col("entry.particle"))
    stands = F.col("entry").isNotNull() & ((F.col("how") != "apart") | F.coalesce(apart, F.lit(False)))
    first = F.col("g.first")
    hit = F.struct(first.alias("first"), (first + F.length("entry.surface")).alias("end"), F.col("entry.surface").alias("surface"), F.col("entry.lemma").alias("lemma"), F.col("entry.particle").alias("particle"), F.col("entry.entry_ord").alias("entry_ord"))
    rest = [c for c in clauses.columns if c not in ("turn_id", "clause_no")]
    return d.groupBy("turn_id", "clause_no").agg(*(F.first(c).alias(c) for c in rest), F.collect_list(F.when(F.col("how") == "direct", F.struct(first.alias("first"), F.col("g.end").alias("end")))).alias("direct"), F.collect_list(F.when(stands, hit)).alias("hits"))


def requests(clauses: DataFrame, graph: DataFrame, registry: DataFrame) -> DataFrame:
    """One row a clause: the longest entry at its predicate, or its unknown verb; act and what keeps it from being done.
    clauses: those of by_turn(turns), so that no task gets more turns than its share."""
    c = C.with_roles(C.prepared(standing(clauses, graph, registry)).withColumn("speech_act", C.speech_act())).withColumnRenamed("speech_act", "act")
    # the place of the predicate: that of its word's first whole standing
    word = C.at(F.col("tokens"), F.col("predicate"))
    c = X.once(c, low=F.lower("clause"), predicate_at=F.when(F.col("predicate") >= 0, whole_at(F.lower("clause"), word)).otherwise(-1), act=F.col("act"), predicate_lemma=F.col("predicate_lemma"), predicate_surface=F.col("predicate_surface"), object=F.col("object"))
    free = lambda h: ~F.exists("direct", lambda d: (h["first"] < d["end"]) & (d["first"] < h["end"]))
    own = F.filter("hits", lambda h: (h["first"] == F.col("predicate_at")) & free(h))
    best = F.array_max(F.transform(own, lambda h: F.struct(F.length(h["surface"]).alias("n"), (-h["entry_ord"]).alias("ord"), h["surface"].alias("surface"), h["lemma"].alias("lemma"), h["particle"].alias("particle"))))
    c = X.once(c, e=best)
    lower = F.col("low")
    known = F.col("e").isNotNull()
    place = F.when(known, F.col("predicate_at")).otherwise(whole_at(lower, F.col("predicate_lemma")))
    c = X.once(c, place=place)
    act = link_act(X.strip_edges(lower), F.col("act"), F.col("place"), F.col("predicate_surface"))
    negated = C.negated(F.col("tokens")) | X.starts_any(lower, ("do not ", "don't ", "never "))
    return c.select(
        "turn_id", "clause_no", "clause", "start_index", "end_index", known.alias("known"), (F.size("direct") > 0).alias("direct"), F.coalesce("e.surface", "predicate_lemma").alias("surface"), F.coalesce("e.lemma", "predicate_lemma").alias("lemma"), F.coalesce("e.particle", F.lit("")).alias("particle"),
        act.alias("speech_act"), F.col("act").alias("clause_act"), negated.alias("negated"), (known & X.is_quoted(F.col("clause"), F.col("predicate_at"))).alias("quoted"), X.is_reported(F.col("clause")).alias("reported"), "predicate_at", "object",
    )


def proposals(asked: DataFrame, graph: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranked candidates of requests that may be acted on, candidates left out because the registry lacks the action)."""
    able = asked.where("known and speech_act = 'request' and not negated and not quoted and not reported").select("turn_id", "clause_no", "surface")
    offered = able.join(match.small(graph), "surface")
    names = known.select("action")
    kept = offered.join(match.small(names), "action", "left_semi")
    lacking = offered.join(match.small(names), "action", "left_anti").select("turn_id", "clause_no", F.concat(F.lit("SBA_CAPABILITY_FILTERED:"), F.col("action")).alias("code"))
    order = Window.partitionBy("turn_id", "clause_no").orderBy(F.desc("confidence"), "action")
    return kept.withColumn("rank", F.row_number().over(order)), lacking


def ambiguous(ranked: DataFrame, gap: str = GAP) -> DataFrame:
    """turn_id, clause_no, ambiguous: the second candidate is closer than gap to the first."""
    order = Window.partitionBy("turn_id", "clause_no").orderBy("rank")
    return ranked.withColumn("next", F.lead("confidence").over(order)).where("rank = 1").select("turn_id", "clause_no", F.coalesce(F.col("confidence") - F.col("next") < F.lit(gap).cast("decimal(3,2)"), F.lit(False)).alias("ambiguous"))


def link_status(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """turn_id, status: ambiguous before candidates before not needed before no link."""
    a = ambiguous(ranked)
    joined = asked.select("turn_id", "clause_no", "direct").join(a, ["turn_id", "clause_no"], "left")
    return joined.groupBy("turn_id").agg(F.when(F.bool_or(F.coalesce("ambiguous", F.lit(False))), "AMBIGUOUS").when(F.bool_or(F.col("ambiguous").isNotNull()), "CANDIDATES").when(F.bool_or("direct"), "NOT_NEEDED").otherwise("NO_LINK").alias("status"))


def numbered(asked: DataFrame) -> DataFrame:
    """request_id by place, then by clause."""
    order = Window.partitionBy("turn_id").orderBy(F.col("start_index") + F.greatest("predicate_at", F.lit(0)), "clause_no")
    return asked.withColumn("request_id", F.format_string("literal_%03d", F.row_number().over(order)))
