"""Matching clauses against the registry: n-grams of words joined to surfaces, split particles, inflected verbs, and the
choice among the candidates. The registry is a broadcast side only up to BROADCAST_ROWS surfaces, which is checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import morphology as M
from turnwise.functions import text as X
from turnwise.operators import classify as C
from turnwise.operators.segment import words_of

BROADCAST_ROWS = 100_000


def actions(spark: SparkSession, rows=L.ACTIONS) -> DataFrame:
    return spark.createDataFrame(list(rows), "action string, target_mode string, family string")


def aliases(spark: SparkSession, rows=L.ALIASES) -> DataFrame:
    """surface, action, alias_ord (place of the surface among distinct ones)."""
    order = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in rows))}
    return spark.createDataFrame([(s, a, order[s]) for s, a in rows], "surface string, action string, alias_ord int")


def surfaces(registry: DataFrame) -> DataFrame:
    """One row a surface with its sorted actions."""
    return registry.groupBy("surface").agg(F.sort_array(F.collect_set("action")).alias("actions"), F.min("alias_ord").alias("alias_ord"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df as a broadcast side if it has no more than limit rows, else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ngrams(clauses: DataFrame, longest: int = 3) -> DataFrame:
    """turn_id, clause_no, first, end, n, surface: every run of up to longest words, as it stands in the clause."""
    rows = clauses.select("turn_id", "clause_no", F.lower("clause").alias("lower"), words_of(F.col("clause")).alias("w"))
    run = lambda n: F.transform(F.slice(F.col("w"), 1, F.greatest(F.size("w") - (n - 1), F.lit(0))), lambda w, i: F.struct(w["first"].alias("first"), F.get(F.col("w"), i + (n - 1))["end"].alias("end"), F.lit(n).alias("n"), i.alias("word_no")))
    found = rows.select("turn_id", "clause_no", "lower", F.explode(F.flatten(F.array(*(run(n) for n in range(1, longest + 1))))).alias("g"))
    return found.select("turn_id", "clause_no", "g.first", "g.end", "g.n", "g.word_no", F.substring("lower", F.col("g.first") + 1, F.col("g.end") - F.col("g.first")).alias("surface"))


def contiguous(clauses: DataFrame, registry: DataFrame) -> DataFrame:
    """Surfaces found whole in a clause."""
    return ngrams(clauses).join(small(surfaces(registry)), "surface").select("turn_id", "clause_no", "surface", "first", "end", "actions", "alias_ord", F.lit(-1).alias("particle_at"), F.lit(0).alias("particle_length"), F.lit("direct").alias("how"))


def separated(clauses: DataFrame, registry: DataFrame, gap: int = 4) -> DataFrame:
    """Two-word surfaces with one to gap words between verb and particle, no comma or "and" among them, and the particle
    at the end or before a sign or a closing word."""
    rows = clauses.select("turn_id", "clause_no", F.lower("clause").alias("lower"), words_of(F.col("clause")).alias("w"))
    heads = rows.select("turn_id", "clause_no", "lower", "w", F.posexplode("w").alias("i", "head"))
    near = F.filter(F.slice("w", F.col("i") + 3, gap), lambda p: p["word"].isin(*L.PARTICLES))
    pairs = heads.select("*", F.explode(near).alias("p")).withColumn("between", F.substring("lower", F.col("head.end") + 1, F.col("p.first") - F.col("head.end"))).withColumn("tail", F.substring("lower", F.col("p.end") + 1, F.length("lower")))
    pairs = pairs.where(~F.col("between").contains(",") & ~F.col("between").contains(" and ") & F.col("tail").rlike("^(?:[.,!?;]|$| (?:please|now|again|for|and|then|to)(?: |$|[.,!?]))"))
    pairs = pairs.withColumn("surface", F.concat_ws(" ", "head.word", "p.word"))
    return pairs.join(small(surfaces(registry)), "surface").select("turn_id", "clause_no", "surface", F.col("head.first").alias("first"), F.col("head.end").alias("end"), "actions", "alias_ord", F.col("p.first").alias("particle_at"), F.length("p.word").alias("particle_length"), F.lit("separated").alias("how"))


NARRATION = rf"^(?:(?:and|so|but|oh|well|yesterday|today|then),? )*(?:i|we)(?:'m|'re|'ve|'d|'ll| am| are| was| were| have| had)?(?: (?:just|already|also|now|then|still|quickly|finally))* ([{L.WORD_CLASS}]+)"


def narrated(clauses: DataFrame, registry: DataFrame, known: DataFrame) -> DataFrame:
    """What the speaker tells of himself: the verb right after I or we, by its lemma (or lemma with e), if its action is
    a deed and no thought or perception."""
    deeds = known.where(~F.col("family").isin("perception", "perceptioncognition", "metaactions", "information")).select("action")
    single = registry.where(~F.col("surface").contains(" ")).join(deeds, "action", "left_semi")
    rows = clauses.select("turn_id", "clause_no", F.lower("clause").alias("lower"))
    verb = rows.withColumn("verb", F.regexp_extract("lower", NARRATION, 1)).where("verb != ''")
    verb = verb.withColumn("end", F.length(F.regexp_extract("lower", NARRATION, 0))).withColumn("surface", F.explode(F.array_distinct(F.array(M.lemma(F.col("verb")), F.concat(M.lemma(F.col("verb")), F.lit("e")), "verb"))))
    return verb.join(small(surfaces(single)), "surface").select("turn_id", "clause_no", "surface", (F.col("end") - F.length("verb")).alias("first"), "end", "actions", "alias_ord", F.lit(-1).alias("particle_at"), F.lit(0).alias("particle_length"), F.lit("narration").alias("how"))


def gerunds(clauses: DataFrame, registry: DataFrame) -> DataFrame:
    """An -ing form that asks: at the head of its part of the clause, after "mind", or after how or what about."""
    single = registry.where(~F.col("surface").contains(" "))
    words = ngrams(clauses, 1).where(F.col("surface").endswith("ing")).withColumnRenamed("surface", "word")
    words = words.withColumn("surface", F.explode(F.array(M.lemma(F.col("word")), F.concat(M.lemma(F.col("word")), F.lit("e")))))
    found = words.join(small(surfaces(single)), "surface").join(clauses.select("turn_id", "clause_no", "clause"), ["turn_id", "clause_no"])
    lead = imperative_prefix(X.strip_edges(F.substring(F.lower("clause"), F.lit(1), F.col("first"))))
    found = found.where((lead == "") | lead.endswith("mind") | lead.isin("how about", "what about"))
    return found.select("turn_id", "clause_no", "surface", "first", "end", "actions", "alias_ord", F.lit(-1).alias("particle_at"), F.lit(0).alias("particle_length"), F.lit("gerund").alias("how"))


def inflected(clauses: DataFrame, registry: DataFrame) -> DataFrame:
    """One-word surfaces in any inflected form, by a join on all forms that a surface can take."""
    forms = registry.where(~F.col("surface").contains(" ")).select("surface", "alias_ord").distinct().select("surface", "alias_ord", F.explode(M.forms_of(F.col("surface"))).alias("form"))
    words = ngrams(clauses, 1).withColumnRenamed("surface", "word")
    irregular = words.withColumn("form", F.explode(F.array_distinct(F.array("word", M.lemma(F.col("word"))))))
    return irregular.join(small(forms), "form").where("word != surface").join(small(surfaces(registry).drop("alias_ord")), "surface").select("turn_id", "clause_no", "surface", "first", "end", "actions", "alias_ord", F.lit(-1).alias("particle_at"), F.lit(0).alias("particle_length"), F.lit("mention").alias("how")).distinct()


def not_determined(candidates: DataFrame, clauses: DataFrame) -> DataFrame:
    """Without candidates that a determiner stands before: there they are nouns."""
    prefix = F.substring(F.lower("clause"), F.lit(1), F.col("first"))
    joined = candidates.join(clauses.select("turn_id", "clause_no", "clause"), ["turn_id", "clause_no"])
    return joined.where(~prefix.rlike(f"(?:^|[^{L.LEXICAL_CLASS}])(?:{L.any_of(L.DETERMINERS[:-1])}) +$"))


def imperative_prefix(prefix: Column) -> Column:
    return X.without_discourse(X.local_prefix(prefix))


def bases_of(word: Column) -> Column:
    """Base forms that a word may be an inflection of by rule; the word itself is not one."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    single = lambda c: F.regexp_replace(c, r"(.)\1$", "$1")
    none = F.array().cast("array<string>")
    every = F.concat(
        F.array(M.lemma(word)),
        F.when(word.endswith("ed"), F.array(cut(2), single(cut(2)), cut(1))).otherwise(none),
        F.when(word.endswith("ing"), F.array(cut(3), single(cut(3)), F.concat(cut(3), F.lit("e")))).otherwise(none),
        F.when(word.endswith("s"), F.array(cut(1), cut(2))).otherwise(none),
        F.when(word.rlike("(?:ied|ies)$"), F.array(F.concat(cut(3), F.lit("y")))).otherwise(none),
    )
    return F.filter(F.array_distinct(every), lambda b: b != word)


def chosen(pieces: DataFrame, registry: DataFrame, known: DataFrame, longest: int = 3, gap: int = 4) -> DataFrame:
    """pieces (turn_id, clause_no, clause and more) with hit, the best candidate of each or null.

    All that could be a surface (runs of words, split particles, told and asked inflections, mentions) is laid out in the
    row and exploded once, joined once, and the best taken where the rows already are: the pieces must be partitioned by
    turn_id, then nothing is shuffled."""
    deeds = known.where(~F.col("family").isin("perception", "perceptioncognition", "metaactions", "information")).select("action").distinct().withColumn("deed", F.lit(True))
    table = registry.join(small(deeds), "action", "left").groupBy("surface").agg(F.sort_array(F.collect_set("action")).alias("actions"), F.min("alias_ord").alias("alias_ord"), F.sort_array(F.collect_set(F.when(F.col("deed"), F.col("action")))).alias("deeds"))
    d = X.once(pieces, low=F.lower("clause"), w=words_of(F.col("clause")))
    item = lambda surface, first, end, how, at=F.lit(-1), n=F.lit(0): F.struct(surface.alias("surface"), first.cast("int").alias("first"), end.cast("int").alias("end"), F.lit(how).alias("how"), at.cast("int").alias("particle_at"), n.cast("int").alias("particle_length"))
    low, w = F.col("low"), F.col("w")

    def run(n: int) -> Column:
        whole = lambda x, i: item(F.substring(low, x["first"] + 1, F.get(w, i + (n - 1))["end"] - x["first"]), x["first"], F.get(w, i + (n - 1))["end"], "direct")
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), whole)

    def apart(head: Column, i: Column) -> Column:
        near = F.filter(F.slice(w, i + 3, gap), lambda p: p["word"].isin(*L.PARTICLES))
        between = lambda p: F.substring(low, head["end"] + 1, p["first"] - head["end"])
        closed = lambda p: F.substring(low, p["end"] + 1, F.length(low)).rlike("^(?:[.,!?;]|$| (?:please|now|again|for|and|then|to)(?: |$|[.,!?]))")
        kept = F.filter(near, lambda p: ~between(p).contains(",") & ~between(p).contains(" and ") & closed(p))
        return F.transform(kept, lambda p: item(F.concat_ws(" ", head["word"], p["word"]), head["first"], head["end"], "separated", p["first"], F.length(p["word"])))

    told = F.regexp_extract(low, NARRATION, 1)
    d = X.once(d, told=told, told_end=F.length(F.regexp_extract(low, NARRATION, 0)))
    told_bases = F.array_distinct(F.array(M.lemma(F.col("told")), F.concat(M.lemma(F.col("told")), F.lit("e")), F.col("told")))
    narration = F.when(F.col("told") != "", F.transform(told_bases, lambda b: item(b, F.col("told_end") - F.length("told"), F.col("told_end"), "narration"))).otherwise(F.array())
    mention = F.flatten(F.transform(w, lambda x: F.transform(bases_of(x["word"]), lambda b: item(b, x["first"], x["end"], "mention"))))
    asked = F.flatten(F.transform(F.filter(w, lambda x: x["word"].endswith("ing")), lambda x: F.transform(F.array(M.lemma(x["word"]), F.concat(M.lemma(x["word"]), F.lit("e"))), lambda b: item(b, x["first"], x["end"], "gerund"))))
    d = d.withColumn("all", F.concat(*(run(n) for n in range(1, longest + 1)), F.flatten(F.transform(w, apart)), F.coalesce(narration.cast("array<struct<surface:string,first:int,end:int,how:string,particle_at:int,particle_length:int>>"), F.array()), asked, mention))
    d = d.drop("w", "told", "told_end").select("*", F.posexplode_outer("all").alias("c_no", "c")).drop("all")
    d = d.withColumn("surface", F.col("c.surface")).join(small(table), "surface", "left")
    # of what is no surface one row a piece is enough
    d = d.where(F.col("actions").isNotNull() | (F.coalesce("c_no", F.lit(0)) == 0))
    before = F.substring("low", F.lit(1), F.col("c.first"))
    d = X.once(d, prefix=X.strip_edges(before), noun=before.rlike(f"(?:^|[^{L.LEXICAL_CLASS}])(?:{L.any_of(L.DETERMINERS[:-1])}) +$"))
    d = X.once(d, lead=imperative_prefix(F.col("prefix")))
    how = F.col("c.how")
    single = ~F.col("surface").contains(" ")
    fits = F.when(how == "narration", single & (F.size("deeds") > 0)).when(how == "gerund", single & ((F.col("lead") == "") | F.col("lead").endswith("mind") | F.col("lead").isin("how about", "what about"))).when(how == "mention", single).otherwise(True)
    usable = F.col("actions").isNotNull() & fits & (~F.col("noun") | (how == "mention"))
    score = F.when(C.addressed_modal(X.tokenize(F.col("prefix"))), 10_000).otherwise(0) + F.when(X.has_any_word(F.col("prefix"), ["please"]), 1000).otherwise(0) + F.when(F.col("lead").isin("go", "come"), 500).otherwise(0)
    imperative = (F.size(X.tokenize(F.col("lead"))) <= 1) & how.isin("direct", "separated")
    acts = F.when(how == "narration", F.col("deeds")).otherwise(F.col("actions"))
    hit = F.struct("surface", F.col("c.first").alias("first"), F.col("c.end").alias("end"), acts.alias("actions"), F.col("c.particle_at").alias("particle_at"), F.col("c.particle_length").alias("particle_length"), how.alias("how"), "prefix", "lead")
    d = d.withColumn("hit", F.when(usable, hit)).withColumn("key", F.when(usable, F.struct(how != "mention", score, imperative, -F.col("c.first"), F.length("surface"), -F.col("alias_ord"))))
    rest = [c for c in pieces.columns if c not in ("turn_id", "clause_no")]
    return d.groupBy("turn_id", "clause_no").agg(*(F.first(c).alias(c) for c in rest), F.max_by("hit", "key").alias("hit"))


def ranked(candidates: DataFrame) -> DataFrame:
    """score, imperative and rank key of candidates that carry their clause: politeness and modals in front first, then
    a direct order, a whole or told action before a mention, the place from the left, the longer surface, the order
    of the registry."""
    prefix = X.strip_edges(F.substring(F.lower("clause"), F.lit(1), F.col("first")))
    out = candidates.withColumn("prefix", prefix).withColumn("lead", imperative_prefix(F.col("prefix")))
    score = F.when(C.addressed_modal(X.tokenize(F.col("prefix"))), 10_000).otherwise(0) + F.when(X.has_any_word(F.col("prefix"), ["please"]), 1000).otherwise(0) + F.when(F.col("lead").isin("go", "come"), 500).otherwise(0)
    out = out.withColumn("score", score).withColumn("imperative", (F.size(X.tokenize(F.col("lead"))) <= 1) & F.col("how").isin("direct", "separated"))
    return out.withColumn("key", F.struct(F.col("how") != "mention", "score", "imperative", -F.col("first"), F.length("surface"), -F.col("alias_ord")))
