"""Offline lexicon work over synsets as node and edge tables: closures, paths, generalization, categories, lexicons.

words: offset, word, word_ord, sense_rank (place of the synset among the word's senses, from 0), observed (senses of the
word that were seen in use). edges: source, relation, target. All steps are joins; depths are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sense_in_use(rank: Column, observed: Column) -> Column:
    """The first sense, or any if fewer than two were seen, or one of those seen."""
    return (rank == 0) | (observed < 2) | (rank < observed)


def closure(roots: DataFrame, edges: DataFrame, stops: DataFrame, depth: int = 20) -> DataFrame:
    """(root, node, depth) of all nodes below each root; a stop prunes its branch. roots: root, node; stops: root, node."""
    out = now = roots.select("root", "node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        below = now.join(edges.select(F.col("source").alias("node"), "target"), "node").select("root", F.col("target").alias("node")).distinct()
        now = below.join(stops, ["root", "node"], "left_anti").join(out, ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        out = out.unionByName(now)
    return out


def closure_sql(depth: int = 20) -> str:
    """The same as one recursive query over views roots, edges and stops."""
    return f"""
    WITH RECURSIVE below(root, node, depth) AS (
      SELECT root, node, 0 FROM roots
      UNION ALL
      SELECT b.root, e.target, b.depth + 1 FROM below b JOIN edges e ON e.source = b.node
      WHERE b.depth < {depth} AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.root = b.root AND s.node = e.target)
    ) SELECT root, node, min(depth) AS depth FROM below GROUP BY root, node"""


def short_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, path): the least path of one or two edges, in either direction ("^" marks reverse), "override-only" if there
    is none and "" for a node and itself."""
    both = edges.select("source", F.col("relation").alias("sign"), "target").unionByName(edges.select(F.col("target").alias("source"), F.concat(F.lit("^"), F.col("relation")).alias("sign"), F.col("source").alias("target")))
    one = pairs.join(both, (F.col("a") == F.col("source")) & (F.col("b") == F.col("target"))).select("a", "b", F.struct(F.lit(1).alias("d"), F.col("sign").alias("s1"), F.col("b").alias("n1"), F.lit("").alias("s2")).alias("p"))
    first = both.select(F.col("source").alias("a"), F.col("sign").alias("s1"), F.col("target").alias("n1"))
    second = both.select(F.col("source").alias("n1"), F.col("sign").alias("s2"), F.col("target").alias("b"))
    two = pairs.join(first, "a").join(second, ["n1", "b"]).select("a", "b", F.struct(F.lit(2).alias("d"), "s1", "n1", "s2").alias("p"))
    best = one.unionByName(two).groupBy("a", "b").agg(F.min("p").alias("p"))
    told = F.when(F.col("a") == F.col("b"), "").when(F.col("p").isNull(), "override-only").when(F.col("p.d") == 1, F.concat(F.col("p.s1"), F.lit(":"), F.col("b"))).otherwise(F.concat("p.s1", F.lit(":"), "p.n1", F.lit(","), "p.s2", F.lit(":"), "b"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", told.alias("path"))


def generated(anchors: DataFrame, words: DataFrame) -> DataFrame:
    """(surface, action, confidence) of the synonyms of each action's synset that are in use there."""
    return anchors.join(words, "offset").where(sense_in_use(F.col("sense_rank"), F.col("observed"))).select(F.translate("word", "_", " ").alias("surface"), "action", F.lit("0.90").cast("decimal(3,2)").alias("confidence")).distinct()


def generalized(anchors: DataFrame, words: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(surface, action, depth, confidence) of the narrower verbs below each action, first senses only, least depth."""
    roots = anchors.select(F.col("action").alias("root"), F.col("offset").alias("node"))
    none = roots.where("false")
    reach = closure(roots, edges, none, depth).where("depth > 0")
    firsts = words.where("sense_rank = 0").select(F.col("offset").alias("node"), F.translate("word", "_", " ").alias("surface"))
    near = reach.join(firsts, "node").groupBy("surface", F.col("root").alias("action")).agg(F.min("depth").alias("depth"))
    return near.withColumn("confidence", (F.lit("0.80").cast("decimal(3,2)") - F.lit("0.15").cast("decimal(3,2)") * (F.col("depth") - 1)).cast("decimal(3,2)"))


def merged(hand: DataFrame, made: DataFrame) -> DataFrame:
    """Hand rows (mode promote or forbid) first; made rows whose pair no hand row names, the first for each pair; forbidden
    pairs are left out. made: surface, action, confidence, ord."""
    order = Window.partitionBy("surface", "action").orderBy("ord")
    own = made.join(hand.select("surface", "action"), ["surface", "action"], "left_anti").withColumn("n", F.row_number().over(order)).where("n = 1").select("surface", "action", "confidence", F.lit("generated").alias("origin"))
    return hand.where("mode != 'forbid'").select("surface", "action", "confidence", F.lit("hand").alias("origin")).unionByName(own)


def grouped(rows: DataFrame) -> DataFrame:
    """(surface, n, candidates): a surface's candidates from the surest down."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "action")))
    return rows.groupBy("surface").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["action"]), ",").alias("candidates"))


def is_name(word: Column) -> Column:
    """A common noun's name: no capital (but for a letter and hyphen, "X-ray"), parenthesis or digit."""
    return ~word.rlike(r"[0-9()]") & (~word.rlike("[A-Z]") | word.rlike("^[A-Z]-[a-z]+$"))


SIZES = ("tiny", "small", "medium", "large", "huge")


def categories(named: DataFrame, senses: int = 3) -> DataFrame:
    """(noun, categories) in order of sense, deeper first, then by name; of size classes only the first stays. named: noun,
    sense_rank, depth, category, of the first senses concrete senses."""
    ranks = Window.partitionBy("noun").orderBy("sense_rank")
    kept = named.withColumn("r", F.dense_rank().over(ranks)).where(F.col("r") <= senses)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", (-F.col("depth")).alias("d"), "category"))), lambda x: x["category"])
    step = lambda out, c: F.when(c.isin(*SIZES) & (F.size(F.filter(out, lambda o: o.isin(*SIZES))) > 0), out).otherwise(F.array_union(out, F.array(c)))
    return kept.groupBy("noun").agg(listed.alias("all")).select("noun", F.array_join(F.aggregate("all", F.array().cast("array<string>"), step), ",").alias("categories"))


STOPWORDS = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "used", "with", "which")


def keywords(gloss: Column, name: Column, around: Column, limit: int = 30) -> Column:
    """Words of the gloss that are no stop words and not the name's, then those of the neighbours, once each."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    own = words(name)
    every = F.concat(words(gloss), F.flatten(F.transform(around, words)))
    return F.slice(F.array_distinct(F.filter(every, lambda w: ~w.isin(*STOPWORDS) & ~F.array_contains(own, w))), 1, limit)


def phrasal(lemmas: DataFrame, tails) -> DataFrame:
    """(lemma, head, tail) of two-part lemmas whose head is a lemma and whose tail is one of tails."""
    parts = F.split("lemma", "_")
    two = lemmas.where(F.size(parts) == 2).select("lemma", F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("tail")).where(F.col("tail").isin(*tails))
    return two.join(lemmas.select(F.col("lemma").alias("head")), "head", "left_semi").select("lemma", "head", "tail")


def first_bases(exceptions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(form, base): the first base of each irregular form by line, of known bases, leaving out forms that are lemmas or of
    several parts. exceptions: line, form, base."""
    order = Window.partitionBy("form").orderBy("line")
    usable = exceptions.where(~F.col("form").rlike("[_-]")).join(lemmas.select(F.col("lemma").alias("form")), "form", "left_anti").join(lemmas.select(F.col("lemma").alias("base")), "base", "left_semi")
    return usable.withColumn("n", F.row_number().over(order)).where("n = 1").select("form", "base")


def coverage(tags: DataFrame, catalogue: DataFrame, top: int) -> DataFrame:
    """(nouns, covered, share) of the most tagged nouns. tags: noun, count; catalogue: noun."""
    best = tags.groupBy("noun").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "noun").limit(top)
    known = best.join(catalogue.select("noun").distinct().withColumn("known", F.lit(1)), "noun", "left")
    return known.agg(F.count("*").alias("nouns"), F.count("known").alias("covered"), F.round(F.count("known") / F.count("*"), 6).alias("share"))
