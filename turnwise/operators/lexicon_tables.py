"""Word forms by lexicons that are tables: joins, so that neither plan nor memory grows with the lexicon. A lexicon is passed
with each call and replaces the one before as a whole; nothing is kept from call to call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import morphology as M
from turnwise.operators.match import small


def lemmas(words: DataFrame, forms: DataFrame, column: str = "w") -> DataFrame:
    """words with lemma: that of the irregular form (forms: form, lemma; the least lemma of a form listed twice), else by
    rule. A null word has a null lemma."""
    irregular = forms.groupBy(F.lower("form").alias("__form")).agg(F.min("lemma").alias("__lemma"))
    joined = words.join(small(irregular), F.lower(column) == F.col("__form"), "left")
    return joined.withColumn("lemma", F.coalesce("__lemma", M.lemma(F.col(column), {}))).drop("__form", "__lemma")


def verbs(words: DataFrame, lexicon: DataFrame, forms: DataFrame, column: str = "w") -> DataFrame:
    """Distinct words with lemma and verb: the word itself, its lemma, or an inflected form's lemma with e is in the lexicon
    (lexicon: lemma). A null word is no verb; an empty lexicon has none."""
    known = lexicon.select(F.col("lemma").alias("__verb")).distinct()
    base = lemmas(words.select(column).distinct(), forms, column)
    tries = F.array_distinct(F.array(F.col(column), F.col("lemma"), F.when(F.col("lemma") != F.col(column), F.concat("lemma", F.lit("e"))).otherwise(F.col(column))))
    hits = base.select(column, F.explode(tries).alias("__verb")).join(small(known), "__verb", "left_semi").select(F.col(column).alias("__hit")).distinct()
    return base.join(hits, F.col(column) == F.col("__hit"), "left").withColumn("verb", F.col("__hit").isNotNull()).drop("__hit")
