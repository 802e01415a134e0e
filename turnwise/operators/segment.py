"""Segmentation: turns to clauses, clauses to tokens, predicate units, words with places. All of it stays in the row's
arrays (a turn is bounded), so nothing is shuffled; explode() where rows are wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import text as X

_WORD = f"[{L.WORD_CLASS}]"
_RUN = f"[{L.WORD_CLASS}.]"
#: A full stop that ends no sentence, and the space behind it: after a single letter, a title, or a run with another stop
#: in it, or alone. No part of the pattern is tried twice on the same signs, so it takes time in proportion to the text.
NO_END = rf"(?<!{_RUN})({_WORD}?\.|(?i:{L.any_of(L.TITLES)})\.|{_WORD}*+\.{_RUN}++(?<=\.)) "
#: (pattern, replacement) in order; "|" marks a boundary, \x02 stands for a space that ends no sentence.
BOUNDARIES = (
    (r"\? ", "?| "),
    ("! ", "!| "),
    ("\n", "| "),
    (NO_END, "$1\x02"),
    (r"\. ", ".| "),
    ("\x02", " "),
    (rf"(?i)(?:, and|,| and) (?:{L.any_of(L.SEQUENCE)}) | then |;", "| "),
    ("(?i) and (create|make|are you|do you) ", "| $1 "),
    (f", ({L.any_of(L.TAIL_QUESTIONS)}) ", "| $1 "),
)


def marked(c: Column) -> Column:
    c = X.strip_edges(c)
    for pattern, put in BOUNDARIES:
        c = F.regexp_replace(c, pattern, put)
    return c


def pieces_of(c: Column, limit: int = L.MAX_FRAMES + 1) -> Column:
    """The pieces between marks without edges, trailing comma and empty ones; one more than a turn may have at most."""
    parts = F.transform(F.split(c, r"\|"), lambda p: F.regexp_replace(X.strip_edges(p), ",$", ""))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


def split_clauses(c: Column) -> Column:
    """Sentences, sequence markers and tail questions begin a new clause."""
    return pieces_of(marked(c))


def places_of(text: Column, clauses: Column, lower: Column | None = None) -> Column:
    """array<struct<text, start_index, end_index>>: each clause's place, looked for after the one before."""
    lower = F.lower(text) if lower is None else lower

    def step(state: Column, clause: Column) -> Column:
        at = F.position(F.lower(clause), lower, state["at"] + 1)
        start = F.when(at > 0, at - 1).otherwise(F.instr(lower, F.lower(clause)) - 1)
        found = start >= 0
        a = F.when(found, start).otherwise(0)
        b = F.when(found, start + F.length(clause)).otherwise(F.length(text))
        item = F.struct(clause.alias("text"), a.cast("int").alias("start_index"), b.cast("int").alias("end_index"))
        return F.struct(F.when(found, b).otherwise(state["at"]).cast("int").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    empty = F.array().cast("array<struct<text:string,start_index:int,end_index:int>>")
    return F.aggregate(clauses, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def clauses(turns: DataFrame, *keep: str) -> DataFrame:
    """turn_id, clause_no (from 1), clause, start_index, end_index, and the kept columns of turns."""
    found = X.once(turns, normalized=X.normalize(F.col("text")))
    found = X.once(found, parts=split_clauses(F.col("normalized")), lower=F.lower("normalized"))
    found = found.withColumn("places", places_of(F.col("normalized"), F.col("parts"), F.col("lower")))
    return found.select("turn_id", *keep, F.posexplode("places").alias("i", "c")).select("turn_id", *keep, (F.col("i") + 1).alias("clause_no"), F.col("c.text").alias("clause"), "c.start_index", "c.end_index")


def words_of(c: Column) -> Column:
    """array<struct<word, first, end>>: runs of lexical characters of the lower-cased text, with places."""
    runs = lambda k: F.regexp_extract_all(F.lower(c), F.lit(f"([^{L.LEXICAL_CLASS}]*)([{L.LEXICAL_CLASS}]+)"), F.lit(k))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + F.length(x["gap"])
        end = first + F.length(x["word"])
        item = F.struct(x["word"].alias("word"), first.cast("int").alias("first"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    empty = F.array().cast("array<struct<word:string,first:int,end:int>>")
    zipped = F.arrays_zip(runs(1).alias("gap"), runs(2).alias("word"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])


def units_of(clause: Column) -> Column:
    """Predicate units: the clause cut at " and "."""
    return F.filter(F.transform(F.split(clause, "(?i) and "), X.strip_edges), lambda u: u != "")


def split_coordination(c: Column, surfaces) -> Column:
    """Clauses cut where a coordinated part is an action of its own: after " and " or a comma an action's surface opens
    (after a comma only with an object, a particle or nothing behind it); a verb is repeated before a coordinated noun
    phrase, and an object behind a verb that has none."""
    alias, det = L.any_of(surfaces), L.any_of(L.DETERMINERS)
    follows = L.any_of((*L.DETERMINERS, "it", "them", "me", "us", "him", "her", *L.PARTICLES))
    edge = f"(?![{L.LEXICAL_CLASS}])"
    cut = F.regexp_replace(c, f"(?i)(?:,? and )(?=(?:please )?(?:{alias}){edge})", "|")
    cut = F.regexp_replace(cut, f"(?i), (?=(?:please )?(?:{alias})(?: (?:{follows}){edge}|[.!?]*(?:$|\\|)))", "|")
    cut = F.regexp_replace(cut, f"(?i)^((?:please )?(?:{alias})) ((?:{det}) [^|]*?) and ((?:{det}) [^|]*)$", "$1 $2|$1 $3")
    bare = f"(?i)^(?:please )?(?:{alias})$"

    def shared(parts: Column) -> Column:
        behind = lambda p, i: F.when(p.rlike(bare) & F.get(parts, i + 1).rlike(f"(?i)^(?:{alias}) "), F.concat(p, F.lit(" "), F.regexp_replace(F.get(parts, i + 1), f"(?i)^(?:{alias}) ", ""))).otherwise(p)
        return F.transform(parts, behind)

    out = F.filter(F.transform(X.let(F.split(cut, r"\|"), shared), X.strip_edges), lambda p: p != "")
    return F.filter(out, lambda p: ~p.rlike(f"(?i)^(?:{L.any_of(('and', 'then', 'so', 'but'))}),?$"))
