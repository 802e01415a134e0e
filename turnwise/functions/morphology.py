"""Word forms as column expressions over literal maps of bounded size (the registry's lexicon)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L


def _map(values: dict) -> Column:
    """A literal map, as one SQL expression: building it call by call costs more than running it."""
    put = lambda v: str(v) if isinstance(v, int) else L.quoted(v)
    return F.expr("map(" + ", ".join(f"{put(k)}, {put(v)}" for k, v in values.items()) + ")")


def words(values) -> Column:
    """A literal array of words."""
    return F.expr("array(" + ", ".join(map(L.quoted, values)) + ")" if values else "cast(array() as array<string>)")


def lemma(c: Column, irregular: dict[str, str] = L.IRREGULAR) -> Column:
    """Irregular forms first, then the suffixes -ies, -ing (its doubled consonant undone), -ied, -ed, -s, in that order."""
    w = F.lower(c)
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    undoubled = F.regexp_replace(cut(3), r"(.)\1$", "$1")
    rule = (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ing") & (F.length(w) > 5), undoubled)
        .when(w.endswith("ied") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("ed") & (F.length(w) > 4), cut(2))
        .when(w.endswith("s") & ~w.rlike("(?:ss|us|is|ous|ics)$") & (F.length(w) > 3), cut(1))
        .otherwise(w)
    )
    return F.coalesce(F.element_at(_map(irregular), w), rule) if irregular else rule


def is_verb(c: Column, verbs=L.VERBS) -> Column:
    """A form of a verb: itself, its lemma, or of an inflected form the lemma with e. No lexicon: never."""
    if not verbs:
        return F.lit(False)
    base = lemma(c)
    return c.isin(*verbs) | base.isin(*verbs) | ((base != c) & F.concat(base, F.lit("e")).isin(*verbs))


def is_base_verb(c: Column, verbs=L.VERBS) -> Column:
    """A verb in its base form that is no modal or auxiliary."""
    return is_verb(c, verbs) & (lemma(c) == c) & ~c.isin(*L.MODALS, "be", "do", "have")


def verb_unit(tokens: Column, at: Column, verbs=L.VERBS) -> Column:
    """How many tokens from a place (0-based) on form one verb of the lexicon; 1 if a particle or preposition follows."""
    long = [v for v in verbs if "_" in v]
    token = lambda i: F.get(tokens, at + i)
    head = F.when(lemma(token(0)).isin(*verbs), lemma(token(0))).otherwise(token(0))
    best = F.lit(1)
    for n in (2, 3, 4):
        joined = F.concat_ws("_", head, F.slice(tokens, at + 2, n - 1))
        best = F.when((F.size(tokens) >= at + n) & joined.isin(*long), n).otherwise(best)
    return F.when(F.coalesce(token(1), F.lit("")).isin(*L.VERB_BLOCKERS), 1).otherwise(best)


def number_value(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int")), F.element_at(_map(L.NUMBERS), c), F.lit(0))


def forms_of(c: Column) -> Column:
    """All forms that a base word can take by rule: what a phrase's word may look like where it is inflected."""
    cut = F.substring(c, F.lit(1), F.length(c) - 1)
    last = F.substring(c, F.length(c), F.lit(1))
    put = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    regular = [c, *(put(c, s) for s in ("ed", "ing", "s", "es")), put(c, last, "ed"), put(c, last, "ing")]
    with_e = F.when(c.endswith("e"), F.array(put(c, "d"), put(cut, "ing"))).otherwise(F.array().cast("array<string>"))
    with_y = F.when(c.endswith("y") & (F.length(c) > 1), F.array(put(cut, "ied"), put(cut, "ies"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(*regular), with_e, with_y))
