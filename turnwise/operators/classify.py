"""Clause features as column expressions over tokens, lemmas and the clause's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import morphology as M
from turnwise.functions import text as X


def at(tokens: Column, i) -> Column:
    return F.coalesce(F.get(tokens, i if isinstance(i, Column) else F.lit(i)), F.lit(""))


def first_index(tokens: Column, test) -> Column:
    """Place of the first token for which test(token, place) holds; -1 if none."""
    hits = F.filter(F.transform(tokens, lambda t, i: F.when(test(t, i), i).otherwise(-1)), lambda i: i >= 0)
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def inverted_modal(tokens: Column, initial: bool = False) -> Column:
    """Place after the first modal that a second person follows ("can you"); at the start only if initial."""
    pair = lambda t, i: t.isin(*L.MODALS) & at(tokens, i + 1).isin(*L.SECOND_PERSON)
    if initial:
        return F.when(at(tokens, 0).isin(*L.MODALS) & at(tokens, 1).isin(*L.SECOND_PERSON), 2).otherwise(-1)
    found = first_index(tokens, pair)
    return F.when(found >= 0, found + 2).otherwise(-1)


def addressed_modal(tokens: Column) -> Column:
    """A modal next to a second person, in either order."""
    return first_index(tokens, lambda t, i: (t.isin(*L.MODALS) & at(tokens, i + 1).isin(*L.SECOND_PERSON)) | (t.isin(*L.SECOND_PERSON) & at(tokens, i + 1).isin(*L.MODALS))) >= 0


def negates(t: Column, following: Column) -> Column:
    """not, never, and ...n't unless the second person follows ("don't you")."""
    return t.isin("not", "never") | (t.endswith("n't") & ~following.isin(*L.SECOND_PERSON))


def negated(tokens: Column) -> Column:
    return first_index(tokens, lambda t, i: negates(t, at(tokens, i + 1))) >= 0


def condition_kind(tokens: Column) -> Column:
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return F.when(has(L.CONDITIONS), "explicit").when(has(("would", "could")), "modal").otherwise("")


def modal(tokens: Column) -> Column:
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.isin(*L.MODALS, "ought")), F.lit(0)), F.lit(""))


def references(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(*L.REFERENCES)))


LEADS = rf"^(?:(?:{L.any_of(L.RETRACT_LEADS)}|[,-])(?![{L.WORD_CLASS}])[\x00-\x20]*)+"


def is_retraction(clause: Column) -> Column:
    """Leading interjections aside, the clause takes back what was said."""
    rest = F.regexp_replace(X.strip_edges(F.lower(clause)), LEADS, "")
    return rest.rlike(f"^(?:{L.any_of(L.RETRACTIONS)})")


SKIPPED = rf"^(?:[^\s,]+,\s*|(?:and|but|so|or|{L.any_of(L.DISCOURSE)}) +)+"


def head_tokens(lower: Column, tokens: Column) -> Column:
    """Tokens from the first one that is no vocative, conjunction or discourse marker; the last token at least."""
    rest = X.tokenize(F.regexp_replace(lower, SKIPPED, ""))
    return F.when(F.size(rest) > 0, rest).otherwise(F.slice(tokens, -1, 1))


def prepared(clauses, verbs=L.VERBS):
    """clauses with what the rules below look at, each as a column of its own: lower, tokens, lemmas, is_verb (an entry a
    token), head (tokens from the first that counts), head_lemmas, head_verbs, plain (place of the first token that is no
    discourse marker)."""
    c = X.once(clauses, lower=X.strip_edges(F.lower("clause")), tokens=X.tokenize(F.col("clause")))
    c = X.once(c, head=head_tokens(F.col("lower"), F.col("tokens")))
    c = X.once(c, lemmas=F.transform("tokens", lambda t: M.lemma(t)), head_lemmas=F.transform("head", lambda t: M.lemma(t)))
    known = M.words(verbs)
    flags = lambda tokens, lemmas: F.transform(F.arrays_zip(F.col(tokens).alias("t"), F.col(lemmas).alias("l")), lambda x: F.array_contains(known, x["t"]) | F.array_contains(known, x["l"]) | ((x["l"] != x["t"]) & F.array_contains(known, F.concat(x["l"], F.lit("e")))))
    return X.once(c, is_verb=flags("tokens", "lemmas"), head_verbs=flags("head", "head_lemmas"), plain=first_index(F.col("tokens"), lambda t, i: ~t.isin(*L.DISCOURSE)))


def _flag(flags: str, i) -> Column:
    return F.coalesce(F.get(F.col(flags), i if isinstance(i, Column) else F.lit(i)), F.lit(False))


def _base(tokens: str, lemmas: str, flags: str, i) -> Column:
    """The token at a place is a verb's base form and no modal or auxiliary."""
    t = at(F.col(tokens), i)
    return _flag(flags, i) & (t == at(F.col(lemmas), i)) & ~t.isin(*L.MODALS, "be", "do", "have")


OBJECTS = (*L.DETERMINERS, "it", "them", "me", "us", "him")


def speech_act(verbs=L.VERBS) -> Column:
    """fragment, statement, request or question of a prepared clause; the first rule that holds decides."""
    tokens, lower, head = F.col("tokens"), F.col("lower"), F.col("head")
    permission = at(tokens, 0).isin("can", "could", "may") & at(tokens, 1).isin("i", "we") & _flag("is_verb", 2)
    asked = at(tokens, 0).isin(*L.AUXILIARIES) & at(tokens, 1).isin(*L.SUBJECTS, "u")
    turned = at(tokens, 0).isin(*L.MODALS) & at(tokens, 1).isin(*L.SECOND_PERSON)
    imperative = (F.col("plain") >= 0) & _base("tokens", "lemmas", "is_verb", F.col("plain"))
    subject = F.regexp_extract(at(head, 0), "^([^']*)", 1)
    declarative = subject.isin(*L.DECLARATIVE)
    later = F.exists(F.sequence(F.lit(2), F.greatest(F.size(head) - 1, F.lit(2))), lambda i: _flag("head_verbs", i) & ~at(head, i - 1).isin(*OBJECTS))
    unknown = at(head, 1).isin(*OBJECTS) & ~declarative & ~later
    adverb = _base("head", "head_lemmas", "head_verbs", 1) & ~declarative & ~at(head, 0).contains("'")
    return (
        F.when(F.size(tokens) == 0, "fragment")
        .when(lower.startswith("*"), "statement")
        .when(permission, "request")
        .when(lower.endswith("?") & ~turned & ~imperative, "question")
        .when(asked, "question")
        .when(turned | X.starts_any(lower, L.REQUEST_OPENERS), "request")
        .when(subject.isin(*L.WH_WORDS), "question")
        .when(F.lit(bool(verbs)) & ~_flag("head_verbs", 0), F.when(unknown | adverb, "request").otherwise("statement"))
        .when(~declarative & (at(head, 0) == at(F.col("head_lemmas"), 0)), "request")
        .otherwise("statement")
    )


def with_predicate(c, act: str = "speech_act"):
    """c with predicate: the place of the clause's verb, the first that is no noun, marker or auxiliary of a later verb; in
    a request without one, the word in front of its object; -1 if there is none."""
    tokens, lower = F.col("tokens"), F.col("lower")
    begin = (
        F.when(at(tokens, 0).isin(*L.MODALS) & at(tokens, 1).isin(*L.SECOND_PERSON), 2)
        .when(at(tokens, 0).isin("can", "could", "may") & at(tokens, 1).isin("i", "we"), 2)
        .when(lower.startswith("please "), 1)
        .when(X.starts_any(lower, [o for o in L.REQUEST_OPENERS if o.endswith(" to ")]), F.array_position("tokens", "to").cast("int"))
        .when(lower.startswith("go ahead and "), 3)
        .otherwise(0)
    )
    c = X.once(c, begin=begin)
    determined = lambda i: at(tokens, i).isin(*L.DETERMINERS)
    helper = lambda i: at(tokens, i).isin(*L.MODALS) | at(tokens, i).endswith("n't") | at(F.col("lemmas"), i).isin("be", "do", "have")

    def governs(i: Column) -> Column:
        """A verb stands among the next three tokens before any determiner."""
        out = F.lit(False)
        for k in (3, 2, 1):
            out = F.when(determined(i + k), False).when(_flag("is_verb", i + k), True).otherwise(out)
        return out

    verb = first_index(tokens, lambda t, i: (i >= F.col("begin")) & _flag("is_verb", i) & ~((i > 0) & determined(i - 1)) & ~t.isin(*L.DISCOURSE) & ~(helper(i) & governs(i)))
    c = X.once(c, verb_at=verb, open_at=first_index(tokens, lambda t, i: (i >= F.col("begin")) & ~t.isin(*L.DISCOURSE)))
    word = at(tokens, F.col("open_at"))
    closed = word.isin(*L.DETERMINERS, *L.SUBJECTS, "u", "not", "never", *L.WH_WORDS, "there", "here", "let's") | word.contains("'")
    unknown = (F.col(act) == "request") & (F.col("open_at") >= 0) & ~closed & at(tokens, F.col("open_at") + 1).isin(*OBJECTS, "her")
    return X.once(c, predicate=F.when(F.col("verb_at") >= 0, F.col("verb_at")).when(unknown, F.col("open_at")).otherwise(-1)).drop("begin", "verb_at", "open_at")


def with_unit(c, verbs=L.VERBS):
    """c with unit: how many tokens from the predicate on form one verb."""
    tokens, p = F.col("tokens"), F.col("predicate")
    long = [v for v in verbs if "_" in v]
    head = F.when(at(F.col("lemmas"), p).isin(*verbs), at(F.col("lemmas"), p)).otherwise(at(tokens, p))
    c = X.once(c, unit_head=head)
    best = F.lit(1)
    for n in (2, 3, 4):
        joined = F.concat_ws("_", "unit_head", F.slice(tokens, F.greatest(p, F.lit(0)) + 2, n - 1))
        best = F.when((F.size(tokens) >= p + n) & joined.isin(*long), n).otherwise(best)
    return X.once(c, unit=F.when(at(tokens, p + 1).isin(*L.VERB_BLOCKERS), 1).otherwise(best)).drop("unit_head")


def with_target(c, text: str, target: str = "target", recipient: str = "recipient"):
    """c with the target and recipient of a column's text: a recipient in front or behind is taken off first."""
    c = X.once(c, __s=F.regexp_replace(text, X.SPAN_TAIL, ""))
    rest, who = X.split_recipient(F.col("__s"))
    c = X.once(c, __rest=rest, __who=who)
    given = (F.col("__who") != "") & (X.strip_edges(F.col("__rest")) != "")
    c = c.withColumn("__t", F.when(given, F.col("__rest")).otherwise(F.col(text))).withColumn(recipient, F.when(given, F.col("__who")).otherwise(""))
    return c.withColumn(target, F.coalesce(X.trim_target(F.col("__t")), F.lit(""))).drop("__s", "__rest", "__who", "__t")


def with_place(c, target: str = "target"):
    """c with target, place and preposition taken apart."""
    thing, place, preposition = X.split_place(F.col(target))
    return c.withColumn("place", place).withColumn("preposition", preposition).withColumn(target, thing)


def with_roles(c, verbs=L.VERBS):
    """c (prepared, with speech_act) with predicate, predicate_lemma, predicate_surface, object, destination and
    recipient_or_direction; empty where there is no predicate."""
    c = with_unit(with_predicate(c), verbs)
    some, tokens = F.col("predicate") >= 0, F.col("tokens")
    first = F.greatest("predicate", F.lit(0)) + 1
    c = c.withColumn("predicate_surface", F.when(some, F.array_join(F.slice(tokens, first, F.col("unit")), " ")).otherwise(""))
    c = c.withColumn("predicate_lemma", F.when(some, F.when(F.col("unit") > 1, F.col("predicate_surface")).otherwise(at(F.col("lemmas"), F.col("predicate")))).otherwise(""))
    c = c.withColumn("payload", F.when(some, F.array_join(F.slice(tokens, first + F.col("unit"), 2000), " ")).otherwise(""))
    to = r"^(.*?) to (.*)$"
    c = c.withColumn("__to", F.col("payload").rlike(to)).withColumn("__thing", F.when(F.col("__to"), F.regexp_extract("payload", to, 1)).otherwise(F.col("payload"))).withColumn("__whom", F.regexp_extract("payload", to, 2))
    c = with_target(c, "__thing", "object", "__recipient")
    c = c.withColumn("recipient_or_direction", F.when(F.col("__to"), X.trim_target(F.col("__whom"))).otherwise(F.col("__recipient")))
    return with_place(c, "object").withColumnRenamed("place", "destination").drop("__to", "__thing", "__whom", "__recipient", "payload", "unit", "preposition")
