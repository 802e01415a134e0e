"""Text primitives as column expressions. Places count code points from 0; -1 means not found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L

EDGE = r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++$"


def once(d: DataFrame, **columns: Column) -> DataFrame:
    """d with the columns, each worked out once a row however often it is used: expressions are copied into each of their
    uses, but not through a generator. They are worked out in a projection below it, as compiled code: a generator whose
    own expressions hold a lambda is interpreted. (The outer form, as Spark infers a filter on the other one's input.)"""
    kept = [c for c in d.columns if c not in columns]
    made = d.select(*kept, F.array(F.struct(*(c.alias(k) for k, c in columns.items()))).alias("__made"))
    return made.select(*kept, F.explode_outer("__made").alias("__once")).select(*kept, "__once.*")


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, inside an expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_edges(c: Column) -> Column:
    """Spaces and controls off both ends."""
    return F.regexp_replace(c, EDGE, "")


def word_char(c: Column) -> Column:
    """Is the first character a word character?"""
    return F.substring(c, 1, 1).rlike(f"[{L.WORD_CLASS}]")


def lexical_char(c: Column) -> Column:
    return F.substring(c, 1, 1).rlike(f"[{L.LEXICAL_CLASS}]")


def has_word(c: Column) -> Column:
    return c.rlike(f"[{L.WORD_CLASS}]")


def count_of(c: Column, sign: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(sign)))) / len(sign)).cast("int")


def inside(c: Column, place: Column, sign: str) -> Column:
    """An odd number of signs stands before the place."""
    return (place >= 0) & (count_of(F.substring(c, F.lit(1), place), sign) % 2 == 1)


def _bounded(word: str, chars: str) -> str:
    return f"(?<![{chars}]){L.any_of([word])}(?![{chars}])"


def find_word(c: Column, word: str, chars: str = L.LEXICAL_CLASS) -> Column:
    """First place of the word, whole, in the lower-cased text without its edges."""
    return F.regexp_instr(strip_edges(F.lower(c)), F.lit(_bounded(word, chars))) - 1


def find_last_word(c: Column, word: str, chars: str = L.LEXICAL_CLASS) -> Column:
    return F.regexp_instr(strip_edges(F.lower(c)), F.lit(_bounded(word, chars) + f"(?!(?s:.*){_bounded(word, chars)})")) - 1


def has_any_word(c: Column, words) -> Column:
    """One of the words or phrases stands whole in the lower-cased text."""
    return F.lower(c).rlike(f"(?<![{L.LEXICAL_CLASS}])(?:{L.any_of(words)})(?![{L.LEXICAL_CLASS}])")


def last_boundary(c: Column) -> Column:
    """Place of the last comma, semicolon, dash, colon or full stop that ends a sentence."""
    last = lambda sign: F.when(F.instr(c, sign) > 0, F.length(c) - F.instr(F.reverse(c), sign[::-1]) - len(sign) + 1).otherwise(-1)
    return F.greatest(*(last(s) for s in (",", ";", "—", ":", ". ")), F.when(c.endswith("."), F.length(c) - 1).otherwise(-1))


def local_prefix(c: Column) -> Column:
    """What follows the last boundary."""
    return strip_edges(F.substring(c, last_boundary(c) + 2, F.length(c)))


def is_discourse(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), ",$", "").isin(*L.DISCOURSE)


def without_discourse(c: Column) -> Column:
    """Discourse markers off both ends, a comma off the last word, one space between words."""
    words = f"(?:{L.any_of(L.DISCOURSE)}),?"
    bare = F.regexp_replace(F.regexp_replace(strip_edges(F.lower(c)), ",$", ""), " {2,}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, f"^ ?(?:{words}(?: |$))++", ""), f"(?:(?:^| ){words})+$", ""))


def comma_before_subject(c: Column) -> Column:
    """Place of the first comma that a subject pronoun follows."""
    return F.regexp_instr(c, F.lit(f",\\s*(?:{L.any_of(L.SUBJECTS)})(?![{L.LEXICAL_CLASS}])")) - 1


SPAN_TAIL = r"""[\x00-\x20.!?;"']+$"""


def trim_target(c: Column) -> Column:
    """The noun phrase at the start of a span: punctuation off its end, cut where another phrase begins, without leading
    determiners, prepositions and particles, trailing particles and resulting states."""
    c = strip_edges(F.regexp_replace(c, SPAN_TAIL, ""))
    comma = f",\\s*(?:{L.any_of(L.SUBJECTS)})(?![{L.LEXICAL_CLASS}])"
    c = F.regexp_replace(c, f"(?s)(?:{comma}|{L.any_of(L.SPAN_ENDS)}).*$", "")
    c = F.regexp_replace(strip_edges(c), f"^(?:(?:{L.any_of(L.SPAN_LEADS)}) +)+", "")
    c = strip_edges(F.regexp_replace(c, ",$", ""))
    c = F.regexp_replace(c, "^(?:onto|into) (it|them|this|that|him|her)$", "$1")
    c = F.regexp_replace(c, f" (?:{L.any_of(L.SPAN_PARTICLES)})$", "")
    return F.regexp_replace(c, f"(?<=.) (?:{L.any_of(L.SPAN_RESULTS)})$", "")


PLACE = rf"(?s)^(.+?) ({L.any_of(L.PLACE_PREPOSITIONS)}) +((?:{L.any_of(L.PLACE_DETERMINERS)})(?: .*)?)$"


def split_place(c: Column) -> tuple[Column, Column, Column]:
    """(object, place, preposition) where a preposition with a determined noun phrase follows; else the object alone."""
    has = c.rlike(PLACE)
    part = lambda k: F.regexp_extract(c, PLACE, k)
    return F.when(has, trim_target(part(1))).otherwise(c), F.when(has, trim_target(part(3))).otherwise(""), F.when(has, part(2)).otherwise("")


def split_recipient(c: Column) -> tuple[Column, Column]:
    """(object, recipient): a recipient alone, in front of the object unless a place follows it, or behind to or for."""
    places = f"(?:{L.any_of(L.RECIPIENT_PLACES)}) "
    target, who = c, F.lit("")
    for surface in reversed(L.RECIPIENTS):
        name = "user" if surface in ("the user", "user", "me", "us") else surface
        tail = f"(?s) (?:to|for) {surface}$"
        front = c.rlike(f"^{surface} (?!{places})")
        hit = (c == surface) | front | c.rlike(tail)
        left = F.when(c == surface, "").when(front, strip_edges(F.regexp_replace(c, f"^{surface} ", ""))).otherwise(strip_edges(F.regexp_replace(c, tail, "")))
        target, who = F.when(hit, left).otherwise(target), F.when(hit, F.lit(name)).otherwise(who)
    return target, who


def starts_any(c: Column, prefixes) -> Column:
    return c.rlike(f"^(?:{L.any_of(prefixes)})")


def span_of(c: Column, first: Column, end: Column) -> Column:
    """The clamped span and its text."""
    a = F.greatest(F.lit(0), F.least(first, F.length(c)))
    b = F.greatest(a, F.least(end, F.length(c)))
    return F.struct(a.alias("start_index"), b.alias("end_index"), F.substring(c, a + 1, b - a).alias("text"))


def clause_start(text: Column, clause: Column, after: Column) -> Column:
    """Place of the clause from a place on, else anywhere, whatever the case."""
    found = F.locate(F.lower(clause), F.lower(text), after + 1) if isinstance(after, int) else F.position(F.lower(clause), F.lower(text), after + 1)
    return F.when(found > 0, found - 1).otherwise(F.instr(F.lower(text), F.lower(clause)) - 1)


def normalize(c: Column) -> Column:
    """Line ends to \\n, edges off, runs of spaces to one; other white space stays."""
    return F.regexp_replace(strip_edges(F.regexp_replace(c, "\r\n?", "\n")), " {2,}", " ")


def tokenize(c: Column, signs: str = L.TOKEN_SIGNS, limit: int | None = L.MAX_TOKENS + 1) -> Column:
    """Lower-cased tokens; at most limit, one more than a turn may have."""
    words = F.filter(F.split(F.translate(F.lower(c), signs, " " * len(signs)), " +"), lambda w: w != "")
    return F.slice(words, 1, limit) if limit else words


def is_quoted(c: Column, place: Column) -> Column:
    return inside(c, place, '"') | inside(c, place, "`") | inside(c, place, "*")


def is_reported(c: Column) -> Column:
    return F.lower(c).rlike(f"(?:{L.any_of(L.REPORTS)})")


def leading_vocative(prefix: Column) -> Column:
    """Only a name and a comma, of 32 characters at most."""
    return strip_edges(prefix).rlike(f"^[{L.WORD_CLASS}' -]{{1,32}},$")


def token_end(c: Column, first: Column, n: Column) -> Column:
    """Where the n-th word token from a place on ends."""
    rest = F.substring(c, first + 1, F.length(c))
    found = F.regexp_extract_all(rest, F.lit(f"[^{L.LEXICAL_CLASS}]*[{L.LEXICAL_CLASS}]+"), F.lit(0))
    return first + F.length(F.array_join(F.slice(found, 1, n), ""))
