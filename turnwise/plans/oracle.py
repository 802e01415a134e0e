"""Pieces of DuckDB SQL that the oracle queries are put together from. The classes that decide negation, conditions, modals,
discourse markers and retractions, and the marks between sentences, are stated here anew, as is all that is done with
them; other fixed word classes are shared with the engine."""

from __future__ import annotations

from turnwise.functions import lexicon as L
from turnwise.plans.turns import turns_sql, utterances_sql

W, X = L.WORD_CLASS, L.LEXICAL_CLASS.replace("'", "''")


# Fixed values, restated.
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
SECOND_PERSON = ("you", "u", "ya", "yah")
CONDITIONS = ("if", "unless", "provided", "providing", "assuming", "supposing")
DISCOURSE = ("ok", "okay", "now", "so", "alright", "well", "hey", "then", "right", "next", "first", "also", "afterwards", "finally", "later", "and", "but", "or", "oh", "um", "uh", "yeah", "maybe", "actually", "just", "please", "thanks", "sorry", "hi", "hello", "yes", "wow", "hmm")
LEADS = ("actually", "no", "oh", "wait", "hmm", "sorry", "ok", "okay")
RETRACTIONS = ("never mind", "nevermind", "cancel that", "cancel it", "cancel this", "forget it", "forget that", "forget about it", "scratch that", "don't do that", "don't do it", "do not do that", "not now")
TITLES = ("mr", "mrs", "ms", "dr", "st", "jr", "sr", "vs", "etc", "no")
#: In order: a stop after a letter, a title, a dotted run or nothing is hidden, twice since matches share their edges.
MARKS = (
    (r"\? ", "?| "), ("! ", "!| "), ("\n", "| "),
    *((rf"(^|[^{L.WORD_CLASS}.])([{L.WORD_CLASS}]|(?i:{'|'.join(TITLES)})|[{L.WORD_CLASS}.]*\.[{L.WORD_CLASS}.]*|)\. ", "$1$2\x02 "),) * 2,
    (r"\. ", ".| "), ("\x02", "."), (r"(?i)(?:, and|,| and) (?:afterwards|after that|finally|later|next|then) | then |;", "| "),
    ("(?i) and (create|make|are you|do you) ", "| $1 "), (", (could you|would you|are you|can you|did you|do you|have you|will you|was it|is it) ", "| $1 "),
)


def text(s: str) -> str:
    """A string literal; control signs are concatenated by code."""
    parts = []
    for c in s:
        if c in "\n\x02":
            parts.append(f"chr({ord(c)})")
        elif parts and parts[-1].startswith("'"):
            parts[-1] = parts[-1][:-1] + c.replace("'", "''") + "'"
        else:
            parts.append("'" + c.replace("'", "''") + "'")
    return "(" + " || ".join(parts or ["''"]) + ")"


def one_of(words) -> str:
    return L.any_of(words).replace("'", "''")


def members(words) -> str:
    return "(" + ", ".join(text(w) for w in words) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def normal(x: str) -> str:
    return "regexp_replace(" + strip(f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')") + ", ' {2,}', ' ', 'g')"


def tokens(x: str, signs: str = L.TOKEN_SIGNS, cap: str = "[1:1025]") -> str:
    return f"list_filter(string_split_regex(translate(lower({x}), {text(signs)}, '{' ' * len(signs)}'), ' +'), lambda w: w <> ''){cap}"


def lemma(w: str, forms: dict[str, str] = L.IRREGULAR) -> str:
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in forms.items()) or "WHEN '' THEN ''"
    return f"""CASE {w} {irregular} ELSE
      CASE WHEN suffix({w}, 'ies') AND length({w}) > 4 THEN {w}[:-4] || 'y'
           WHEN suffix({w}, 'ing') AND length({w}) > 5 THEN CASE WHEN {w}[-4] = {w}[-5] THEN {w}[:-5] ELSE {w}[:-4] END
           WHEN suffix({w}, 'ied') AND length({w}) > 4 THEN {w}[:-4] || 'y'
           WHEN suffix({w}, 'ed') AND length({w}) > 4 THEN {w}[:-3]
           WHEN suffix({w}, 's') AND NOT regexp_matches({w}, '(ss|us|is|ous|ics)$') AND length({w}) > 3 THEN {w}[:-2]
           ELSE {w} END END"""


def verb(w: str) -> str:
    v = members(L.VERBS)
    return f"({w} IN {v} OR ({lemma(w)}) IN {v} OR (({lemma(w)}) <> {w} AND ({lemma(w)}) || 'e' IN {v}))"


def found(x: str, word: str, chars: str = X) -> str:
    """Place of the first whole standing of a word in lower-cased, stripped text; -1."""
    p = f"(?s)^(.*?(?:^|[^{chars}])){word}(?:[^{chars}]|$)"
    return f"CASE WHEN regexp_matches({strip(f'lower({x})')}, '{p}') THEN length(regexp_extract({strip(f'lower({x})')}, '{p}', 1)) ELSE -1 END"


def found_last(x: str, word: str, chars: str = X) -> str:
    p = f"(?s)^((?:.*[^{chars}])?){word}(?:[^{chars}].*)?$"
    return f"CASE WHEN regexp_matches({strip(f'lower({x})')}, '{p}') THEN length(regexp_extract({strip(f'lower({x})')}, '{p}', 1)) ELSE -1 END"


def negation(i: str = "i", t: str = "t") -> str:
    """The i-th token negates."""
    return f"({t}[{i}] IN ('not', 'never') OR (suffix({t}[{i}], 'n''t') AND NOT coalesce({t}[{i} + 1], '') IN {members(SECOND_PERSON)}))"


def retracts(x: str) -> str:
    """x, lower-cased, takes back what was said once interjections, commas and dashes in front are off."""
    apart = strip(f"regexp_replace({x}, '([,-])', ' \\1', 'g')")
    return f"regexp_matches(regexp_replace({apart}, '^(?:(?:{one_of(LEADS)}|[,-])(?:[\\x00-\\x20]+|$))+', ''), '^(?:{one_of(RETRACTIONS)})')"


def without_markers(x: str) -> str:
    mark = f"(?:{one_of(DISCOURSE)}),?"
    bare = f"regexp_replace(regexp_replace({x}, ',$', ''), ' {{2,}}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '^ ?(?:{mark}(?: |$))+', ''), '(?:(?:^| ){mark})+$', ''), ' ')"


def has_word(x: str, words, chars: str = X) -> str:
    return f"regexp_matches(lower({x}), '(^|[^{chars}])({one_of(words)})([^{chars}]|$)')"


def marked(x: str) -> str:
    x = strip(x)
    for pattern, put in MARKS:
        x = f"regexp_replace({x}, {text(pattern)}, {text(put.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return x


def clause_list(x: str) -> str:
    parts = f"list_transform(string_split({marked(x)}, '|'), lambda p: regexp_replace({strip('p')}, ',$', ''))"
    return f"list_filter({parts}, lambda p: p <> '')[1:33]"


TURNS = f"turns AS ({turns_sql()})"
UTTERANCES = f"utt AS ({utterances_sql()})"
NORMAL = f"norm AS (SELECT turn_id, text, {normal('text')} AS n FROM utt)"
CLAUSES = f"clauses AS (SELECT turn_id, n, unnest(cl) AS clause, generate_subscripts(cl, 1) AS clause_no FROM (SELECT turn_id, n, {clause_list('n')} AS cl FROM norm))"
TOKENS = f"ct AS (SELECT turn_id, clause_no, clause, {tokens('clause')} AS t FROM clauses)"
TOKEN = "tok AS (SELECT turn_id, clause_no, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM ct)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


ON_TEXT = with_(UTTERANCES, NORMAL)
ON_CLAUSES = with_(UTTERANCES, NORMAL, CLAUSES, TOKENS)
ON_TOKENS = with_(UTTERANCES, NORMAL, CLAUSES, TOKENS, TOKEN)
#: The same over made turns only, with their kind.
T_TURNS = with_(TURNS)
T_CLAUSES = with_(TURNS, "utt AS (SELECT turn_id, text FROM turns)", NORMAL, CLAUSES, TOKENS)
T_TOKENS = with_(TURNS, "utt AS (SELECT turn_id, text FROM turns)", NORMAL, CLAUSES, TOKENS, TOKEN)
