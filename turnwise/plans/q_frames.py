"""Queries of matching, the guards, frames, turn-level steps, dialogue and links, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import text as X
from turnwise.operators import contract, frames, link, match
from turnwise.operators import segment as S
from turnwise.plans import analysis
from turnwise.plans import oracle as O
from turnwise.plans.turns import turns
from turnwise.sources.tables import Step, by_turn
from turnwise.streaming import dialogue

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.compiled(spark, turns(spark, sf_dir), "kind")


#: All frames of the made turns: many queries look at them from one side each.
framed = Step("frames", compiled)


long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
T = lambda: F.col("text")
LOW = lambda: X.strip_edges(F.lower("text"))
low = O.strip("lower(text)")


def on_turns(name: str, sql: str, **columns):
    query(name, O.T_TURNS + f"SELECT turn_id, {sql} FROM turns")(lambda s, d: turns(s, d).select("turn_id", *(v().alias(k) for k, v in columns.items())))


# Whole frames: what each template must compile to. o and p are the things named in the turn.
#: kind: frames of (type, query kind, speech act, action, object, destination, recipient, candidates, guard, depends on, count)
W, V, C_, Q = "world_action", "inventory_action", "conversation", "clarification"
R, ST, QU = "request", "statement", "question"
EXPECTED = {
    "direct": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "polite": [(W, "", R, "close", "o", "o", "", "", "execute", None, None)],
    "modal": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "prohibition": [(C_, "", ST, "", "", "", "", "", "prohibition", None, None)],
    "negation": [(C_, "prohibition", ST, "open", "", "", "", "", "negated", None, None)],
    "quotation": [(C_, "action_mention", ST, "open", "", "", "", "", "delimited", None, None)],
    "past": [(C_, "self_narration", ST, "open", "o", "", "", "", "narration", None, None)],
    "question": [("state_query", "action_capability", QU, "open", "", "", "", "", "question", None, None)],
    "condition": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None), (W, "", R, "close", "o", "o", "", "", "execute", 1, None)],
    "coordination": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "close", "p", "p", "", "", "execute", None, None)],
    "comma": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "close", "o", "o", "", "", "execute", 1, None)],
    "sequence": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "close", "p", "p", "", "", "execute", 1, None)],
    "counted": [(W, "", R, "jump", "", "", "", "", "execute", n - 1 or None, (n, 3)) for n in (1, 2, 3)],
    "retraction": [(C_, "prohibition", ST, "open", "o", "", "", "", "retracted", None, None), (C_, "", ST, "", "", "", "", "", "prohibition", 1, None)],
    "missing": [(Q, "", R, "open", "'it'", "", "", "open", "missing_target", None, None)],
    "answer": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None)],
    "unknown": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None)],
    "particle": [(V, "", R, "pickup", "o", "o", "", "", "execute", None, None)],
    "recipient": [(V, "", R, "give", "o", "o", "user", "", "execute", None, None)],
    "containment": [(W, "", R, "insert", "o", "p", "", "", "execute", None, None)],
    "attention": [(C_, "discourse_marker", ST, "wait", "", "", "", "", "attention", None, None), (W, "", R, "open", "o", "o", "", "", "execute", 1, None)],
    "fetch": [(V, "", R, "pickup", "o", "o", "", "", "execute", None, None), (V, "", R, "give", "o", "o", "user", "", "execute", 1, None)],
    "canonical": [(W, "", R, "break", "o", "o", "", "", "execute", None, None)],
    "ambiguous": [(Q, "", R, "", "", "", "", "pickup,raise", "ambiguous_alias", None, None)],
    "modal_statement": [(V, "", R, "give", "o", "o", "user", "", "execute", None, None)],
    "ability": [("state_query", "action_capability", QU, "jump", "", "", "", "", "question", None, None)],
    "wh": [(C_, "conversation", QU, "", "", "", "", "", "no_alias", None, None)],
    "possession": [("inventory_query", "has_item", QU, "", "o", "", "", "", "possession", None, None)],
    "preference": [("emotion_signal", "preference_query", QU, "", "", "", "", "", "preference", None, None)],
    "threat": [("threat_signal", "", ST, "", "'danger'", "", "", "", "threat", None, None)],
    "deferred": [(C_, "conditional_request", ST, "open", "", "", "", "", "deferred", None, None)],
    "topic": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None), (V, "", R, "pickup", "o", "o", "", "", "execute", 1, None)],
    "equipment": [("inventory_query", "equipment", QU, "", "", "", "", "", "equipment", None, None)],
    "three": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "close", "p", "p", "", "", "execute", 1, None), (V, "", R, "drop", "p", "p", "", "", "execute", 2, None)],
    "blank": [],
    "narration": [(C_, "self_narration", ST, "open", "o", "", "", "", "narration", None, None)],
    "tail": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None), (C_, "conversation", QU, "", "", "", "", "", "no_alias", 1, None)],
    "feeling": [("emotion_signal", "emotion_query", QU, "", "", "", "", "", "emotion", None, None)],
    "place": [(W, "", R, "throw", "o", "p", "", "", "execute", None, None)],
    "front": [(V, "", R, "give", "o", "o", "user", "", "execute", None, None)],
    "pending": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None)],
    "competing": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None)],
    "code": [(C_, "action_mention", ST, "open", "", "", "", "", "delimited", None, None)],
    "twice": [(W, "", R, "open", "o", "o", "", "", "execute", n - 1 or None, (n, 2)) for n in (1, 2)],
    "indirect": [(W, "", R, "repair", "o", "o", "", "", "execute", None, None)],
    "title": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None), (W, "", R, "read", "p", "p", "", "", "execute", 1, None)],
    "leave": [(C_, "state_preservation", R, "", "", "", "", "", "leave_state", None, None)],
    "multiword": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None)],
    "adverb": [(W, "", R, "clean", "o", "o", "", "", "execute", None, None)],
    "future": [(C_, "action_mention", ST, "examine", "", "", "", "", "no_request", None, None)],
    "report": [(C_, "", ST, "", "", "", "", "", "prohibition", None, None)],
    "why": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "gerund": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "shared": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "close", "o", "o", "", "", "execute", 1, None)],
    "nouns": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "open", "p", "p", "", "", "execute", 1, None)],
    "bring": [(V, "", R, "pickup", "o", "o", "", "", "execute", None, None), (V, "", R, "give", "o", "o", "user", "", "execute", 1, None)],
    "hedge": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "assuming": [(C_, "conversation", ST, "", "", "", "", "", "no_alias", None, None), (W, "", R, "close", "o", "o", "", "", "execute", 1, None)],
    "not_you": [(C_, "prohibition", ST, "open", "", "", "", "", "negated", None, None)],
    "not_now": [(C_, "prohibition", ST, "open", "o", "", "", "", "retracted", None, None), (C_, "conversation", ST, "", "", "", "", "", "no_alias", 1, None)],
    "told_of": [(C_, "action_mention", ST, "open", "", "", "", "", "mention", None, None)],
    "noun_subject": [(C_, "action_mention", ST, "open", "", "", "", "", "noun_phrase", None, None)],
    "complement": [(W, "", R, "open", "o", "o", "", "", "execute", None, None), (W, "", R, "examine", "o", "o", "", "", "execute", None, None)],
    "resultative": [(C_, "action_mention", ST, "break", "", "", "", "", "resultative", None, None)],
    "span_cut": [(W, "", R, "open", "o", "o", "", "", "execute", None, None)],
    "five": [(W, "", R, "gesture", "'user'", "user", "user", "", "execute", None, None)],
    "again": [(W, "", R, "throw", "o", "o", "", "", "execute", None, None)] + [(W, "", R, "throw", "o", "o", "", "", "execute", n, (n, 2)) for n in (1, 2)],
    "landing": [(W, "", R, "throw", "o", "o", "", "", "execute", None, None), (W, "", R, "throw", "o", "o", "", "", "execute", 1, (1, 2)), (W, "", R, "throw", "p", "p", "", "", "execute", 2, (2, 2))],
}

_thing = lambda x: {"o": "lower(p_name)", "p": "lower(p_type)", "": "''"}.get(x, x)
_rows = []
for _kind, _frames in EXPECTED.items():
    for _n, (_type, _query, _act, _action, _object, _destination, _who, _several, _guard, _after, _count) in enumerate(_frames, 1):
        _null = lambda v: "NULL" if v is None else str(v)
        _rows.append(f"SELECT '{_kind}' AS kind, {_n} AS frame_no, '{_type}' AS frame_type, '{_query}' AS query_kind, '{_act}' AS speech_act, '{_action}' AS action, '{_object.strip(chr(39))}' AS obj, '{_destination}' AS dest, '{_who}' AS recipient, '{_several}' AS candidates, '{_guard}' AS guard, CAST({_null(_after)} AS BIGINT) AS depends_on, CAST({_null(_count and _count[0])} AS VARCHAR) AS count_index, CAST({_null(_count and _count[1])} AS VARCHAR) AS count_total")
FRAMES = (
    O.TURNS + ", expected AS (" + " UNION ALL ".join(_rows) + "), frames AS (SELECT t.turn_id, t.conv_id, t.turn, e.frame_no, e.frame_type, e.query_kind, e.speech_act, e.action,"
    " CASE e.obj WHEN 'o' THEN lower(p_name) WHEN 'p' THEN lower(p_type) ELSE e.obj END AS object, CASE e.dest WHEN 'o' THEN lower(p_name) WHEN 'p' THEN lower(p_type) ELSE e.dest END AS destination,"
    " e.recipient, e.candidates, e.guard, e.depends_on, e.count_index, e.count_total, t.kind FROM turns t JOIN expected e USING (kind) JOIN part ON p_partkey = t.turn_id) "
)
FRAMED = "WITH RECURSIVE " + FRAMES


def on_frames(name: str, columns: str, where: str = "true", of=framed):
    """A view of the frames: the same columns and condition on both sides, over frames compiled here and there."""
    query(name, FRAMED + f"SELECT turn_id, CAST(frame_no AS BIGINT) AS frame_no, {columns} FROM frames WHERE {where}")(lambda s, d: of(s, d).where(where).selectExpr("turn_id", "CAST(frame_no AS BIGINT) AS frame_no", *columns.split(", ")))


on_frames("compile_frames", "frame_type, query_kind, speech_act, action, object, destination, recipient, candidates, guard, count_index, count_total", of=compiled)
for _id, _name in {
    "b02": "prohibition", "b03": "equipment", "b04": "possession", "b05a": "emotion", "b05b": "preference", "b06": "threat", "b09": "no_alias", "b11": "ambiguous_alias", "b12": "mention", "b14": "delimited", "b16": "negated", "b17": "leave_state",
    "b18": "deferred", "b20": "question", "b21": "noun_phrase", "b22": "no_request", "b27": "narration", "b30": "resultative", "b31": "missing_target", "b33": "execute", "k02": "retracted", "k06": "attention",
}.items():
    on_frames(f"{_id}_{_name}", "frame_type, query_kind, speech_act, action, object", f"guard = '{_name}'")
on_frames("b10_canonical_name", "action", "kind = 'canonical'")
on_frames("b23_target_and_recipient", "object, recipient", "recipient <> ''")
on_frames("b24_containment", "action, object, destination", "destination <> object")
on_frames("b26_coreference", "object", "kind IN ('comma', 'topic', 'three') AND frame_no > 1")
on_frames("b25_complement", "action, object", "kind = 'complement'")
on_frames("b29_addressee", "action, object, recipient", "kind = 'five'")
on_frames("g06_do_targets", "action, object, count_index, count_total", "kind IN ('again', 'landing')")
query("k04_span_end", O.TURNS.join(("WITH ", " ")) + "SELECT turn_id, CAST(length('Open the ' || p_name) AS BIGINT) AS end_index FROM turns JOIN part ON p_partkey = turn_id WHERE kind = 'span_cut'")(lambda s, d: framed(s, d).where("kind = 'span_cut'").select("turn_id", long("end_index").alias("end_index")))
on_frames("k05_dependencies", "CAST(CASE WHEN depends_on IS NULL THEN 0 ELSE depends_on END AS BIGINT) AS depends_on")
on_frames("g05_counted_suffix", "count_index, count_total, object", "count_total IS NOT NULL")
on_frames("g07_fetch", "action, object, recipient", "kind IN ('fetch', 'bring')")
on_frames("g02_coordination", "action, object", "kind IN ('coordination', 'comma', 'shared', 'nouns')")
on_frames("j03_gerund", "action, object", "kind = 'gerund'")

query("frames_by_type", FRAMED + "SELECT frame_type, query_kind, count(*) AS n, count(DISTINCT turn_id) AS turns FROM frames GROUP BY ALL")(lambda s, d: framed(s, d).groupBy("frame_type", "query_kind").agg(F.count("*").alias("n"), F.countDistinct("turn_id").alias("turns")))
query("k07_frame_limit", FRAMED + "SELECT turn_id, count(*) AS n, count(*) <= 32 AS within FROM frames GROUP BY turn_id")(lambda s, d: framed(s, d).groupBy("turn_id").agg(F.count("*").alias("n")).withColumn("within", F.col("n") <= L.MAX_FRAMES))
query("k08_validation", FRAMED + "SELECT turn_id, count(frame_no) > 0 AS valid FROM turns LEFT JOIN (SELECT turn_id, frame_no FROM frames) USING (turn_id) GROUP BY turn_id")(lambda s, d: turns(s, d).select("turn_id").join(framed(s, d).groupBy("turn_id").agg(F.count("*").alias("n")), "turn_id", "left").select("turn_id", (F.coalesce("n", F.lit(0)) > 0).alias("valid")))
query("k09_packets", FRAMED + "SELECT turn_id, 'native_turn_packet_v1' AS packet_version, count(frame_no) AS n_frames, count(frame_no) = 0 AS abstained, count(frame_no) > 0 AS valid FROM turns LEFT JOIN (SELECT turn_id, frame_no FROM frames) USING (turn_id) GROUP BY turn_id")(lambda s, d: analysis.packets(s, turns(s, d)).select("turn_id", "packet_version", long("n_frames").alias("n_frames"), "abstained", "valid"))
query("a11_pass_rates", FRAMED + "SELECT kind, count(*) AS frames, count(*) FILTER (frame_type IN ('world_action', 'inventory_action')) AS executable FROM frames GROUP BY kind")(lambda s, d: framed(s, d).groupBy("kind").agg(F.count("*").alias("frames"), F.count_if(F.col("frame_type").isin("world_action", "inventory_action")).alias("executable")))
query("a12_percentile", "SELECT quantile_disc(len, 0.5) AS p50, quantile_disc(len, 0.95) AS p95, quantile_disc(len, 0.99) AS p99, max(len) AS top FROM (SELECT length(text) AS len FROM conversations)")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(F.length("text").alias("len")).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY len)").cast("long").alias(k) for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), long(F.max("len")).alias("top")))

# Single guards as expressions over whole turns
_wh = " OR ".join(f"starts_with(l, '{w}')" for w in frames.QUESTION_WORDS)
_aux = "regexp_matches(l, '^(does|did|are|is|has) ') OR (regexp_matches(l, '^(do|have) ') AND (suffix(l, '?') OR coalesce(t[2], '') IN " + O.members((*L.SUBJECTS, "u")) + "))"
on_turns("b01_auxiliary_question", f"({_wh}) AS wh, ({_aux}) AS auxiliary".replace("(l,", f"({low},").replace("t[2]", f"({O.tokens(low)})[2]"), wh=lambda: frames.questions(LOW(), ["open"])["wh"], auxiliary=lambda: frames.questions(LOW(), ["open"])["auxiliary"])
on_turns("b02_prohibited_prefix", " OR ".join(f"starts_with({low}, {O.text(p)})" for p in L.PROHIBITIONS) + " AS prohibited", prohibited=lambda: frames.prohibited(LOW(), [a for a, _ in L.ALIASES]))
on_turns("b04_possession_target", rf"regexp_replace(regexp_replace({O.strip(f'''regexp_extract({low}, '(?s)^.*?(?:do you have |have you got )(.*)$', 1)''')}, '[.?]+$', ''), '^(?:(?:the|a|an|your) +)+', '') AS thing", thing=lambda: frames.possession(F.regexp_replace(LOW(), "^i have .*", "")))
_suf = rf"regexp_extract({low}, '(?:open|close|read) (.*)$', 1)"
on_turns("b20_generic_plural", f"coalesce(len(t) BETWEEN 1 AND 3 AND t[1] NOT IN {O.members((*L.DETERMINERS, 'it', 'them', 'me', 'us'))} AND suffix(t[-1], 's') AND ({O.lemma('t[-1]')}) <> t[-1], false) AS plural".replace("t[", f"({O.tokens(_suf)})[").replace("len(t)", f"len({O.tokens(_suf)})"), plural=lambda: frames.generic_plural(F.regexp_extract(LOW(), "(?:open|close|read) (.*)$", 1)))
_pre = f"regexp_extract({low}, '^(.*?)(?:^|[^{O.X}])open(?:[^{O.X}]|$)', 1)"
_neg = f"len(list_filter(range(greatest(1, len(t) - 3), len(t) + 1), lambda i: {O.negation()} OR t[i] IN ('dont', 'avoid', 'stop'))) > 0"
query("b16_local_negation", O.T_TURNS + f"SELECT turn_id, {_neg} AS negated FROM (SELECT turn_id, {O.tokens(_pre)} AS t FROM turns)")(lambda s, d: turns(s, d).select("turn_id", frames.locally_negated(F.regexp_extract(LOW(), f"^(.*?)(?:^|[^{L.LEXICAL_CLASS}])open(?:[^{L.LEXICAL_CLASS}]|$)", 1)).alias("negated")))
on_turns("b13_interjection", rf"regexp_matches({low}, '^[a-z]+,\s*(?:{O.one_of(frames.INTERRUPTED)})(?:[^a-z]|$)') AS interjection", interjection=lambda: LOW().rlike(rf"^[a-z]+,\s*(?:{L.any_of(frames.INTERRUPTED)})(?:[^a-z]|$)"))
on_turns("b15_indirect_query", " OR ".join(f"contains({low}, '{p}')" for p in frames.INDIRECT_QUERY) + " AS indirect", indirect=lambda: frames.contains_any(LOW(), frames.INDIRECT_QUERY))
on_turns("b19_contrastive", " OR ".join(f"contains({low}, '{p}')" for p in frames.UNCLEAR) + " AS unclear", unclear=lambda: frames.contains_any(LOW(), frames.UNCLEAR))
on_turns("b28_deixis", f"regexp_replace(regexp_extract({low}, '^(?:put|throw|hand|give|wait|open|close) (.*)$', 1), '(?:[.!?,\\s]| please| now)+$', '') IN {O.members(frames.DEIXIS)} AS here", here=lambda: F.regexp_replace(F.regexp_extract(LOW(), "^(?:put|throw|hand|give|wait|open|close) (.*)$", 1), r"(?:[.!?,\s]| please| now)+$", "").isin(*frames.DEIXIS))
on_turns("b32_indefinite", f"regexp_matches({low}, '^[a-z]+ (?:(?:me|us|him|her|them) )*(?:a|an|some|any|another) ') AS indefinite", indefinite=lambda: LOW().rlike("^[a-z]+ (?:(?:me|us|him|her|them) )*(?:a|an|some|any|another) "))
on_turns("g05_count_value", f"CASE WHEN regexp_matches(text, '(?i) twice[.!]*$') THEN 2 WHEN regexp_matches(text, '(?i) thrice[.!]*$') THEN 3 WHEN regexp_matches(text, '(?i) [0-9]+ times?[.!]*$') THEN greatest(CAST(regexp_extract(text, '(?i) ([0-9]+) times?[.!]*$', 1) AS BIGINT), 1) ELSE 1 END AS n", n=lambda: long(frames.counted(X.normalize(T()))[1]))
on_turns("g06_do_count", "CASE WHEN regexp_matches('do 2 ' || lower(regexp_extract(text, '^([A-Za-z]+)', 1)) || 's', '^do 2 (open|close|jump|push|wave|wait|sit|read|drop|give|hand|pass|put|place|lift|throw|break|leave|clean|press|raise|grab|take|shut|equip|insert|toss|smash|destroy|wipe|repair|fix|examine|inspect|remember|hop|follow)s$') THEN 2 ELSE 0 END AS n", n=lambda: long(frames.do_counted(F.concat(F.lit("do 2 "), F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)), F.lit("s")), [a for a, _ in L.ALIASES])[1]))
on_turns("k02_retraction_formula", f"regexp_matches({low}, '(?:^|[.!?] )(?:{O.one_of(L.RETRACTIONS)})(?:[^{O.X}]|$)') AS takes_back", takes_back=lambda: LOW().rlike(f"(?:^|[.!?] )(?:{L.any_of(L.RETRACTIONS)})(?:[^{L.LEXICAL_CLASS}]|$)"))

# Joins
_alias = "alias AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in L.ALIASES) + ") v(surface, action))"
_action = "actions AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{m}', '{f}')" for a, m, f in L.ACTIONS) + ") v(action, target_mode, family))"
_hit = f", {_alias}, hit AS (SELECT turn_id, clause_no, clause, surface, length(regexp_extract(lower(clause), '(?s)^(.*?(?:^|[^{O.X}]))' || surface || '(?:[^{O.X}]|$)', 1)) AS first FROM ct JOIN (SELECT DISTINCT surface FROM alias) ON regexp_matches(lower(clause), '(^|[^{O.X}])' || surface || '([^{O.X}]|$)'))"
_direct = lambda s, d: match.contiguous(S.clauses(turns(s, d)), match.aliases(s)).groupBy("turn_id", "clause_no", "surface").agg(F.min("first").alias("first"))
query("j01_phrase_join", O.T_CLAUSES + _hit + " SELECT turn_id, clause_no, surface, first FROM hit")(lambda s, d: _direct(s, d).select("turn_id", long("clause_no").alias("clause_no"), "surface", long("first").alias("first")))
_sep = [a for a in dict.fromkeys(x for x, _ in L.ALIASES) if " " in a and a.split(" ")[1] in L.PARTICLES]
_sepv = "(VALUES " + ", ".join(f"('{a}', '{a.split(' ')[0]}', '{a.split(' ')[1]}')" for a in _sep) + ") v(surface, head, particle)"
query("j02_separated_particle", O.T_CLAUSES + f" SELECT turn_id, clause_no, surface FROM ct JOIN (SELECT * FROM {_sepv}) ON regexp_matches(lower(clause), '(^|[^{O.X}])' || head || '(?:[^{O.X},]+[{O.X}]+){{1,4}}[^{O.X},]+' || particle || '([.,!?;]|$| (?:please|now|again|for|and|then|to)(?: |$|[.,!?]))') AND NOT regexp_matches(lower(clause), head || '.* and .*' || particle)")(lambda s, d: match.separated(S.clauses(turns(s, d)), match.aliases(s)).select("turn_id", long("clause_no").alias("clause_no"), "surface").distinct())
query("j04_narration", O.T_CLAUSES + f", {_alias}, {_action}, v AS (SELECT turn_id, clause_no, regexp_extract(lower(clause), '^(?:i|we) ([{O.W}]+)', 1) AS w FROM ct) SELECT DISTINCT turn_id, clause_no, surface FROM v JOIN alias ON NOT contains(surface, ' ') AND surface IN (w, {O.lemma('w')}, ({O.lemma('w')}) || 'e') JOIN actions USING (action) WHERE w <> '' AND family NOT IN ('perception', 'perceptioncognition', 'metaactions', 'information')")(lambda s, d: match.narrated(S.clauses(turns(s, d)), match.aliases(s), match.actions(s)).select("turn_id", long("clause_no").alias("clause_no"), "surface").distinct())
query("j05_not_determined", O.T_CLAUSES + _hit + f" SELECT turn_id, clause_no, surface, first FROM hit WHERE NOT regexp_matches(substr(lower(clause), 1, first), '(?:^|[^{O.X}])(?:{O.one_of(L.DETERMINERS[:-1])}) +$')")(lambda s, d: match.not_determined(_direct(s, d), S.clauses(turns(s, d))).select("turn_id", long("clause_no").alias("clause_no"), "surface", long("first").alias("first")))
query("j06_alias_actions", O.T_CLAUSES + _hit + ", a AS (SELECT surface, string_agg(DISTINCT action, ',' ORDER BY action) AS actions FROM alias GROUP BY surface) SELECT turn_id, clause_no, surface, actions FROM hit JOIN a USING (surface)")(lambda s, d: match.contiguous(S.clauses(turns(s, d)), match.aliases(s)).select("turn_id", long("clause_no").alias("clause_no"), "surface", F.array_join("actions", ",").alias("actions")).distinct())
query("j07_action_contract", FRAMED + f", {_action} SELECT turn_id, CAST(frame_no AS BIGINT) AS frame_no, action, target_mode, family FROM frames JOIN actions USING (action)")(lambda s, d: framed(s, d).join(match.small(match.actions(s)), "action").select("turn_id", long("frame_no").alias("frame_no"), "action", "target_mode", "family"))
query("j08_direct_semi", O.T_CLAUSES + _hit + " SELECT turn_id, clause_no FROM ct WHERE EXISTS (SELECT 1 FROM hit WHERE hit.turn_id = ct.turn_id AND hit.clause_no = ct.clause_no)")(lambda s, d: (lambda c: c.join(match.contiguous(c, match.aliases(s)), ["turn_id", "clause_no"], "left_semi").select("turn_id", long("clause_no").alias("clause_no")))(S.clauses(turns(s, d))))
_key = f"CASE WHEN regexp_matches(p, '(^|[^{O.X}])please([^{O.X}]|$)') THEN 1000 ELSE 0 END"


@query("r01_alias_rank", O.T_CLAUSES + _hit + f", k AS (SELECT *, {O.strip('substr(lower(clause), 1, first)')} AS p FROM hit), s AS (SELECT *, CASE WHEN {' OR '.join(f'''regexp_matches(p, '(^|[^{O.X}])({m}) ({y})([^{O.X}]|$)')''' for m, y in ((O.one_of(O.MODALS), O.one_of(O.SECOND_PERSON)), (O.one_of(O.SECOND_PERSON), O.one_of(O.MODALS))))} THEN 10000 ELSE 0 END + {_key} AS score FROM k) SELECT turn_id, clause_no, arg_max(surface, score::BIGINT * 1000000 - first * 1000 + length(surface)) AS surface FROM s GROUP BY ALL")
def _rank(s, d):
    """By score, place and length: the made turns have one clause-initial order each, so no other rule decides."""
    c = S.clauses(turns(s, d))
    ranked = match.ranked(match.contiguous(c, match.aliases(s)).join(c.select("turn_id", "clause_no", "clause"), ["turn_id", "clause_no"]))
    return ranked.groupBy("turn_id", "clause_no").agg(F.max_by("surface", F.struct("score", -F.col("first"), F.length("surface"))).alias("surface")).select("turn_id", long("clause_no").alias("clause_no"), "surface")


# Windows
query("r06_ids", O.T_CLAUSES + " SELECT turn_id, clause_no, format('clause_{:03d}', clause_no) AS clause_id FROM clauses")(lambda s, d: S.clauses(turns(s, d)).select("turn_id", long("clause_no").alias("clause_no"), F.format_string("clause_%03d", F.col("clause_no")).alias("clause_id")))
query("r07_running_offset", O.T_CLAUSES + " SELECT turn_id, clause_no, coalesce(sum(length(clause)) OVER (PARTITION BY turn_id ORDER BY clause_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM clauses")(lambda s, d: S.clauses(turns(s, d)).select("turn_id", long("clause_no").alias("clause_no"), F.coalesce(F.sum(F.length("clause")).over(Window.partitionBy("turn_id").orderBy("clause_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
_w = lambda: Window.partitionBy("turn_id").orderBy("frame_no")
query("r12_look_around", FRAMED + "SELECT turn_id, CAST(frame_no AS BIGINT) AS frame_no, coalesce(lag(frame_type) OVER w, '') AS before, coalesce(lead(frame_type) OVER w, '') AS after, coalesce(bool_or(guard = 'prohibition') OVER (PARTITION BY turn_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS taken_back FROM frames WINDOW w AS (PARTITION BY turn_id ORDER BY frame_no)")(lambda s, d: framed(s, d).select("turn_id", long("frame_no").alias("frame_no"), F.coalesce(F.lag("frame_type").over(_w()), F.lit("")).alias("before"), F.coalesce(F.lead("frame_type").over(_w()), F.lit("")).alias("after"), F.coalesce(F.bool_or(F.col("guard") == "prohibition").over(_w().rowsBetween(1, Window.unboundedFollowing)), F.lit(False)).alias("taken_back")))
query("j14_previous_target", FRAMED + "SELECT turn_id, CAST(frame_no AS BIGINT) AS frame_no, coalesce(lag(object) OVER (PARTITION BY turn_id ORDER BY frame_no), '') AS previous FROM frames")(lambda s, d: framed(s, d).select("turn_id", long("frame_no").alias("frame_no"), F.coalesce(F.lag("object").over(_w()), F.lit("")).alias("previous")))

# Dialogue: which turns answer an open question. Made conversations repeat, so the answers follow from the kinds.
_open = "SELECT t.turn_id, t.conv_id, t.turn, t.kind, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns t"


@query("k01_pending_fold", O.T_TURNS + f"SELECT o.turn_id, coalesce(kind = 'answer' AND before = 'missing', false) AS resolved, CASE WHEN kind = 'answer' AND before = 'missing' THEN lower(p_name) ELSE '' END AS object, CASE WHEN kind = 'answer' AND before = 'missing' THEN 'world_action' ELSE '' END AS frame_type FROM ({_open}) o JOIN part ON p_partkey = o.turn_id")
def _pending(s, d):
    return dialogue.fold(dialogue.outcomes(turns(s, d), framed(s, d))).select("turn_id", "resolved", "object", "frame_type")


on_turns("k01_answers", rf"coalesce(CASE WHEN contains({low}, 'i meant ') AND NOT contains({low}, ' or ') THEN regexp_extract({low}, 'i meant (?:the )?(.*?)[.]?$', 1) WHEN regexp_matches({low}, 'use .* as the target') THEN regexp_extract({low}, 'use (?:the )?(.*?) as the target', 1) ELSE '' END, '') AS answer, contains({low}, 'i meant ') AND contains({low}, ' or ') AS asks_again", answer=lambda: dialogue.answer(T())["answer"], asks_again=lambda: dialogue.answer(T())["asks_again"])

# Links
LINK_TEMPLATES = ("Carve the {o}.", "Get rid of the {o}.", "Carry the {o} and open the {p}.", "Do not carve the {o}.", '"Carve the {o}" she wrote.', "You will probably carve the {o}.", "Mop the {o} up.", "Please bring the {o}.", "Cook the {o}.", "Open the {o}.", "Hide the {o}.", "Anna told you to paint the {o}.", "Sing to the {o}.", "Could we be singing the {o}?", "Carve the {o}. Paint the {p}.")


def link_turns_sql() -> str:
    from turnwise.plans.turns import _expression

    text = " ".join(f"WHEN {k} THEN {_expression(t, 'lower(p_name)', 'lower(p_type)')}" for k, t in enumerate(LINK_TEMPLATES))
    return f"SELECT p_partkey AS turn_id, p_partkey % {len(LINK_TEMPLATES)} AS kind, CASE p_partkey % {len(LINK_TEMPLATES)} {text} END AS text FROM part"


def link_turns(s, d):
    s.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("turnwise_part")
    return by_turn(s.sql(link_turns_sql().replace("FROM part", "FROM turnwise_part")))


requests = Step("requests", lambda s, d: link.numbered(link.requests(S.clauses(link_turns(s, d)), link.entries(s), match.aliases(s))))


def linked(s, d):
    asked = requests(s, d)
    ranked, lacking = link.proposals(asked, link.candidates(s), match.actions(s))
    return {"requests": asked, "ranked": ranked, "filtered": lacking, "status": link.link_status(asked, ranked)}


_lt = "WITH lt AS (" + link_turns_sql() + ")"
#: kind: (status, what each clause links to: proposals of (action, confidence) in order)
LINKS = {
    0: ("CANDIDATES", [(("break", 62),)]), 1: ("AMBIGUOUS", [(("destroy", 70), ("drop", 60))]), 2: ("CANDIDATES", [(("pickup", 80),)]), 3: ("NO_LINK", [()]), 4: ("NO_LINK", [()]), 5: ("NO_LINK", [()]), 6: ("CANDIDATES", [(("clean", 95),)]),
    7: ("CANDIDATES", [(("give", 75), ("pickup", 45))]), 8: ("NO_LINK", [()]), 9: ("NOT_NEEDED", [()]), 10: ("NO_LINK", [()]), 11: ("NO_LINK", [()]), 12: ("NO_LINK", [()]), 13: ("NO_LINK", [()]), 14: ("CANDIDATES", [(("break", 62),), (("clean", 35),)]),
}
#: kind: the act of each clause for the linking step, whether its predicate has an entry, and the surface or unknown verb
ACTS = {
    0: [("request", True, "carve")], 1: [("request", True, "get rid of")], 2: [("request", True, "carry")], 3: [("request", True, "carve")], 4: [("request", True, "carve")], 5: [("statement", True, "carve")], 6: [("request", True, "mop up")], 7: [("request", True, "bring")],
    8: [("request", True, "cook")], 9: [("request", False, "open")], 10: [("request", True, "hide")], 11: [("statement", True, "paint")], 12: [("request", False, "sing")], 13: [("statement", False, "sing")], 14: [("request", True, "carve"), ("request", True, "paint")],
}
_status = " ".join(f"WHEN {k} THEN '{v[0]}'" for k, v in LINKS.items())
_offers = ", ".join(f"({k}, {c}, {i}, '{a}', {p})" for k, v in LINKS.items() for c, offers in enumerate(v[1], 1) for i, (a, p) in enumerate(offers, 1))
_acts = ", ".join(f"({k}, {c}, '{act}', {str(known).lower()}, '{surface}')" for k, v in ACTS.items() for c, (act, known, surface) in enumerate(v, 1))
_asked = _lt + f" SELECT turn_id, CAST(c AS BIGINT) AS clause_no, {{}} FROM lt JOIN (VALUES {_acts}) v(k, c, act, known, surface) ON k = kind WHERE {{}}"
_of = lambda column, name: lambda s, d: linked(s, d)["requests"].select("turn_id", long("clause_no").alias("clause_no"), F.col(column).alias(name))
query("a03_link_status", _lt + f" SELECT turn_id, CASE kind {_status} END AS status FROM lt")(lambda s, d: linked(s, d)["status"])
query("r03_candidate_rank", _lt + f" SELECT turn_id, CAST(c AS BIGINT) AS clause_no, CAST(r AS BIGINT) AS rank, action, CAST(p AS BIGINT) AS confidence FROM lt JOIN (VALUES {_offers}) v(k, c, r, action, p) ON k = kind")(lambda s, d: linked(s, d)["ranked"].select("turn_id", long("clause_no").alias("clause_no"), long("rank").alias("rank"), "action", long(F.col("confidence") * 100).alias("confidence")))
query("r04_ambiguity", _lt + f" SELECT turn_id, CAST(c AS BIGINT) AS clause_no, kind = 1 AS ambiguous FROM lt JOIN (VALUES {_offers}) v(k, c, r, action, p) ON k = kind WHERE r = 1")(lambda s, d: link.ambiguous(linked(s, d)["ranked"]).select("turn_id", long("clause_no").alias("clause_no"), "ambiguous"))
query("j13_capability_filter", _lt + " SELECT turn_id, 'SBA_CAPABILITY_FILTERED:' || CASE kind WHEN 2 THEN 'teleport' ELSE 'boil' END AS code FROM lt WHERE kind IN (2, 8)")(lambda s, d: linked(s, d)["filtered"].select("turn_id", "code"))
query("r05_request_order", _asked.format("format('literal_{:03d}', c) AS request_id", "true"))(_of("request_id", "request_id"))
query("r02_longest_entry", _asked.format("surface", "known"))(lambda s, d: linked(s, d)["requests"].where("known").select("turn_id", long("clause_no").alias("clause_no"), "surface"))
query("c13_link_act", _asked.format("act", "true"))(_of("speech_act", "act"))
query("c14_unknown_predicate", _asked.format("surface AS verb", "NOT known"))(lambda s, d: linked(s, d)["requests"].where("not known").select("turn_id", long("clause_no").alias("clause_no"), F.col("surface").alias("verb")))
_entries = "(VALUES " + ", ".join(f"('{a}', '{b}', '{p}')" for a, b, p in link.ENTRIES) + ") e(surface, lemma, particle)"
query("j11_entry_hits", "WITH RECURSIVE lt AS (" + link_turns_sql() + f"), w AS (SELECT turn_id, lower(text) AS l, list_transform({O.tokens('text')}, lambda w: {O.lemma('w')}) AS ls FROM lt) SELECT DISTINCT turn_id, surface FROM w, {_entries} WHERE regexp_matches(l, '(^|[^{O.X}])' || surface || '([^{O.X}]|$)') OR list_contains(ls, lemma) OR (particle <> '' AND regexp_matches(l, '(^|[^{O.X}])' || split_part(surface, ' ', 1) || ' [^,]{{0,38}} ' || particle || '[.!?]*$'))")(lambda s, d: link.found_entries(S.clauses(link_turns(s, d)), link.entries(s)).select("turn_id", "surface").distinct())
query("v03_link_errors", _lt + " SELECT count(*) FILTER (turn_id < 0) AS errors FROM lt")(lambda s, d: contract.validate_links(linked(s, d)["requests"], linked(s, d)["ranked"], match.actions(s)).agg(F.count("*").alias("errors")))
_lo = f"lo AS (SELECT turn_id, lower(text) AS l FROM lt)"
query("j09_interval_antijoin", _lt + f", {_lo} SELECT turn_id, surface, strpos(l, surface) - 1 AS first FROM lo, (VALUES ('the'), ('open the'), ('pen')) v(surface) WHERE contains(l, surface) AND (surface = 'the' OR (surface = 'pen' AND false))")(lambda s, d: _overlap(s, d))


def _overlap(s, d):
    c = S.clauses(link_turns(s, d)).where("clause_no = 1")
    grams = match.ngrams(c).where(F.col("surface").isin("the", "open the")).groupBy("turn_id", "clause_no", "surface").agg(F.min("first").alias("first")).withColumn("end", F.col("first") + F.length("surface"))
    return link.without_overlap(grams, match.contiguous(c, match.aliases(s))).select("turn_id", "surface", long("first").alias("first"))


query("j10_unit_range_join", O.T_CLAUSES + ", w AS (SELECT turn_id, clause_no, clause, unnest(string_split_regex(clause, '(?i) and ')) AS unit, generate_subscripts(string_split_regex(clause, '(?i) and '), 1) AS unit_no FROM ct WHERE contains(clause, ' and ')) SELECT turn_id, clause_no, unit_no FROM w WHERE contains(lower(unit), 'the ')")(lambda s, d: _in_units(s, d))


def _in_units(s, d):
    c = S.clauses(turns(s, d)).where(F.col("clause").contains(" and "))
    parts = c.select("turn_id", "clause_no", F.posexplode(S.places_of(F.col("clause"), S.units_of(F.col("clause")))).alias("i", "u"))
    units = parts.select("turn_id", "clause_no", (F.col("i") + 1).alias("unit_no"), F.col("u.start_index").alias("first"), F.col("u.end_index").alias("end"))
    hits = match.ngrams(c, 1).where("surface = 'the'").select("turn_id", "clause_no", "first")
    return link.unit_at(hits, units).select("turn_id", long("clause_no").alias("clause_no"), long("unit_no").alias("unit_no")).distinct()


_act_known = "SELECT turn_id, kind IN (3) AS negated, kind = 4 AS quoted, kind = 11 AS reported FROM lt"
query("j12_request_flags", _lt + " " + _act_known)(lambda s, d: linked(s, d)["requests"].groupBy("turn_id").agg(F.bool_or("negated").alias("negated"), F.bool_or("quoted").alias("quoted"), F.bool_or("reported").alias("reported")))
query("v05_fail_closed", O.T_TURNS + "SELECT turn_id, CASE WHEN kind = 'blank' THEN 'SBA_ANALYSIS_INVALID' ELSE '' END AS code FROM turns")(lambda s, d: analysis.limits(turns(s, d)).select("turn_id", F.when(F.col("language_status") != "english", "SBA_ANALYSIS_INVALID").otherwise("").alias("code")))
query("v06_build_info", "SELECT 'turnwise' AS engine, '4' AS analysis_version, 8192::BIGINT AS max_chars, 1024::BIGINT AS max_tokens, 32::BIGINT AS max_frames")(lambda s, d: s.range(1).select(*(F.lit(contract.build_info()[k]).cast("long" if k.startswith("max") else "string").alias(k) for k in ("engine", "analysis_version", "max_chars", "max_tokens", "max_frames"))))
query("v01_analysis_errors", O.T_TURNS + "SELECT count(*) AS records, 0::BIGINT AS bad FROM turns")(lambda s, d: contract.validate_analysis(analysis.analyze(turns(s, d))).agg(F.count("*").alias("records"), F.count_if(F.size("errors") > 0).alias("bad")))
query("modal_features", O.T_CLAUSES + f" SELECT turn_id, clause_no, len(list_filter(t, lambda w: w IN {O.members(O.MODALS)})) AS modals FROM ct")(lambda s, d: S.clauses(turns(s, d)).select("turn_id", long("clause_no").alias("clause_no"), long(F.size(F.filter(X.tokenize(F.col("clause")), lambda w: w.isin(*L.MODALS)))).alias("modals")))
