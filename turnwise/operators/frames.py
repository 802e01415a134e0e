"""Compiling turns to frames. One row a piece (a clause or a coordinated part of one); the guards are staged columns, the
first that holds decides and leaves its name in guard. What depends on earlier frames of the turn (pronouns, retractions,
attention calls, dependencies) is a fold or a look over the turn's pieces, which share a partition from the start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.functions import morphology as M
from turnwise.functions import text as X
from turnwise.operators import classify as C
from turnwise.operators import match
from turnwise.operators.segment import places_of, split_clauses, split_coordination

COUNT = r"(?i)^(.*?) (?:(twice)|(thrice)|([a-z]+|[0-9]{1,4}) times?)[.!]*$"
DO_COUNT = r"(?i)^do ([a-z]+|[0-9]{1,4}) ([a-z]+)\b.*$"
FETCH = r"(?i)^((?:please |can you |could you |would you |will you )?)(?:fetch|bring|get|retrieve) (.+?) (?:for|to) (me|us|him|her|them|the user|user)[.!?]*$"
FETCH_FRONT = r"(?i)^((?:please |can you |could you |would you |will you )?)(?:fetch|bring|get|retrieve) (me|us|him|her|them) ((?:the|a|an|my|your|this|that|some) .+?)[.!?]*$"


def counted(piece: Column) -> tuple[Column, Column]:
    """(piece without its count, how often): twice, thrice, N times; 1 where nothing is counted."""
    word = F.lower(F.regexp_extract(piece, COUNT, 4))
    n = F.when(F.regexp_extract(piece, COUNT, 2) != "", 2).when(F.regexp_extract(piece, COUNT, 3) != "", 3).when(word != "", M.number_value(word)).otherwise(1)
    return F.when(n > 1, F.regexp_extract(piece, COUNT, 1)).otherwise(piece), F.greatest(n, F.lit(1))


def do_counted(piece: Column, surfaces) -> tuple[Column, Column]:
    """(verb, how often) of "do N verb": the verb is a one-word surface once its ending is off."""
    word = M.lemma(F.regexp_extract(piece, DO_COUNT, 2))
    n = M.number_value(F.lower(F.regexp_extract(piece, DO_COUNT, 1)))
    known = piece.rlike(DO_COUNT) & (n > 0) & word.isin(*[s for s in surfaces if " " not in s])
    return F.when(known, word).otherwise(""), F.when(known, n).otherwise(0)


def landing(piece: Column) -> Column:
    """What the last of "do N verb" lands on, if the piece says so; else empty."""
    said = X.strip_edges(F.regexp_extract(F.lower(piece), "(?s)^.*land on (.*)$", 1))
    return X.strip_edges(F.regexp_replace(F.regexp_replace(said, r"[?]?!?[.]?$", ""), "^(?:the )?(?:a )?(?:an )?(?:to )?(?:on )?", ""))


def fetched(piece: Column) -> Column:
    """The steps of a fetch: pick the thing up, then give it. One step, the piece itself, for everything else."""
    lead = F.regexp_extract(piece, FETCH, 1)
    back = F.array(F.concat(lead, F.lit("pick up "), F.regexp_extract(piece, FETCH, 2)), F.concat(F.lit("give "), F.regexp_extract(piece, FETCH, 2), F.lit(" to "), F.regexp_extract(piece, FETCH, 3)))
    lead = F.regexp_extract(piece, FETCH_FRONT, 1)
    front = F.array(F.concat(lead, F.lit("pick up "), F.regexp_extract(piece, FETCH_FRONT, 3)), F.concat(F.lit("give "), F.regexp_extract(piece, FETCH_FRONT, 3), F.lit(" to "), F.regexp_extract(piece, FETCH_FRONT, 2)))
    return F.when(piece.rlike(FETCH), back).when(piece.rlike(FETCH_FRONT), front).otherwise(F.array(piece))


def pieces(turns: DataFrame, surfaces, sole, *keep: str) -> DataFrame:
    """turns: turn_id, normalized. turn_id, clause_no (number of the piece), clause (what is compiled), raw (what was said), start_index, end_index,
    times, step, steps, do_times and do_landing ("do N verb": how often, else 0, and where the last ends), normalized. An
    empty turn has no piece. sole: the surfaces of one action, which alone can be counted by "do"."""
    found = X.once(turns, parts=split_clauses(F.col("normalized")), low=F.lower("normalized"))
    found = X.once(found, cut=F.flatten(F.transform("parts", lambda c: split_coordination(c, surfaces))))
    found = found.withColumn("places", places_of(F.col("normalized"), F.col("cut"), F.col("low"))).select("turn_id", "normalized", *keep, F.posexplode("places").alias("i", "c"))
    base, times = counted(F.col("raw"))
    verb, n = do_counted(F.col("raw"), sole)
    found = X.once(found.select("turn_id", "normalized", *keep, "i", F.col("c.text").alias("raw"), "c.start_index", "c.end_index"), verb=verb, do_times=n, do_landing=F.when(n > 0, landing(F.col("raw"))).otherwise(""), base=base, times=times)
    found = found.withColumn("times", F.when(F.col("do_times") > 0, 1).otherwise(F.col("times"))).withColumn("base", F.when(F.col("do_times") > 0, F.col("verb")).otherwise(F.col("base")))
    found = X.once(found, all_steps=fetched(F.col("base"))).select("*", F.posexplode("all_steps").alias("step", "clause"))
    order = Window.partitionBy("turn_id").orderBy("i", "step")
    return found.select("turn_id", "normalized", *keep, F.row_number().over(order).alias("clause_no"), "clause", "raw", "start_index", "end_index", "times", "do_times", "do_landing", "step", F.size("all_steps").alias("steps"))


QUESTION_WORDS = L.QUESTION_WORDS
INDIRECT_QUERY = L.INDIRECT_QUERY
INDIRECT_REQUEST = L.INDIRECT_REQUEST
CANCELS = L.CANCELS
UNCLEAR = L.UNCLEAR
THOUGHT = L.THOUGHT
STATES = L.STATES
DEIXIS = L.DEIXIS
INTERRUPTED = L.INTERRUPTED


def contains_any(c: Column, parts) -> Column:
    return c.rlike(f"(?:{L.any_of(parts)})")


def questions(lower: Column, deeds: list[str]) -> dict[str, Column]:
    """Flags of a clause's mood. deeds: surfaces whose first action is no thought or perception."""
    head = F.get(X.tokenize(X.without_discourse(lower)), F.lit(0))
    tokens = X.tokenize(lower)
    wh = X.starts_any(lower, QUESTION_WORDS)
    auxiliary = X.starts_any(lower, ("does ", "did ", "are ", "is ", "has ")) | (X.starts_any(lower, ("do ", "have ")) & (lower.endswith("?") | C.at(tokens, 1).isin(*L.SUBJECTS, "u")))
    imperative = F.coalesce(~wh & ~auxiliary & ~head.isin(*L.MODALS) & head.isin(*sorted({d.split(" ")[0] for d in deeds})), F.lit(False))
    indirect = contains_any(lower, INDIRECT_QUERY)
    return {"wh": wh, "auxiliary": auxiliary, "imperative_shape": imperative, "indirect_query": indirect, "question": (lower.endswith("?") & ~imperative) | indirect | auxiliary | (wh & ~lower.contains(","))}


def prohibited(lower: Column, surfaces) -> Column:
    """A prohibition opens the clause, unless it is itself a surface of several words."""
    whole = [s for s in surfaces if " " in s]
    return X.starts_any(lower, L.PROHIBITIONS) & ~lower.rlike(f"^(?:{L.any_of(whole)})(?: |$)") if whole else X.starts_any(lower, L.PROHIBITIONS)


def possession(lower: Column) -> Column:
    """The thing asked for in "do you have ...", "have you got ...", "you have ... with you"; empty if none."""
    ask = r"(?s)^.*?(?:do you have |have you got )(.*)$"
    near = r"(?s)^.*?you have (.* with you.*)$"
    thing = F.when(lower.rlike(ask), F.regexp_extract(lower, ask, 1)).when(lower.rlike(near), F.regexp_extract(lower, near, 1)).otherwise("")
    thing = F.regexp_replace(F.regexp_replace(X.strip_edges(thing), r"[.?]+$", ""), "(?s) with you.*$", "")
    return F.regexp_replace(thing, "^(?:(?:the|a|an|your) +)+", "")


def generic_plural(suffix: Column) -> Column:
    """One to three words, no determiner, a plural at the end: "can you open doors" asks for the ability."""
    t = X.tokenize(suffix)
    last = F.get(t, F.size(t) - 1)
    return F.coalesce(F.size(t).between(1, 3) & ~C.at(t, 0).isin(*L.DETERMINERS, "it", "them", "me", "us") & last.endswith("s") & (M.lemma(last) != last), F.lit(False))


def locally_negated(prefix: Column) -> Column:
    """A negation among the last four tokens of the prefix."""
    t = F.slice(X.tokenize(prefix), F.greatest(F.size(X.tokenize(prefix)) - 3, F.lit(1)), 4)
    return (C.first_index(t, lambda w, i: C.negates(w, C.at(t, i + 1)) | w.isin("dont", "avoid", "stop"))) >= 0


def topic(lower: Column) -> Column:
    """What a clause is about: its determined subject of two to four words before a verb of state."""
    bare = F.regexp_replace(lower, "^(?:if|when|since|once|because) ", "")
    subject = F.regexp_extract(bare, r"^((?:the|my|your|this|that)(?: [^\s,]+){1,3}?) (?:is|are|was|were|looks|seems|feels) ", 1)
    return X.trim_target(subject)


def question_topic(lower: Column) -> Column:
    """The only determined noun phrase at the end of a question, of three words at most."""
    t = F.array_join(X.tokenize(lower), " ")
    phrase = r"^(?:.* )?(?:the|my|your|this|that) ((?:[^ ]+)(?: [^ ]+){0,2})$"
    return F.when(F.size(F.filter(X.tokenize(lower), lambda w: w.isin("the", "my", "your", "this", "that"))) == 1, X.trim_target(F.regexp_extract(t, phrase, 1))).otherwise("")


def compile_frames(turns: DataFrame, registry: DataFrame, known: DataFrame, *keep: str) -> DataFrame:
    """turns: turn_id (unique), text. One row a frame: turn_id, frame_no, frame_type, query_kind, speech_act, action,
    object, destination, recipient, candidates, references, evidence, guard, depends_on, count_index, count_total,
    start_index, end_index, raw. A turn over the limits, or empty, has no frame."""
    spark = turns.sparkSession
    listed = match.surfaces(registry).select("surface", F.size("actions").alias("n")).sort("surface").collect()
    surfaces, sole = [r["surface"] for r in listed], [r["surface"] for r in listed if r["n"] == 1]
    thought = {r[0] for r in known.where(F.col("family").isin(*THOUGHT)).select("action").collect()}
    first = registry.groupBy("surface").agg(F.min_by("action", "alias_ord").alias("a")).collect()
    deeds = sorted(r["surface"] for r in first if r["a"] not in thought)
    names = sorted(r[0] for r in known.select("action").collect())

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    short = X.once(turns.select("turn_id", "text", *keep).repartition(n, "turn_id"), normalized=X.normalize(F.col("text"))).where(F.length("normalized") <= L.MAX_CHARS)
    usable = short.where(F.size(X.tokenize(F.col("normalized"))) <= L.MAX_TOKENS)
    cut = pieces(usable, surfaces, sole, *keep)

    one = match.chosen(cut, registry, known)
    return _turn_level(_guards(one, surfaces, deeds, names, known), keep)


def _guards(one: DataFrame, surfaces, deeds, names, known: DataFrame) -> DataFrame:
    lower = X.strip_edges(F.lower("clause"))
    d = X.once(X.once(one, lower=lower), **questions(F.col("lower"), deeds))
    d = X.once(d, retraction=C.is_retraction(F.col("lower")), topic=topic(F.col("lower")), question_topic=F.when(F.col("question"), question_topic(F.col("lower"))).otherwise(""))
    d = d.withColumn("possession", F.when(F.col("question"), possession(F.col("lower"))).otherwise(""))
    # the candidate and its actions; a surface that is one of its actions' names means that one
    d = d.select("*", "hit.surface", F.col("hit.how").alias("how"), "hit.prefix", "hit.lead", "hit.first", F.col("hit.end").alias("verb_end"), "hit.particle_at", "hit.particle_length", F.col("hit.actions").alias("several")).drop("hit")
    named = F.translate("surface", " -", "__")
    d = d.withColumn("candidates", F.when(F.array_contains("several", named) & named.isin(*names), F.array(named)).otherwise(F.col("several"))).drop("several")
    d = d.withColumn("action", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).otherwise(""))
    d = d.join(match.small(known), "action", "left")
    suffix = F.substring("lower", F.col("verb_end") + 1, F.length("lower"))
    payload = F.when(F.col("particle_at") >= 0, F.concat(F.substring("lower", F.col("verb_end") + 1, F.col("particle_at") - F.col("verb_end")), F.substring("lower", F.col("particle_at") + F.col("particle_length") + 1, F.length("lower")))).otherwise(suffix)
    d = X.once(d, suffix=suffix, payload=X.strip_edges(payload))
    why_not = X.has_any_word(F.col("prefix"), ["why don't you", "why not"])
    d = d.withColumn("why_not", F.coalesce(why_not | (F.col("how") == "gerund"), F.lit(False))).withColumn("asks", F.col("question") & ~F.col("why_not"))
    d = X.once(d, prefix_tokens=X.tokenize(F.col("prefix")), after=X.tokenize(F.col("suffix")), asks=F.col("asks"), why_not=F.col("why_not"))
    tokens = F.col("prefix_tokens")
    modal = (C.inverted_modal(tokens) >= 0) | X.has_any_word(F.col("prefix"), ["you can", "you could", "you would", "you will", "you may"])
    d = d.withColumn("addressed", F.coalesce(F.col("asks") & (F.col("target_mode") == "required") & modal & ~generic_plural(F.col("suffix")), F.lit(False)))
    likely = X.has_any_word(F.col("prefix"), ["will probably", "will likely", "will perhaps", "will maybe", "will most likely"])
    told = X.has_any_word(F.col("prefix"), ["you should", "you must", "you can", "you could", "you would"]) | (X.has_any_word(F.col("prefix"), ["you will"]) & ~likely) | (C.inverted_modal(tokens) >= 0)
    boundary = F.col("prefix").rlike("[—;:]$")
    ordered = (F.size(X.tokenize(F.col("lead"))) <= 1) | boundary | F.col("lead").isin("go", "come", "please go", "please come")
    request = X.has_any_word(F.col("prefix"), ["please"]) | told | contains_any(F.col("lower"), INDIRECT_REQUEST) | F.col("why_not") | ordered | (F.col("how") == "narration")
    d = X.once(d, request=F.coalesce(request, F.lit(False)), addressed=F.col("addressed"), told=F.coalesce(told, F.lit(False)))
    told = F.col("told")
    after = F.col("after")
    subject = F.size(after).cast("int") >= 3
    bare = ~C.at(after, 0).isin(*L.DETERMINERS, "it", "them", "me", "us", "all", "every") & ~C.at(after, 1).isin(*L.VERB_BLOCKERS, "and", "or", "then", "now", "please") & C.at(after, 2).isin(*L.DETERMINERS, "it", "them", "me", "us", "him") & C.at(after, 1).isin(*L.VERBS)
    noun_phrase = F.coalesce(subject & bare & ~told & ~F.col("why_not") & (F.col("how") != "narration"), F.lit(False))
    interrupted = X.strip_edges(F.col("suffix")).startswith(",") & F.regexp_extract(C.at(after, 0), "^([^']*)", 1).isin(*INTERRUPTED)
    quoted = X.is_quoted(F.col("lower"), F.col("first"))
    code = X.strip_edges(F.col("suffix")).startswith("(") | F.col("lower").rlike(r'^[{\[]|"action"')
    cancelled = contains_any(F.col("suffix"), CANCELS)
    deferred = (X.has_any_word(F.col("prefix"), ["only"]) & X.has_any_word(F.col("suffix"), ["if", "when", "unless"])) | X.has_any_word(F.col("suffix"), ["only if", "only when"])
    leave = (F.col("surface") == "leave") & (F.col("action") == "drop") & F.get(after, F.size(after) - 1).isin(*STATES)
    none = F.col("surface").isNull()
    guards = [
        ("prohibition", prohibited(F.col("lower"), surfaces) | X.is_reported(F.col("lower")), "conversation", ""),
        ("equipment", contains_any(F.col("lower"), ("on your head", "what are you wearing", "your equipment")), "inventory_query", "equipment"),
        ("possession", F.col("possession") != "", "inventory_query", "has_item"),
        ("emotion", contains_any(F.col("lower"), ("how angry", "are you angry", "how are you feeling", "how do you feel")), "emotion_signal", "emotion_query"),
        ("preference", contains_any(F.col("lower"), ("what do you like", "things do you like", "your preferences")), "emotion_signal", "preference_query"),
        ("threat", contains_any(F.col("lower"), ("watch out", "arrow is coming", "attack you")), "threat_signal", ""),
        ("no_alias", none, "conversation", "conversation"),
        ("ambiguous_alias", F.size("candidates") != 1, "clarification", ""),
        ("mention", (F.col("how") == "mention") & ~F.col("question"), "conversation", "action_mention"),
        ("interjection", interrupted, "conversation", "action_mention"),
        ("delimited", quoted | code, "conversation", "action_mention"),
        ("indirect_query", F.col("indirect_query"), "state_query", "action_history"),
        ("negated", (locally_negated(F.col("prefix")) & ~F.col("why_not")) | cancelled, "conversation", "prohibition"),
        ("leave_state", leave, "conversation", "state_preservation"),
        ("deferred", deferred, "conversation", "conditional_request"),
        ("unclear", contains_any(F.col("lower"), UNCLEAR), "clarification", ""),
        ("question", F.col("asks") & ~F.col("addressed"), "state_query", "action_capability"),
        ("noun_phrase", noun_phrase & ~F.col("addressed"), "conversation", "action_mention"),
        ("no_request", ~F.col("addressed") & ~F.col("request"), "conversation", "action_mention"),
    ]
    guard = F.lit("execute")
    for name, test, *_ in reversed(guards):
        guard = F.when(F.coalesce(test, F.lit(False)), name).otherwise(guard)
    d = X.once(d, guard=guard, surface_kind=F.when(quoted, "quotation").when(code, "code").otherwise(""))
    outcome = M._map({name: kind for name, _, kind, _ in guards} | {"execute": "execute"})
    asked = M._map({name: query for name, _, _, query in guards} | {"execute": ""})
    d = d.withColumns({"outcome": F.element_at(outcome, F.col("guard")), "query_kind": F.element_at(asked, F.col("guard"))})
    # target, place and recipient
    resultative = r"^(it|them|this|that|him|her) ([^ ]*ed)[.!?]*$"
    d = X.once(C.with_target(d, "payload", "whole_target", "recipient"), whole_target=F.col("whole_target"), recipient=F.col("recipient"))
    held = F.col("payload").rlike(resultative) & M.is_verb(F.regexp_extract("payload", resultative, 2))
    d = d.withColumn("whole_target", F.coalesce(F.when(held, F.regexp_extract("payload", resultative, 1)), F.col("whole_target"))).withColumn("recipient", F.when(held, "").otherwise(F.coalesce("recipient", F.lit(""))))
    d = X.once(d.withColumn("target", F.col("whole_target")), recipient=F.col("recipient"), target=F.col("whole_target"))
    d = X.once(C.with_place(d), target=F.col("target"), place=F.col("place"), preposition=F.col("preposition"))
    d = d.withColumn("complement", F.coalesce(F.col("payload").rlike("^(?:if|whether) "), F.lit(False)))
    d = d.withColumn("target", F.when(F.col("complement"), "").otherwise(F.col("target"))).withColumn("place", F.when(F.col("complement"), "").otherwise(F.col("place")))
    if "insert" in names:
        d = d.withColumn("action", F.when((F.col("action") == "place") & F.col("preposition").isin("in", "into", "inside"), "insert").otherwise(F.col("action")))
    here = F.regexp_replace(F.col("payload"), r"(?:[.!?,\s]| please| now)+$", "")
    d = d.withColumn("deixis", F.coalesce(here.isin(*DEIXIS), F.lit(False))).withColumn("target", F.when(F.col("deixis"), "user").otherwise(F.col("target")))
    five = F.coalesce((F.col("action") == "gesture") & F.col("surface").isin(*L.FIVES) & (F.col("target") == ""), F.lit(False))
    d = d.withColumn("five", five).withColumn("target", F.when(F.col("five"), "user").otherwise(F.col("target"))).withColumn("recipient", F.when(F.col("five"), "user").otherwise(F.col("recipient")))
    indefinite = F.col("payload").rlike("^(?:(?:me|us|him|her|them) )*(?:a|an|some|any|another) ")
    return d.withColumn("indefinite", F.coalesce(indefinite, F.lit(False)))


def _missing(target: Column, mode: Column) -> Column:
    return (mode == "required") & ((target == "") | target.isin(*L.PRONOUN_TARGETS, "the other", "other", *L.BARE_PREPOSITIONS) | target.contains("...") | ~X.has_word(target) | target.rlike("[—-]$"))


def _turn_level(d: DataFrame, keep) -> DataFrame:
    # the fold: pronouns take the only target of the frame before, or what that clause was about
    names = [c for c in d.columns if c not in ("turn_id", "clause_no")]
    rows = d.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("clause_no", F.struct(*names).alias("r")))).alias("rows"))
    item = "array<struct<target:string,reference:string,coreference:string>>"
    start = F.struct(F.lit("").alias("target"), F.lit("").alias("topic"), F.lit("").alias("asked"), F.array().cast(item).alias("out"))

    def step(s: Column, x: Column) -> Column:
        r = x["r"]
        pronoun = r["target"].isin(*L.PRONOUN_TARGETS) & (r["outcome"] == "execute")
        near = F.when(s["target"] != "", s["target"]).when(s["topic"] != "", s["topic"]).otherwise(s["asked"])
        why = F.when(s["target"] != "", "coreference:unique_previous_target").when(s["topic"] != "", "coreference:previous_clause_subject").otherwise("coreference:previous_question_topic")
        taken = (pronoun & (near != "")) | (r["complement"] & (s["target"] != ""))
        again = (r["do_times"] > 0) & (r["target"] == "")  # "do N verb" is done to the thing before
        target = F.when(pronoun & (near != ""), near).when((r["complement"] | again) & (s["target"] != ""), s["target"]).otherwise(r["target"])
        last = F.when(r["do_landing"] != "", r["do_landing"]).otherwise(target)
        lasting = (r["outcome"] == "execute") & ~_missing(last, r["target_mode"]) & (last != "")
        note = F.struct(target.alias("target"), F.when(pronoun & taken, r["target"]).otherwise("").alias("reference"), F.when(taken & pronoun, why).when(taken, "coreference:clause_complement_previous_target").otherwise("").alias("coreference"))
        return F.struct(
            F.when(lasting, last).otherwise("").alias("target"),
            F.when(r["outcome"] == "conversation", F.coalesce(r["topic"], F.lit(""))).otherwise("").alias("topic"),
            F.when(r["question"], F.coalesce(r["question_topic"], F.lit(""))).otherwise("").alias("asked"),
            F.concat(s["out"], F.array(note)).alias("out"),
        )

    notes = rows.withColumn("notes", F.aggregate("rows", start, step, lambda s: s["out"]))
    each = notes.select("turn_id", F.explode(F.arrays_zip("rows", "notes")).alias("z"))
    d = each.select("turn_id", "z.rows.clause_no", "z.rows.r.*", F.col("z.notes.target").alias("solved"), F.col("z.notes.reference").alias("reference"), F.col("z.notes.coreference").alias("coreference"))
    # "do N verb": a frame each time, the last one where it lands; what the turn may hold at most is cut further down
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.greatest("do_times", F.lit(1)), F.lit(L.MAX_FRAMES + 1)))))
    d = d.withColumn("lands", (F.col("do_landing") != "") & (F.col("nth") == F.col("do_times"))).withColumn("solved", F.when(F.col("lands"), F.col("do_landing")).otherwise(F.col("solved")))
    run = d["outcome"] == "execute"
    narrated = run & (F.col("how") == "narration")
    state = run & ~narrated & F.col("solved").isin("free", "loose", "shut", "closed", "open", "apart")
    missing = run & ~narrated & ~state & _missing(F.col("solved"), F.col("target_mode"))
    guard = F.when(narrated, "narration").when(state, "resultative").when(missing, "missing_target").otherwise(F.col("guard"))
    kind = F.when(narrated | state, "conversation").when(missing, "clarification").when(run, F.when(F.col("action").isin(*L.INVENTORY_ACTIONS), "inventory_action").otherwise("world_action")).otherwise(F.col("outcome"))
    query = F.when(narrated, "self_narration").when(state, "action_mention").otherwise(F.col("query_kind"))
    d = d.withColumns({"guard": guard, "frame_type": kind, "query_kind": query})
    # a later retraction takes back what could be done
    turn = Window.partitionBy("turn_id").orderBy("clause_no", "nth")
    later = F.coalesce(F.max("retraction").over(turn.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    back = later & F.col("frame_type").isin("world_action", "inventory_action", "clarification")
    d = d.withColumns({"guard": F.when(back, "retracted").otherwise(F.col("guard")), "query_kind": F.when(back, "prohibition").otherwise(F.col("query_kind")), "frame_type": F.when(back, "conversation").otherwise(F.col("frame_type"))})
    # calls for attention before something to do or to answer
    following = F.lead("frame_type").over(turn)
    bare = F.regexp_replace(F.lower("raw"), r"[,;!.\s]+$", "")
    calls = bare.isin(*L.ATTENTION) & (F.col("frame_type") == "world_action") & (F.col("solved") == "") & (following.isin("world_action", "inventory_action", "clarification") | following.endswith("query"))
    d = d.withColumn("calls", F.coalesce(calls, F.lit(False)))
    d = d.withColumns({"guard": F.when(F.col("calls"), "attention").otherwise(F.col("guard")), "query_kind": F.when(F.col("calls"), "discourse_marker").otherwise(F.col("query_kind")), "frame_type": F.when(F.col("calls"), "conversation").otherwise(F.col("frame_type"))})
    # plain coordination without a reference back does not depend on what came before
    between = F.lower(F.substring("normalized", F.lag("end_index").over(turn) + 1, F.col("start_index") - F.lag("end_index").over(turn)))
    words = X.tokenize(between)
    plain = F.array_contains(words, "and") & ~between.rlike("[;.]") & ~F.arrays_overlap(words, F.array(*map(F.lit, ("then", "after", "afterwards", "finally", "next", "later", "first", "before")))) & (F.col("reference") == "") & ~F.col("solved").isin(*L.PRONOUN_TARGETS)
    d = d.withColumn("plain", F.coalesce(plain, F.lit(False)) & (F.col("step") == 0))
    executable = F.col("frame_type").isin("world_action", "inventory_action")
    d = d.withColumn("times", F.when(executable, F.col("times")).otherwise(1))
    d = d.withColumn("count_index", F.explode(F.sequence(F.lit(1), "times")))
    done = F.col("do_times") > 0
    d = d.withColumn("count_index", F.when(done, F.col("nth")).otherwise(F.col("count_index"))).withColumn("times", F.when(done, F.col("do_times")).otherwise(F.col("times"))).withColumn("counted", done | (F.col("times") > 1))
    order = Window.partitionBy("turn_id").orderBy("clause_no", "count_index")
    whole = Window.partitionBy("turn_id")
    d = d.withColumn("frame_no", F.row_number().over(order)).withColumn("frames", F.count("*").over(whole)).where(F.col("frames") <= L.MAX_FRAMES)
    evidence = F.array_compact(F.array(F.concat(F.lit("guard:"), F.col("guard")), F.when(F.col("coreference") != "", F.col("coreference")), F.when(F.col("indefinite") & executable, F.lit("target_reference:indefinite")), F.when(F.col("deixis") & executable, F.lit("deixis:user_location")), F.when(F.col("preposition").isin("in", "into", "inside") & (F.col("action") == "insert"), F.lit("preposition:containment")), F.when(F.col("five") & executable, F.when(F.col("surface") == "hit five", "typo_resolution:hit_five_to_high_five").otherwise("gesture:addressee_user")), F.when(F.col("counted"), F.concat(F.lit("counted_action:"), F.col("count_index"), F.lit("/"), F.col("times"))), F.when(F.col("lands"), F.lit("override:final_destination"))))
    acts = executable | (F.col("frame_type") == "clarification") | (F.col("guard").isin("narration", "retracted"))
    named = ~F.col("guard").isin("prohibition", "no_alias", "ambiguous_alias", "equipment", "possession", "emotion", "preference", "threat", "leave_state")
    act = (
        F.when(executable | (F.col("frame_type") == "clarification"), "request").when(F.col("guard") == "leave_state", "request")
        .when(F.col("frame_type").isin("state_query", "inventory_query", "emotion_signal"), "question")
        .when(F.col("guard").isin("prohibition", "no_alias") & F.col("question"), "question").otherwise("statement")
    )
    # what stands behind "and" and a verb's base form is another deed: the span ends before it
    more = F.regexp_instr(F.lower("raw"), F.lit(f" and (?:{L.any_of([v for v in L.VERBS if '_' not in v])})(?![{L.LEXICAL_CLASS}])")) - 1
    d = d.withColumn("end_index", F.when(more >= 0, F.least("end_index", F.col("start_index") + more)).otherwise(F.col("end_index")).cast("int"))
    empty = F.lit("")
    return d.select(
        "turn_id", *keep, "frame_no", "frame_type", "query_kind", act.alias("speech_act"),
        F.when(named, F.coalesce("action", empty)).otherwise(empty).alias("action"),
        F.when(F.col("guard") == "possession", F.col("possession")).when(F.col("guard") == "threat", F.when(F.col("lower").contains("arrow"), "arrow").when(F.col("lower").contains("attack"), "attack").otherwise("danger")).when(acts & (F.col("guard") != "ambiguous_alias"), F.col("solved")).otherwise(empty).alias("object"),
        F.when(executable, F.when(F.col("place") != "", F.col("place")).otherwise(F.col("solved"))).otherwise(empty).alias("destination"),
        F.when(executable, F.col("recipient")).otherwise(empty).alias("recipient"),
        F.when(F.col("frame_type") == "clarification", F.array_join("candidates", ",")).otherwise(empty).alias("candidates"),
        F.col("reference").alias("references"), evidence.alias("evidence"), "guard",
        F.when((F.col("frame_no") > 1) & ~F.col("plain"), F.col("frame_no") - 1).alias("depends_on"),
        F.when(F.col("counted"), F.col("count_index")).cast("string").alias("count_index"), F.when(F.col("counted"), F.col("times")).cast("string").alias("count_total"),
        "start_index", "end_index", "raw",
    )
