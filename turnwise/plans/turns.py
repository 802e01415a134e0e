"""Turns to analyze. The tables hold no English commands, so commands are made from their rows, by one SQL expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.sources.tables import read, spread

#: {o}: the thing, {p}: a second thing; each tests what its name says.
TEMPLATES = (
    ("direct", "Open the {o}."), ("polite", "Please close the {o}."), ("modal", "Can you open the {o}?"), ("prohibition", "Do not open the {o}."), ("negation", "You should never open the {o}."), ("quotation", '"Open the {o}" was on the sign.'),
    ("past", "I opened the {o} yesterday."), ("question", "Did you open the {o}?"), ("condition", "If it rains, close the {o}."), ("coordination", "Open the {o} and close the {p}."), ("comma", "Open the {o}, close it."), ("sequence", "Open the {o} then close the {p}."),
    ("counted", "Jump 3 times."), ("retraction", "Open the {o}. Never mind."), ("missing", "Open it."), ("answer", "I meant the {o}."), ("unknown", "Frobnicate the {o}."), ("particle", "Pick the {o} up."), ("recipient", "Give the {o} to me."), ("containment", "Put the {o} in the {p}."),
    ("attention", "Wait; open the {o}."), ("fetch", "Fetch the {o} for me."), ("canonical", "Break the {o}."), ("ambiguous", "Lift the {o}."), ("modal_statement", "You could pass me the {o}?"), ("ability", "Can you jump?"), ("wh", "Where is the {o}?"), ("possession", "Do you have the {o}?"),
    ("preference", "What do you like?"), ("threat", "Watch out, the {o} is falling!"), ("deferred", "Only open the {o} when the bell rings."), ("topic", "The {o} is heavy. Pick it up."), ("equipment", "What are you wearing?"), ("three", "Open the {o}! Close the {p}! Drop it."), ("blank", "   "), ("narration", "We opened the {o} while walking to the {p}."),
    ("tail", "I left the {o} here, did you notice it?"), ("feeling", "How are you feeling?"), ("place", "Throw the {o} at the {p}."), ("front", "Hand me the {o}."), ("pending", "Use the {o} as the target."), ("competing", "I meant the {o} or the {p}."), ("code", '{{"action": "open"}}'), ("twice", "Open the {o} twice."),
    ("indirect", "I need you to repair the {o}."), ("title", "Mr. Smith saw the {o}. Read the {p}."), ("leave", "Leave the {o} closed."), ("multiword", "Get rid of the {o}."), ("adverb", "Carefully clean the {o}."), ("future", "You will probably examine the {o}."), ("report", "Anna told you to open the {o}."), ("why", "Why don't you open the {o}?"),
    ("gerund", "Would you mind opening the {o}?"), ("shared", "Open and close the {o}."), ("nouns", "Open the {o} and the {p}."), ("bring", "Can you bring me the {o}?"),
    ("hedge", "Maybe you can open the {o}."), ("assuming", "Assuming it rains, close the {o}."), ("not_you", "Not you open the {o}."), ("not_now", "Open the {o}. Not now."),
    ("told_of", "Sam opened the {o}."), ("noun_subject", "Open windows make the {o} cold."), ("complement", "Open the {o} and examine if the {p} moves."), ("resultative", "Break free."),
    ("span_cut", "Open the {o} and write to Sam."), ("five", "High five!"), ("again", "Throw the {o}. Do 2 throws."), ("landing", "Throw the {o}. Do 2 throws, land on the {p}."),
)

def _expression(template: str, thing: str, other: str) -> str:
    """SQL of one template; apostrophes are written as chr(39), which all engines read alike."""
    parts: list[str] = []
    for piece in template.replace("{{", "{").replace("}}", "}").replace("{o}", "\0o\0").replace("{p}", "\0p\0").split("\0"):
        if piece in ("o", "p"):
            parts.append(thing if piece == "o" else other)
        elif piece:
            parts += [x for k, text in enumerate(piece.split("'")) for x in (["chr(39)"] if k else []) + ([f"'{text}'"] if text else [])]
    return " || ".join(parts)


def turns_sql() -> str:
    """turn_id, conv_id, turn, kind, text: one turn for each part, four turns a conversation."""
    text = " ".join(f"WHEN {k} THEN {_expression(t, 'lower(p_name)', 'lower(p_type)')}" for k, (_, t) in enumerate(TEMPLATES))
    kind = " ".join(f"WHEN {k} THEN '{name}'" for k, (name, _) in enumerate(TEMPLATES))
    n = len(TEMPLATES)
    return f"SELECT p_partkey AS turn_id, CAST(floor(p_partkey / 4) AS BIGINT) AS conv_id, p_partkey % 4 AS turn, CASE p_partkey % {n} {kind} END AS kind, CASE p_partkey % {n} {text} END AS text FROM part"


def utterances_sql() -> str:
    """turn_id, text: the made turns and the raw conversations, whose ids are negative."""
    return f"SELECT turn_id, text FROM ({turns_sql()}) t UNION ALL SELECT -(conv_id * 1000 + turn) - 1 AS turn_id, text FROM conversations"


def _query(spark: SparkSession, sf_dir: str, sql: str, over=lambda df: df) -> DataFrame:
    for name in ("part", "conversations"):
        if f"FROM {name}" in sql:
            over(read(spark, sf_dir, name)).createOrReplaceTempView(f"turnwise_{name}")
            sql = sql.replace(f"FROM {name}", f"FROM turnwise_{name}")
    return spark.sql(sql)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, turns_sql())


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, utterances_sql(), spread)
