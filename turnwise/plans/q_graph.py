"""Queries of the lexicon work (sources, closures, paths, precedence, categories), with a small lexicon in the files' own
formats, and of set and aggregate operators over the tables. The graph for the oracles is the same lexicon as VALUES, or
is made from the rows of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import lexicon as L
from turnwise.operators import contract, lexical_graph as G
from turnwise.sources import lexical_files as S
from turnwise.sources.tables import scratch

QUERIES, ORACLE = {}, {}

#: Fixture of our own: verb synsets (offset, lex number, words, [(relation, target)], gloss).
VERB_SYNSETS = (
    ("00000100", 36, ("make", "create"), (("~", "00000200"), ("~", "00000300")), "bring into being"),
    ("00000200", 36, ("build", "construct"), (("@", "00000100"), ("~", "00000400")), "make by combining parts"),
    ("00000300", 36, ("cook", "prepare"), (("@", "00000100"), ("~", "00000500"), ("~", "00000600")), "make food ready"),
    ("00000400", 36, ("assemble", "put_together"), (("@", "00000200"),), "build from pieces"),
    ("00000500", 30, ("boil",), (("@", "00000300"), ("*", "00000700")), "cook in hot water"),
    ("00000600", 30, ("fry", "brown"), (("@", "00000300"),), "cook in fat"),
    ("00000700", 30, ("heat", "heat_up"), (("~", "00000500"),), "make hot or hotter"),
    ("00000800", 35, ("open", "open_up"), (("!", "00000900"),), "cause to open"),
    ("00000900", 35, ("close", "shut"), (("!", "00000800"),), "move so that an opening is shut"),
    ("00001000", 38, ("jump", "leap"), (("~", "00001100"),), "move upward by the legs"),
    ("00001100", 38, ("hop",), (("@", "00001000"),), "jump lightly"),
)
#: word, senses in order, senses seen in use
VERB_INDEX = (("make", ("00000100",), 1), ("create", ("00000100",), 1), ("build", ("00000200",), 1), ("construct", ("00000200",), 1), ("cook", ("00000300",), 1), ("prepare", ("00000300", "00000200"), 1), ("assemble", ("00000400",), 1), ("put_together", ("00000400",), 0), ("boil", ("00000500", "00000700"), 1), ("fry", ("00000600",), 1), ("brown", ("00000700", "00000600"), 2), ("heat", ("00000700",), 1), ("heat_up", ("00000700",), 1), ("open", ("00000800",), 1), ("open_up", ("00000800",), 1), ("close", ("00000900",), 1), ("shut", ("00000900",), 1), ("jump", ("00001000",), 1), ("leap", ("00001000",), 1), ("hop", ("00001100",), 1))
ADVERBS = ("up", "down", "together", "away")
EXCEPTIONS = (("built", "build"), ("shut", "shut"), ("made", "make"), ("leapt", "leap"), ("leapt", "hop"), ("put-up", "make"), ("sang", "sing"))
LEXNAMES = ((30, "verb.change", 2), (35, "verb.contact", 2), (36, "verb.creation", 2), (38, "verb.motion", 2))
TAGS = (("make%2:36:00::", "00000100", 1, 90), ("build%2:36:00::", "00000200", 1, 40), ("cook%2:36:00::", "00000300", 1, 35), ("open%2:35:00::", "00000800", 1, 70), ("hop%2:38:00::", "00001100", 1, 5))
ANCHORS = (("create", "00000100"), ("cook", "00000300"), ("open", "00000800"), ("jump", "00001000"))
#: mode, surface, action, confidence
HAND = (("promote", "whip up", "cook", "0.95"), ("promote", "boil", "cook", "0.99"), ("forbid", "heat", "cook", "0.00"), ("forbid", "prepare", "cook", "0.00"))
NAMED = (("pot", 0, 3, "vessel"), ("pot", 0, 4, "cookware"), ("pot", 1, 2, "small"), ("pot", 1, 2, "medium"), ("pan", 0, 4, "cookware"), ("pan", 2, 1, "large"), ("pan", 5, 1, "tool"), ("pan", 7, 1, "weapon"), ("X-ray", 0, 2, "image"))


def files() -> dict[str, list[str]]:
    """The fixture's files, line by line."""
    data = [f"{o} {n:02d} v {len(w):02x} " + " ".join(f"{x} 0" for x in w) + f" {len(e):03d} " + "".join(f"{r} {t} v 0000 " for r, t in e) + f"00 | {g}  " for o, n, w, e, g in VERB_SYNSETS]
    index = ["  1 header line"] + [f"{w} v {len(s)} 1 @ {len(s)} {seen} " + " ".join(s) + "  " for w, s, seen in VERB_INDEX]
    return {
        "data.verb": ["  1 header line", *data], "index.verb": index, "index.adv": ["  1 header line", *(f"{w} r 1 0 1 0 0000000{i}  " for i, w in enumerate(ADVERBS))],
        "verb.exc": [f"{a} {b}" for a, b in EXCEPTIONS], "lexnames": [f"{n}\t{x}\t{p}" for n, x, p in LEXNAMES], "index.sense": [f"{k} {o} {n} {t}" for k, o, n, t in TAGS], "roots.tsv": ["# comment", *(f"{a}\t{o}" for a, o in ANCHORS)],
    }


_written: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The fixture written where executors read it too: spark.checkpoint.dir, or a folder of our own in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        path = scratch(spark, "lexicon")
        for name, rows in files().items():
            spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{path}/{name}")
        _written[app] = path
    return _written[app]


#: Files with names: folder and name, text.
NAMED_FILES = {"inventory/drop.tres": "drop a thing", "inventory/give.tres": "give it", "physical/jump.tres": "jump", "physical/wave.tres": "wave é"}


def named_files(spark: SparkSession) -> str:
    """The folder of the named files, written for each use."""
    path = scratch(spark, "named")
    for name, text in NAMED_FILES.items():
        S.put_file(spark, f"{path}/{name}", text)
    return path


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def values(rows, names: str) -> str:
    put = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(put, r)) + ")" for r in rows) + f") v({names}))"


long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
WORDS = values([(o, w, i) for o, _, ws, _, _ in VERB_SYNSETS for i, w in enumerate(ws)], "off, word, word_ord")
EDGES = values([(o, r, t) for o, _, _, es, _ in VERB_SYNSETS for r, t in es], "src, rel, dst")
INDEX = values([(w, seen, k, o) for w, s, seen in VERB_INDEX for k, o in enumerate(s)], "word, observed, sense_rank, off")

# Sources
query("io02_lexnames", f"SELECT CAST(n AS BIGINT) AS number, name FROM {values(LEXNAMES, 'n, name, pos')}")(lambda s, d: S.lexnames(s, f"{folder(s)}/lexnames").select(long("number").alias("number"), "name"))
query("io03_index", f"SELECT word, CAST(observed AS BIGINT) AS observed, CAST(sense_rank AS BIGINT) AS sense_rank, off AS sense FROM {INDEX}")(lambda s, d: S.index(s, f"{folder(s)}/index.verb").select("word", long("observed").alias("observed"), long("sense_rank").alias("sense_rank"), F.col("offset").alias("sense")))
query("io04_data_words", f"SELECT off AS synset, word, CAST(word_ord AS BIGINT) AS word_ord FROM {WORDS}")(lambda s, d: S.data_words(s, f"{folder(s)}/data.verb").select(F.col("offset").alias("synset"), "word", long("word_ord").alias("word_ord")))
query("io04_data_edges", f"SELECT src AS source, rel AS relation, dst AS target FROM {EDGES}")(lambda s, d: S.data_edges(s, f"{folder(s)}/data.verb").select("source", "relation", "target"))
query("io05_adverbs", f"SELECT word FROM {values([(w,) for w in ADVERBS], 'word')}")(lambda s, d: S.adverbs(s, f"{folder(s)}/index.adv"))
query("io06_glosses", f"SELECT off AS synset, gloss FROM {values([(o, g) for o, _, _, _, g in VERB_SYNSETS], 'off, gloss')}")(lambda s, d: S.data_words(s, f"{folder(s)}/data.verb").where("word_ord = 0").select(F.col("offset").alias("synset"), "gloss"))
query("io07_sense_tags", f"SELECT split_part(k, '%', 1) AS word, off AS synset, CAST(n AS BIGINT) AS tags FROM {values([(k, o, t) for k, o, _, t in TAGS], 'k, off, n')}")(lambda s, d: S.sense_tags(s, f"{folder(s)}/index.sense").select("word", F.col("offset").alias("synset"), long("count").alias("tags")))
_lemmas = lambda s: S.index(s, f"{folder(s)}/index.verb").select(F.col("word").alias("lemma")).distinct()
_exc = values([(i, a, b) for i, (a, b) in enumerate(EXCEPTIONS)], "line, form, base")
query("io08_exceptions", f"SELECT form, arg_min(base, line) AS base FROM {_exc} WHERE NOT regexp_matches(form, '[_-]') AND form NOT IN (SELECT word FROM {INDEX}) AND base IN (SELECT word FROM {INDEX}) GROUP BY form")(lambda s, d: G.first_bases(S.exceptions(s, f"{folder(s)}/verb.exc"), _lemmas(s)))
query("io09_families", f"SELECT DISTINCT action, family FROM {values([(f.split('/')[1].split('.')[0], f.split('/')[0]) for f in NAMED_FILES], 'action, family')}")(lambda s, d: S.families(s, named_files(s)))
query("io10_table", f"SELECT action, off AS synset FROM {values(ANCHORS, 'action, off')}")(lambda s, d: S.table(s, f"{folder(s)}/roots.tsv", "action string, synset string"))
query("io01_turn_source", "SELECT role, count(*) AS turns FROM conversations GROUP BY role")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("role").agg(F.count("*").alias("turns")))
query("io12_json_rows", "SELECT n_nationkey, CAST(to_json({'key': n_nationkey, 'name': n_name}) AS VARCHAR) AS json FROM nation")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.as_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("json")))
_per_cent = lambda c: f"printf('%.2f', {c})"
_quote = lambda sql: "chr(34) || " + sql + " || chr(34)"
_candidate = "'{' || chr(34) || 'action' || chr(34) || ':' || " + _quote("'line ' || l_linenumber") + " || ',' || chr(34) || 'relation' || chr(34) || ':' || " + _quote("l_returnflag") + " || ',' || chr(34) || 'confidence' || chr(34) || ':' || " + _per_cent("l_discount") + " || ',' || chr(34) || 'role_compatibility' || chr(34) || ':' || " + _per_cent("l_tax") + " || '}'"
query("io12_graph_entries", "SELECT 'order ' || o_orderkey AS surface, '{' || chr(34) || 'surface' || chr(34) || ':' || " + _quote("'order ' || o_orderkey") + " || ',' || chr(34) || 'lemma' || chr(34) || ':' || " + _quote("o_orderstatus") + " || ',' || chr(34) || 'particle' || chr(34) || ':' || chr(34) || chr(34) || ',' || chr(34) || 'candidates' || chr(34) || ':[' || coalesce(c, '') || ']}' AS json FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(" + _candidate + ", ',' ORDER BY round(l_discount, 2) DESC, 'line ' || l_linenumber, l_returnflag, round(l_tax, 2)) AS c FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")(lambda s, d: S.graph_entries(*_order_graph(s, d)))
query("io11_json_update", "SELECT event_id, '{' || chr(34) || 'user' || chr(34) || ':' || CAST(user_id AS VARCHAR) || ',' || chr(34) || 'k' || chr(34) || ':' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS VARCHAR) || ',' || chr(34) || 'kind' || chr(34) || ':' || CAST(to_json(event_type) AS VARCHAR) || '}' AS json FROM events")(lambda s, d: _updated(s, d))
query("io13_row_digest", "SELECT n_nationkey, sha256(n_name || ':' || CAST(n_regionkey AS VARCHAR)) AS digest FROM nation")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.sha2(F.concat_ws(":", "n_name", F.col("n_regionkey").cast("string")), 256).alias("digest")))
query("io13_check", "SELECT * FROM (VALUES ('again', 'unchanged'), ('changed', 'DIFFERS'), ('fewer', 'DIFFERS')) v(what, state)")(lambda s, d: _checked(s, d))


@query("io14_round_trip", "SELECT n_nationkey, n_name FROM nation")
def _round_trip(s, d):
    """Written as one ordered JSON file and read back."""
    path = f"{folder(s)}/nation-{uuid.uuid4().hex}"
    S.write_json(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), path, "n_nationkey")
    return s.read.schema("n_nationkey int, n_name string").json(path)


query("io15_manifest", f"SELECT name, octet_length(encode(text)) AS bytes, sha256(text) AS sha256 FROM {values([(f.split('/')[1], t) for f, t in NAMED_FILES.items()], 'name, text')}")(lambda s, d: S.manifest(s, named_files(s)))
query("io16_text_sink", "SELECT n_name AS value FROM nation")(lambda s, d: _text_sink(s, d))


def _updated(s, d):
    """Two keys of a catalogue are set one after the other, one it has and one it lacks; the third stays as it is."""
    props = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(","), F.expr("substring(props, 2)"))
    k = F.from_json("props", "k long")["k"]
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", props.alias("json"), (k + 1).cast("string").alias("k"), F.to_json(F.array("event_type")).alias("kind"))
    return rows.select("event_id", S.put_key(S.put_key(F.col("json"), "k", F.col("k")), "kind", F.expr("substring(kind, 2, length(kind) - 2)")).alias("json"))


def _order_graph(s, d):
    """Orders as entries, their lines as candidates: a graph as large as the tables."""
    named = lambda c: F.concat(F.lit("order "), F.col(c).cast("string")).alias("surface")
    entries = s.read.parquet(f"{d}/orders.parquet").select(named("o_orderkey"), F.col("o_orderstatus").alias("lemma"), F.lit("").alias("particle"))
    lines = s.read.parquet(f"{d}/lineitem.parquet").select(named("l_orderkey"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("action"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("role_compatibility"))
    return entries, lines


def _checked(s, d):
    """A table against its own file, and against it with one value changed and one row less."""
    rows = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")
    path = f"{folder(s)}/checked-{uuid.uuid4().hex}"
    S.write_json(rows, path, "n_nationkey")
    other = rows.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "elsewhere").otherwise(F.col("n_name")))
    cases = {"again": rows, "changed": other, "fewer": rows.where("n_nationkey <> 3")}
    found = [S.checked(df, path).select(F.lit(what).alias("what"), "state") for what, df in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _text_sink(s, d):
    path = f"{folder(s)}/turns-{uuid.uuid4().hex}"
    s.read.parquet(f"{d}/nation.parquet").select("n_name").write.text(path)
    return s.read.text(path)


# Lexicon as tables
_index = lambda s: S.index(s, f"{folder(s)}/index.verb")
_edges = lambda s: S.data_edges(s, f"{folder(s)}/data.verb")
_anchors = lambda s: s.createDataFrame(list(ANCHORS), "action string, offset string")
_ranked = lambda s: _index(s).join(S.data_words(s, f"{folder(s)}/data.verb").select("offset", "word", "word_ord"), ["offset", "word"])
_use = "(sense_rank = 0 OR observed < 2 OR sense_rank < observed)"
query("m08_sense_in_use", f"SELECT word, off AS synset, {_use} AS used FROM {INDEX}")(lambda s, d: _index(s).select("word", F.col("offset").alias("synset"), G.sense_in_use(F.col("sense_rank"), F.col("observed")).alias("used")))
query("m09_particles", f"SELECT DISTINCT word, string_split(word, '_')[-1] AS particle FROM {INDEX} WHERE contains(word, '_') AND string_split(word, '_')[-1] IN (SELECT word FROM {values([(w,) for w in ADVERBS], 'word')})")(lambda s, d: _lemmas(s).where(F.col("lemma").contains("_")).select(F.col("lemma").alias("word"), F.element_at(F.split("lemma", "_"), -1).alias("particle")).join(S.adverbs(s, f"{folder(s)}/index.adv").withColumnRenamed("word", "particle"), "particle", "left_semi"))
query("m10_names", "SELECT DISTINCT s_name AS name, NOT regexp_matches(s_name, '[0-9()]') AND (NOT regexp_matches(s_name, '[A-Z]') OR regexp_matches(s_name, '^[A-Z]-[a-z]+$')) AS is_name FROM supplier UNION SELECT DISTINCT p_name, NOT regexp_matches(p_name, '[0-9()]') AND NOT regexp_matches(p_name, '[A-Z]') FROM part")(lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("name")).union(s.read.parquet(f"{d}/part.parquet").select("p_name")).distinct().select("name", G.is_name(F.col("name")).alias("is_name")))
_stop = ", ".join(f"'{w}'" for w in G.STOPWORDS)
query("m11_keywords", f"SELECT p_partkey, array_to_string(list_distinct_order[1:30], ' ') AS words FROM (SELECT p_partkey, list_reduce([[]] || list_transform(list_filter(regexp_extract_all(lower(p_type || ' with a ' || p_name || ' of the ' || p_brand), '[a-z]+'), lambda w: w NOT IN ({_stop}) AND NOT list_contains(regexp_extract_all(lower(p_name), '[a-z]+'), w)), lambda w: [w]), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_order FROM part)")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(G.keywords(F.concat("p_type", F.lit(" with a "), "p_name", F.lit(" of the "), "p_brand"), F.col("p_name"), F.array().cast("array<string>")), " ").alias("words")))
query("m12_nth_sense", f"SELECT word, off AS synset FROM {INDEX} WHERE sense_rank = 1")(lambda s, d: _index(s).where("sense_rank = 1").select("word", F.col("offset").alias("synset")))
_down = f"WITH RECURSIVE e AS {EDGES}, below(root, node, depth) AS (SELECT action, off, 0 FROM {values(ANCHORS, 'action, off')} UNION SELECT root, dst, depth + 1 FROM below JOIN e ON src = node AND rel = '~' WHERE depth < 20"
_roots = lambda s: _anchors(s).select(F.col("action").alias("root"), F.col("offset").alias("node"))
query("s01_closure", _down + " AND NOT (root = 'create' AND dst = '00000600')) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM below GROUP BY ALL")(lambda s, d: G.closure(_roots(s), _edges(s).where("relation = '~'"), s.createDataFrame([("create", "00000600")], "root string, node string"), 6).select("root", "node", long("depth").alias("depth")))


@query("s01_closure_recursive_sql", _down + ") SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM below GROUP BY ALL")
def _recursive(s, d):
    _roots(s).createOrReplaceTempView("roots")
    _edges(s).where("relation = '~'").createOrReplaceTempView("edges")
    s.createDataFrame([], "root string, node string").createOrReplaceTempView("stops")
    return s.sql(G.closure_sql()).select("root", "node", long("depth").alias("depth"))


query("a13_depth", _down + ") SELECT root, CAST(max(depth) AS BIGINT) AS depth, count(DISTINCT node) AS nodes FROM below GROUP BY root")(lambda s, d: G.closure(_roots(s), _edges(s).where("relation = '~'"), _roots(s).where("false"), 6).groupBy("root").agg(long(F.max("depth")).alias("depth"), F.countDistinct("node").alias("nodes")))
query("s02_union_and_difference", _down + ") SELECT DISTINCT node FROM below WHERE root IN ('create', 'cook') EXCEPT SELECT node FROM below WHERE root = 'jump'")(lambda s, d: (lambda c: c.where("root in ('create', 'cook')").select("node").distinct().join(c.where("root = 'jump'").select("node"), "node", "left_anti"))(G.closure(_roots(s), _edges(s).where("relation = '~'"), _roots(s).where("false"), 6)))
_pairs = f"(SELECT a.off AS a, b.off AS b FROM {values([(o,) for o, *_ in VERB_SYNSETS], 'off')} a, {values([(o,) for o, *_ in VERB_SYNSETS], 'off')} b WHERE a.off <= b.off)"
_both = f"(SELECT src, rel AS sign, dst FROM {EDGES} UNION ALL SELECT dst, '^' || rel, src FROM {EDGES})"
query("s03_short_paths", f"WITH e AS {_both}, p AS {_pairs}, o AS (SELECT a, b, min(1 || '|' || sign || ':' || b) AS k FROM p JOIN e ON a = src AND b = dst GROUP BY ALL), t AS (SELECT a, b, min(2 || '|' || x.sign || ':' || x.dst || ',' || y.sign || ':' || b) AS k FROM p JOIN e x ON x.src = a JOIN e y ON y.src = x.dst AND y.dst = b GROUP BY ALL) SELECT p.a, p.b, CASE WHEN p.a = p.b THEN '' ELSE coalesce(substr(coalesce(o.k, t.k), 3), 'override-only') END AS path FROM p LEFT JOIN o USING (a, b) LEFT JOIN t USING (a, b)")(lambda s, d: G.short_paths(_edges(s), (lambda x: x.select(F.col("offset").alias("a")).join(x.select(F.col("offset").alias("b")), F.col("a") <= F.col("b")))(S.data_words(s, f"{folder(s)}/data.verb").select("offset").distinct())))
query("s04_generalize", _down.replace("depth < 20", "depth < 2") + f") SELECT replace(word, '_', ' ') AS surface, root AS action, CAST(min(depth) AS BIGINT) AS depth, CAST(80 - 15 * (min(depth) - 1) AS BIGINT) AS confidence FROM below JOIN {INDEX} i ON i.off = node AND sense_rank = 0 WHERE depth > 0 GROUP BY ALL")(lambda s, d: G.generalized(_anchors(s), _index(s), _edges(s).where("relation = '~'"), 2).select("surface", "action", long("depth").alias("depth"), long(F.col("confidence") * 100).alias("confidence")))
query("j15_generated_synonyms", f"SELECT DISTINCT replace(word, '_', ' ') AS surface, action FROM {values(ANCHORS, 'action, off')} a JOIN {INDEX} i USING (off) WHERE {_use}")(lambda s, d: G.generated(_anchors(s), _index(s)).select("surface", "action"))
_made = f"(SELECT DISTINCT replace(word, '_', ' ') AS surface, action, 90 AS confidence FROM {values(ANCHORS, 'action, off')} a JOIN {INDEX} i USING (off) WHERE {_use})"
_handv = values([(m, a, b, int(float(c) * 100)) for m, a, b, c in HAND], "mode, surface, action, confidence")
_rows = lambda s: G.merged(s.createDataFrame(list(HAND), "mode string, surface string, action string, confidence string").withColumn("confidence", F.col("confidence").cast("decimal(3,2)")), G.generated(_anchors(s), _index(s)).withColumn("ord", F.monotonically_increasing_id()))
_merge = f"(SELECT surface, action, confidence, 'hand' AS origin FROM {_handv} WHERE mode <> 'forbid' UNION ALL SELECT surface, action, confidence, 'generated' FROM {_made} m WHERE NOT EXISTS (SELECT 1 FROM {_handv} h WHERE h.surface = m.surface AND h.action = m.action))"
query("s05_precedence", f"SELECT surface, action, CAST(confidence AS BIGINT) AS confidence, origin FROM {_merge}")(lambda s, d: _rows(s).select("surface", "action", long(F.col("confidence") * 100).alias("confidence"), "origin"))
query("r10_first_row", f"SELECT action, count(*) AS n FROM {_merge} GROUP BY action")(lambda s, d: _rows(s).groupBy("action").agg(F.count("*").alias("n")))
query("a05_grouped_candidates", f"SELECT surface, count(*) AS n, string_agg(action, ',' ORDER BY confidence DESC, action) AS candidates FROM {_merge} GROUP BY surface")(lambda s, d: G.grouped(_rows(s)))
query("s06_lemma_union", f"SELECT word FROM {INDEX} UNION SELECT word FROM {values([(w,) for w in ADVERBS], 'word')}")(lambda s, d: _lemmas(s).select(F.col("lemma").alias("word")).union(S.adverbs(s, f"{folder(s)}/index.adv")).distinct())
query("s07_family_filter", f"SELECT off AS synset FROM {values([(o, n) for o, n, *_ in VERB_SYNSETS], 'off, n')} JOIN {values(LEXNAMES, 'n, name, pos')} USING (n) WHERE name IN ('verb.creation', 'verb.motion')")(lambda s, d: S.data_words(s, f"{folder(s)}/data.verb").where("word_ord = 0").join(S.lexnames(s, f"{folder(s)}/lexnames").where("name in ('verb.creation', 'verb.motion')"), F.col("lex_number") == F.col("number"), "left_semi").select(F.col("offset").alias("synset")))
query("s08_grandparents", f"SELECT a.src AS synset, b.dst AS grandparent FROM {EDGES} a JOIN {EDGES} b ON a.dst = b.src WHERE a.rel = '@' AND b.rel = '@'")(lambda s, d: (lambda e: e.select(F.col("source").alias("synset"), F.col("target").alias("p")).join(e.select(F.col("source").alias("p"), F.col("target").alias("grandparent")), "p").select("synset", "grandparent"))(_edges(s).where("relation = '@'")))
query("j17_phrasal_verbs", f"SELECT DISTINCT word AS lemma, split_part(word, '_', 1) AS head, split_part(word, '_', 2) AS tail FROM {INDEX} WHERE len(string_split(word, '_')) = 2 AND split_part(word, '_', 2) IN ('up', 'down', 'off', 'out') AND split_part(word, '_', 1) IN (SELECT word FROM {INDEX})")(lambda s, d: G.phrasal(_lemmas(s), ("up", "down", "off", "out")))
_named = values(NAMED, "noun, sense_rank, depth, category")
_size = ", ".join(f"'{w}'" for w in G.SIZES)
query("a06_categories", f"WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY noun ORDER BY sense_rank) AS r FROM {_named}), k AS (SELECT *, row_number() OVER (PARTITION BY noun ORDER BY r, depth DESC, category) AS o FROM r WHERE r <= 3), f AS (SELECT *, CASE WHEN category IN ({_size}) THEN row_number() OVER (PARTITION BY noun, category IN ({_size}) ORDER BY o) ELSE 1 END AS s FROM k) SELECT noun, string_agg(category, ',' ORDER BY o) AS categories FROM f WHERE s = 1 GROUP BY noun")(lambda s, d: G.categories(s.createDataFrame(list(NAMED), "noun string, sense_rank int, depth int, category string")))
query("a07_sense_categories", f"SELECT noun, CAST(sense_rank AS BIGINT) AS sense_rank, count(DISTINCT category) AS kinds FROM {_named} GROUP BY ALL")(lambda s, d: s.createDataFrame(list(NAMED), "noun string, sense_rank long, depth int, category string").groupBy("noun", "sense_rank").agg(F.countDistinct("category").alias("kinds")))
query("a08_category_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
_top = "(SELECT p_name AS noun, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, noun LIMIT 20)"
query("a09_coverage", f"SELECT count(*) AS nouns, count(*) FILTER (noun LIKE 'red %' OR noun LIKE 'blue %') AS covered, round(count(*) FILTER (noun LIKE 'red %' OR noun LIKE 'blue %') / count(*), 6) AS share FROM {_top}")(lambda s, d: (lambda p: G.coverage(p.groupBy(F.col("p_name").alias("noun")).agg(F.count("*").alias("count")), p.where("p_name like 'red %' or p_name like 'blue %'").select(F.col("p_name").alias("noun")), 20))(s.read.parquet(f"{d}/part.parquet")))
query("a10_branch_counts", f"SELECT dst AS parent, count(*) AS n FROM {EDGES} WHERE rel = '@' AND src NOT IN (SELECT off FROM {values(ANCHORS, 'action, off')}) GROUP BY dst")(lambda s, d: _edges(s).where("relation = '@'").join(_anchors(s).select(F.col("offset").alias("source")), "source", "left_anti").groupBy(F.col("target").alias("parent")).agg(F.count("*").alias("n")))
query("r08_first_senses", f"SELECT noun, category FROM (SELECT *, row_number() OVER (PARTITION BY noun ORDER BY sense_rank, depth DESC, category) AS n FROM {_named}) WHERE n <= 3")(lambda s, d: s.createDataFrame(list(NAMED), "noun string, sense_rank int, depth int, category string").withColumn("n", F.row_number().over(Window.partitionBy("noun").orderBy("sense_rank", F.desc("depth"), "category"))).where("n <= 3").select("noun", "category"))
query("r09_top_names", f"SELECT noun, n FROM {_top}")(lambda s, d: s.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_name").alias("noun")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "noun").limit(20))
query("r11_stable_ordinals", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS ordinal FROM part")(lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", long(F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"))).alias("ordinal")))
_bad = ((0, 0, "open", "EQUIVALENT", 90), (1, 0, "", "EQUIVALENT", 90), (1, 1, "close", "SAME", 50), (2, 0, "jump", "ENABLES", 150))
query("v02_graph_errors", "SELECT unnest(['candidate_action:1:0', 'candidate_relation:1:1', 'candidate_confidence:2:0', 'entry_surface:2']) AS error")(lambda s, d: contract.validate_graph(s.createDataFrame([(0, "open"), (1, "close"), (2, " ")], "i int, surface string"), s.createDataFrame(list(_bad), "i int, j int, action string, relation string, confidence int").withColumn("confidence", F.col("confidence") / 100)))
query("v04_input_checks", f"SELECT action FROM {values(ANCHORS, 'action, off')} WHERE action NOT IN (SELECT action FROM {values([(a,) for a, _, _ in L.ACTIONS], 'action')})")(lambda s, d: _anchors(s).join(s.createDataFrame([(a,) for a, _, _ in L.ACTIONS], "action string"), "action", "left_anti").select("action"))
query("j16_roots_names_senses", f"SELECT action, word FROM {values(ANCHORS, 'action, off')} a JOIN {WORDS} w USING (off)")(lambda s, d: _anchors(s).join(S.data_words(s, f"{folder(s)}/data.verb").select("offset", "word"), "offset").select("action", "word"))
