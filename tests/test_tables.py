"""Lexicons as tables, catalogues and checks, the act of a clause for the linking step."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import lexicon_tables, link
from turnwise.sources import lexical_files as S


def test_irregular_forms_are_those_of_the_call(spark):
    words = spark.createDataFrame([("Went",), ("went",), ("opened",), ("was",), (None,), ("",)], "w string")
    forms = spark.createDataFrame([("went", "go"), ("WENT", "walk"), (None, "x")], "form string, lemma string")
    got = {(r["w"], r["lemma"]) for r in lexicon_tables.lemmas(words, forms).collect()}
    assert got == {("Went", "go"), ("went", "go"), ("opened", "open"), ("was", "was"), (None, None), ("", "")}
    assert {r["lemma"] for r in lexicon_tables.lemmas(words, forms.limit(0)).collect()} == {"went", "open", "was", None, ""}


def test_verbs_of_a_table(spark):
    words = spark.createDataFrame([("gliding",), ("glide",), ("glided",), ("stone",), ("went",), (None,), ("glide",)], "w string")
    forms = spark.createDataFrame([("went", "go")], "form string, lemma string")
    lexicon = spark.createDataFrame([("glide",), ("go",), (None,), ("go",)], "lemma string")
    got = {(r["w"], r["verb"]) for r in lexicon_tables.verbs(words, lexicon, forms).collect()}
    assert got == {("gliding", True), ("glide", True), ("glided", True), ("stone", False), ("went", True), (None, False)}
    assert not any(r["verb"] for r in lexicon_tables.verbs(words, lexicon.limit(0), forms).collect())


@pytest.mark.parametrize("before", ['{"a":1,"k":[1,2],"z":{"y":null}}', '{"z":0.5}', "{}", "[1]", "no json", None])
def test_one_key_of_a_catalogue(spark, before):
    df = spark.createDataFrame([(before,)], "j string")
    got = json.loads(df.select(S.put_key(F.col("j"), "k", F.lit('{"n": 3}')).alias("j")).first()["j"])
    try:
        want = json.loads(before or "{}")
    except ValueError:
        want = {}
    want = want if isinstance(want, dict) else {}
    want["k"] = {"n": 3}
    assert got == want and list(got) == list(want)


def test_checks_compare_whole_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0.5), (2, "b", 0.5)], "n long, s string, x double")
    S.write_json(df, f"{tmp_path}/t", "n")
    states = [S.checked(d, f"{tmp_path}/t").first()["state"] for d in (df, df.repartition(5).orderBy(F.desc("s")), df.distinct(), df.limit(0), df.withColumn("x", F.lit(0.0)))]
    assert states == ["unchanged", "unchanged", "DIFFERS", "DIFFERS", "DIFFERS"]


def test_graph_file_is_stable(spark, tmp_path):
    texts = []
    for k, n in enumerate((1, 7)):
        S.write_graph(link.entries(spark).repartition(n), link.candidates(spark).repartition(n), f"{tmp_path}/{k}")
        texts.append([r["value"] for r in spark.read.text(f"{tmp_path}/{k}").collect()])
    assert texts[0] == texts[1] == sorted(texts[0])
    first = json.loads(next(t for t in texts[0] if "get rid of" in t))
    assert [c["action"] for c in first["candidates"]] == ["destroy", "drop"] and '"confidence":0.70' in "".join(texts[0])
    assert json.loads(next(t for t in texts[0] if '"hide"' in t))["candidates"] == []


ACTS = [
    ("carve the wood", "request", 0, "carve", "request"), ("carve the wood", "statement", 0, "carve", "statement"), ("why carve it", "question", 4, "carve", "question"), ("", "fragment", -1, "", "fragment"),
    ("carefully carve the wood", "request", 10, "carve", "request"), ("could we be singing it", "request", -1, "singing", "statement"), ("please be singing", "request", -1, "singing", "request"),
    ("sasha, whittle it", "request", 7, "other", "request"), ("sit and whittle it", "request", 8, "sit", "request"), ("sit now whittle it", "request", 8, "sit", "statement"),
    ("tomorrow you will carve it", "request", 18, "carve", "statement"), ("you will maybe carve it", "request", 15, "carve", "statement"), ("you will carve it", "request", 9, "carve", "request"),
]


def test_acts_for_links(spark):
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(ACTS)], "i int, lower string, act string, place int, surface string, want string")
    rows = df.withColumn("got", link.link_act(F.col("lower"), F.col("act"), F.col("place"), F.col("surface"))).collect()
    assert [(r["lower"], r["got"]) for r in rows] == [(r["lower"], r["want"]) for r in rows]


def test_standing_entries_are_the_found_ones(spark):
    from turnwise.operators import match
    from turnwise.operators import segment as G

    texts = ["Mop the floor up!", "mop up mop up.", "Mop, then, up the floor.", "Get rid of the open box, cooks hid it.", "", "Carving; carve the door and carry it"]
    clauses = G.clauses(spark.createDataFrame(list(enumerate(texts)), "turn_id long, text string")).cache()
    graph, registry = link.entries(spark, (*link.ENTRIES, ("open the", "open", ""), ("get of", "get", "of"))), match.aliases(spark)
    rows = link.standing(clauses, graph, registry).collect()
    got = {(r["turn_id"], r["clause_no"], *h) for r in rows for h in r["hits"]}
    want = link.found_entries(clauses, graph).select("turn_id", "clause_no", "first", "end", "surface", "lemma", "particle", "entry_ord").collect()
    assert len(rows) == clauses.count() and got == {tuple(r) for r in want} and len(got) > 8
    direct = {(r["turn_id"], r["clause_no"], *d) for r in rows for d in r["direct"]}
    assert direct == {tuple(r) for r in match.contiguous(clauses, registry).select("turn_id", "clause_no", "first", "end").collect()}
