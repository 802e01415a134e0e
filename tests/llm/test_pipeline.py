"""The stages of the pipeline on planted cases, and on odd rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    random.seed(12)
    vocab = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8))) for _ in range(800)]
    text = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    rows = {i: text(random.randint(60, 200)) for i in range(200)}
    rows[200] = rows[3]  # a copy
    near = rows[4].split()
    near[len(near) // 2] = "changed"
    rows[201] = " ".join(near)
    passage = text(55)
    for i in (202, 203):
        rows[i] = f"{text(80)} {passage} {text(80)}"
    item = f"{text(25)}. {text(6)}."
    rows[204] = f"{text(50)} {item} {text(50)}"
    rows[205] = "### *** %%% " * 40
    rows |= {206: None, 207: "", 208: " \n "}
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()] + [(None, text(90), None, None, None), (None, text(90), None, None, None), (10, rows[10], "en", "s", 1)]
    d = tmp_path_factory.mktemp("sf").as_uri()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(205, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, passage


def stages(spark, d, docs=None):
    docs = spark.read.parquet(f"{d}/documents.parquet") if docs is None else docs
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        out.append(docs)
    return out


def test_planted(spark, made):
    d, rows, passage = made
    quality, near, cut, clean, tokens = stages(spark, d)
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    assert set(range(205)) - {200, 201} <= set(ids(quality)) and not {205, 206, 207, 208} & set(ids(quality))
    kept = ids(near)
    assert kept.count(None) == 2 and len(kept) == len(set(kept)) + 1 and not {200, 201} & set(kept) and set(range(200)) <= set(kept) and None in kept
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(passage[5:-5] not in texts[i] for i in (202, 203)) and texts[7] == rows[7]
    assert 204 not in ids(clean) and set(range(200)) <= set(ids(clean))
    assert all(list(df.columns) == list(corpus_pipeline.COLUMNS) for df in (quality, near, cut, clean))
    assert tokens.where("not round_trip").count() == 0 and tokens.count() == clean.count()


def test_leaks_without_an_id(spark, made):
    """A leak takes no document with it that shares its doc_id, or that has none either."""
    d, rows, _ = made
    leak = rows[204]
    docs = [(None, leak), (None, rows[1]), (None, rows[2]), (None, None), (7, leak), (7, rows[3]), (8, leak), (9, rows[4])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.decontaminated(spark, df, d).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(i, t) for i, t in docs if t != leak} and len(got) == 5


def test_empty(spark, made):
    d = made[0]
    assert [df.count() for df in stages(spark, d, spark.read.parquet(f"{d}/documents.parquet").where("false"))] == [0] * 5


def test_registered():
    import __spark_entry__ as e

    assert {f"op{i}_" for i in range(1, 11)} == {k.split("_")[0] + "_" for k in e.queries() if k.startswith("op")} and "pipeline" in e.queries()
