"""What the plans must look like at any size, and a few oracles side by side."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from turnwise.plans import analysis
from turnwise.plans.turns import turns

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")


def test_frames_take_one_shuffle(spark):
    plan = analysis.compiled(spark, turns(spark, str(DATA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    # besides the one by turn, only the small registry is grouped
    assert plan.count("Exchange hashpartitioning") <= 3


def test_scans_read_what_they_need(spark):
    plan = entry.queries()["t20_tokenize"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "p_brand" not in plan and "p_retailprice" not in plan


def test_json_of_every_utterance(spark):
    import json

    from pyspark.sql import functions as F

    from turnwise.functions import text as X
    from turnwise.plans.turns import utterances

    want = {r["turn_id"]: r["n"] for r in utterances(spark, str(DATA)).select("turn_id", X.normalize(F.col("text")).alias("n")).collect()}
    rows = entry.queries()["t27_json_text"](spark, str(DATA)).collect()
    assert len(rows) == len(want) and any('"' in n for n in want.values())
    assert all(r["json"] == json.dumps([want[r["turn_id"]]], ensure_ascii=False) for r in rows)
    odd = 'a "b" \\ c\n\t/ é'
    assert spark.range(1).select(F.to_json(F.array(F.lit(odd))).alias("json")).first()["json"] == json.dumps([odd], ensure_ascii=False)


def test_all_parts_are_ordered(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_brand", "p_size", "p_partkey").collect()
    want, last = set(), {}
    for r in sorted(parts):
        last[r["p_brand"]] = last.get(r["p_brand"], 0) + 1
        want.add((r["p_brand"], r["p_partkey"], last[r["p_brand"]]))
    got = [tuple(r) for r in entry.queries()["r11_stable_ordinals"](spark, str(DATA)).collect()]
    assert len(got) == len(parts) == len(want) and set(got) == want


@pytest.mark.parametrize("name", ["t05_find_word", "t12_trim_target", "t13_split_place", "g01_split_clauses", "c04_negated", "j01_phrase_join", "s03_short_paths", "a12_percentile", "io11_json_update"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()[list(got.columns)]
    rows = lambda d: sorted(map(repr, d.astype(object).values.tolist()))
    assert len(got) and rows(got) == rows(want)


def test_requests_read_their_turns_once(spark):
    from turnwise.operators import link, match
    from turnwise.operators import segment as S
    from turnwise.plans.q_frames import link_turns

    asked = link.numbered(link.requests(S.clauses(link_turns(spark, str(DATA))), link.entries(spark), match.aliases(spark)))
    plan = asked._jdf.queryExecution().executedPlan().toString()
    # dealt by turn before anything is worked out, and never again
    assert plan.count("FileScan") == 1 and plan.count("REPARTITION_BY_NUM") == 1
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 2  # the other one is of the registry


def test_columns_worked_out_once_are_compiled(spark):
    """Lambdas stand in projections: a generator that holds one is interpreted with all that stands in it."""
    from pyspark.sql import functions as F

    from turnwise.functions import text as X

    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "i int, t string")
    got = X.once(df, t=F.upper("t"), n=F.size(F.transform(F.split("t", " "), lambda w: F.concat(w, F.lit("!")))))
    made = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate " in line]
    assert made and not any("lambda" in line or "array(" in line for line in made)
    assert [tuple(r) for r in got.sort("i").collect()] == [(1, "A B", 2), (2, "", 1), (3, None, None if df.selectExpr("size(cast(null as array<int>)) n").first()["n"] is None else -1)]
