"""Tables between the steps: their files follow from their rows, not from the number of partitions."""

from collections import Counter

import pytest

from turnwise.llm import common, components, simhash, suffix_dedup


@pytest.fixture
def many_parts(spark):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """(name, files) of every table written."""
    found = []

    def counted(df, name, *rows):
        out = common.written(df, name, *rows)
        found.append((name, len(out.inputFiles())))
        return out

    for module in (components, simhash):
        monkeypatch.setattr(module, "written", counted)
    return found


@pytest.mark.parametrize("meet", [4, 1000])
def test_components(spark, many_parts, files, monkeypatch, meet):
    monkeypatch.setattr(components, "MEET", meet)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)]
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 150)}
    assert len(files) > 2 and all(n == 1 for _, n in files[1:])  # the first has as many edges as are given


def test_near_duplicates(docs_of, many_parts, files):
    rows = [(i, f"some words of text number {i % 90} that differ by {i % 90 * 7919} and {i % 90 * 104729}") for i in range(180)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == 180 and all(r["component_id"] <= r["doc_id"] % 90 for r in got)
    assert {n for name, n in files if name in ("nodes", "member", "components")} == {1}


def test_rows_of_a_file(spark):
    made = common.written(spark.range(0, 3 * common.FILE_ROWS + 1, 1, 16), "made", 3 * common.FILE_ROWS + 1)
    assert len(made.inputFiles()) == 4 and made.count() == made.distinct().count() == 3 * common.FILE_ROWS + 1
    assert common.written(spark.range(0).repartition(5), "none", 0).count() == 0


def test_suffix_dedup(spark, docs_of, many_parts, monkeypatch):
    found = []

    def counted(df, name, *rows):
        out = common.written(df, name, *rows)
        found.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    passage = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, f"{i * 7919} begins {passage[: 300 + i]} and ends {i * 104729}") for i in range(90)]
    docs = docs_of(rows, 20)
    got = suffix_dedup.remove_repeats(docs, 200, whole=True)
    twice = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = {}
    for k, t in rows:
        ends = [i for i in range(len(t) - 199) if twice[t[i : i + 200]] > 1]
        gone = {j for i in ends for j in range(i, i + 200)}
        want[k] = "".join(c for j, c in enumerate(t) if j not in gone)
    assert {r["row"]["doc_id"]: bytes(r["kept"]).decode() for r in got.collect()} == want
    few = 20 // common.TOGETHER
    assert got.rdd.getNumPartitions() <= few and suffix_dedup.remove_repeats_and_passages(docs).rdd.getNumPartitions() <= few
    assert {"anchors", "classes"} <= {name for name, _ in found} and all(n <= few for name, n in found if name in ("anchors", "classes"))
