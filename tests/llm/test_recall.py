"""Near duplicates of a whole table against all links there are, counted through the shingles that texts share."""

from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnwise.llm import simhash

DATA = Path("/root/testdata/sf0.01")


def _shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def _components(rows, similarity=0.8):
    """The smallest doc_id that each doc_id reaches by links of the similarity or more; texts without a word are linked."""
    sets = {i: _shingles(t or "") for i, t in rows}
    holders, shared = defaultdict(list), Counter()
    for i, s in sorted(sets.items()):
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        shared.update(combinations(h, 2))
    empty = sorted(i for i, s in sets.items() if not s)
    links = [p for p, n in shared.items() if n >= similarity * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9] + [(empty[0], i) for i in empty[1:]]
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i] = up[up[i]]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in sets}, len(links)


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
def test_every_link_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want, links = _components([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert links > 20 and got == want


def test_links_just_above_and_below(docs_of):
    """Texts with words changed at a rate that spreads their similarities around 0.8."""
    import random

    draw = random.Random(8)
    rows = []
    for k in range(120):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(60, 400))]
        for j, rate in enumerate((0, 0.01, 0.02, 0.03)):
            rows.append((k * 10 + j, " ".join(f"x{draw.randrange(4000)}" if draw.random() < rate else w for w in words)))
    want, links = _components(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_of(rows)).select("doc_id", F.col("component_id")).collect()}
    apart = sum(want[k * 10] != want[k * 10 + 3] for k in range(120))
    assert links > 150 and apart > 20 and got == want


def test_texts_that_are_not_compared_stay_where_they_are(spark, docs_of):
    """With sides too large for a broadcast, only the texts of candidates are shuffled."""
    import random

    draw = random.Random(3)
    rows = [(i, " ".join(f"{draw.randrange(1 << 40):x}" for _ in range(2000))) for i in range(150)]
    rows.append((150, rows[0][1] + " once more"))
    docs = docs_of(rows)
    docs.count()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    conf, kept = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    source = docs.select("doc_id", "text").write
    path = f"{spark.conf.get('spark.checkpoint.dir')}/stay-where-they-are"
    source.mode("overwrite").parquet(path)
    spark.conf.set(conf, "-1")
    try:
        before = moved()
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.read.parquet(path)).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        shuffled = moved() - before
    finally:
        spark.conf.set(conf, kept)
    assert got == {i: 0 if i == 150 else i for i in range(151)}
    assert shuffled < 0.4 * sum(len(t) for _, t in rows)


def test_sifted_rows_keep_every_key(spark):
    rows = spark.range(-20_000, 20_000)
    side = rows.where("id % 40 = 0")
    got = simhash.sifted(rows, side, "id", 1000)
    assert got.columns == ["id"] and got.where("id % 40 = 0").count() == 1000
    assert got.count() < 6000
