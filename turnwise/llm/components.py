"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import written

#: Keys that a spread join broadcasts, at most; rows of one key that it lets meet in one task, at least.
HOT, MEET = 250_000, 1000


def limit_of(total: int) -> int:
    """Rows of one key that may meet in one task, of total rows."""
    return max(MEET, -(-total // HOT))


def spread_parts(rows: DataFrame, side: DataFrame, key: str, total: int) -> list[DataFrame]:
    """rows joined with side on key, in one or two parts. side has one row a key, with n, the rows of that key; total is the
    number of rows.

    Keys with more than MEET rows, or their share of total if that is more, are joined where the rows are: there are HOT
    of them at most, since each has more than total / HOT rows. All others are joined by a shuffle, in which no key is hot."""
    limit = limit_of(total)
    if total > limit:
        side = written(side, "side", total)
        if (side.agg(F.max("n")).first()[0] or 0) > limit:
            return _parts(rows, side, key, limit)
    return [rows.join(side.drop("n"), key)]


def _parts(rows: DataFrame, side: DataFrame, key: str, limit: int) -> list[DataFrame]:
    hot, cold = side.where(F.col("n") > limit).drop("n"), side.where(F.col("n") <= limit).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return [rows.join(F.broadcast(hot), key), rest.join(cold, key)]


def spread_join(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """All parts."""
    return reduce(DataFrame.unionByName, spread_parts(rows, side, key, total))


def _star(edges: DataFrame, large: bool, hot: int, total: int) -> DataFrame:
    """Large star: every larger neighbour of u is joined to the smallest node around u. Small star: u and its smaller
    neighbours are. hot: how many edges make a node hot, 0 if no node is; total: edges there are."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = both if large else both.where("v < u")
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if hot:
        least = written(least, "least", 2 * total)
    near = reduce(DataFrame.unionByName, _parts(sides, least, "u", hot)) if hot else sides.join(least.drop("n"), "u")
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """edges: u, v (any order, no nulls). Returns (node, component), the component being its smallest node; nodes
    without an edge are not in it. Every step writes its edges to the shared folder."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(steps):
        total, open_, degree = _state(now)
        if not open_:
            break
        # a step gives no node more edges to smaller ones than it had edges
        limit = limit_of(2 * total)
        hot = limit if degree > limit else 0
        stars = _star(now, True, hot, total)
        now = written(_star(written(stars, "stars", total) if hot else stars, False, hot, total), "edges", 2 * total)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """How many edges there are, how many nodes keep them from being stars around their smallest nodes (a larger end of
    several edges, or of one and the smaller end of another), and the most edges of a node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    nodes = ends.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = nodes.agg(F.sum("a").alias("total"), F.count_if(F.expr("a > 1 or a > 0 and b > 0")).alias("open"), F.max(F.expr("a + b")).alias("degree")).first()
    return found["total"] or 0, found["open"], found["degree"] or 0
