"""Shared helpers: the shared folder, tables that cut lineage, and Arrow maps over texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.tables import read, scratch, spread

#: Rows a Python worker holds at once are bounded by bytes, not by count: a batch is cut when it passes this.
BATCH_BYTES = 2 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read(spark, sf_dir, name))


def bounded(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are large rows: no Arrow batch of this session is to hold more than rows of them."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


#: Rows of a file of written(), where the number of rows is known.
FILE_ROWS = 1 << 15


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost no recomputation.

    rows: how many rows df may have. Its files then follow from that and not from the number of partitions: on a file system
    without Hadoop's native library each file is several processes that the executor's JVM starts."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle partitions that fewer() gives to one task.
TOGETHER = 4


def fewer(df: DataFrame) -> DataFrame:
    """df with several of its partitions in one task, one after another, and at least as many tasks as cores. For results with
    large rows: of a file for each partition every one starts three processes (see written()), and while such a process starts
    it shares the memory of its JVM, which counts twice until then."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, spark.sparkContext.defaultParallelism, n // TOGETHER))


#: Bytes of a side that small() broadcasts, and what a row of numbers takes beside them.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 32


def small(df: DataFrame) -> DataFrame:
    """df, of columns of numbers only, as a broadcast side if it is no larger than BROADCAST_BYTES; else Spark shuffles both
    sides."""
    rows = BROADCAST_BYTES // (ROW_BYTES + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sifted(rows: DataFrame, side: DataFrame, key: str, n: int) -> DataFrame:
    """rows without most of those whose key is not among the n keys of side, so that a join that follows shuffles little
    else. A bit map, 16 bits a key but no larger than BROADCAST_BYTES as a broadcast side, is looked up where the rows are;
    with more keys it lets more of the other rows through."""
    words = max(1, min(n // 4, BROADCAST_BYTES // (ROW_BYTES + 16)))
    place = F.pmod(F.xxhash64(key), F.lit(64 * words).cast("long"))
    found = side.select(place.alias("p")).selectExpr("shiftright(p, 6) AS __word", "shiftleft(1L, CAST(p & 63 AS INT)) AS __bit")
    marks = found.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = rows.withColumn("__p", place).withColumn("__word", F.expr("shiftright(__p, 6)")).join(F.broadcast(marks), "__word")
    return held.where("shiftright(__bits, CAST(__p & 63 AS INT)) & 1 = 1").select(*rows.columns)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes of the text column (one row at least)."""
    for batch in batches:
        at, held = 0, 0
        sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        for i, n in enumerate(sizes):
            if i > at and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: workers are reused from stage to stage, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over bounded batches; a task gives its memory back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    bounded(df.sparkSession)
    return df.mapInArrow(whole, schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow with a per-task setup: make() runs once in each task, what it returns runs on byte-bounded batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in small_batches(batches, text):
            step = step or make()
            yield step(batch)
            pa.default_memory_pool().release_unused()

    return map_batches(df, run, schema)


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)
