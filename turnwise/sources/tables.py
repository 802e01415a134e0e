"""Tables of a folder, the folder that driver and executors share, and tables written there as a step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file is one partition, which would leave all cores
    but one idle. A table of more partitions, as any large one is, stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def by_turn(turns: DataFrame) -> DataFrame:
    """turns dealt by turn_id over the shuffle partitions: a file's rows can all be in one row group, which is one task
    whatever the number of partitions read."""
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return turns.repartition(n, "turn_id")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="turnwise-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/turnwise/{name}-{uuid.uuid4().hex}"


class Step:
    """A table that is made once a session from the tables of a folder, written to the shared folder, and read from there by
    all queries that look at it."""

    def __init__(self, name: str, make) -> None:
        self.name, self.make, self.paths = name, make, {}

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in self.paths:
            path = scratch(spark, self.name)
            self.make(spark, sf_dir).write.parquet(path)
            self.paths[key] = path
        return spark.read.parquet(self.paths[key])
