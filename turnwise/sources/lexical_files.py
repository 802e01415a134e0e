"""Readers of lexical files (line-based text with fixed fields) and of configuration tables, and the sinks of catalogues.

Formats: lexnames (tab-separated number, name, part of speech); index.* (word, part of speech, counts, pointers, sense
count, observed count, offsets; lines that begin with a space are a header); data.* (offset, file number, type, hex word
count, words with ids, pointer count, pointers, " | " gloss); index.sense (sense key, offset, number, tag count);
*.exc (form, base ...). A source is a Spark path, so it may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """value: the lines of text files. Other encodings are read through the CSV reader, which decodes."""
    if encoding.upper().replace("-", "") == "UTF8":
        return spark.read.text(path)
    return spark.read.csv(path, sep="\x01", encoding=encoding, quote="", schema="value string")


def lexnames(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return lines(spark, path, "ISO-8859-1").select(f[0].cast("int").alias("number"), f[1].alias("name"), f[2].cast("int").alias("pos"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """word, observed, sense_rank (from 0), offset: one row a sense."""
    f = F.split(F.trim("value"), " +")
    rows = lines(spark, path).where(~F.col("value").startswith(" ") & (F.col("value") != "")).select(f.alias("f"))
    n, p = F.col("f")[2].cast("int"), F.col("f")[3].cast("int")
    rows = rows.select(F.col("f")[0].alias("word"), F.get("f", p + 5).cast("int").alias("observed"), F.slice("f", p + 7, n).alias("offsets"))
    return rows.select("word", "observed", F.posexplode("offsets").alias("sense_rank", "offset"))


def adverbs(spark: SparkSession, path: str) -> DataFrame:
    return index(spark, path).select("word").distinct()


def _data(spark: SparkSession, path: str) -> DataFrame:
    head = F.split(F.trim(F.substring_index("value", " | ", 1)), " +")
    gloss = F.when(F.col("value").contains(" | "), F.trim(F.expr("substring(value, instr(value, ' | ') + 3)"))).otherwise("")
    rows = lines(spark, path).where(~F.col("value").startswith(" ") & (F.col("value") != "")).select(head.alias("f"), gloss.alias("gloss"))
    return rows.withColumn("n", F.conv(F.col("f")[3], 16, 10).cast("int"))


def data_words(spark: SparkSession, path: str) -> DataFrame:
    """offset, lex_number, word_ord (from 0), word, gloss."""
    words = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("f", i * 2 + 4))
    return _data(spark, path).select(F.col("f")[0].alias("offset"), F.col("f")[1].cast("int").alias("lex_number"), "gloss", F.posexplode(words).alias("word_ord", "word"))


def data_edges(spark: SparkSession, path: str) -> DataFrame:
    """source, relation, target, pos: typed links between synsets."""
    at = F.col("n") * 2 + 4
    links = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: F.struct(F.get("f", at + 1 + i * 4).alias("relation"), F.get("f", at + 2 + i * 4).alias("target"), F.get("f", at + 3 + i * 4).alias("pos")))
    rows = _data(spark, path).withColumn("p", F.get("f", at).cast("int")).where("p > 0")
    return rows.select(F.col("f")[0].alias("source"), F.explode(links).alias("l")).select("source", "l.*")


def sense_tags(spark: SparkSession, path: str) -> DataFrame:
    """word, offset, count."""
    f = F.split("value", " +")
    return lines(spark, path).where("value != ''").select(F.substring_index(f[0], "%", 1).alias("word"), f[1].alias("offset"), f[3].cast("int").alias("count"))


def exceptions(spark: SparkSession, path: str) -> DataFrame:
    """line, form, base. Order within a file is kept by its place: files are read line by line."""
    f = F.split("value", " +")
    return lines(spark, path).where("value != ''").select(F.monotonically_increasing_id().alias("line"), f[0].alias("form"), f[1].alias("base"))


def families(spark: SparkSession, path: str) -> DataFrame:
    """action (file stem) and family (its folder) of every file under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("action"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("family"))


def table(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A tab-separated configuration table; lines that begin with # are left out."""
    return spark.read.csv(path, sep="\t", comment="#", schema=columns)


def as_json(row: Column) -> Column:
    """A row's JSON, the form in which catalogues are written and compared."""
    return F.to_json(row)


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """One ordered JSON-lines file: equal tables give equal bytes."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and sha256 of a table whatever its order: the digests of its rows' JSON are summed in parts, which any number
    of tasks can do for their own rows."""
    each = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", k * 8 + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return each.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *(F.coalesce(p, F.lit("0")) for p in parts)), 256).alias("sha256"))


def checked(df: DataFrame, path: str) -> DataFrame:
    """What a check does instead of writing: state ("unchanged" or "DIFFERS") and sha256 of df against the JSON lines at path."""
    stored = fingerprint(df.sparkSession.read.schema(df.schema).json(path)).withColumn("new", F.lit(False))
    both = fingerprint(df).withColumn("new", F.lit(True)).unionByName(stored)
    same = (F.min("rows") == F.max("rows")) & (F.min("sha256") == F.max("sha256"))
    return both.agg(F.when(same, "unchanged").otherwise("DIFFERS").alias("state"), F.max(F.when(F.col("new"), F.col("sha256"))).alias("sha256"))


def put_key(catalogue: Column, key: str, value: Column) -> Column:
    """A JSON object with one key set to a value (given as JSON text); all its other keys keep their places and values, a new
    key comes last. What is no object becomes one of this key alone."""
    known = F.coalesce(F.from_json(catalogue, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    new = F.parse_json(value)
    return F.to_json(F.when(F.map_contains_key(known, key), F.transform_values(known, lambda k, v: F.when(k == key, new).otherwise(v))).otherwise(F.map_concat(known, F.create_map(F.lit(key), new))))


def graph_entries(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """surface and json: an entry with its candidates in order, numbers with two places, as the graph's file has them.
    entries: surface, lemma, particle; candidates: surface, action, relation, confidence, role_compatibility. What one surface
    can mean is a short list."""
    two = lambda c: F.col(c).cast("decimal(3,2)").alias(c)
    each = candidates.select("surface", F.struct("action", "relation", two("confidence"), two("role_compatibility")).alias("c"))
    rank = lambda c: F.struct((-c["confidence"]).alias("a"), c["action"].alias("b"), c.alias("c"))
    lists = each.groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(rank(F.col("c")))), lambda x: x["c"]).alias("candidates"))
    empty = F.array().cast(lists.schema["candidates"].dataType)
    rows = entries.join(lists, "surface", "left").withColumn("candidates", F.coalesce("candidates", empty))
    return rows.select("surface", F.to_json(F.struct("surface", "lemma", "particle", "candidates")).alias("json"))


def write_graph(entries: DataFrame, candidates: DataFrame, path: str) -> None:
    """The graph as one file, a line an entry, by surface: equal graphs give equal bytes."""
    graph_entries(entries, candidates).orderBy("surface").coalesce(1).select("json").write.mode("overwrite").text(path)


def put_file(spark: SparkSession, path: str, text: str) -> None:
    """A file with a name of its own in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and sha256 of each file under a folder. Files without a byte are not listed: Spark reads none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
