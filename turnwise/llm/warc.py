"""WARC archives: a deterministic sharded writer and a reader.

Writing: records are range-sorted by page and digest into shards; each shard is written as gzip members, one a record, and a new
file is started when the compressed size passes a limit. The ranges follow from the pages alone: their bounds are taken
from the records that hash lowest, and their number from the bytes of all payloads. So equal pages give equal files,
whatever the session's settings and however rows are dealt. Headers and digests are made anew from the
payload. A file is written under a temporary name and renamed when whole; names depend on the shard and the roll number
only, so a task that runs again, or twice at once, puts the same bytes under the same name. The manifest of all files,
with sizes and digests, is committed last, by Spark's own writer, and temporary files that lost tasks left are swept; a
reader takes nothing that the manifest does not list.

Of records with equal payloads of at least REVISIT_BYTES, the one with the largest page_id is a response and the others
revisit it. Defined results: a null or empty html is an empty payload; smaller payloads are always responses; a null
page_id sorts first and is a response only where its group has no other; of rows that repeat a page_id with the same
payload the first is the response and the others revisit it.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_batches, small_batches

REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, shards at most, and records that stand for a shard's share when bounds are taken.
SHARD_BYTES, SHARDS, SAMPLED = 8 << 20, 20_000, 20
#: Stands for a null id where ids are compared.
NONE = -(1 << 63)
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def file_system(uri: str):
    """(file system, path) of a folder that Python workers can write to: file, hdfs, s3 and whatever else pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def planned(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One row a record, html only in rows that carry one, plus one narrow row for each page that revisits another.

    Only page ids and digests go through the grouping and the join; html is shuffled once, by the writer's range sort.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    named = rows.withColumn("digest", F.sha1("payload"))
    narrow = named.where(F.length("payload") >= revisit_bytes).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(groups, "digest").where("refers_to is not null and (page_id is null or page_id < refers_to)").select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")).distinct()
    return named.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "payload").unionByName(revisits)


def bounds(pages: DataFrame, shards: int = 0) -> list[tuple[int, str]]:
    """(page_id, digest) at which a new shard begins: of the records that hash lowest, SAMPLED a shard on average, those
    that part all records evenly. Equal records go together; null ids come first."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NONE)).alias("page_id"), html.alias("html"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    shards = shards or min(SHARDS, -(-size // SHARD_BYTES))
    if shards < 2:
        return []
    part = min(1 << 30, -(-(shards * SAMPLED << 30) // n))
    some = rows.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) < part).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    found = sorted((r["page_id"], r["digest"], r["n"]) for r in some.groupBy("page_id", "digest").agg(F.count("*").alias("n")).collect())
    total, seen, done, out = sum(k for *_, k in found), 0, 0, []
    for page_id, digest, k in found:
        if seen * shards // total > done:  # what came before fills its shards
            done = seen * shards // total
            out.append((page_id, digest))
        seen += k
    return out


def shard_of(page_id: Column, digest: Column, cuts: list[tuple[int, str]]) -> Column:
    """How many of the cuts are no greater than the record's id and digest."""

    @F.pandas_udf("int")
    def place(ids: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, x) for x in zip(ids.tolist(), digests.tolist(), strict=True)], dtype="int32")

    return place(F.coalesce(page_id, F.lit(NONE)), digest) if cuts else F.lit(0)


def name_of(page_id: int | None, digest: str, nth: int = 0) -> str:
    """Id of the n-th record of a page with a payload of this digest."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}:{nth}"


def record(name: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; names are those of name_of(). A revisit holds the HTTP headers only; their Content-Length still is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if refers_to else http + payload
    to32 = lambda raw: base64.b32encode(raw).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        f"WARC-Payload-Digest: sha1:{to32(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: sha1:{to32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def member(raw: bytes) -> bytes:
    """A gzip member without time or name: equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Roll:
    """The files of one range."""

    def __init__(self, uri: str, shard: int, limit: int) -> None:
        self.fs, self.folder = file_system(uri)
        self.shard, self.limit, self.n, self.out, self.files = shard, limit, 0, None, []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        packed = member(raw)
        self.out.write(packed)
        self.sha.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> list[tuple]:
        """The files that are whole."""
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.files.append((self.name, self.size, self.records, self.sha.hexdigest()))
            self.out, self.n = None, self.n + 1
        return self.files


MANIFEST = "file string, bytes long, records long, sha256 string"


def write(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES, shards: int = 0) -> DataFrame:
    """Write pages as WARC files under uri/data and return the committed manifest, uri/manifest. shards: how many ranges of
    ids, about; 0: as many as the payloads' bytes call for."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{uri}/data")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    cuts = bounds(pages, shards)
    rows = planned(pages, revisit_bytes)
    placed = rows.withColumn("shard", shard_of(F.col("page_id"), F.col("digest"), cuts)).repartitionByRange(len(cuts) + 1, "shard")
    ranged = placed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, files, last, nth, target = None, [], None, 0, None
        for batch in small_batches(batches, "payload"):
            columns = (batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "refers_to", "url", "payload"))
            for shard, page_id, digest, kind, refers_to, url, payload in zip(*columns, strict=True):
                if roll is None or roll.shard != shard:
                    files += roll.close() if roll else []
                    roll = Roll(f"{uri}/data", shard, roll_bytes)
                if last != (page_id, digest):
                    nth, last, target = 0, (page_id, digest), None
                if not kind:
                    target = name_of(refers_to, digest)
                    continue
                own = target or (name_of(page_id, digest) if nth and len(payload) >= revisit_bytes else None)
                roll.add(record(name_of(page_id, digest, nth), url or "", payload, digest, own))
                nth += 1
        files += roll.close() if roll else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files, strict=True) if files else ([],) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "bytes", "records", "sha256"])

    map_batches(ranged, run, MANIFEST).write.mode("overwrite").parquet(f"{uri}/manifest")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{uri}/data/.part-*")) or ():
        store.delete(f.getPath(), False)
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def members(raw: io.BufferedIOBase, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one whole record each."""
    left = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or raw.read(chunk)
            if not left:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(unpack.decompress(left))
            left = unpack.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Headers of a record (lower-cased names), its payload, and the HTTP Content-Length."""
    head, _, rest = raw.partition(END)
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:]))
    block = rest[: int(headers["content-length"])]
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["warc-block-digest"]:
        raise ValueError(f"damaged block in {headers['warc-record-id']}")
    http, _, payload = block.partition(END)
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"headers": headers, "payload": payload, "length": length}


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(manifest: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """One row a record of the files that the manifest lists. A damaged block or payload is an error."""
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(f"{uri}/data")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 7, kinds, strict=True)], names).select(names if payloads else names[:-1])

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        r = parse(raw)
                        h = r["headers"]
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        own = h["warc-record-id"].strip("<>").split(":")[2]
                        other = h["warc-refers-to"].strip("<>").split(":")[2] if "warc-refers-to" in h else ""
                        if h["warc-type"] == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                            raise ValueError(f"damaged payload in {h['warc-record-id']}")
                        rows.append((int(own) if own else None, h["warc-target-uri"], r["length"], digest, h["warc-type"], int(other) if other else None, r["payload"] if payloads else None))
                        held += len(raw)
                        if held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_batches(manifest.select("file").repartition(n, "file"), run, READ if payloads else READ.rpartition(",")[0])
