"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are linked at RADIUS differing bits or fewer. A random map of the 64 bit places to vectors of RADIUS + 1
bits gives one mask for each non-zero vector v: the places whose vector has an odd product with v. Any RADIUS places
span a space of RADIUS dimensions at most, so some v is orthogonal to all of them: its mask leaves all differing places
out, and the pair has equal masked fingerprints in that table. No pair within the radius is missed.

Documents are reduced to distinct fingerprints first, so copies cost one row. Within a bucket no pairs are emitted:
a search from each unreached fingerprint over the bucket's array finds its clusters and gives one edge for each further
member, in time linear in the bucket if it is one dense cluster; a bucket of many fingerprints is first dealt again by
other masks, which cover its pairs too.

Defined results: a null text, an empty one or one of white space has fingerprint zero, linked like any other; a null
doc_id is never a component's name unless a component has no other; further columns are read only if asked for; repeated
rows each give their own row.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import UPPER, as_bytes, map_batches, map_texts, sifted, written
from turnwise.llm.components import components, spread_join, spread_parts

SHINGLE = 4
SEED = 42
RADIUS = 4
ASCII_LOWER = bytes(b + 32 if chr(b) in UPPER else b for b in range(256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> tuple[list[bytes], np.ndarray]:
    """The text's words and the hash of each shingle, repeats included; fewer words are one shingle, none have none."""
    import xxhash

    words = text.translate(ASCII_LOWER).split()
    if not words:
        return words, np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle, 0) + 1
    digest = xxhash.xxh64_intdigest
    places = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return words, np.fromiter((digest(line[a:b], SEED) for a, b in places), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes; zero for none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle)[1])


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 20_250_101) -> list[int]:
    """2 ** (radius + 1) - 1 masks. The vectors are dealt evenly, so that all masks keep about half of the places."""
    size = 1 << (radius + 1)
    vectors = [i % (size - 1) + 1 for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed long) of each document; keep names further columns to carry."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = pa.array([signed(fingerprint(t, shingle)) for t in as_bytes(batch.column("text"))], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), fps, *(batch.column(k) for k in keep)], ["doc_id", "fp", *keep])

        return step

    return map_texts(source, make, "doc_id long, fp long" + "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep))


def cluster(n: int, near) -> list[tuple[int, int]]:
    """Edges that connect what near links, one for each member after the first; near(places, place) -> bools."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(left, at)
            if hit.any():
                queue += left[hit].tolist()
                edges += [(int(at), int(x)) for x in left[hit]]
                left = left[~hit]
    return edges


#: Fingerprints of a bucket that are searched at once; more are dealt again, LEVELS times at most.
SEARCHED, LEVELS = 2048, 2


def near_fingerprints(fps: np.ndarray, radius: int, level: int = 1) -> list[tuple[int, int]]:
    """Edges that connect all fingerprints within the radius."""
    if len(fps) <= SEARCHED or level > LEVELS:
        return cluster(len(fps), lambda left, at: np.bitwise_count(fps[left] ^ fps[at]) <= radius)
    edges: set[tuple[int, int]] = set()
    for m in masks(radius, seed=level):
        key = fps & np.uint64(m)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                edges.update((int(part[i]), int(part[j])) for i, j in near_fingerprints(fps[part], radius, level + 1))
    return sorted(edges)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: distinct fp. Edges (u, v) whose connected components are those of all links within the radius."""
    dealt = nodes.select("fp", F.explode(tables(F.col("fp"), radius)).alias("b")).select("b.t", "b.key", F.col("fp").alias("node"))

    def near(rows: np.ndarray) -> list[tuple[int, int]]:
        return near_fingerprints(np.ascontiguousarray(rows[2]).view(np.uint64), radius)

    return in_buckets(dealt, near).distinct()


def tables(fp, radius: int):
    """(table, masked fingerprint) in every table."""
    return F.array(*(F.struct(F.lit(t).cast("long").alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))))


def in_buckets(dealt: DataFrame, near) -> DataFrame:
    """Edges u, v between nodes of one bucket. dealt: long columns t, key (the bucket), node, and what else near() needs;
    near(rows of one bucket, a column each) gives pairs of places. Buckets are streamed out of sorted partitions."""
    names = dealt.columns
    n = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            rows = np.concatenate([*held, rows], axis=1)
            if not rows.shape[1]:
                continue
            last = rows[:2, -1:]
            whole = int((rows[:2] == last).all(axis=0).argmax())  # the last bucket may go on in the next batch
            held = [rows[:, whole:]]
            yield of(rows[:, :whole])
        if held:
            yield of(held[0])

    def of(rows: np.ndarray) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        if rows.shape[1] > 1:
            new = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [rows.shape[1]]])
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                found += [(int(rows[2, a + i]), int(rows[2, a + j])) for i, j in near(rows[:, a:b])]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return map_batches(dealt.repartition(n, "key", "t").sortWithinPartitions("key", "t"), run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id, and the kept columns."""
    prints = written(fingerprints(docs, keep, shingle), "fingerprints")
    total = prints.count()
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes", total)
    groups = components(links(nodes.select("fp"), radius))
    # the smallest document of each component of fingerprints, then back to fingerprints and documents
    member = written(nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.col("n").alias("rows"), F.coalesce("component", "fp").alias("component")), "member", total)
    least = member.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = written(spread_join(member, least, "component", member.count()).select("fp", "component_id", F.col("rows").alias("n")), "components", total)
    return spread_join(prints, named, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


# Documents of a given similarity. Shingle sets that share four fifths differ in about ten of 64 fingerprint bits, which
# no covering family of bearable size reaches. So fingerprints are also taken of SEGMENTS short segments of each text,
# those that start at its least shingle hashes and so are the same in copies; in unedited segments they are equal or
# nearly so. Covering tables over segment fingerprints find the candidates, and shingle sets, of whole 64-bit hashes,
# decide. Fingerprints of whole texts decide nothing here: repeated words outvote the rest of a text in them.
#
# Candidates that hang together are compared in one task if they are few. Of more, those that share most buckets with a
# bucket's centre are first compared in blocks around it, which joins families of copies; then only documents of
# different families matter. Similar sets share one at least of each one's rarest shingles (as many as they may differ in,
# and one more), so documents without such a one in common part company; what still hangs together is compared block by
# block, but for the blocks of its largest family among themselves. Every step keeps all links between families.

SEGMENTS = 8
SEGMENT_WORDS = 8
SEGMENT_RADIUS = 1
#: Documents, and shingles of documents, that are compared in one task.
CLUSTER, WEIGHT = 4096, 1 << 20


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key, size (distinct shingles) and segments (fingerprints) of each text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, segments = [], []
            for text in as_bytes(batch.column("text")):
                words, h = shingle_hashes(text, shingle)
                distinct = np.unique(h)
                least = distinct[:SEGMENTS] if len(distinct) else distinct
                first = np.flatnonzero(np.isin(h, least))
                span = max(1, SEGMENT_WORDS - shingle + 1)
                sizes.append(len(distinct))
                segments.append(sorted({signed(majority(h[a : a + span])) for a in first.tolist()}))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(segments, pa.list_(pa.int64()))], ["doc_id", "key", "size", "segments"])

        return step

    return map_texts(docs, make, "doc_id long, key long, size long, segments array<long>")


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, component_id, key (the text's hash) and stays of each document: components of the links between documents
    whose sets of shingles have a Jaccard similarity of similarity or more. Texts without a word are linked to each
    other. In each component the row with the smallest doc_id, then key, stays, with its repeats; rows without an id stay
    only where there is no other."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    every = written(sketches(keyed, shingle), "sketches")
    total = every.count()
    found = written(every.groupBy("key").agg(F.first("size").alias("size"), F.first("segments").alias("segments"), F.count("*").alias("n")), "texts", total)
    edges = written(_candidates(found, similarity), "candidates")
    near = written(components(edges).join(found.select(F.col("key").alias("node"), "size", F.col("n").alias("copies")), "node"), "near", total)
    # one row of each text that is to be compared; most others are not shuffled
    wanted = _placed(near, edges).withColumnRenamed("node", "key").withColumnRenamed("copies", "n")
    some = sifted(keyed.select("key", "text"), wanted, "key", wanted.count())
    texts = reduce(DataFrame.unionByName, (x.dropDuplicates(["key"]) for x in spread_parts(some, wanted, "key", total)))
    sets = written(_shingle_sets(texts, shingle).withColumnRenamed("key", "node"), "sets")
    exact = _links(sets, similarity)
    empty = found.where("size = 0").select(F.lit(0).cast("long").alias("u"), F.col("key").alias("v"))
    groups = components(exact.unionByName(empty))
    of = found.select("key", "n").join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "n", F.coalesce("component", "key").alias("component"))
    named = written(spread_join(every.select("doc_id", "key"), of, "key", total), "named", total)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    one = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("one"), F.count("*").alias("n"))
    return spread_join(named, one, "component", total).select("doc_id", "component_id", "key", (F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("key") == F.col("one.key"))).alias("stays"))


def _candidates(found: DataFrame, similarity: float) -> DataFrame:
    """u, v, votes: texts v that share a bucket with its smallest text u, and how many such buckets. Similar sets have sizes
    within a factor of similarity, so they share one of two neighbouring size classes, and only those share a bucket."""
    step = F.floor(F.log(F.greatest("size", F.lit(1))) / -np.log(similarity)).cast("long")
    dealt = found.withColumn("class", F.explode(F.array(step, step + 1))).withColumn("segment", F.explode("segments"))
    dealt = dealt.select("key", "class", F.explode(tables(F.col("segment"), SEGMENT_RADIUS)).alias("b"))
    dealt = dealt.select(F.xxhash64("b.t", "b.key", "class").alias("bucket"), F.col("key").alias("v"))
    least = dealt.groupBy("bucket").agg(F.min("v").alias("u"), F.count("*").alias("n")).where("n > 1")
    return spread_join(dealt, least, "bucket", 6 * SEGMENTS * found.count()).where("u != v").groupBy("u", "v").agg(F.count("*").alias("votes"))


def _placed(near: DataFrame, edges: DataFrame) -> DataFrame:
    """near (node, component of candidates, size, copies) with few, whether its component is compared in one task, and at,
    the (component, a, b) in which it is compared first: so sets of shingles are dealt there without a join."""
    total = near.count()
    sizes = near.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).withColumn("few", (F.col("n") <= CLUSTER) & (F.col("weight") <= WEIGHT))
    near = written(spread_join(near.select("node", "component", "size", "copies"), sizes.select("component", "n", "few"), "component", total), "sized", total)
    zero = F.lit(0).cast("long")
    few = near.where("few").withColumn("at", F.array(F.struct("component", zero.alias("a"), zero.alias("b"))))
    many = near.where("not few")
    if not many.limit(1).count():
        return few
    around = _around(many.select("node", "component", "size"), edges, total).groupBy("node").agg(F.collect_list(F.struct("component", "a", "b")).alias("at"))
    return written(few.unionByName(many.join(around, "node", "left").select(*few.columns)), "placed", total)


def _links(sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: links whose components are those of all similar texts. sets: those of _placed() with their shingles."""
    compare = lambda s: _verified(s.select(F.explode("at").alias("p"), "node", "shingles").select("p.*", "node", "shingles"), similarity)
    out = compare(sets.where("few"))
    many = sets.where("not few").select("node", "component", "size")
    total = many.count()
    if not total:
        return out
    own = written(compare(sets.where("not few")), "own", 2 * total)
    family = components(own).select("node", F.col("component").alias("family"))
    many = written(many.join(family, "node", "left").select("node", "component", "size", F.coalesce("family", "node").alias("family")), "families", total)
    kinds = many.groupBy("component").agg(F.min("family").alias("x"), F.max("family").alias("y"), F.count("*").alias("n")).where("x != y").select("component", "n")
    mixed = written(spread_join(many, kinds, "component", total), "mixed", total)
    parts = components(_sharing(mixed, sets, similarity)).select("node", F.col("component").alias("part"))
    left = written(mixed.join(parts, "node").select("node", F.col("part").alias("component"), "size", "family"), "left", total)
    met = _blocks(left, total).join(sets.select("node", "shingles"), "node").select("component", "a", "b", "node", "shingles")
    return out.unionByName(own).unionByName(_verified(met, similarity))


def _around(many: DataFrame, edges: DataFrame, total: int) -> DataFrame:
    """node, component, a, b: each text beside the centre that it shares most buckets with, in blocks; the centre is in
    all blocks around it."""
    best = edges.join(many.select(F.col("node").alias("v"), "size"), "v").groupBy("v").agg(F.max_by("u", F.struct("votes", "u")).alias("u"), F.first("size").alias("size"))
    blocks = F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("size") / WEIGHT)).cast("long")
    centres = best.groupBy("u").agg(F.count("*").alias("n"), blocks.alias("blocks"))
    zero = F.lit(0).cast("long")
    members = spread_join(best, centres, "u", total).select(F.col("v").alias("node"), F.col("u").alias("component"), F.pmod(F.xxhash64("v"), F.col("blocks")).alias("a"), zero.alias("b"))
    return members.unionByName(centres.select(F.col("u").alias("node"), F.col("u").alias("component"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("a"), zero.alias("b")))


def _sharing(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: edges that connect texts of one component that share one of their rarest shingles, where texts of different
    families do. How rare a shingle is, is counted in its component. Shingles of one text are only counted: they come
    first, and connect nothing."""
    # few components: each has over CLUSTER texts or WEIGHT shingles
    held = sets.where("not few").join(F.broadcast(mixed.select("component").distinct()), "component")
    held = written(held.select("node", "component", F.explode("shingles").alias("s")).select("node", F.xxhash64("component", "s").alias("g")), "held")
    counts = held.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    some = spread_join(held, counts.withColumn("rows", F.col("n")), "g", held.count())
    shared = some.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rows", "g"))).alias("all")).join(mixed.select("node", "family", "size"), "node")
    first = (F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1).cast("int")
    alone = F.col("size").cast("int") - F.size("all")
    rare = shared.select("node", "family", F.explode(F.slice("all", F.lit(1), F.greatest(first - alone, F.lit(0)))).alias("x")).select("node", "family", "x.g")
    rare = written(rare, "rare")
    groups = rare.groupBy("g").agg(F.min("node").alias("u"), F.min("family").alias("x"), F.max("family").alias("y"), F.count("*").alias("n")).where("x != y").select("g", "u", "n")
    return spread_join(rare, groups, "g", rare.count()).select("u", F.col("node").alias("v"))


def _blocks(left: DataFrame, total: int) -> DataFrame:
    """node, component, a, b: blocks of texts that meet. All texts of a component meet, but for the blocks of its largest
    family, which need not meet each other: its texts are linked already."""
    families = left.groupBy("component", "family").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    whole = families.groupBy("component").agg(F.max_by("family", F.struct("w", "family")).alias("main"), F.max(F.struct("w", "family", "n")).alias("m"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    blocks = lambda n, w: F.greatest(F.ceil(n / CLUSTER), F.ceil(w / WEIGHT)).cast("long")
    whole = whole.withColumn("few", (F.col("n") <= CLUSTER) & (F.col("w") <= WEIGHT)).withColumn("mains", blocks(F.col("m.n"), F.col("m.w"))).withColumn("rests", blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")))
    d = spread_join(left.select("node", "component", "family"), whole.select("component", "n", "main", "few", "mains", "rests"), "component", total)
    zero = F.lit(0).cast("long")
    is_main = F.col("family") == F.col("main")
    d = d.withColumn("own", F.when(is_main, F.pmod(F.xxhash64("node"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "rests")))
    rests, mains = F.sequence(F.col("mains"), F.col("mains") + F.col("rests") - 1), F.sequence(zero, F.col("mains") - 1)
    rests = F.when(F.col("rests") > 0, rests).otherwise(F.array().cast("array<bigint>"))
    meet = F.when(is_main, rests).otherwise(F.concat(mains, F.filter(rests, lambda b: (b != F.col("own")) | (F.col("rests") == 1))))
    meet = F.when(F.col("few"), F.array(zero)).otherwise(meet)
    own = F.when(F.col("few"), zero).otherwise(F.col("own"))
    return d.withColumn("b", F.explode(meet)).withColumn("own", own).select("node", "component", F.least("own", "b").alias("a"), F.greatest("own", "b").alias("b"))


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """key, shingles (the distinct 64-bit hashes), and what else texts have but the text."""
    names = [c for c in texts.columns if c not in ("key", "text")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t, shingle)[1]).view(np.int64) for t in as_bytes(batch.column("text"))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))), *(batch.column(c) for c in names)], ["key", "shingles", *names])

        return step

    return map_texts(texts, make, "key long, shingles array<long>" + "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in names))


def _verified(met: DataFrame, similarity: float) -> DataFrame:
    n = max(1, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def edges(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        sizes = np.array([len(x) for x in sets], np.int64)
        ends = np.cumsum(sizes)
        # shingles by number, the rarest first; each set in that order
        _, flat, n_of = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(n_of), np.int32)
        rank[np.argsort(n_of, kind="stable")] = np.arange(len(n_of), dtype=np.int32)
        flat = rank[flat]
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            flat[a:b].sort()
        mark = np.zeros(len(rank), bool)
        # similar sets share similarity of the larger one's shingles, so one at least of the first of each
        first = np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)
        rare = np.concatenate([flat[e - n : e - n + k] for e, n, k in zip(ends.tolist(), sizes.tolist(), first.tolist(), strict=True)])
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), first)[np.argsort(rare, kind="stable")]
        until = np.cumsum(np.bincount(rare, minlength=len(rank)))
        having = np.diff(until, prepend=0)
        shares = np.zeros(len(sets), bool)

        def test(left: np.ndarray, at: int) -> np.ndarray:
            """Shared shingles of one document with all that may be similar, a bounded number at a time."""
            own = flat[ends[at] - sizes[at] : ends[at]]
            hit = (np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at])) & (sizes[left] > 0)
            lead = own[: first[at]]
            if having[lead].sum() < sizes[left[hit]].sum():  # else it is less work to compare all
                for x in lead.tolist():
                    shares[owners[until[x] - having[x] : until[x]]] = True
                hit &= shares[left]
                shares[:] = False
            mark[own] = True
            places = np.flatnonzero(hit)
            for part in np.array_split(places, max(1, int(sizes[left[places]].sum()) >> 18)) if len(places) else ():
                n = sizes[left[part]]
                start = np.cumsum(n) - n
                place = np.arange(n.sum()) + np.repeat(ends[left[part]] - n - start, n)
                shared = np.add.reduceat(mark[flat[place]], start, dtype=np.int64)
                hit[part] = shared >= similarity * (n + sizes[at] - shared) - 1e-9
            mark[own] = False
            return hit

        return [(nodes[i], nodes[j]) for i, j in cluster(len(nodes), test)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            found = []
            shingles = batch.column("shingles")
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b", "node")), strict=True)
            for i, (component, a, b, node) in enumerate(keys):
                if now != (component, a, b):
                    found += edges(nodes, sets)
                    now, nodes, sets = (component, a, b), [], []
                nodes.append(node)
                sets.append(shingles[i].values.to_numpy(zero_copy_only=False).copy())
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])
            pa.default_memory_pool().release_unused()
        found = edges(nodes, sets)
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return map_batches(met.repartition(n, "component", "a", "b").sortWithinPartitions("component", "a", "b"), run, "u long, v long").distinct()
