"""Exact repeated-substring removal by merging Burrows-Wheeler transforms of shards.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another.

1. Anchors. Every LENGTH-byte string holds a seed (a shorter string) whose hash is the least in it, at a place that its
   bytes alone decide. Equal strings thus have equal anchors at equal places, so only strings around equal anchors are compared.
   The text around an anchor that such strings can reach, LENGTH bytes less the seed on the left and LENGTH bytes from the
   anchor on, is its context.
2. Copies. Contexts are grouped by anchor and hash; where a context occurs twice all of it is repeated and nothing else is
   looked at. Anchors that occur once are dropped. What is left are anchors with several distinct contexts, each once.
3. Merge. Contexts are aligned at their anchors and dealt to tasks by anchor. A task cuts them into shards, each with a
   positional Burrows-Wheeler transform: for every column the shard's order of reversed prefixes, and the bytes in that
   order. The transforms are merged by refining their interleave column by column: the merged order of one column, read
   through the shards' own orders, is stably dealt by byte, which is the merged order of the next. No suffix is sorted
   again. The first column of the common part of merged neighbours is carried along; where that part reaches LENGTH bytes,
   the interval's members are repeated there.
4. Anchors with more than GROUP distinct contexts don't fit one task. Their LENGTH-byte strings are hashed and counted in
   Spark, key by key, which gives the same strings.

Two lengths at once (remove_repeats_and_passages): the shorter is searched in all texts, the longer only in what that covers.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than LENGTH are kept; repeated rows
are repeats of each other; further columns are carried by remove_repeats() whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import as_bytes, fewer, map_batches, map_texts, sifted, small_batches, written

LENGTH = 400
GROUP = 16_384
#: Contexts of small groups that are merged in one go.
TOGETHER = 4096
SHARD = 2048
#: No byte of UTF-8: stands where a context is cut by the start or the end of its text, and equals nothing.
PAD = 0xFF


def seed_size(length: int) -> int:
    return max(8, length * 4 // 25)


_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size-byte string, from hashes of halves."""
    with np.errstate(over="ignore"):
        power, base, done, out = _TABLE[data], np.uint64(0x9E3779B97F4A7C15), 0, None
        step = 1
        left = size
        while left:
            if left & 1:
                out = power[: len(data) - size + 1] if out is None else out * base + power[done : done + len(data) - size + 1]
                done += step
            left >>= 1
            if left:
                power = power[:-step] * base + power[step:]
                base = base * base + np.uint64(2)
                step *= 2
        return _mixed(out)


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each width values in a row."""
    step, now = 1, values
    while step * 2 <= width:
        now = best(now[:-step], now[step:])
        step *= 2
    rest = width - step
    return best(now[: len(now) - rest], now[rest:]) if rest else now


def anchors_of(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Places of the anchors, their hashes, and spans of the text that are repeated within it a short way on.

    Where a string holds its least hash several times, its anchor is the first or the last of these, whichever lies
    farther from the string's own end: in text with a period, strings that reach beyond it then share one anchor at its
    edge. Strings inside it equal those a period on; they are known to be repeated, and only one of each kind keeps its
    anchor."""
    seed, none = seed_size(length), (np.zeros(0, np.int64), np.zeros(0, np.uint64), [])
    if len(text) < length:
        return none
    data = np.frombuffer(text, np.uint8)
    h = rolling(data, seed)
    width = length - seed + 1
    least = slide(h, width, np.minimum)
    # a place is an anchor if the minimum of some string that holds it is its own hash
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    order = np.argsort(h[at], kind="stable")
    gaps = np.diff(at[order])[h[at][order][1:] == h[at][order][:-1]]
    gaps = np.unique(gaps[gaps < width])
    if not len(gaps):
        return at, h[at], []
    needed, spans = np.ones(len(least), bool), []
    kinds = np.zeros(len(least), bool)
    for q in gaps.tolist():
        for a, b in runs(data[:-q] == data[q:]):
            if b - a >= length:  # the text from a to b + q has the period q
                needed[a : b + q - length + 1] = False
                kinds[a : a + q] = True
                spans.append((a, b + q))
    place = np.arange(len(h))
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64) << 32
    low = (1 << 32) - 1
    first, last = slide(rank | place, width, np.minimum) & low, len(h) - (slide(rank | (len(h) - place), width, np.minimum) & low)
    start = np.arange(len(least))
    chosen = np.where(first - start < start + width - 1 - last, last, first)
    at = np.unique(chosen[needed | kinds])
    return at, h[at], joined(spans)


def context_of(place: int, size: int, length: int) -> tuple[int, int]:
    return max(0, place - length + seed_size(length)), min(size, place + length)


ANCHORS = "k1 long, k2 long, place int, first int, last int, anchor long, context long"


def _anchors(keyed: DataFrame, length: int) -> DataFrame:
    def make():
        import xxhash

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, places, firsts, lasts, hashes, contexts = [], [], [], [], [], []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                at, h, spans = anchors_of(text, length)
                view = memoryview(text)
                rows += [i] * len(at)
                for p in at.tolist():
                    a, b = context_of(p, len(text), length)
                    places.append(p)
                    firsts.append(a)
                    lasts.append(b)
                    contexts.append(xxhash.xxh3_64_intdigest(view[a:b], p - a))
                hashes.append(h)
                for a, b in spans:  # known already: no anchor
                    rows.append(i)
                    places.append(-1)
                    firsts.append(a)
                    lasts.append(b)
                    contexts.append(0)
                hashes.append(np.zeros(len(spans), np.uint64))
            take = pa.array(rows, pa.int64())
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            out = [batch.column("k1").take(take), batch.column("k2").take(take), *(pa.array(x, pa.int32()) for x in (places, firsts, lasts)), pa.array(h.view(np.int64)), pa.array(np.array(contexts, np.uint64).view(np.int64))]
            return pa.RecordBatch.from_arrays(out, ["k1", "k2", "place", "first", "last", "anchor", "context"])

        return step

    return map_texts(keyed.select("k1", "k2", "text"), make, ANCHORS)


def repeated_ends(contexts: np.ndarray, length: int, shard: int = SHARD) -> np.ndarray:
    """contexts: one row each, PAD where cut. True where the length bytes that end in a column are found in another row
    at the same columns."""
    n, width = contexts.shape
    column = np.ascontiguousarray(contexts.T)
    shard_of = (np.arange(n) // shard).astype(np.uint16)
    own = np.arange(n)  # shard after shard, each in its own order
    merged_shard = shard_of.copy()  # the interleave
    start = np.zeros(n + 1, np.int32)  # where the common part of a row and the one before it begins
    out = np.zeros((width, n), bool)
    for j in range(width):
        byte = column[j][own]
        slots = np.argsort(merged_shard, kind="stable")  # merged places, shard after shard
        merged = np.empty(n, np.uint8)
        merged[slots] = byte
        dealt = np.argsort(merged, kind="stable")
        by_byte = np.argsort(byte, kind="stable")
        own = own[by_byte[np.argsort(shard_of[by_byte], kind="stable")]]
        merged_shard = merged_shard[dealt]
        sorted_bytes = merged[dealt]
        same = (sorted_bytes[1:] == sorted_bytes[:-1]) & (sorted_bytes[1:] != PAD)
        fresh = np.full(n + 1, j + 1, np.int32)
        if same.any():
            pairs = np.empty(2 * int(same.sum()), np.int64)
            pairs[0::2], pairs[1::2] = dealt[:-1][same] + 1, dealt[1:][same] + 1
            fresh[1:n][same] = np.maximum.reduceat(start, pairs)[::2]
        start = fresh
        if j + 1 >= length:
            long = np.flatnonzero(j + 1 - start[1:n] >= length)
            if len(long):
                row = np.empty(n, np.int64)
                row[np.argsort(merged_shard, kind="stable")] = own
                out[j, row[long]] = out[j, row[long + 1]] = True
    return out.T


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def covered(ends: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of the bytes under strings that end where ends is True."""
    return joined([(a - length + 1, b) for a, b in runs(ends)])


def joined(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


CONTEXTS = "k1 long, k2 long, first int, lead int, anchor long, bytes binary"
SPANS = "k1 long, k2 long, first int, end int"


def _contexts(keyed: DataFrame, probes: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts of probes (k1, k2, place, anchor)."""
    lists = probes.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "anchor")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 << 20):
            rows = []
            for k1, k2, text, wanted in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), as_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    a, b = context_of(w["place"], len(text), length)
                    rows.append((k1, k2, a, length - seed_size(length) - (w["place"] - a), w["anchor"], text[a:b]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["k1", "k2", "first", "lead", "anchor", "bytes"])

    return map_batches(keyed.join(lists, ["k1", "k2"]), run, CONTEXTS)


def _merged(contexts: DataFrame, length: int, group: int) -> DataFrame:
    """Spans of the contexts that are repeated in another context of their anchor. No anchor has more than group."""
    width = 2 * length - seed_size(length)
    n = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.repartition(n, "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            spans = []
            if len(rows) > 1:
                table = np.full((len(rows), width), PAD, np.uint8)
                for i, (_, _, _, lead, _, raw) in enumerate(rows):
                    table[i, lead : lead + len(raw)] = np.frombuffer(raw, np.uint8)
                ends = repeated_ends(table, length)
                for i in np.flatnonzero(ends.any(axis=1)).tolist():
                    k1, k2, first, lead, _, _ = rows[i]
                    spans += [(k1, k2, first + a - lead, first + b - lead) for a, b in covered(ends[i], length)]
            return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "first", "end"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "first", "lead", "anchor", "bytes")), strict=True):
                if len(held) >= min(group, TOGETHER) and held[-1][4] != row[4]:
                    yield flush(held)
                    held = []
                held.append(row)
        yield flush(held)

    return map_batches(dealt, run, SPANS)


#: Bytes by which the reach of a context is narrowed at a time.
STEP = 24


def _reach(contexts: DataFrame, length: int) -> DataFrame:
    """contexts with left and right: how far, in whole steps from the seed, the text is found again around its anchor."""
    seed = seed_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, "bytes", 1 << 19):
            rows, far, hashes = [], [], []
            for i, (lead, raw) in enumerate(zip(batch.column("lead").to_pylist(), as_bytes(batch.column("bytes")), strict=True)):
                at = length - seed - lead
                reach = [(-j, raw[at - j : at + seed]) for j in range(STEP, at + 1, STEP)] + [(j, raw[at : at + seed + j]) for j in range(STEP, len(raw) - at - seed + 1, STEP)]
                rows += [i] * len(reach)
                far += [j for j, _ in reach]
                hashes += [xxhash.xxh3_64_intdigest(x, j & 0xFFFF) for j, x in reach]
            take = pa.array(rows, pa.int64())
            out = [*(batch.column(c).take(take) for c in KEY), pa.array(far, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out, [*KEY, "far", "h"])

    parts = map_batches(contexts, run, "k1 long, k2 long, anchor long, first int, lead int, far int, h long")
    twice = parts.groupBy("anchor", "far", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    known = parts.join(twice, ["anchor", "far", "h"]).groupBy(*KEY).agg(F.coalesce(-F.min(F.when(F.col("far") < 0, F.col("far"))), F.lit(0)).alias("left"), F.coalesce(F.max(F.when(F.col("far") > 0, F.col("far"))), F.lit(0)).alias("right"))
    return contexts.join(known, list(KEY), "left").fillna(0, ["left", "right"])


KEY = ("k1", "k2", "anchor", "first", "lead")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of any size. Each context is narrowed to what is found again to the left and to the right of
    its anchor. If that stretch as a whole is found again, all strings in it are; the strings left to decide, which reach
    less than a step beyond it, or all in reach where it is not, are hashed, counted and joined back by their hash."""
    seed = seed_size(length)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, "bytes", 1 << 19):
            columns = (batch.column(c).to_pylist() for c in ("lead", "left", "right"))
            h = [xxhash.xxh3_64_intdigest(raw[length - seed - lead - left : length - lead + right]) for lead, left, right, raw in zip(*columns, as_bytes(batch.column("bytes")), strict=True)]
            yield batch.append_column("h", pa.array(np.array(h, np.uint64).view(np.int64)))

    reached = _reach(contexts, length)
    reached = written(map_batches(reached, whole, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reached.schema) + ", h long"), "reach")
    twice = reached.where(F.col("left") + F.col("right") + seed >= length).groupBy("anchor", "left", "right", "h").agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("one")).where("n > 1").select("anchor", "left", "right", "h", "one")
    # one context of each such stretch still gives all its strings, for those that share only a part of it
    reached = reached.join(twice, ["anchor", "left", "right", "h"], "left").withColumn("whole", F.col("one").isNotNull()).withColumn("known", F.col("whole") & (F.struct(*KEY) != F.col("one"))).drop("h", "one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "bytes", 1 << 19):
            rows, hashes, firsts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("first", "lead", "left", "right", "known"))
            for i, (first, lead, left, right, known, raw) in enumerate(zip(*columns, as_bytes(batch.column("bytes")), strict=True)):
                at = length - seed - lead
                # a string that begins l bytes before the anchor reaches length - seed - l bytes beyond the seed
                a, b = max(0, at - left - STEP + 1), min(len(raw) - length, at + seed + right + STEP - 1 - length)
                inner = (at - left, at + seed + right - length + 1) if known else (b + 1, b + 1)
                for x, y in ((a, min(b + 1, inner[0])), (max(a, inner[1]), b + 1)):
                    if x < y:
                        h = rolling(np.frombuffer(raw, np.uint8)[x : y - 1 + length], length)
                        rows.append(np.full(len(h), i))
                        hashes.append(h.view(np.int64))
                        firsts.append(first + x + np.arange(len(h)))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            out = [*(batch.column(c).take(take) for c in ("k1", "k2", "anchor")), pa.array(np.concatenate(firsts).astype(np.int32) if rows else [], pa.int32()), pa.array(np.concatenate(hashes) if rows else [], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["k1", "k2", "anchor", "first", "h"])

    strings = map_batches(reached, run, "k1 long, k2 long, anchor long, first int, h long")
    # two contexts of one text may hold the same string at the same place: places are counted, not rows
    at = F.struct("k1", "k2", "first")
    again = strings.groupBy("anchor", "h").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("anchor", "h")
    single = strings.join(again, ["anchor", "h"]).select("k1", "k2", "first", (F.col("first") + length).alias("end"))
    place = F.col("first") + (length - seed) - F.col("lead")
    return single.unionByName(reached.where("whole").select("k1", "k2", (place - F.col("left")).alias("first"), (place + seed + F.col("right")).alias("end")))


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2, text and row, a struct of the other columns. Rows of the same doc_id and text share their keys."""
    names = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*names).alias("row") if names else F.struct(F.lit(0).alias("none")).alias("row"), F.col("text").cast("string").alias("text"))
    own = F.col("row.doc_id").cast("string") if "doc_id" in names else F.lit("")
    return packed.select(F.xxhash64(own).alias("k1"), F.xxhash64("text").alias("k2"), "text", "row")


def _dealt(keyed: DataFrame) -> DataFrame:
    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(n, "k1", "k2")


def _repeated(keyed: DataFrame, dealt: DataFrame, length: int, group: int) -> DataFrame:
    """k1, k2 and spans, the spans of a text's bytes under strings that are repeated; they may overlap. dealt: keyed by its
    keys."""
    if length < 16:
        raise ValueError("length must be 16 bytes or more")
    found = written(_anchors(fewer(keyed), length), "anchors")
    local, anchors = found.where("place < 0").select("k1", "k2", "first", F.col("last").alias("end")), found.where("place >= 0")
    classes = anchors.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    totals = classes.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("classes")).where("total > 1").drop("total")
    wanted = written(fewer(classes.join(totals, "anchor").select("anchor", "context", "n", "one", "classes")), "classes")
    copies = anchors.join(wanted.where("n > 1").select("anchor", "context"), ["anchor", "context"]).where(F.col("last") - F.col("first") >= length).select("k1", "k2", "first", F.col("last").alias("end"))
    probes = wanted.where("classes > 1").select("one.*", "anchor", "classes")
    spans = _merged(_contexts(dealt, probes.where(F.col("classes") <= group), length), length, group)
    hot = probes.where(F.col("classes") > group)
    if hot.limit(1).count():
        spans = spans.unionByName(_counted(written(_contexts(keyed, hot, length), "hot"), length))
    return _gathered(spans.unionByName(copies).unionByName(local))


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def _shrunk(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [x for s in spans for x in [within_characters(raw, *s)] if x[0] < x[1]]


def _joined(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [joined((s["first"], s["end"]) for s in found or ()) for found in column.to_pylist()]


KEPT = "n_bytes long, kept binary, spans array<struct<first: int, end: int>>"
_SPAN_LIST = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _as_spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "end": b} for a, b in own] for own in spans], _SPAN_LIST)


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, whole: bool = False) -> DataFrame:
    """row (a struct of docs' columns but text), n_bytes, kept (the bytes left) and spans (array<struct<first, end>> of
    byte places). whole: spans shrink to whole characters, and kept is their text."""
    keyed = _keyed(docs)
    dealt = _dealt(keyed)  # the text is shuffled once and read for the contexts and for the result
    pieces = dealt.join(_repeated(keyed, dealt, length, group), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = as_bytes(batch.column("text"))
            spans = [_shrunk(raw, own) if whole else own for raw, own in zip(texts, _joined(batch.column("spans")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(map(len, texts), pa.int64()), pa.array(map(_without, texts, spans), pa.binary()), _as_spans(spans)], ["row", "n_bytes", "kept", "spans"])

    return map_batches(fewer(pieces.select("k1", "k2", "row", "text", "spans")), run, f"row {keyed.schema['row'].dataType.simpleString()}, {KEPT}")


#: Bytes of a passage: under fifty words of any of the languages served.
PASSAGE = 200


def remove_repeats_and_passages(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, group: int = GROUP) -> DataFrame:
    """What remove_repeats(docs, length) returns, and n_in_passages and without_passages: the bytes of whole characters
    under repeated strings of passage bytes, and the text without them. passage is at most length.

    Any passage bytes of a repeated string are repeated, so strings of length bytes stand in the joined spans of the
    passages, each whole in one: only these stretches, as texts of their own, are searched for them."""
    if passage > length:
        raise ValueError("passage must not be longer than length")
    keyed = _keyed(docs)
    short = written(_repeated(keyed, _dealt(keyed), passage, group), "passages")
    far = short.where(F.array_max("spans.end") - F.array_min("spans.first") >= length)
    texts = sifted(keyed.select("k1", "k2", "text"), far, "k2", far.count()).join(far, ["k1", "k2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = zip(as_bytes(batch.column("text")), _joined(batch.column("spans")), strict=True)
            rows = [(i, a, raw[a:b]) for i, (raw, spans) in enumerate(found) for a, b in spans if b - a >= length]
            take = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), pa.array([a for _, a, _ in rows], pa.int32()), pa.array([t for _, _, t in rows], pa.binary())], ["k1", "k2", "base", "text"])

    parts = written(map_batches(texts.select("k1", "k2", "text", "spans"), cut, "k1 long, k2 long, base int, text binary").withColumn("part", F.xxhash64("k2", "base")), "parts")
    alone = parts.select("k1", F.col("part").alias("k2"), "text")
    inside = _repeated(alone, _dealt(alone), length, group).select("k1", F.col("k2").alias("part"), F.explode("spans").alias("s"))
    inside = inside.join(parts.select("k1", "part", "k2", "base").distinct(), ["k1", "part"])
    long = _gathered(inside.select("k1", "k2", (F.col("base") + F.col("s.first")).alias("first"), (F.col("base") + F.col("s.end")).alias("end")))
    pieces = _dealt(keyed).join(short.withColumnRenamed("spans", "passages").join(long, ["k1", "k2"], "left"), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = as_bytes(batch.column("text"))
            spans = _joined(batch.column("spans"))
            passages = [_shrunk(raw, own) for raw, own in zip(texts, _joined(batch.column("passages")), strict=True)]
            columns = [batch.column("row"), pa.array(map(len, texts), pa.int64()), pa.array(map(_without, texts, spans), pa.binary()), _as_spans(spans)]
            columns += [pa.array([sum(b - a for a, b in own) for own in passages], pa.int64()), pa.array(map(_without, texts, passages), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "kept", "spans", "n_in_passages", "without_passages"])

    return map_batches(fewer(pieces.select("k1", "k2", "row", "text", "passages", "spans")), run, f"row {keyed.schema['row'].dataType.simpleString()}, {KEPT}, n_in_passages long, without_passages binary")


def within_characters(raw: bytes, first: int, end: int) -> tuple[int, int]:
    """The span without the characters that it cuts."""
    while first < end and raw[first] & 0xC0 == 0x80:
        first += 1
    while end > first and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return first, end


def digest(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and text, the bytes left as a string; characters that
    a cut has split come out as U+FFFD there. n_in_passages and without_passages follow where found has them."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["first"]))
    text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    more = ["n_in_passages", text("without_passages").alias("without_passages")] if "without_passages" in found.columns else []
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text("kept").alias("text"), *more)
