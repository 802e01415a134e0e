"""Benchmark decontamination: a BM25 inverted index of test items searched by block-max WAND, then overlap checks.

Items are put into classes by length, each up to twice as long as the one before. For a class, every document is read as
passages of twice the class's greatest length, starting at every multiple of that length, so that each item-long stretch
lies whole in some passage. A passage is a query. An item's score is divided by the highest it can reach, so one threshold
serves all.

Postings are ordered by item and cut into blocks with the highest impact of each (block-max). Per item, its lightest terms
that together stay under SLACK are left out of the postings; bounds are raised by SLACK instead. The search first adds up,
for all passages of a batch at once, the highest impacts of their terms in each range of RANGE items, and drops ranges that
cannot reach the threshold. In a range that can, WAND runs over the posting lists: cursors are ordered by item, the first
at which the lists' maxima add up to the threshold is the pivot, a pivot whose blocks' maxima do not reach it is skipped
with its blocks, and only at a pivot that all cursors before it have come to are impacts added. So no item at or above
the threshold is missed. Items found are scored with all their terms, and those above the threshold verified: five-word
shingles of question (all but the last sentence) and answer (the last sentence) must be found in the passage.

The benchmark is parsed and counted by Spark. Chunks of about INDEX_ITEMS items and INDEX_WORDS words at most come to the
driver one by one; each is sent to all tasks and takes one pass over the documents, and what it finds is written before the
next is read. Counts of items and words are those of the whole benchmark, so scores and matches do not depend on chunks.

Defined results: null and empty texts, and items without a word, match nothing; a null doc_id or item_id is carried;
benchmark rows that repeat count once, and rows that repeat give one row a pair; a very long item makes passages long for
its own class only; further columns of either table are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_texts, written

THRESHOLD = 0.6
SLACK = 0.3
#: Items of a range, postings of a block.
RANGE, BLOCK = 16, 4
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
INDEX_ITEMS = 20_000
INDEX_WORDS = 2_000_000

#: Bytes of words stay; ASCII punctuation and controls become a space.
NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(NORMAL).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """Word n-grams; fewer words are one shingle of their own."""
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n, 0) + 1)} if words else set()


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    question: list[bytes]
    answer: list[bytes]


def parted(item_id, text: str) -> Item:
    parts = SENTENCE.split(text.strip())
    question, answer = (words_of(" ".join(parts[:-1])), words_of(parts[-1])) if len(parts) > 1 else (words_of(text), [])
    return Item(item_id, words_of(text), question, answer)


def overlap(wanted: list[bytes], passage: list[bytes], have: set[tuple[bytes, ...]]) -> float:
    own = shingles(wanted)
    if not own:
        return 1.0
    if len(wanted) < SHINGLE:
        return float(any(passage[i : i + len(wanted)] == wanted for i in range(len(passage) - len(wanted) + 1)))
    return len(own & have) / len(own)


@dataclass
class Totals:
    """What scores take from the whole benchmark: its items, their words, and how many items hold a word."""

    items: int
    words: int
    holding: dict[bytes, int]


def totals(items: list[Item]) -> Totals:
    some = [x for x in items if x.words]
    return Totals(len(some), sum(len(x.words) for x in some), Counter(w for x in some for w in set(x.words)))


def span_of(words: int) -> int:
    """The greatest length of an item's class: a power of two, 16 at least."""
    return 1 << max(4, (words - 1).bit_length())


class Lists:
    """Posting lists of the items of one class, by number of the term."""

    def __init__(self, span: int, items: list[int], postings: list[dict[int, float]], terms: int, size: int, block: int) -> None:
        """postings: of each item, its terms and their impacts."""
        self.span, self.items, self.size, self.block = span, items, size, block
        self.postings: dict[int, tuple[list[int], list[float], list[float], float]] = {}
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, own in enumerate(postings):
            for t, v in own.items():
                lists.setdefault(t, []).append((i, v))
        tops = []
        for t in sorted(lists):
            at, impacts = [i for i, _ in lists[t]], [v for _, v in lists[t]]
            self.postings[t] = at, impacts, [max(impacts[j : j + block]) for j in range(0, len(at), block)], max(impacts)
            top: dict[int, float] = {}
            for i, v in lists[t]:
                top[i // size] = max(top.get(i // size, 0.0), v)
            tops += [(t, r, v) for r, v in sorted(top.items())]
        self.ranges = (len(items) + size - 1) // size
        self.length = np.bincount([t for t, _, _ in tops], minlength=terms).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.of_range = np.array([r for _, r, _ in tops], np.int64)
        self.maxima = np.array([v for _, _, v in tops])

    def reachable(self, text: np.ndarray, at: np.ndarray, term: np.ndarray, least: float) -> list[tuple[int, int, int]]:
        """(text, passage, range) of all ranges whose maxima of a passage's terms add up to least. One entry a known word."""
        if not len(term):
            return []
        passage = at // self.span
        width, terms = int(passage.max()) + 2, len(self.length)
        # a word lies in the passage that starts at its stretch and in the one before
        home = (text * width + passage + 1)[:, None] - np.array([0, 1])
        kept = np.stack([np.ones(len(passage), bool), passage > 0], axis=1)
        pair = np.unique(home[kept] * terms + np.repeat(term[:, None], 2, axis=1)[kept])
        home, term = pair // terms, pair % terms
        n = self.length[term]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term], n)
        key, back = np.unique(np.repeat(home, n) * self.ranges + self.of_range[place], return_inverse=True)
        bound = np.bincount(back, self.maxima[place], len(key))
        key = key[bound >= least]
        home = key // self.ranges
        return list(zip((home // width).tolist(), (home % width - 1).tolist(), (key % self.ranges).tolist(), strict=True))

    def wand(self, terms, number: int, least: float) -> list[int]:
        """Items of a range whose impacts of the terms add up to least, by pivots over the lists' cursors."""
        end = min((number + 1) * self.size, len(self.items))
        cursors = []  # item, place in the list, the list's highest impact, the list
        for t in terms:
            if t in self.postings:
                own = self.postings[t]
                p = bisect.bisect_left(own[0], number * self.size)
                if p < len(own[0]) and own[0][p] < end:
                    cursors.append([own[0][p], p, own[3], own])
        out = []

        def move(c: list, item: int) -> None:
            c[1] = bisect.bisect_left(c[3][0], item, c[1])
            c[0] = c[3][0][c[1]] if c[1] < len(c[3][0]) else end

        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
            bound, last = 0.0, -1
            while bound < least and last + 1 < len(cursors):
                last += 1
                bound += cursors[last][2]
            if bound < least:
                return out
            pivot = cursors[last][0]
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            ahead = cursors[: last + 1]
            bound, until = 0.0, cursors[last + 1][0] if last + 1 < len(cursors) else end
            for c in ahead:  # the block of each list that the pivot would be in, and where the first of these ends
                p = bisect.bisect_left(c[3][0], pivot, c[1])
                if p < len(c[3][0]):
                    bound += c[3][2][p // self.block]
                    stop = (p // self.block + 1) * self.block
                    until = min(until, c[3][0][stop - 1] + 1 if stop <= len(c[3][0]) else end)
            if bound < least:
                for c in ahead:
                    move(c, max(until, pivot + 1))
            elif ahead[0][0] == pivot:
                if sum(c[3][1][c[1]] for c in ahead) >= least:
                    out.append(pivot)
                for c in ahead:
                    move(c, pivot + 1)
            else:
                for c in ahead:
                    move(c, pivot)


class Index:
    """An index of items, which are all of the benchmark or, with the totals of all, a part of it."""

    def __init__(self, items: list[Item], threshold: float = THRESHOLD, slack: float = SLACK, size: int = RANGE, block: int = BLOCK, whole: Totals | None = None) -> None:
        self.items = [x for x in items if x.words]
        self.threshold = threshold
        self.least = threshold - slack - 1e-9  # sums of another order differ in their last bits
        whole = whole or totals(self.items)
        df, n, mean = whole.holding, whole.items, whole.words / max(whole.items, 1)
        self.impact: list[dict[bytes, float]] = []
        self.terms: dict[bytes, int] = {}
        classes: dict[int, tuple[list[int], list[dict[int, float]]]] = {}
        for i, x in enumerate(self.items):
            own = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(x.words) / mean)) for w, f in Counter(x.words).items()}
            top = sum(own.values())
            self.impact.append({w: v / top for w, v in own.items()})
            left_out, posted = 0.0, {}
            for w, v in sorted(self.impact[-1].items(), key=lambda p: (p[1], p[0])):
                if left_out + v < slack:
                    left_out += v
                else:
                    posted[self.terms.setdefault(w, len(self.terms))] = v
            numbers, postings = classes.setdefault(span_of(len(x.words)), ([], []))
            numbers.append(i)
            postings.append(posted)
        self.classes = [Lists(span, *classes[span], len(self.terms), size, block) for span in sorted(classes)]

    def matches(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlaps of item, question and answer) of every item above the threshold in a passage."""
        get = self.terms.get
        term = np.fromiter((get(w, -1) for words in texts for w in words), np.int64)
        counts = np.array([len(w) for w in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = term >= 0
        term, text, at = term[known], text[known], at[known]
        out = []
        for lists in self.classes:
            now = None
            for t, p, r in lists.reachable(text, at, term, self.least):
                if now != (t, p):
                    now, have = (t, p), None
                    passage = texts[t][p * lists.span : (p + 2) * lists.span]
                    own = set(passage)
                    numbers = sorted({self.terms[w] for w in own if w in self.terms})
                for i in lists.wand(numbers, r, self.least):
                    x = self.items[lists.items[i]]
                    score = sum(v for w, v in self.impact[lists.items[i]].items() if w in own)
                    if score >= self.threshold:
                        have = have or shingles(passage)
                        out.append((t, lists.items[i], score, overlap(x.words, passage, have), overlap(x.question, passage, have), overlap(x.answer, passage, have)))
        return out


SCHEMA = "doc_id long, item_id long, score double, item_overlap double, question_overlap double, answer_overlap double"
NAMES = ["doc_id", "item_id", "score", "item_overlap", "question_overlap", "answer_overlap"]


def is_leak(item: float, question: float, answer: float, least: float = OVERLAP) -> bool:
    return item >= least or question >= least and answer >= least


def parsed(benchmark: DataFrame) -> DataFrame:
    """item_id, text, n_words and the distinct words of each item that has a word; rows that repeat count once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [words_of(x) for x in batch.column("text").to_pylist()]
            held = pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in words], pa.int64()), held], ["item_id", "text", "n_words", "words"])

        return step

    return map_texts(rows, make, "item_id long, text string, n_words long, words array<string>").where("n_words > 0")


def parts(benchmark: DataFrame) -> Iterator[tuple[list[Item], Totals, bool]]:
    """Chunks of items with the totals of all, one after the other, and whether a chunk is the only one."""
    items = written(parsed(benchmark), "items")
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    if not n_items:
        return
    n = max(-(-n_items // INDEX_ITEMS), -(-n_words // INDEX_WORDS))
    placed = items.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    holding = written(items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "holding")
    for k in range(n):
        own = placed.where(F.col("chunk") == k)
        held = holding if n == 1 else holding.join(own.select(F.explode("words").alias("word")).distinct(), "word")
        counts = {r["word"].encode(): r["n"] for r in held.toLocalIterator()}
        found = [parted(r["item_id"], r["text"]) for r in own.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
        yield found, Totals(n_items, n_words, counts), n == 1


def leaks(docs: DataFrame, benchmark: DataFrame, overlaps: float = OVERLAP) -> DataFrame:
    """One row for each document and item found in it, with the best passage's score and overlaps."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    best = lambda found: found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*NAMES[2:])).alias("best")).select("doc_id", "item_id", "best.*")
    every = None
    for items, whole, only in parts(benchmark):
        found = best(_search(source, items, whole, overlaps))
        found = found if only else written(found, "leaks")
        every = found if every is None else every.unionByName(found)
    if every is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return every if only else best(every)  # items that share an id may lie in several chunks


def _search(source: DataFrame, items: list[Item], whole: Totals, overlaps: float) -> DataFrame:
    def make():
        index = Index(items, whole=whole)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple, tuple] = {}
            for t, i, score, *shares in index.matches([words_of(x or "") for x in batch.column("text").to_pylist()]):
                if is_leak(*shares, overlaps):
                    key = (ids[t], index.items[i].item_id)
                    best[key] = max(best.get(key, ()), (score, *shares))
            rows = [(*k, *v) for k, v in best.items()]
            kinds = (pa.int64(), pa.int64(), *(pa.float64(),) * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], NAMES)

        return step

    return map_texts(source, make, SCHEMA)
