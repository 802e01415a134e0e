"""Quality rules: base rules, then gradient-boosted trees over document statistics.

The trees are fitted on the driver over a bounded sample of labelled documents (SAMPLE rows, those whose ids hash
lowest); what is gathered there is one row of numbers each. Scoring runs in Arrow batches over flat node arrays.

Defined results: a null or empty text has no words and fails the base rules; a label that is null, or whose document is
missing, is not used; with no labels at all the trees keep every document; repeated rows each give their own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm import gbt
from turnwise.llm.common import as_bytes, map_texts

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 6000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_lines", "repeats", "upper", "digits", "marks", "line_words", "distinct", "bars")
#: The score may only fall as these rise.
MONOTONE = {FEATURES.index(k): -1 for k in ("symbols_per_word", "dup_lines", "repeats")}


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """(words in windows that are found twice or more, distinct words). Windows are compared exactly: each gets the
    rank of its pair of shorter windows, so equal ranks mean equal words."""
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(one) - window + 1
    if n < 2:
        return 0, len(ids)
    key, size, known = one, 1, len(ids)
    while size < window:
        step = min(size, window - size)
        # the window of size + step words is its first size words and its last size words, which overlap if step < size
        key = key[: len(key) - step] * known + key[step:]
        size += step
        if size < window and known * known >= 2**31 or known >= 2**31:
            key = np.unique(key, return_inverse=True)[1]
            known = int(key.max()) + 1
        else:
            known = known * known
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0, len(ids)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    delta = np.zeros(len(one) + 1, np.int32)
    at = np.flatnonzero(again)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + window, -1)
    return int((np.cumsum(delta[:-1]) > 0).sum()), len(ids)


def measures(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts and the features of one text."""
    words = text.split()  # bytes.split() splits at exactly the six ASCII white-space bytes
    n, size = len(words), len(text)
    less = lambda chars: size - len(text.translate(None, chars))
    chars = size - less(bytes(range(0x80, 0xC0)))  # code points: bytes that don't continue one
    symbols = less(SYMBOLS)
    seen: set[bytes] = set()
    dup = n_lines = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    repeats, distinct = repeated_words(words)
    in_words = chars - less(SPACES)
    base = (n, in_words, symbols, dup, repeats)
    per = 1 / max(n, 1)
    return base, (np.log1p(n), in_words * per, symbols * per, dup / max(n_lines, 1), repeats * per, less(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(in_words, 1), less(b"0123456789") / max(in_words, 1), less(b"!?") * per, n / max(n_lines, 1), distinct * per, less(b"|") * per)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _features(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [list(map(float, measures(t)[1])) for t in as_bytes(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

        return step

    return map_texts(docs, make, "y double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Trees:
    """Trees for the probability that a document is good, from at most sample labelled documents."""
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")
    got = _features(known).orderBy(F.xxhash64("x", "y"), "y").limit(sample).toPandas()
    got = got.iloc[np.lexsort([got.y.to_numpy(), *(np.array(got.x.tolist(), float).reshape(len(got), -1).T)])] if len(got) else got
    return gbt.fit(np.array(got.x.tolist(), float).reshape(len(got), len(FEATURES)), got.y.to_numpy(float), MONOTONE)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, trees: gbt.Trees, keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Per document the base counts, base_failed, kept and the trees' score; keep names further columns of docs to carry."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__{c}") for c in keep))
    schema = SCHEMA + "".join(f", `__{f.name}` {f.dataType.simpleString()}" for c in keep for f in [docs.schema[c]])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measures(t) for t in as_bytes(batch.column("text"))]
            base = [r[0] for r in rows]
            good = trees.probability(np.array([r[1] for r in rows]))
            failed = [base_failed(b[0], b[4]) for b in base]
            out = [pa.array([b[i] for b in base], pa.int64()) for i in range(len(BASE))]
            out += [pa.array(failed), pa.array([not f and bool(p >= threshold) for f, p in zip(failed, good, strict=True)]), pa.array(good)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *out, *(batch.column(f"__{c}") for c in keep)], ["doc_id", *BASE, "base_failed", "kept", "score", *(f"__{c}" for c in keep)])

        return step

    return map_texts(source, make, schema)
