"""Language identification: script ranges narrow the candidates of each word, then Viterbi over per-word scores with a
switching penalty labels the spans of mixed-language text.

The model (counts of hashed character n-grams for each language, and the scripts each is written in) is learned from at
most TRAIN documents that have a language and are not held out; executors count, what reaches the driver is one table of
BUCKETS numbers for each language.

Defined results: a null text or one without a letter is "und" with score 0 and no spans, and so is every text if nothing
can be learned; a null doc_id is not held out; repeated rows each give their own row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_texts

#: Documents learned from, at most: those whose ids hash lowest.
TRAIN = 4000
BUCKETS = 1 << 15
#: Log-probability that a change of language between two words costs.
SWITCH = 8.0
#: What a word costs in a language that its script is not used for.
FOREIGN = -60.0
#: A language uses a script that at least this share of its letters is in.
USED = 0.01


def _numbers(first: int, end: int) -> re.Pattern:
    """Numbers that are word characters but neither letters nor digits (½, ², ①, Ⅳ): they part words."""
    return re.compile("[" + "".join(c for c in map(chr, range(first, end)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")


#: Two classes: the first is looked up in a table, which no class with code points beyond it is.
NUMBER, FAR_NUMBER = _numbers(0x80, 0x10000), _numbers(0x10000, 0x32000)
FAR = re.compile("[\U00010000-\U0010ffff]")
WORD = re.compile(r"[^\W\d_]+")


def parted(text: str) -> str:
    """The text in lower case with a space for each such number: WORD finds its words of letters at their places."""
    lower = text.lower()
    if lower.isascii():
        return lower
    lower = NUMBER.sub(" ", lower)
    return FAR_NUMBER.sub(" ", lower) if FAR.search(lower) else lower


#: First code point of each range and its script; a range ends where the next begins.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in RANGES))
STARTS = np.array([a for a, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each word, script of each word) for n from 1 to 3 and the edges of words."""
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    mix = lambda *parts: sum(p * np.uint64(m) for p, m in zip(parts, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=False))
    with np.errstate(over="ignore"):
        pad = np.append(codes, [32, 32]).astype(np.uint64)
        one, two, three = mix(codes), mix(codes, pad[1:-1]), mix(codes, pad[1:-1], pad[2:])
        rows = np.stack([(h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49) for h in (one, two, three)], axis=1)
    return rows.astype(np.int64) % BUCKETS, starts, SCRIPT_OF[np.searchsorted(STARTS, codes[starts + 1].astype(np.int64), side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, log-probabilities
    uses: np.ndarray  # SCRIPTS x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-score of each word in each language; languages whose script differs get FOREIGN."""
        rows, starts, script = grams(words)
        per_char = self.weights[rows[:, 0]] + self.weights[rows[:, 1]] + self.weights[rows[:, 2]]
        scores = np.add.reduceat(per_char, starts, axis=0)
        uses = self.uses[script]
        return np.where(uses, scores, np.where(uses.any(axis=1, keepdims=True), FOREIGN + scores.min(axis=1, keepdims=True), 0))


def labels_of(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best sequence of languages for each document. scores: all documents' words, one document after the other.
    One step handles the t-th word of all documents that are so long."""
    total, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    stays = np.zeros((total, k), bool)  # the language was the same one word before
    best = np.zeros(total, np.int16)  # else it was this
    delta = np.zeros((len(lengths), k))
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            top = delta[:n].argmax(axis=1)
            change = delta[np.arange(n), top][:, None] - switch
            stays[at], best[at] = delta[:n] >= change, top
            delta[:n] = np.maximum(delta[:n], change)
        delta[:n] += scores[at]
    out, now = np.zeros(total, np.int16), delta.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = now[:n]
        now[:n] = np.where(stays[at, now[:n]], now[:n], best[at])
    return out


def learn(docs: DataFrame, train: int = TRAIN) -> Model:
    """docs: doc_id, text, lang. Held-out documents are never read here."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)
    sample = usable.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, keys, counts = [], [], []
            words_of: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words_of.setdefault(lang, []).extend(WORD.findall(parted(text)))
            for lang, words in words_of.items():
                if words:
                    rows, _, script = grams(words)
                    for shift, found in ((0, rows.ravel()), (BUCKETS, script)):
                        key, count = np.unique(found, return_counts=True)
                        langs += [lang] * len(key)
                        keys.append(key + shift)
                        counts.append(count)
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(join(keys)), pa.array(join(counts))], ["lang", "key", "n"])

        return step

    got = map_texts(sample, make, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(got["lang"]))
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[got["key"].to_numpy(int), [languages.index(x) for x in got["lang"]]] = got["n"]
    counts, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log(counts + 0.5) - np.log(counts.sum(axis=0, keepdims=True) + 0.5 * BUCKETS)
    return Model(languages, weights.astype(np.float32), scripts >= USED * np.maximum(scripts.sum(axis=0, keepdims=True), 1))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first_char: int, end_char: int, lang: string>>"


def identify(docs: DataFrame, model: Model, spans: bool = True, switch: float = SWITCH) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred (the language of most letters), score (its share of letters), and the
    spans of each language in characters of the text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("first_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string())]))

    def make():
        k = len(model.languages)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids: dict[str, int] = {}
            at, lengths = [], []
            for text in texts:
                words = WORD.findall(parted(text)) if k else []
                at += [ids.setdefault(w, len(ids)) for w in words]
                lengths.append(len(words))
            counts, at = np.array(lengths, int), np.array(at, int)
            pred, score, labels = ["und"] * len(texts), [0.0] * len(texts), np.zeros(0, int)
            if len(ids):
                labels = labels_of(model.word_scores(list(ids))[at], counts, switch)
                letters = np.array([len(w) for w in ids])[at]
                doc = np.repeat(np.arange(len(texts)), counts)
                share = np.bincount(doc * k + labels, letters, len(texts) * k).reshape(-1, k)
                for i in np.flatnonzero(counts):
                    j = int(share[i].argmax())
                    pred[i], score[i] = model.languages[j], float(share[i, j] / share[i].sum())
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                out.append(pa.array(spans_of(texts, counts, labels, model.languages), kind))
            return pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(out)])

        return step

    return map_texts(source, make, SCHEMA if spans else SCHEMA.partition(", spans")[0])


def spans_of(texts: list[str], counts: np.ndarray, labels: np.ndarray, languages: list[str]) -> list[list[dict]]:
    out, at = [], 0
    for text, n in zip(texts, counts, strict=True):
        own: list[dict] = []
        # positions are those of the lower-cased text, mapped back where lower() changes a text's length
        lower = parted(text)
        places = [m.span() for m in WORD.finditer(lower)] if n else []
        if len(lower) != len(text):
            back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
            places = [(back[a], back[b]) for a, b in places]
        for (a, b), x in zip(places, labels[at : at + n].tolist(), strict=True):
            if own and own[-1]["lang"] == languages[x]:
                own[-1]["end_char"] = b
            else:
                own.append({"first_char": a, "end_char": b, "lang": languages[x]})
        out.append(own)
        at += n
    return out
