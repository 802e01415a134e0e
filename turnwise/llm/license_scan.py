"""License scan: exact base phrases, and fuzzy search for short notices.

A notice that may differ by k edits is cut into k + 1 pieces; by the pigeonhole principle one piece stands unchanged
in every match. One Aho-Corasick pass finds all pieces, the regex library's bounded-error matching then verifies the
window around each seed, which is no longer than the notice and its edits, and gives the span and the number of edits. Of
matches of one notice that overlap, the one with the fewest edits stays, then the first. A match is dropped where a match
of another label with fewer edits overlaps it. Base phrases are notices with k = 0.

Defined results: a null or empty text has no words and no labels, its first_word, last_word are null and its score 0;
a text of any length is scanned whole, in time that grows with its length and the seeds found in it; further columns of
docs are not read; repeated rows each give their own row.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import as_bytes, map_texts

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Short notices in normal form (lower case, words with one space between them) and the label of each.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)

#: One edit is allowed for each so many characters of a notice: pieces then are long enough to be rare.
CHARS_PER_EDIT = 14

#: Bytes of words keep their place, A-Z become a-z, all other bytes become a space.
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    base: bool


def notices(fuzzy=NOTICES, base=BASE, chars_per_edit: int = CHARS_PER_EDIT) -> list[Notice]:
    return [Notice(p, x, 0, True) for p, x in base] + [Notice(p, x, len(p) // chars_per_edit, False) for p, x in fuzzy]


def pieces(phrase: str, n: int) -> list[tuple[int, str]]:
    """The phrase in n parts of nearly equal length, each with its place."""
    cuts = [round(i * len(phrase) / n) for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, wanted: list[Notice]) -> None:
        import ahocorasick
        import regex

        self.wanted, seeds = wanted, {}
        for k, n in enumerate(wanted):
            for at, piece in pieces(n.phrase, n.edits + 1):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()
        self.fuzzy = [None if n.base else regex.compile(rf"(?b)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}") for n in wanted]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int, str]]]:
        """Words of the text, and its matches: (notice, first word, last word, edits, matched text)."""
        words = text.translate(NORMAL).split()
        line = b" ".join(words).decode("utf-8", "replace")
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, owners) in self.seeds.iter(line):
            for k, at in owners:
                first = end + 1 - length - at
                windows.setdefault(k, []).append((first, first + len(self.wanted[k].phrase)))
        if not windows:
            return len(words), []
        spaces = [i for i, c in enumerate(line) if c == " "]
        word_at = lambda i: bisect.bisect_left(spaces, i)
        found = []
        for k, places in windows.items():
            n = self.wanted[k]
            if n.base:
                found += [(k, word_at(a), word_at(b - 1), 0, n.phrase) for a, b in places if (a == 0 or line[a - 1] == " ") and (b == len(line) or line[b] == " ")]
                continue
            near: dict[tuple[int, int], int] = {}
            for a in sorted({a for a, _ in places}):
                m = self.fuzzy[k].search(line, max(0, a - n.edits), min(len(line), a + len(n.phrase) + n.edits))
                if m and m[0].strip():
                    first = m.start() + len(m[0]) - len(m[0].lstrip())
                    near[first, first + len(m[0].strip())] = sum(m.fuzzy_counts)
            found += [(k, word_at(a), word_at(b - 1), edits, line[a:b]) for a, b, edits in apart(near)]
        return len(words), sorted(self.unbeaten(found))

    def unbeaten(self, found: list[tuple]) -> list[tuple]:
        """Matches that no other beats, in one sweep: matches of one notice do not overlap, so at any word no more are open
        than there are notices, but for those that share a word at their ends."""
        beaten, alive = set(), []
        order = sorted(range(len(found)), key=lambda i: found[i][1])
        for i in order:
            alive = [j for j in alive if found[j][2] >= found[i][1]]
            for j in alive:
                if self.beats(found[j], found[i]):
                    beaten.add(i)
                elif self.beats(found[i], found[j]):
                    beaten.add(j)
            alive.append(i)
        return [f for i, f in enumerate(found) if i not in beaten]

    def beats(self, a, b) -> bool:
        """b has edits and overlaps a, which has fewer and another label: b is a's notice misread."""
        return a[3] < b[3] and a[1] <= b[2] and b[1] <= a[2] and self.wanted[a[0]].label != self.wanted[b[0]].label


def apart(near: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(first, end, edits) of spans that do not overlap, those with the fewest edits before others, then the first."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for (a, b), edits in sorted(near.items(), key=lambda x: (x[1], x[0])):
        i = bisect.bisect_left(starts, a)
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            starts.insert(i, a)
            kept.insert(i, (a, b, edits))
    return kept


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, edits: int, matched: string>>"
)


def scan_documents(docs: DataFrame, wanted: list[Notice] | None = None) -> DataFrame:
    """Per document the counts, places, labels and score, and each match with its span in words."""
    wanted = wanted or notices()
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())])

    def make():
        scanner = Scanner(wanted)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in as_bytes(batch.column("text")):
                n, found = scanner.scan(text)
                starts = [f[1] for f in found if wanted[f[0]].base]
                score = max((1 - f[3] / len(wanted[f[0]].phrase) for f in found), default=0.0)
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), joined(wanted[f[0]].label for f in found if wanted[f[0]].base), joined(wanted[f[0]].label for f in found), score, [dict(zip(("label", "first_word", "last_word", "edits", "matched"), (wanted[f[0]].label, *f[1:]), strict=True)) for f in found]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, SCHEMA)


def joined(labels) -> str:
    return ",".join(sorted(set(labels)))
