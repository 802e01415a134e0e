"""Byte-level BPE: encoding through the tokenizers library over Arrow batches, decoding by the reversed byte table.

Defined results: a null or empty text has no ids, digests are those of no bytes; repeated rows each give
their own row; columns other than the two read are kept by encode_documents() under their own names only if asked.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_texts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the others,
    in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token: merge its bytes by all lower ranks until two parts are left."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        at = min((i for i in range(len(parts) - 1)), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], own)) < own else own)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder built from a rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_chars()
        shown = lambda b: "".join(chars[x] for x in b)
        order = sorted(ranks, key=ranks.__getitem__)
        merges = [(shown(a), shown(b)) for t in order if len(t) > 1 for a, b in [halves(t, ranks)]]
        self.library = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # The decoding table: a token's characters read back through the reversed byte table.
        back = {c: b for b, c in chars.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.library.get_vocab().items()}

    def encode(self, texts: list[str], chunk: int = 1 << 19) -> list[np.ndarray]:
        """Ids of each text; the library's own records of at most about chunk characters exist at once."""
        out, at, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= chunk or i + 1 == len(texts):
                out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts[at : i + 1], add_special_tokens=False)]
                at, held = i + 1, 0
        return out

    def encode_with_offsets(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(id, first, end) for each token, in character offsets of the text; tokens that share a split character
        all carry that character's place."""
        return [[(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of the ids; characters split at either end, or broken inside, come out as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, ids):
        """Yield text piece by piece, holding back the bytes of a character until its last token has come."""
        import codecs

        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := reader.decode(self.bytes_of[i]):
                yield piece
        if piece := reader.decode(b"", final=True):
            yield piece


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, and the ids if asked."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids

    def make():
        bpe = coder(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            encoded = bpe.encode(texts)
            decoded = [bpe.decode_bytes(x.tolist()) for x in encoded]
            out = [
                batch.column("doc_id"),
                pa.array([len(x) for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in encoded]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                pa.array([x == t.encode() for x, t in zip(decoded, texts, strict=True)]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if ids:
                flat = np.concatenate(encoded) if encoded else np.zeros(0, "<u4")
                ends = np.cumsum([0, *map(len, encoded)]).astype("int32")
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype("int32"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names)

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, schema)
