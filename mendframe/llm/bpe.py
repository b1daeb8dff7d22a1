"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a tokenizers BPE model: bytes are written as printable characters, and each
token's merge is the pair its own bytes end in under lower ranks. A text is cut by the pattern, and each match is merged
on its own; merged pieces are kept in a bounded cache of each worker. Offsets are characters: a token that holds part of a
character counts from that character's start to its end, so neighbours may share it. Decoding maps ids to bytes through
the byte table; a document's bytes are joined before they are read as UTF-8, so split characters come back whole.

Defined cases: a null or empty text has no tokens; null ids of a document pass through; repeated rows are encoded
each; other columns of the input are left out of the results; unpaired surrogates can't be in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, texts

#: Pieces that a worker keeps, and the longest of them in characters; both only save time.
CACHE_PIECES, CACHE_LENGTH = 300_000, 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merge into token last."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


class TwoAges(dict):
    """A bounded cache: when it is full it becomes the old one, whose entries are found again on use. make(key) fills it."""

    def __init__(self, most: int, longest: int):
        super().__init__()
        self.most, self.longest, self.old = most, longest, {}

    def make(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBPE(TwoAges):
    """piece -> its ids as packed little-endian uint32; a bounded cache in front of the tokenizers model."""

    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        super().__init__(CACHE_PIECES, CACHE_LENGTH)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        text = lambda b: "".join(chars[x] for x in b)
        merges = [(text(a), text(b)) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for a, b in [_last_pair(t, ranks)]]
        self.model = BPE({text(t): r for t, r in ranks.items()}, merges)
        self.table = dict(enumerate(chars))
        self.cut = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.digits = [str(i) for i in range(len(self.bytes_of))]

    def make(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut(text))), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end character of each token."""
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype="int64") if len(ids) else np.zeros(0, "int64")
        starts = np.r_[0, ends[:-1]][: len(ends)]
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


@cache
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, starts, ends (characters, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            ids, starts, ends = [], [], []
            for x in texts(b):
                own = c.encode(x)
                s, e = c.offsets(own, x)
                ids.append(own.astype("int32"))
                starts.append(s.astype("int32"))
                ends.append(e.astype("int32"))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, kind) for v in (ids, starts, ends))], ["doc_id", "ids", "starts", "ends"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (the bytes), text (raw as UTF-8; what isn't valid becomes U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            raw = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "raw", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, raw binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for x in texts(b):
                ids = c.encode(x).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
