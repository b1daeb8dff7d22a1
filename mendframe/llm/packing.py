"""Best-fit packing of tokenised documents: a round in each task, then one over all that is left.

Each task tokenises its documents, cuts those longer than ``size`` and packs the pieces best-fit (longest first, into the
fullest sequence that still has room). Sequences filled to ``nearly`` are final; the pieces of all others go on, whole,
however many they are.

The last round packs these best-fit over all tasks at once. Best fit only looks at lengths, of which there are ``size`` at
most, so it runs on the count of each length and on ranges of alike sequences (``plan``): its memory and time don't grow with the
input, and its sequences are as many as ``best_fit`` on the single pieces makes. A piece finds its place by its number
among the pieces of its length: those of earlier tasks, and of its own. No tokens move.

Defined cases: a null or empty text is the end token alone; repeated rows and null ids are packed like any other row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TwoAges, byte_characters
from .common import map_arrow, table, texts

CARRY, NEARLY = 4096, 0.98
#: Sequences of the last round are numbered from here, beyond any task's.
LAST = 1 << 62
CACHE_CHUNKS, CACHE_LENGTH = 300_000, 40


class Pieces(TwoAges):
    """Normalised piece (letters, one digit, or other characters) -> packed ids, by the tokenizer's own BPE model."""

    def __init__(self, model, most: int):
        super().__init__(most, CACHE_LENGTH)
        self.model, self.table = model, dict(enumerate(byte_characters()))

    def make(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


class Chunks(TwoAges):
    """White-space-free chunk -> packed ids. The tokenizer drops white space and never joins over it, so a text's ids are its chunks' ids.

    Letters with at most one mark after them are lower-cased and cut here, as the file's normaliser and pattern do, and go to
    the file's BPE model; every other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        super().__init__(most, CACHE_LENGTH)
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.known = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.latin = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
        self.pieces = Pieces(self.whole.model, most // 2)

    def make(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        mark = chunk[-1] if chunk[-1] in ".,!?;:" else ""
        body = chunk[:-1] if mark else chunk
        if self.known and self.latin(body):
            return self.pieces[body.lower()] + self.pieces[mark] if mark else self.pieces[body.lower()]
        return array("I", self.whole.encode(chunk, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


    def forget(self) -> None:
        for held in (self, self.pieces):
            held.clear()
            held.old = {}


@cache
def chunks(path: str, most: int = CACHE_CHUNKS) -> Chunks:
    return Chunks(path, most)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its offset there; for each bin its fill. Longest first, into the least room that is enough."""
    order = np.argsort(-lengths, kind="stable")
    bins, offs = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    fill: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = size, len(fill)
            fill.append(0)
        bins[i], offs[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            rooms[left].append(b)
            mask |= 1 << left
    return bins, offs, np.asarray(fill, "int64")


def close(lengths: np.ndarray, size: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of a pool: each item's bin, offset, and whether it is settled; at most CARRY items are not. pack() has no such cap and doesn't call this; a test does."""
    bins, offs, fill = best_fit(lengths, size)
    done = np.ones(len(fill), bool)
    if not last:
        done = fill >= NEARLY * size
        held = np.bincount(bins, minlength=len(fill))
        weak = np.flatnonzero(~done)
        weak = weak[np.argsort(fill[weak], kind="stable")]
        done[weak[np.cumsum(held[weak]) > CARRY]] = True
    return bins, offs, done[bins] if len(bins) else np.zeros(0, bool)


def plan(counts: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Best fit of counts[n] items of each length n. Rows of length, first number, first bin, items in each bin, offset; and the count of bins.

    Item i of a length is in bin (first bin + j // items in each bin), where j = i - first number in the last row whose first number isn't over i.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # ranges of bins: first, how many
    mask, total = 0, 0

    def put(room: int, first: int, k: int) -> None:
        nonlocal mask
        if room and k:
            rooms[room].append((first, k))
            mask |= 1 << room

    for n in range(size, 0, -1):
        at, c = 0, int(counts[n])
        while at < c:
            if fits := mask >> n:
                room = n + (fits & -fits).bit_length() - 1
                first, k = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                room, first, k = size, total, -(-(c - at) // (size // n))
                total += k
            each = room // n
            full = min(k, (c - at) // each)
            if full:
                rows.append((n, at, first, each, size - room))
                put(room - each * n, first, full)
                at += full * each
            if full < k and (some := c - at):  # fewer than a bin takes
                rows.append((n, at, first + full, some, size - room))
                put(room - some * n, first + full, 1)
                at, full = c, full + 1
            put(room, first + full, k - full)
    return np.asarray(rows, "int64").reshape(-1, 5), total


def _cut(path: str, size: int, end_id: int, cached: int, keep: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks(path, cached)
        cols: list[list[int]] = [[] for _ in range(5)]
        doc, piece, start, length, crc = (c.append for c in cols)
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids = coder.packed(x) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    doc(d), piece(k), start(at // 4), length(len(own) // 4), crc(zlib.crc32(own))
        if not keep:
            coder.forget()
        if not cols[0]:
            return
        lengths = np.asarray(cols[3], "int64")
        bins, offs, fill = best_fit(lengths, size)
        done = fill[bins] >= NEARLY * size
        pool = TaskContext.get().partitionId()
        base = pool << 36
        number = np.zeros(len(bins), "int64")  # among the pieces of its length that go on
        left = np.flatnonzero(~done)
        left = left[np.argsort(lengths[left], kind="stable")]
        start_of = np.r_[True, np.diff(lengths[left]) > 0][: len(left)]
        number[left] = np.arange(len(left)) - np.maximum.accumulate(np.where(start_of, np.arange(len(left)), 0))
        first = np.full(bins.max() + 1, len(bins), "int64")
        np.minimum.at(first, bins, np.arange(len(bins)))
        yield from pa.Table.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array(np.full(len(bins), pool)), pa.array(number), pa.array(base + first[bins]), pa.array(offs), pa.array(done)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "pool", "number", "sequence_id", "offset", "done"],
        ).to_batches(max_chunksize=20_000)

    return run


def _place(rows: np.ndarray):
    """Numbered pieces -> their sequences, by the plan's rows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    head = rows[:, 0] << 48 | rows[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            n, first, bins, each, off = rows[np.searchsorted(head, length << 48 | number, side="right") - 1].T
            j = number - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _OUT), pa.array(LAST + bins + j // each), pa.array(off + j % each * n)], [*_OUT, "sequence_id", "offset"])

    return run


_OUT = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, cached: int = CACHE_CHUNKS, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. A worker keeps the ids of up to twice ``cached`` chunks, from task to task if ``keep``: for speed only."""
    own = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = table(map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _cut(path, size, end_id, cached, keep), f"{own}, pool long, number long, sequence_id long, offset long, done boolean"), "pieces")
    done = pieces.where("done").select(*_OUT, "sequence_id", "offset")
    rest = pieces.where("not done").select(*_OUT, "pool", "number")
    held = table(rest.groupBy("pool", "length").agg(F.count(F.lit(1)).alias("n")), "held")
    counts = np.zeros(size + 1, "int64")
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # size rows at most
        counts[r.length] = r.n
    if not counts.any():
        return done
    rows, _ = plan(counts, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select(F.col("pool").alias("_pool"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rest.join(base, (F.col("pool") == F.col("_pool")) & (F.col("length") == F.col("_length"))).select(*_OUT, (F.col("number") + F.col("_before")).alias("number"))
    return done.unionByName(map_arrow(numbered, _place(rows), f"{own}, sequence_id long, offset long"))
