"""Substring dedup by FM-indexes: matching statistics by backward search over wavelet trees.

A shard's index is a Burrows-Wheeler transform of its word numbers in a wavelet tree (a row of packed bits for each bit of the
numbers, with a running count every 64 bits), and the owner of each suffix with a range-minimum table. Segments stream against it:
from an end, backward search goes left as long as the interval holds a document smaller than the segment's own, which
gives the matching statistic of that end, the start of the longest such match. Starts never fall as ends rise, so the statistics
at two ends often settle all windows between them, and otherwise the middle one is asked next (``matches``).

Frame, sharding and defined cases: see repeats. Words are what white space of ASCII separates, unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, words
from .minhash import _HASHES
from .repeats import Units, covered, keyed, repeated_ranges, with_ranges


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of t by prefix doubling; t must end in a unique least number."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletTree:
    """Rank over numbers 0..2^levels-1 in levels rows of packed bits (a wavelet matrix): n bits and n / 64 counts a row."""

    def __init__(self, values: np.ndarray):
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        v, words = values, len(values) // 64 + 1
        for level in reversed(range(self.levels)):
            bit = ((v >> level) & 1).astype(bool)
            packed = np.zeros(8 * words, np.uint8)
            packed[: -(-len(v) // 8)] = np.packbits(bit, bitorder="little")
            self.bits.append(packed.view("<u8"))
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(self.bits[-1]), dtype=np.int32)].astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.r_[v[~bit], v[bit]]

    def ones(self, row: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a row before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[row][word] + np.bitwise_count(self.bits[row][word] & low)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        both = np.concatenate([np.zeros_like(at), at])
        twice = np.concatenate([symbols, symbols])
        for i, level in enumerate(reversed(range(self.levels))):
            one = self.ones(i, both)
            both = np.where((twice >> level) & 1, self.zeros[i] + one, both - one)
        return both[len(at) :] - both[: len(at)]


class FMIndex:
    """Index of rows of numbers >= 1; each row belongs to an owner."""

    def __init__(self, rows: list[np.ndarray], owners: list[int]):
        parts = []
        for r in rows:
            parts += [r, [1]]  # 1 parts rows; numbers are shifted by 2
        t = np.r_[np.concatenate(parts).astype(np.int64), 0]
        order = suffix_array(t)
        self.first = np.r_[0, np.cumsum(np.bincount(t))]
        self.tree = WaveletTree(t[order - 1])
        self.n = len(t)
        self.owners = np.unique(np.asarray(owners, np.int64))
        own = np.searchsorted(self.owners, owners).astype(np.int32)
        least = np.r_[np.repeat(own, [len(r) + 1 for r in rows]), np.int32(len(self.owners))][order]
        table = [least]
        while (1 << len(table)) <= self.n:
            half = 1 << (len(table) - 1)
            table.append(np.r_[np.minimum(table[-1][:-half], table[-1][half:]), table[-1][-half:]])
        self.least = np.stack(table)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals."""
        both = self.first[np.concatenate([symbols, symbols])] + self.tree.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return both[: len(lo)], both[len(lo) :]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place in ``owners`` of each interval's least owner; beyond them all where it is empty."""
        level = np.maximum(np.frexp((hi - lo).astype(np.float64))[1] - 1, 0)
        found = np.minimum(self.least[level, np.minimum(lo, self.n - 1)], self.least[level, np.maximum(hi - (1 << level), 0)])
        return np.where(hi > lo, found, len(self.owners))

    def starts(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Matching statistics of ends: the least start of a match of flat[start:end] with a smaller owner, begin at least."""
        at = end.copy()
        live = np.arange(len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        while len(live):
            live_at = at[live]
            lo, hi = self.extend(lo, hi, flat[live_at - 1])
            ok = self.least_owner(lo, hi) < own[live]
            at[live[ok]] -= 1
            ok &= live_at - 1 > begin[live]
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return at


def matches(index: FMIndex, flat: np.ndarray, base: np.ndarray, own: np.ndarray, window: int) -> np.ndarray:
    """For each position of flat, whether a window that starts there stands with a smaller owner. Segment i is flat[base[i]:base[i + 1]]."""
    hit = np.zeros(len(flat) + 1, np.int64)  # differences
    begin, low, high = base[:-1], base[:-1] + window, base[1:]

    def mark(first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(hit, first - window, 1)
        np.add.at(hit, last - window + 1, -1)

    s_low = index.starts(flat, begin, low, own)
    on = s_low <= high - window  # else no window can match
    begin, own, low, high, s_low = begin[on], own[on], low[on], high[on], s_low[on]
    s_high = index.starts(flat, begin, high, own)
    # ends of low..high are open; the first one is settled by its own start
    while len(low):
        whole = s_high <= low - window
        mark(low[whole], high[whole])
        none = s_low > high - window
        near = ~whole & ~none & (high - low <= 1)
        for end, start in ((low[near], s_low[near]), (high[near], s_high[near])):
            good = start <= end - window
            mark(end[good], end[good])
        on = ~whole & ~none & ~near
        begin, own, low, high, s_low, s_high = (v[on] for v in (begin, own, low, high, s_low, s_high))
        mid = (low + high) // 2
        s_mid = index.starts(flat, begin, mid, own) if len(mid) else mid
        begin, own = np.r_[begin, begin], np.r_[own, own]
        low, high, s_low, s_high = np.r_[low, mid], np.r_[mid, high], np.r_[s_low, s_mid], np.r_[s_mid, s_high]
    return np.cumsum(hit[:-1]) > 0


def earlier_documents(contents: list[bytes], docs: list[int], starts: list[int], u: Units) -> list[np.ndarray]:
    """For each segment, which of its windows stand in a document with a smaller id."""
    numbers: dict[bytes, int] = {}
    rows = [np.array([numbers.setdefault(w, len(numbers) + 2) for w in c.split(b" ")], np.int64) for c in contents]
    index = FMIndex(rows, docs)
    base = np.r_[0, np.cumsum([len(r) for r in rows])]
    hit = matches(index, np.concatenate(rows), base, np.searchsorted(index.owners, docs), u.window)
    return [hit[a : b - u.window + 1] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def split_words(text: str) -> tuple[np.ndarray, list[str]]:
    w = words(text)
    return np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w)), w


def word_units(window: int = 50) -> Units:
    return Units(split_words, lambda w, a, b: " ".join(w[a:b]).encode(), lambda h, w, a, b: h[a:b].tobytes(), window, 8, within=False)


def repeated_words(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, ranges): windows of words that also start in a document with a smaller id."""
    return repeated_ranges(keyed(docs), word_units(window), earlier_documents)


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated words gone, the others joined by one space where words went; texts that lose none stay as they are."""
    (joined, own), names = with_ranges(docs, repeated_words(docs, window)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, r in zip(b.column("text").to_pylist(), b.column(own).to_pylist(), strict=True):
                if r:
                    w = words(x or "")
                    x = " ".join(v for v, gone in zip(w, covered(len(w), r, window).tolist(), strict=True) if not gone)
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return map_arrow(joined, run, docs.schema)


def substring_digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    joined, own = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeated_words(docs, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sums = [], [], []
            for x, r in zip(texts(b), b.column(own).to_pylist(), strict=True):
                w = words(x)
                off = covered(len(w), r, window)
                n.append(len(w))
                gone.append(int(off.sum()))
                sums.append(hashlib.sha256(" ".join([v for v, g in zip(w, off.tolist(), strict=True) if not g] if r else w).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), own AS (
  SELECT k, min(doc_id) AS d FROM win GROUP BY k
), hit AS (
  SELECT win.doc_id, list(i) AS hits FROM win JOIN own ON win.k = own.k AND own.d < win.doc_id GROUP BY win.doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(hits, lambda h: range(h, h + 50)))) AS g FROM hit
), pos AS (
  SELECT w.doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w
), kept AS (
  SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos
  LEFT JOIN (SELECT doc_id, unnest(g) AS p, true AS off FROM gone) q ON q.doc_id = pos.doc_id AND q.p = pos.p WHERE q.off IS NULL GROUP BY pos.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
