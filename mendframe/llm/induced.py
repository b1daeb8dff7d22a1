"""Suffix-array dedup: external induced sorting with common-prefix values.

``array_order`` sorts the suffixes of a text of at most IN_MEMORY units by arrays: S* substrings are sorted by inducing and named, names are
sorted by doubling, and L and S suffixes are induced from the S* order, all suffixes of one first unit at once.

``suffix_order`` sorts the suffixes of a longer text. Whatever it makes on the way is on disk: places, names, orders and values are
files, read and written in order or through the page cache, and queues and sorts spill beyond MEMORY_ITEMS tuples. Only these tuples
and a stack of common-prefix values are in memory, at every level of the recursion:

* substrings between left-most S positions (S*) are sorted by an external merge sort and named; equal names go one level down,
  to the text of names, whose suffix order and common prefixes come back and are spelt out in this level's units;
* L suffixes are induced from the S* order, S suffixes from the L order, each through a priority queue that spills sorted runs to
  disk. A queue's tuple carries first unit, turn, place and the common-prefix value with the suffix induced before it, which is one
  more than the least value between the two inducing suffixes in the scan;
* where L meets S under one first unit, the common prefix is the shorter run of that unit.

``earlier_starts`` sorts a shard's segments and reads runs of suffixes that share W bytes, after an external sort some CHUNK of them at a
time: all of a run but its first in order of (document, start) stand earlier too. A shard's own content is in memory once. Frame, sharding and
defined cases: see repeats. Scratch files are anonymous and local to one task: they hold nothing that another task reads, and a task
that is run again writes them anew.
"""

from __future__ import annotations

import hashlib
import heapq
import marshal
import mmap
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts
from .repeats import Units, covered, keyed, repeated_ranges, with_ranges

#: Tuples that a queue or a sort holds before it spills.
MEMORY_ITEMS = 1 << 18
_CHUNK = 4096
#: Suffixes that are looked at together when runs are read; a run is never cut.
CHUNK = 1 << 18


class Cells:
    """A file of n 64-bit numbers, all ``fill`` at first, for reading and writing at any place."""

    def __init__(self, n: int, fill: int = 0):
        self.file = tempfile.TemporaryFile()
        self.file.truncate(8 * max(n, 1))
        self.map = mmap.mmap(self.file.fileno(), 0)
        self.at = memoryview(self.map).cast("q")
        if fill:
            one = array("q", [fill]) * min(n, 1 << 16)
            for k in range(0, n, 1 << 16):
                self.at[k : min(n, k + (1 << 16))] = one[: min(n, k + (1 << 16)) - k]


def _view(column: Column) -> memoryview:
    """The numbers of a column by place, through the page cache."""
    column._flush()
    column.file.flush()
    return memoryview(mmap.mmap(column.file.fileno(), 0, access=mmap.ACCESS_READ)).cast("q") if column.n else memoryview(b"").cast("B")


class Column:
    """An append-only file of 64-bit numbers, read in order or from the end."""

    def __init__(self):
        self.file, self.held, self.n = tempfile.TemporaryFile(), array("q"), 0

    def append(self, v: int) -> None:
        self.held.append(v)
        self.n += 1
        if len(self.held) >= _CHUNK:
            self._flush()

    def _flush(self) -> None:
        self.file.seek(0, 2)
        self.held.tofile(self.file)
        self.held = array("q")

    def _read(self, at: int, n: int) -> array:
        self.file.seek(8 * at)
        out = array("q")
        out.frombytes(self.file.read(8 * n))
        return out

    def __iter__(self) -> Iterator[int]:
        self._flush()
        for at in range(0, self.n, _CHUNK):
            yield from self._read(at, min(_CHUNK, self.n - at))

    def backwards(self) -> Iterator[int]:
        self._flush()
        for end in range(self.n, 0, -_CHUNK):
            at = max(0, end - _CHUNK)
            yield from reversed(self._read(at, end - at))


#: Sorted runs that are read at once; more are merged to one. Their buffers together hold as many tuples as memory may.
FAN = 16


def _spilled(items: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Sorted items through an anonymous file."""
    f, held, chunk = tempfile.TemporaryFile(), [], max(16, most // FAN)
    for x in items:
        held.append(x)
        if len(held) == chunk:
            marshal.dump(held, f)
            held = []
    marshal.dump(held, f)
    size = f.tell()
    f.seek(0)

    def read() -> Iterator[tuple]:
        with f:
            while f.tell() < size:
                yield from marshal.load(f)

    return read()


class DiskQueue:
    """Priority queue of tuples: a heap in memory, and sorted runs on disk beyond ``most`` tuples, FAN of them at most."""

    def __init__(self, most: int = 0):
        self.most, self.heap = most or MEMORY_ITEMS, []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []  # a heap of next item, number, and what follows
        self.spilled = 0

    def _add(self, run: Iterator[tuple]) -> None:
        self.spilled += 1
        if (item := next(run, None)) is not None:
            heapq.heappush(self.runs, (item, self.spilled, run))

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            held, self.heap = sorted(self.heap), []
            if len(self.runs) >= FAN:
                old, self.runs = self.runs, []
                self._add(_spilled(heapq.merge(*(chain((x,), rest) for x, _, rest in old)), self.most))
            self._add(_spilled(iter(held), self.most))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, k, rest = self.runs[0]
            if (after := next(rest, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, k, rest))
            return item
        return heapq.heappop(self.heap)


def external_sort(items: Iterator[tuple], most: int = 0) -> Iterator[tuple]:
    most, runs, held = most or MEMORY_ITEMS, [], []
    for x in items:
        held.append(x)
        if len(held) >= most:
            if len(runs) >= FAN:
                runs = [_spilled(heapq.merge(*runs), most)]
            held.sort()
            runs.append(_spilled(iter(held), most))
            held = []
    held.sort()
    return heapq.merge(*runs, held) if runs else iter(held)


class _Least:
    """Least common-prefix value of the scan since a turn."""

    def __init__(self):
        self.turns: list[int] = []
        self.values: list[int] = []

    def add(self, turn: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.turns.pop()
        self.values.append(value)
        self.turns.append(turn)

    def since(self, turn: int) -> int:
        return self.values[bisect_right(self.turns, turn)]


def _starred(t) -> Column:
    """S* positions in order, and the end."""
    falling = Column()
    s, after = False, t[len(t) - 1]
    for i in range(len(t) - 2, -1, -1):
        c = t[i]
        if c > after:
            if s:
                falling.append(i + 1)
            s = False
        elif c < after:
            s = True
        after = c
    out = Column()
    for i in falling.backwards():
        out.append(i)
    out.append(len(t) - 1)  # the end, least of all
    return out


def _run(t, i: int) -> int:
    """How often t[i] stands from i on."""
    c, k, n = t[i], i + 1, len(t)
    while k < n and t[k] == c:
        k += 1
    return k - i


def _sorted_starred(t, most: int) -> tuple[Column, Column]:
    """S* positions in suffix order, and the common prefix of each with the one before."""
    starred = _starred(t)
    n, at = starred.n, _view(starred)
    places, values = Column(), Column()
    if n == 1:
        places.append(at[0])
        values.append(0)
        return places, values

    def cut() -> Iterator[tuple]:
        for k in range(n - 1):
            # an end above all units: of two substrings, one within the other, the shorter ends in S and is the larger
            yield (*t[at[k] : at[k + 1] + 1], 1 << 62), k

    names = Cells(n)
    name, last = 0, None
    for key, k in external_sort(cut(), most):
        if key != last:
            name, last = name + 1, key
        names.at[k] = name
    if name < n - 1:
        order, common = suffix_order(names.at, most)
        rank = zip(order, common, strict=True)
    else:
        by = Cells(name + 1)
        for k in range(n):
            by.at[names.at[k]] = k
        rank = ((by.at[k], 0) for k in range(n))
    before = None
    for k, v in rank:
        i = at[k]
        if before is None:
            values.append(0)
        else:
            j, m = at[before], len(t)
            # v names agree: so do all units up to the start of the next substring; then unit by unit
            d = at[k + v] - i
            while i + d < m and j + d < m and t[i + d] == t[j + d]:
                d += 1
            values.append(d)
        places.append(i)
        before = k
    return places, values


def suffix_order(t, most: int = 0) -> tuple[Column, Column]:
    """Suffix array of t and the common prefix of each suffix with the one before. t: numbers by position, its last one the least and unique."""
    n, units = len(t), max(t) + 1
    stars, star_values = _sorted_starred(t, most)
    star, star_common, turns = _view(stars), _view(star_values), Cells(units, -1)
    last = turns.at  # the turn that last induced a suffix of each first unit
    # L suffixes, in rising order, from the S* and L before them
    low, low_common = Column(), Column()
    queue, least = DiskQueue(most), _Least()
    turn, k, before, before_star = 0, 0, -1, False
    head = queue.peek()
    while head is not None or k < len(star):
        if head is not None and (k >= len(star) or head[0] <= t[star[k]]):
            c, _, i, v = queue.pop()
            is_star = False
            low.append(i)
            low_common.append(v)
        else:
            i, v = star[k], star_common[k]
            c, is_star, k = t[i], True, k + 1
            if before >= 0 and not before_star:
                v = min(_run(t, before), _run(t, i)) if t[before] == c else 0
        least.add(turn, v)
        if i and (p := t[i - 1]) >= c and (p > c or not is_star):
            queue.push((p, turn, i - 1, 1 + least.since(last[p]) if last[p] >= 0 else 0))
            last[p] = turn
        before, before_star = i, is_star
        turn += 1
        head = queue.peek()
    # S suffixes, in falling order, from the L and S after them; the value of a pair goes to its larger suffix
    queue, least, turns = DiskQueue(most), _Least(), Cells(units, -1)
    last = turns.at
    order, common = Column(), Column()
    falling = zip(low.backwards(), low_common.backwards(), strict=True)
    high = next(falling, None)
    head, turn, before, before_s, v_before = queue.peek(), 0, -1, False, 0
    while head is not None or high is not None:
        if head is not None and (high is None or -head[0] >= t[high[0]]):
            c, _, i, v = queue.pop()
            c, is_s = -c, True
            v = v if before >= 0 and t[before] == c else 0
        else:
            i, is_s = high[0], False
            c = t[i]
            if before < 0 or t[before] != c:
                v = 0
            else:
                v = min(_run(t, before), _run(t, i)) if before_s else v_before
            v_before = high[1]
            high = next(falling, None)
        if before >= 0:
            common.append(v)
        order.append(i)
        least.add(turn, v)
        if i and (p := t[i - 1]) <= c and (p < c or is_s):
            queue.push((-p, turn, i - 1, 1 + least.since(last[p]) if last[p] >= 0 else 0))
            last[p] = turn
        before, before_s = i, is_s
        turn += 1
        head = queue.peek()
    if before != n - 1:  # the end is first of all; nothing induces it
        if before >= 0:
            common.append(0)
        order.append(n - 1)
    common.append(0)
    rising, values = Column(), Column()
    for i in order.backwards():
        rising.append(i)
    for v in common.backwards():
        values.append(v)
    return rising, values


#: Units of a text that is sorted in memory, by arrays: 55 to 84 bytes a unit, as measured. A longer one is sorted externally.
IN_MEMORY = 1 << 21


def _spread(places: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes of one first unit, each at the end of its run of that unit -> all suffixes of these runs, as each induces the next one to its left."""
    more = left[places]
    if not more.any():
        return places
    size = more + 1
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return (np.repeat(places, size) - step)[np.argsort(step, kind="stable")]


def _induced(t: np.ndarray, stars: np.ndarray, falls: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in the order that S* suffixes, given in order with the end first, induce: L from them, then S from L. falls: which are L; left: units equal to a place's own right before it. A first unit's suffixes are handled at once."""
    n, units = len(t), int(t.max()) + 1
    sa = np.empty(n, np.int32)
    size, low = np.bincount(t, minlength=units), np.bincount(t[falls], minlength=units)
    start = np.cumsum(size) - size
    head, tail, mid = start.copy(), start + size, start + low
    first = t[stars]
    bound = np.searchsorted(first, np.arange(units + 1))

    def send(places: np.ndarray, c: int, rising: bool) -> None:
        places = places[places > 0] - 1
        p = t[places]
        on = p > c if rising else p < c
        places, p = places[on], p[on]
        if not len(p):
            return
        by = np.argsort(p, kind="stable")
        places, p = places[by], p[by]
        edge = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            q = p[a]
            if rising:
                sa[head[q] : head[q] + b - a] = places[a:b]
                head[q] += b - a
            else:
                sa[tail[q] - (b - a) : tail[q]] = places[a:b][::-1]
                tail[q] -= b - a

    used = np.flatnonzero(size).tolist()
    for c in used:
        own = stars[bound[c] : bound[c + 1]]
        if low[c]:
            whole = _spread(sa[start[c] : head[c]], left)
            sa[start[c] : mid[c]] = whole
            own = np.concatenate((whole, own))
        send(own, c, True)
    sa[0] = n - 1
    for c in used[:0:-1]:
        own = sa[start[c] : mid[c]][::-1]
        if mid[c] < start[c] + size[c]:
            whole = _spread(sa[tail[c] : start[c] + size[c]][::-1], left)
            sa[mid[c] : start[c] + size[c]] = whole[::-1]
            own = np.concatenate((whole, own))
        send(own, c, False)
    return sa


def _alike(t: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size units from a on equal those from b on."""
    same = np.ones(len(a), bool)
    left, d = np.arange(len(a)), 0
    while len(left) and d < 64:
        on = t[a[left] + d] == t[b[left] + d]
        same[left[~on]] = False
        d += 1
        left = left[on]
        left = left[size[left] > d]
    for k in left.tolist():
        same[k] = np.array_equal(t[a[k] : a[k] + size[k]], t[b[k] : b[k] + size[k]])
    return same


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text of names, its last one the least and unique: ranks of twice as many names each round, only where ranks are equal."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.r_[fresh[1:], True]
    todo, h = order[~alone], 1
    while len(todo):
        key = rank[todo] * n + rank[todo + h]
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        group, k = key // n, np.arange(len(key))
        top = np.r_[True, group[1:] != group[:-1]]
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[todo] = group + np.maximum.accumulate(np.where(fresh, k, 0)) - np.maximum.accumulate(np.where(top, k, 0))
        todo = todo[~(fresh & np.r_[fresh[1:], True])]
        h *= 2
    order[rank] = np.arange(n)
    return order


def array_order(t: np.ndarray) -> np.ndarray:
    """Suffix array of t by induced sorting over arrays in memory. t: unsigned numbers of at most 16 bits, its last one the least and unique."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    ends = np.flatnonzero(t[:-1] != t[1:])
    size = np.diff(np.r_[-1, ends])
    falls = np.r_[np.repeat(t[ends] > t[ends + 1], size), False]
    left = (np.arange(n - 1) - np.repeat(ends + 1 - size, size)).astype(np.int32)
    left = np.r_[left, np.int32(0)]
    stars = np.flatnonzero(falls[:-1] & ~falls[1:]).astype(np.int32) + np.int32(1)
    if len(stars) > 1:
        starred = np.zeros(n, bool)
        starred[stars] = True
        order = _induced(t, stars[np.argsort(t[stars], kind="stable")], falls, left)
        order = order[starred[order]]
        # substrings end at the next S* place; the end's own is itself
        length = np.zeros(n, np.int32)
        length[stars] = np.r_[np.diff(stars) + 1, 1]
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        same[same] = _alike(t, a[same], b[same], length[a[same]])
        if same.any():
            names = np.empty(n, np.int32)
            names[order] = np.r_[0, np.cumsum(~same)]
            order = stars[_doubled(names[stars].astype(np.int64))]
        stars = order
    return _induced(t, stars, falls, left)


def _array_runs(text: bytes, t: np.ndarray, inside: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _runs, of the suffixes inside alone, from a sort in memory."""
    sa = array_order(t)
    sa = sa[inside[sa]]
    wide = min(8, 1 << (window.bit_length() - 1))
    raw = np.frombuffer(text + bytes(wide), np.uint8)
    units = np.ndarray((len(text),), f"u{wide}", raw, strides=(1,)).copy()
    a, b = sa[:-1], sa[1:]
    on = np.arange(len(a))
    # the last ones first: they differ soonest
    for d in sorted({*range(0, window - wide + 1, wide), window - wide}, reverse=True):
        on = on[units[a[on] + d] == units[b[on] + d]]
    fresh = np.ones(len(sa), bool)
    fresh[on + 1] = False
    yield sa, np.cumsum(fresh)


def earlier_starts(contents: list[bytes], docs: list[int], starts: list[int], u: Units) -> list[np.ndarray]:
    """For each segment, which of its windows stand at an earlier (document, start). Segments come in that order."""
    text = b"\1".join(contents) + b"\1\0"
    # bytes 0 and 1 of the text must not meet the marks
    marked = any(b"\0" in c or b"\1" in c for c in contents)
    base = np.r_[0, np.cumsum([len(c) + 1 for c in contents])]
    sizes = np.diff(base) - 1
    if len(text) <= IN_MEMORY:
        t = np.frombuffer(text, np.uint8)
        if marked:
            t = t.astype(np.uint16) + np.uint16(2)
            t[base[1:] - 1], t[-1] = 1, 0
        edge = np.zeros(len(text) + 1, np.int8)
        wide = sizes >= u.window
        edge[base[:-1][wide]] = 1
        edge[(base[:-1] + sizes - u.window + 1)[wide]] -= 1
        found = _array_runs(text, t, np.cumsum(edge[:-1], dtype=np.int8).view(bool), u.window)
    else:
        if marked:
            units = array("H")
            for c in contents:
                units.extend(x + 2 for x in c)
                units.append(1)
            units.append(0)
        else:
            units = text
        found = _runs(*suffix_order(units), u.window)
    hit = np.zeros(len(text), bool)
    doc_of, start_of = np.asarray(docs, np.int64), np.asarray(starts, np.int64)
    for sa, run in found:
        several = np.r_[False, run[1:] == run[:-1]]
        several[:-1] |= several[1:]
        sa, run = sa[several], run[several]
        seg = np.minimum(np.searchsorted(base, sa, side="right") - 1, len(contents) - 1)
        off = sa - base[seg]
        inside = off + u.window <= sizes[seg]
        sa, run, seg, off = sa[inside], run[inside], seg[inside], off[inside]
        if not len(run):
            continue
        rank = np.lexsort((start_of[seg] + off, doc_of[seg], run))
        first = np.r_[True, run[rank][1:] != run[rank][:-1]]
        hit[sa[rank[~first]]] = True
    return [hit[a : a + max(0, k - u.window + 1)] for a, k in zip(base.tolist(), sizes.tolist(), strict=False)]


def _runs(order: Column, common: Column, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes in order with the number of their run, CHUNK of them or more at a time; suffixes of a run share ``window`` units. A run longer than CHUNK comes whole."""
    sa, lcp = np.frombuffer(_view(order), np.int64), np.frombuffer(_view(common), np.int64)
    at = 0
    while at < len(sa):
        end = min(len(sa), at + CHUNK)
        while end < len(sa) and lcp[end] >= window:
            end += 1
        yield sa[at:end], np.cumsum(lcp[at:end] < window)
        at = end


def split_bytes(text: str) -> tuple[np.ndarray, bytes]:
    raw = text.encode()
    return np.frombuffer(raw, np.uint8).astype(np.uint64), raw


def byte_units(window: int = 100) -> Units:
    return Units(split_bytes, lambda raw, a, b: raw[a:b], lambda h, raw, a, b: raw[a:b], window, 32, within=True)


def repeated_bytes(docs: DataFrame, window: int = 100) -> DataFrame:
    """(doc_id, ranges): windows of UTF-8 bytes that also start earlier."""
    return repeated_ranges(keyed(docs), byte_units(window), earlier_starts)


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_suffixes(docs: DataFrame, window: int = 100) -> DataFrame:
    """docs without repeated bytes, all columns; a character that loses some of its bytes becomes U+FFFD."""
    (joined, own), names = with_ranges(docs, repeated_bytes(docs, window)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, r in zip(b.column("text").to_pylist(), b.column(own).to_pylist(), strict=True):
                if r:
                    raw = (x or "").encode()
                    x = cut(raw, covered(len(raw), r, window)).decode("utf-8", "replace")
                out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return map_arrow(joined, run, docs.schema)


def suffix_digest(docs: DataFrame, window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    joined, own = with_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeated_bytes(docs, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for x, r in zip(texts(b), b.column(own).to_pylist(), strict=True):
                raw = x.encode()
                gone = covered(len(raw), r, window)
                spans = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
                for c, v in zip(cols, (len(raw), int(gone.sum()), spans, hashlib.sha256(cut(raw, gone) if r else raw).hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) - 98)) AS i FROM d WHERE length(h) >= 200)
), own AS (
  SELECT k, min((doc_id, i)) AS least FROM win GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT win.doc_id, i FROM win JOIN own ON win.k = own.k AND own.least < (win.doc_id, win.i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM hit
), marked AS (
  SELECT doc_id, p, CASE WHEN lag(p) OVER (PARTITION BY doc_id ORDER BY p) = p - 1 THEN 0 ELSE 1 END AS fresh FROM gone
), counted AS (
  SELECT doc_id, count(*) AS n, sum(fresh) AS spans FROM marked GROUP BY doc_id
), pos AS (
  SELECT d.doc_id, p, substr(h, 2 * p - 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(1, CAST(length(h) / 2 AS BIGINT) + 1)) AS p FROM d
    WHERE doc_id IN (SELECT doc_id FROM counted)) d
), kept AS (
  SELECT pos.doc_id, string_agg(x, '' ORDER BY pos.p) AS t FROM pos ANTI JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id
)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN counted ON counted.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
