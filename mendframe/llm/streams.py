"""Grouped streaming, bounded bitmaps and connected components, shared by the duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, map_arrow, table

#: Bits of a bitmap filter, at most: 2^27, 16 MB. A fuller bitmap only lets more rows through.
MOST_BITS = 27


#: Rows of a result that runs() gathers before it sends them on.
GATHERED = 20_000


def runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, least: int = 1, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """fn over each group of keys (long columns, no nulls), in sorted streams; groups of under ``least`` rows are passed over. A group must fit in memory: callers split large ones first. What groups give goes on in larger batches, through ``then`` if given, in the same Python worker."""

    def bounds(t: pa.Table) -> np.ndarray:
        n = t.num_rows
        change = np.zeros(n, bool)
        change[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.r_[np.flatnonzero(change), n]

    def groups(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in np.flatnonzero(np.diff(at) >= least).tolist():
            yield from fn(t.slice(at[i], at[i + 1] - at[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ends = [tuple(b.column(k)[i].as_py() for k in keys) for i in (0, b.num_rows - 1)]
            held.append(b)
            if last is not None and ends[0] == ends[1] == last:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at = bounds(t)
            yield from groups(t, at[:-1])
            held, last = t.slice(at[-2]).to_batches(), ends[1]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from groups(t, bounds(t))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= GATHERED:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(gathered(batches)) if then else gathered(batches)

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), all_of, schema)


def mixed(a: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64."""
    x = a + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bitmap(df: DataFrame, key: Column) -> np.ndarray:
    """Bitmap (64-bit words) of the top bits of a 64-bit hash column of a table: 16 bits or more a row, but 2^MOST_BITS at most. It is gathered as words of 64 bits, so it is bounded at any input size."""
    width = min(max(int(df.count() * 16).bit_length(), 12), MOST_BITS)
    at = F.shiftrightunsigned(key, 64 - width)
    words = df.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For uint64 or int64 hashes: whether their bit is set."""
    p = keys.view(np.uint64) >> np.uint64(64 - (6 + len(bits).bit_length() - 1))
    return ((bits.view(np.uint64)[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)


class Forest:
    """Union-find over 0..n-1 whose roots are the least members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch -> at most one edge per vertex, to the least vertex it reaches there."""
    for b in batches:
        both = np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()])
        ids, flat = np.unique(both, return_inverse=True)
        flat = flat.reshape(both.shape)
        forest = Forest(len(ids))
        for x, y in zip(*flat.tolist(), strict=True):
            forest.join(x, y)
        root = forest.roots()
        own = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])


#: Edges of a written partition, at least, where a graph is small.
EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for each vertex of edges(a long, b long) that isn't its component's least: alternating large-star and small-star rounds, each a written table, until nothing changes. The edges of a hub are rows of a join that Spark splits; of each vertex only its least neighbour is gathered, by partial minima."""
    own = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if tuple(state) == before or not state.n:
            return own.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = tuple(state)
        # large star: every larger neighbour of u goes to u's least neighbour
        sym = own.select("a", "b").unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = sym.join(least, F.col("a") == F.col("u")).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = table(new.coalesce(-(-state.n // EDGES)), "edges")
        drop_tables(own.sparkSession, own)
        own = new
