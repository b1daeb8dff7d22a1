"""Windows that stand earlier in the corpus: the distributed frame of suffix-array and substring dedup.

A document is a row of units (bytes or words). A window is W units in a row. Each window picks an anchor, its least K-gram by
hash (the leftmost of equals); the windows of one anchor in a row are a segment. Equal windows have equal anchors at equal
distances, so only segments with equal anchors can hold equal windows:

1. all segments are written with anchor, place and fingerprint, and anchors are counted (partial sums first); those found once are
   settled. The others go to a bitmap sized by their number, up to a bound; beyond it the bitmap only lets a few more through;
2. of equal segments of anchors in the bitmap the first in order is the representative; the others are repeats as a whole, however
   many they are;
3. where an anchor has several different segments, representatives of them are read again with their content and dealt to shards
   by anchor; a shard builds an index over its content and reports the windows that stand earlier. Anchors with over HOT different
   segments never meet in a task: their windows are settled by fingerprints, with partial minima before the shuffle.

The index over a shard's content is the caller's: an induced suffix sort, or an FM-index. Ranges of repeated windows are then
gathered by document, and the text is read once more to cut them. Ranges of a document that touch are one.

Defined cases: null ids count as one id before all others; rows with one id are one document (its text should be one too, and ranges
beyond a text are cut off); texts shorter than a window have none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, free, map_arrow, same, small, table, texts
from .streams import bitmap, in_bitmap, mixed, runs

HOT, SHARD_BYTES, NULL_ID = 2000, 1 << 20, -(2**63)
#: Segments of the documents whose ranges are joined together, about.
SLICE_ROWS = 1 << 16


@dataclass(frozen=True)
class Units:
    """What a text is made of: split gives (hash of each unit, its content), part(content, a, b) the content of units [a, b), mark(hashes, content, a, b) bytes that stand for it in fingerprints."""

    split: Callable
    part: Callable
    mark: Callable
    window: int
    gram: int
    #: Whether a window of the same document, further left, counts as earlier.
    within: bool


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k units; k is a power of two. Units' hashes are mixed, summed with odd factors of their places, and mixed."""
    g, size = mixed(h, 1), 1
    while size < k:
        g = g[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + g[size:]
        size *= 2
    return mixed(g, size)


def segments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(first window, number of windows, anchor) of each segment."""
    if len(h) < window:
        return None
    g = grams(h, gram)
    w, m = window - gram + 1, len(g)
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    n, size = m - w + 1, 1
    while 2 * size <= w:  # least of size keys from each place on
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    at = (np.minimum(key[:n], key[w - size : w - size + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
    # the least hashes all begin with zeros; mixed anew they spread over the bitmap
    return first, np.diff(np.r_[first, n]), mixed(g[at[first]], 21)


def _place(anchor: np.ndarray, doc, start: np.ndarray) -> np.ndarray:
    return mixed(anchor ^ mixed(start.astype(np.uint64) + mixed(np.atleast_1d(np.asarray(doc, np.int64)).view(np.uint64), 11), 12), 13)


def _prints(u: Units, h: np.ndarray, content, spans) -> np.ndarray:
    """128-bit fingerprints of spans, as two columns of longs."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(u.mark(h, content, a, b)) for a, b in spans]), ">i8").astype(np.int64).reshape(-1, 2)


def _segments(u: Units):
    """Every segment with its anchor, fingerprint and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for d, x in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                h, content = u.split(x)
                if (s := segments(h, u.window, u.gram)) is None:
                    continue
                first, n, anchor = s
                prints = _prints(u, h, content, zip(first.tolist(), (first + n + u.window - 1).tolist(), strict=True))
                for c, v in zip(cols, (anchor.view(np.int64), prints, np.full(len(n), d, np.int64), first, n), strict=True):
                    c.append(v)
            if cols[0]:
                anchor, prints, doc, first, n = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (anchor, prints[:, 0], prints[:, 1], doc, first, n)], ["anchor", "f1", "f2", "doc_id", "start", "n"])

    return run


def _often(bits: np.ndarray):
    """The segments whose anchor is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits, b.column("anchor").to_numpy())))

    return run


def _contents(u: Units, wanted: np.ndarray, hot: np.ndarray, anchors: np.ndarray, owners: np.ndarray):
    """Chosen segments with their content; for hot anchors a row for each window instead, with its fingerprint. Documents outside owners have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "f1", "f2", "doc_id", "start", "n", "off", "w1", "w2", "content"]
        for b in batches:
            b = b.filter(pa.array(in_bitmap(owners, b.column("owner").to_numpy())))
            rows: list[tuple] = []
            for d, x in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                h, content = u.split(x)
                if (s := segments(h, u.window, u.gram)) is None:
                    continue
                first, n, anchor = s
                on = in_bitmap(anchors, anchor)
                on &= in_bitmap(wanted, _place(anchor, d, first))
                first, n, anchor = first[on], n[on], anchor[on]
                prints = _prints(u, h, content, zip(first.tolist(), (first + n + u.window - 1).tolist(), strict=True)).tolist()
                for a, k, key, f, warm in zip(first.tolist(), n.tolist(), anchor.view(np.int64).tolist(), prints, in_bitmap(hot, anchor).tolist(), strict=True):
                    if warm:
                        single = _prints(u, h, content, [(a + i, a + i + u.window) for i in range(k)]).tolist()
                        rows += [(key, *f, d, a, k, i, *w, None) for i, w in enumerate(single)]
                    else:
                        rows.append((key, *f, d, a, k, None, None, None, u.part(content, a, a + k + u.window - 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:9]), pa.array([r[9] for r in rows], pa.binary())], names)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hash of anchor, document and start by which chosen segments are found again."""
    for b in batches:
        anchor, doc, start = (b.column(c).to_numpy() for c in ("anchor", "doc_id", "start"))
        place = _place(anchor.view(np.uint64), doc, start)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place.view(np.int64))], [*b.schema.names, "place"])


def _shard(u: Units, earlier: Callable):
    """Segments of a shard -> ranges of windows that stand earlier: (anchor, f1, f2, doc_id, start, lo, hi)."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("anchor", "f1", "f2", "doc_id", "start", "content")), strict=True))
        best: dict[tuple, tuple] = {}
        for r in rows:
            if r[:3] not in best or r[3:5] < best[r[:3]][3:5]:
                best[r[:3]] = r
        count: dict[int, int] = {}
        for r in best.values():
            count[r[0]] = count.get(r[0], 0) + 1
        own = sorted((r for r in best.values() if count[r[0]] > 1), key=lambda r: r[3:5])
        if not own:
            return
        out = []
        for r, hit in zip(own, earlier([r[5] for r in own], [r[3] for r in own], [r[4] for r in own], u), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            out += [(*r[:5], int(a), int(b)) for a, b in edge.reshape(-1, 2)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["anchor", "f1", "f2", "doc_id", "start", "lo", "hi"])

    return run


#: What a row of _joined says, in the last two bits of its tag: what follows is no repeat; a repeat unless so; a repeat.
FIRST, COPY, REPEAT = 0, 1, 2


def _marked(copies: DataFrame, firsts: DataFrame, tag: str, kind: int) -> DataFrame:
    """Rows for _joined of copies(doc_id, a, b, tag) and of firsts(doc_id, a, tag) among them. kind keeps tags apart."""
    own = lambda said: F.expr(f"({tag} & 1073741823L) * 8L + {4 * kind + said}L").alias("tag")
    return copies.select("doc_id", "a", "b", own(COPY)).unionByName(firsts.select("doc_id", "a", F.lit(0).cast("long").alias("b"), own(FIRST)))


def _joined(window: int):
    """Windows a..b-1 of documents -> a row a document, its ranges in order; what overlaps or touches, in units, is one range. COPY rows of the document, place and tag of a FIRST row don't count."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, a, b, tag = (t.column(c).to_numpy() for c in ("doc_id", "a", "b", "tag"))
        by = np.lexsort((tag, a, doc))
        doc, a, b, tag = doc[by], a[by], b[by], tag[by]
        kind, n = tag & 3, len(doc)
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (tag[1:] >> 2 != tag[:-1] >> 2)]
        off = kind[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))] == FIRST
        on = (kind == REPEAT) | ((kind == COPY) & ~off)
        doc, a, b = doc[on], a[on], b[on]
        if not len(doc):
            return
        fresh = np.r_[True, doc[1:] != doc[:-1]]
        far = (np.cumsum(fresh) << 40) + b + (window - 1)
        edge = np.flatnonzero(np.r_[True, (np.cumsum(fresh)[1:] << 40) + a[1:] > np.maximum.accumulate(far)[:-1]])
        last = np.maximum.reduceat(b, edge)
        own = np.flatnonzero(fresh[edge])
        ranges = pa.StructArray.from_arrays([pa.array(a[edge]), pa.array(last)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(doc[edge][own]), pa.ListArray.from_arrays(pa.array(np.r_[own, len(edge)].astype(np.int32)), ranges)], ["doc_id", "ranges"])

    return run


#: A write with this on removes the files of its shuffles when it ends, and not after the driver's next garbage collection.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _table(df: DataFrame, name: str) -> DataFrame:
    """table() of what reads tables only, as nothing else may need its shuffles."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANED, "false")
    conf.set(_CLEANED, "true")
    try:
        return table(df, name)
    finally:
        conf.set(_CLEANED, before)


def repeated_ranges(docs: DataFrame, u: Units, earlier: Callable) -> DataFrame:
    """A table (doc_id, ranges array<struct<a, b>>): what the windows a..b-1 of the document cover is covered by windows that stand earlier too, and a document's ranges don't touch. docs(doc_id long without nulls, text).

    earlier(contents, docs, starts, u) tells for each segment, given in order, which of its windows stand earlier among them.
    """
    key, kind, spark = ["anchor", "f1", "f2"], "anchor long, f1 long, f2 long, doc_id long, start long", docs.sparkSession
    every = table(map_arrow(docs, _segments(u), f"{kind}, n long"), "all-segments")
    counted = every.groupBy("anchor")
    often = counted.agg(F.count(F.lit(1)).alias("n")).where("n > 1") if u.within else counted.agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y")
    often = _table(often.select("anchor"), "often")
    bits = bitmap(often, F.col("anchor"))
    found = _table(map_arrow(every, _often(bits), f"{kind}, n long"), "segments")
    drop_tables(spark, every, often)
    first = found.groupBy(key).agg(F.min(F.struct("doc_id", "start")).alias("r")).select(*key, "r.doc_id", "r.start")
    first = _table(map_arrow(first, _placed, f"{kind}, place long"), "first-segments")
    several = _table(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    apart = first.join(several.select(F.col("anchor").alias("_a")), F.col("anchor") == F.col("_a"), "left_semi")
    apart = _table(apart.select("place", F.xxhash64("doc_id").alias("owner")), "apart")
    wanted, hot, owners = bitmap(apart, F.col("place")), bitmap(several.where(F.col("n") > HOT), F.col("anchor")), bitmap(apart, F.col("owner"))
    drop_tables(spark, several, apart)
    rows = table(map_arrow(docs.withColumn("owner", F.xxhash64("doc_id")), _contents(u, wanted, hot, bits, owners), "anchor long, f1 long, f2 long, doc_id long, start long, n long, off long, w1 long, w2 long, content binary"), "contents")
    size = rows.where("content is not null").agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("b")).first().b
    shards = max(1, -(-size // SHARD_BYTES))
    cold = rows.where("content is not null").withColumn("shard", F.pmod(F.xxhash64(F.lit(23), "anchor"), F.lit(shards)))
    ranges = runs(cold, ["shard"], _shard(u, earlier), "anchor long, f1 long, f2 long, doc_id long, start long, lo long, hi long")
    warm = rows.where("content is null").withColumn("at", F.struct("doc_id", F.expr("start + off").alias("s")))
    least = warm.groupBy("w1", "w2").agg(F.min("at").alias("least"))
    window, repeat = F.expr("start + off").alias("a"), F.lit(REPEAT).cast("long").alias("tag")
    if u.within:
        ranges = _table(ranges, "ranges")
        part = ranges
        # a segment that isn't the first of its print is a repeat as a whole, a hot anchor's window that isn't the least of its own is one too; they are told from these beside the document's others
        spans = _marked(found.select("doc_id", F.col("start").alias("a"), F.expr("start + n").alias("b"), "f1"), first.select("doc_id", F.col("start").alias("a"), "f1"), "f1", 0)
        spans = spans.unionByName(_marked(warm.select("doc_id", window, F.expr("start + off + 1").alias("b"), "w1"), least.select("least.doc_id", F.col("least.s").alias("a"), "w1"), "w1", 1))
    else:
        least = least.select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), "least")
        warm = warm.join(least, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).where("least.doc_id < doc_id")
        # a segment let in by the bitmap's chance isn't its print's first: it is a repeat as a whole, and no range of the first one
        warm = warm.join(first.select(*(F.col(c).alias(f"_{c}") for c in (*key, "doc_id", "start"))), F.expr("anchor = _anchor and f1 = _f1 and f2 = _f2 and doc_id = _doc_id and start = _start"), "left_semi")
        ranges = _table(ranges.unionByName(warm.select(*key, "doc_id", "start", F.col("off").alias("lo"), F.expr("off + 1").alias("hi"))), "ranges")
        head = first.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("doc_id").alias("rep_doc"))
        placed = found.join(head, F.expr("anchor = _anchor and f1 = _f1 and f2 = _f2")).select(*key, "doc_id", "start", "n", "rep_doc")
        part = placed.where("doc_id = rep_doc").join(ranges.select(*(F.col(c).alias(f"_{c}") for c in key), "lo", "hi"), F.expr("anchor = _anchor and f1 = _f1 and f2 = _f2"))
        spans = placed.where("doc_id <> rep_doc").select("doc_id", F.col("start").alias("a"), F.expr("start + n").alias("b"), repeat)
    spans = spans.unionByName(part.select("doc_id", F.expr("start + lo").alias("a"), F.expr("start + hi").alias("b"), repeat))
    slices = 1 + found.count() // SLICE_ROWS
    spans = spans.withColumn("slice", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(slices)))
    out = _table(runs(spans, ["slice"], _joined(u.window), "doc_id long, ranges array<struct<a: long, b: long>>"), "ranges-by-document")
    drop_tables(spark, found, first, rows, ranges)
    return out


def covered(n: int, ranges: list[dict] | None, window: int) -> np.ndarray:
    """Which of n units the windows cover."""
    if not ranges:
        return np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int64)
    a = np.minimum([r["a"] for r in ranges], n)
    b = np.minimum([r["b"] + window - 1 for r in ranges], n)
    np.add.at(delta, a, 1)
    np.add.at(delta, b, -1)
    return np.cumsum(delta[:-1]) > 0


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> tuple[DataFrame, str]:
    """All rows and columns of docs, with the ranges, a table, (null: none) in a column of the name returned. Ranges of SENT_BYTES at most go to the texts; only more make texts move."""
    names, (key, doc, own) = docs.columns, free(docs, "key", "doc", "ranges")
    left = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    right = small(ranges, 16 * F.size("ranges") + 32).select(F.col("doc_id").alias(doc), F.col("ranges").alias(own))
    return left.join(right, same(left, right, (key, doc)), "left").select(*names, own), own
