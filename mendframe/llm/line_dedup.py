"""Line dedup: range-partitioned line hashes, sorted by hash, document and position, streamed once.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; lines whose key is empty always stay.
Keys found in at least ``min_docs`` documents lose their lines; with ``keep_first`` each such key keeps its first line
(smallest document, then position). The result is a compressed keep bitmap for each document that loses lines; texts
don't move, and neither do they in :func:`apply_bitmaps` unless the bitmaps are over SENT_BYTES.

Rows are dealt by range of (hash, document), so a line that a third of all documents share spreads over many tasks. A
run of equal hashes that touches a task's first or last row may go on in a neighbour; such runs report a count each, the
counts are summed, and their lines wait for that sum.

Defined cases: a null or empty text is one empty line; null ids are one document; rows with the same id and text count
as one document, and each row gets the same bitmap; other columns pass through ``apply_bitmaps`` untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free, map_arrow, same, sent, table, texts

_RUNS = "kind int, doc_id long, th long, n_lines int, pos int, h1 long, h2 long, n_docs long"


def _stream(min_docs: int):
    """Sorted rows -> kind 0: a settled line; 1: a line of a run at the task's edge; 2: an edge run's count of documents."""

    def settle(t: pa.Table, first: bool, last: bool) -> pa.RecordBatch | None:
        h1, h2 = (t.column(c).to_numpy() for c in ("h1", "h2"))
        n = len(h1)
        if not n:
            return None
        doc = pc.fill_null(t.column("doc_id"), -(2**63)).to_numpy()
        th = t.column("th").to_numpy()
        fresh = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        run = np.cumsum(fresh) - 1
        new_doc = fresh | np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]
        count = np.bincount(run, weights=new_doc).astype("int64")
        runs = len(count)
        edge = np.zeros(runs, bool)
        edge[0] |= first
        edge[-1] |= last
        kind = np.where(edge[run], 1, 0).astype("int32")
        take = np.flatnonzero(edge[run] | (count[run] >= min_docs))
        heads = np.flatnonzero(fresh)[edge]
        rows = t.take(np.r_[take, heads])
        kinds = np.r_[kind[take], np.full(len(heads), 2, "int32")].astype("int32")
        return pa.Table.from_arrays(
            [pa.array(kinds), *(rows.column(c).combine_chunks() for c in ("doc_id", "th", "n_lines", "pos", "h1", "h2")), pa.array(count[run][np.r_[take, heads]])],
            ["kind", "doc_id", "th", "n_lines", "pos", "h1", "h2", "n_docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], True  # held: the rows of the run that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            if held and (h1[0], h2[0]) == last and (h1[-1], h2[-1]) == last:
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch])
            a, b = t.column("h1").to_numpy(), t.column("h2").to_numpy()
            last = (h1[-1], h2[-1])
            cut = np.flatnonzero((a != last[0]) | (b != last[1]))
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                if (out := settle(t.slice(0, at), first, False)) is not None:
                    yield from out.to_batches()
                first = False
            held = t.slice(at).to_batches()
        if held and (out := settle(pa.Table.from_batches(held), first, True)) is not None:
            yield from out.to_batches()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with a key: its place, and the 128-bit hash of the key. Bytes fold A-Z only."""
    import xxhash

    blank = SPACES.encode()
    for b in batches:
        count, lines, pos, prints = [], [], [], []
        for x in texts(b):
            parts = [p.strip(blank) for p in x.encode().lower().split(b"\n")]
            own = [k for k, p in enumerate(parts) if p]
            pos += own
            prints += [xxhash.xxh3_128_digest(parts[k]) for k in own]
            count.append(len(own))
            lines.append(len(parts))
        h = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 2)
        at = pa.array(np.repeat(np.arange(len(count)), count))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(at), b.column("th").take(at), pa.array(np.repeat(lines, count).astype(np.int32)), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
            ["doc_id", "th", "n_lines", "pos", "h1", "h2"],
        )


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep): for each document that loses lines; keep is a zlib bitmap, bit i of line i."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    lines = map_arrow(own, _hashed, "doc_id long, th long, n_lines int, pos int, h1 long, h2 long")
    dealt = lines.repartitionByRange("h1", "h2", "doc_id", "th").sortWithinPartitions("h1", "h2", "doc_id", "th", "pos")
    runs = table(map_arrow(dealt, _stream(min_docs), _RUNS), "line-runs")
    total = runs.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n_docs").alias("total")).where(F.col("total") >= min_docs)
    # a task has two edges, so total has at most two rows a task, each of some tens of bytes
    pending = runs.where("kind = 1").join(F.broadcast(total), ["h1", "h2"])
    cols = ["doc_id", "th", "n_lines", "pos", "h1", "h2"]
    gone = runs.where("kind = 0").select(cols).unionByName(pending.select(cols))
    if keep_first:
        head = gone.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("head")).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "head")
        gone = gone.join(head, (gone.h1 == head.g1) & (gone.h2 == head.g2)).where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("head")))
    by_doc = gone.groupBy("doc_id", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return map_arrow(by_doc, _pack, "doc_id long, th long, n_lines long, n_dropped long, keep binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, dropped = [], []
        for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone"), strict=True):
            bits = np.ones(n, bool)
            bits[np.asarray(gone.values)] = False
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
            dropped.append(len(gone.values))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pc.cast(b.column("n_lines"), pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "th", "n_lines", "n_dropped", "keep"])


def _kept(text: str, keep: bytes | None) -> str:
    if keep is None:
        return text
    parts = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(parts), bitorder="little")
    return "\n".join(x for x, on in zip(parts, bits.tolist(), strict=True) if on)


def _join(docs: DataFrame, maps: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with each row's bitmap and count of dropped lines (null: none), and the names of these two columns. Bitmaps of SENT_BYTES at most go to the texts; only larger ones make texts move."""
    d, h, dropped, keep, key, own = free(docs, "doc", "th", "dropped", "keep", "key", "hash")
    maps = sent(maps, "bitmaps", F.length("keep") + 48).select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    names = docs.columns
    docs = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.join(maps, same(docs, maps, (key, d), (own, h)), "left").select(*names, dropped, keep), dropped, keep


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """docs with the lines gone that maps drop; every row and column stays, and a document that loses all lines is ''."""
    names = docs.columns
    joined, _, keep = _join(docs, maps)

    def run(batches):
        for b in batches:
            t = [None if x is None and k is None else _kept(x or "", k) for x, k in zip(b.column("text").to_pylist(), b.column(keep).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return map_arrow(joined, run, docs.schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """Documents without the lines that at least min_docs documents share."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, keep_first))


def line_digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the lines that stay."""
    joined, dropped, keep = _join(docs.select("doc_id", "text"), line_bitmaps(docs, min_docs))

    def run(batches):
        for b in batches:
            lines, sums = [], []
            for x, k in zip(b.column("text").to_pylist(), b.column(keep).to_pylist(), strict=True):
                x = x or ""
                lines.append(x.count("\n") + 1)
                sums.append(hashlib.sha256(_kept(x, k).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.int64()), pc.fill_null(b.column(dropped), 0), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_arrow(joined, run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
