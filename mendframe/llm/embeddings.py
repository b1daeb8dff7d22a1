"""Embedding near-dedup: random-hyperplane sign hashes in several tables, exact cosines in double precision, components.

Equal vectors count once, with their number of copies. Each distinct vector goes to one bucket of each table by the
signs of its products with some random hyperplanes: at least BITS of them, and one more for each doubling of the vectors beyond
BUCKET << BITS, so buckets of unlike vectors stay as large as they are; tables are as many as keep MISSED. Vectors travel as
single floats where they are stored so. A bucket's vectors are compared with each other; a pair counts in the first
table that brings it together, so no pair list is kept: a bucket sends on, for each vector, its number of links and its
least partner in the bucket's forest. A bucket of over BLOCK vectors is cut into blocks that meet two by two, so no task
holds more than two blocks.

At cosine 0.95 a pair shares a table's bucket of 12 signs with probability 0.899^12 = 0.28, and at least one of 24 with
0.9996; closer pairs with more, and more signs get more tables.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do rows whose
id is null; vectors of different length never meet; rows with one id and equal vectors are copies of each other; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table
from .streams import Forest, components, runs

BITS, BUCKET, MISSED, BLOCK, ROWS, SEED = 12, 64, 4.3e-4, 2048, 256, 7


def plan(count: int, threshold: float) -> tuple[int, int]:
    """Signs and tables for so many vectors: chance of a pair at the threshold to be missed is MISSED at most."""
    bits = max(BITS, int(np.ceil(np.log2(max(count, 1) / BUCKET))))
    together = (1 - np.arccos(min(threshold, 1.0)) / np.pi) ** bits
    return bits, max(1, int(np.ceil(np.log(MISSED) / np.log1p(-together)))) if together < 1 else 1


@cache
def planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, bits * tables))


def _signed(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = []
            flat, at = b.column("embedding").values, b.column("embedding").offsets.to_numpy()
            flat = flat.to_numpy(zero_copy_only=False)
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = flat[lo:hi].astype(np.float64)
                with np.errstate(over="ignore"):
                    x = x / max(np.abs(x).max(), 1e-300)
                signs = (x @ planes(len(x), bits, tables) >= 0).reshape(tables, bits)
                sigs.append((signs @ (1 << np.arange(bits)) + (len(x) << bits)).astype(np.int64))
            vectors = [flat[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            short = [((s & ((1 << bits) - 1)) & 0xFFFFFFFF).astype(np.uint32).tobytes() for s in sigs]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("copies"), pa.array(vectors, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["vec_id", "copies", "vector", "sigs", "short"])

    return run


def _bucket(threshold: float, kind: type):
    """A bucket, or two blocks of one: each vector's count of links first met in this table, and its forest edge."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(t.column("vec_id").to_numpy(), kind="stable")
        ids, copies, side = (t.column(c).to_numpy()[order] for c in ("vec_id", "copies", "side"))
        table_no, cross = t.column("t")[0].as_py(), t.column("i")[0].as_py() != t.column("j")[0].as_py()
        n = len(ids)
        flat = lambda c, of: np.frombuffer(b"".join(t.column(c).to_pylist()), of).reshape(n, -1)[order]
        x = flat("vector", kind).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sigs = flat("short", np.uint32)[:, :table_no]
        links = np.zeros(n, np.int64)
        forest = Forest(n)
        for at in range(0, n, ROWS):
            hit = x[at : at + ROWS] @ x[at:].T >= threshold
            a, b = np.nonzero(hit)
            a, b = a + at, b + at
            on = (a < b) & ((side[a] != side[b]) if cross else True)
            a, b = a[on], b[on]
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            for s in range(0, len(a), 100_000):
                new[s : s + 100_000] = ~(sigs[a[s : s + 100_000]] == sigs[b[s : s + 100_000]]).any(axis=1)
            np.add.at(links, a[new], copies[b[new]])
            np.add.at(links, b[new], copies[a[new]])
            _, first = np.unique(b, return_index=True)  # most joins of a dense bucket, once each
            for p, q in zip(a[first].tolist(), b[first].tolist(), strict=True):
                forest.join(p, q)
            roots = forest.roots()
            apart = roots[a] != roots[b]
            for p, q in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                forest.join(p, q)
        root = forest.roots()
        own = np.flatnonzero((links > 0) | (root != np.arange(n)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(links[own]), pa.array(ids[root[own]])], ["a", "links", "b"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding). Signs and tables follow the number of distinct vectors unless given."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64(F.lit(3), "embedding")).withColumn("h2", F.xxhash64(F.lit(5), "embedding"))
    rows = table(rows, "vectors")
    distinct = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    first = rows.where("ok").select("vec_id", "embedding", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    heads = first.join(distinct, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")) & (F.col("vec_id") == F.col("rep"))).dropDuplicates(["vec_id", "h1", "h2"])
    heads = table(heads.select("vec_id", "copies", "embedding"), "heads")
    planned = plan(heads.count(), threshold)
    bits, tables = bits or planned[0], tables or planned[1]
    signed = table(map_arrow(heads, _signed(bits, tables), "vec_id long, copies long, vector binary, sigs array<long>, short binary"), "signed")
    # rep ids may repeat where one id has several vectors; buckets work on rows all the same
    keyed = signed.select("vec_id", "copies", "vector", "short", F.posexplode("sigs").alias("t", "sig"))
    sizes = keyed.groupBy("t", "sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > BLOCK).select(F.col("t").alias("lt"), F.col("sig").alias("ls"), F.ceil(F.col("n") / (BLOCK * 0.9)).cast("long").alias("blocks"))
    placed = keyed.join(large, (F.col("t") == F.col("lt")) & (F.col("sig") == F.col("ls")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    placed = placed.withColumn("side", F.pmod(F.xxhash64(F.lit(17), "vec_id", "t"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(F.col("t").cast("long").alias("t"), "sig", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "vec_id", "copies", "vector", "short")
    found = table(runs(placed, ["t", "sig", "i", "j"], _bucket(threshold, np.float32 if single else np.float64), "a long, links long, b long", least=2), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("ca"), "links")
    joined = components(found.select("a", "b"))
    reps = distinct.join(counts, F.col("rep") == F.col("ca"), "left").join(joined, F.col("rep") == F.col("id"), "left")
    reps = reps.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = rows.select("vec_id", "ok", "h1", "h2").join(reps, F.col("ok") & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a)
  SELECT a, min(b) AS least FROM r GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN reach r ON r.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""
