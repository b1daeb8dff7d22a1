"""MinHash near-dedup: chosen-path similarity join of shingle sets, exact confirmation, components.

Equal sets count once. Each distinct set has T minwise values. A tree picks PICK positions by chance, at its root and
again at every node; a document goes down the branch of its own value at each picked position. Nodes of up to LEAF documents
are compared exhaustively by the share of equal minwise values; TREES independent trees repeat this. The trees'
first branching is a shuffle; nodes of up to NODE documents are branched further inside their task, larger ones by
more shuffles, and those that stay large (one group of alike documents) are linked as large groups are, below.

A pair at similarity 0.8 goes down together at one level with probability 1 - 0.2^PICK = 0.96; over three levels a tree
keeps it with about 0.94, and four trees miss it with about 10^-5. Its share of equal values is under NEAR with 2 in 10^4.

Nodes send on forests, never all pairs: components of these are groups of possibly near documents. Full sets are then gathered
by group, and every two of a group that may be linked by their sizes are compared exactly, unless they are in one confirmed
component already, as that changes nothing. What is sent on is again a forest.

A group over BLOCK_BYTES or BLOCK documents is dealt to blocks, and some PIVOTS of its documents go to every block: where all are
alike, one pivot links them all, at a cost in proportion to the group. Only if this leaves several components, the documents
outside the largest one meet all of the group, block by block (``linked``).

Defined cases: texts without words, and null texts, have empty sets and link with nothing; one word is a set of one; null ids are
left unlinked; rows with one id are one document, which has the links of all its texts, and each row is returned with its own
text's set size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD_SPACE, free, map_arrow, same, sent, table, texts
from .streams import Forest, bitmap, components, contracted, in_bitmap, mixed, runs

T, TREES, PICK, LEAF, NODE, DEPTH, BLOCK, NEAR, SEED = 128, 4, 2, 64, 20_000, 6, 2048, 0.67, 42
#: Bytes of sets in a block, and how many documents of a large group all its blocks hold, about.
BLOCK_BYTES, PIVOTS = 8 << 20, 16
#: Words of a shingle and similarity in percent, where no other rule is given.
WIDTH, PERCENT = 2, 80
#: Words whose hashes a worker keeps, and their greatest length: some 30 MB.
WORDS, WORD_LENGTH = 200_000, 32


class WordHashes(dict):
    """word -> 64-bit hash, kept for the commonest."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= WORD_LENGTH:
            if len(self) >= WORDS:
                self.clear()
            self[word] = h
        return h


_HASHES = WordHashes()
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    if lower and not text.isascii():
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        for a, b in zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", strict=True):
            text = text.replace(a, b)
    else:
        text = text.translate(_FOLD if lower else FOLD_SPACE)
    return np.array([_HASHES[w] for w in text.split(" ") if w], np.uint64)


def shingles(text: str, width: int = 2) -> np.ndarray:
    """Sorted distinct hashes of width-word shingles; of all words as one if they are fewer."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = mixed(h[:n], 1)
    for k in range(1, min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n], 2)
    return np.unique(out)


_MULTIPLY = np.random.default_rng(SEED).integers(1, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(values: np.ndarray) -> np.ndarray:
    """T minwise values of a set, 32 bits each."""
    best = np.full(T, 2**64 - 1, np.uint64)
    for s in range(0, len(values), 2048):
        part = values[s : s + 2048]
        best = np.minimum(best, (part[None, :] * _MULTIPLY[:, None]).min(axis=1))
    return (mixed(best, 3) >> np.uint64(32)).astype(np.uint32)


def near_share(percent: int) -> float:
    """The share of equal minwise values from which a pair is compared: 3.68 deviations under the similarity; NEAR at 80 percent."""
    t = percent / 100
    return NEAR if percent == PERCENT else max(0.0, t - 3.68 * (t * (1 - t) / T) ** 0.5)


def trees_for(percent: int) -> int:
    """Trees that miss a pair at this similarity with about 10^-5: TREES at 80 percent."""
    kept = 1.0
    for _ in range(3):
        kept = 1 - (1 - percent / 100 * kept) ** PICK
    return TREES if percent == PERCENT else max(1, int(np.ceil(np.log(1.3e-5) / np.log(max(1 - kept, 1e-9)))))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, d1, d2, sigs = [], [], [], []
            for x in texts(b):
                s = shingles(x, width)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append((d >> 64) - 2**63)
                d2.append((d & (2**64 - 1)) - 2**63)
                sigs.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n, d1, d2)), pa.array(sigs, pa.binary())], ["doc_id", "n", "d1", "d2", "sig"])

    return run


def _branch(path: np.ndarray, level: int) -> np.ndarray:
    """PICK distinct positions for each node, by chance fixed by its path: PICK x nodes."""
    first = (mixed(path, 100 + level) % np.uint64(T)).astype(np.int64)
    step = 1 + (mixed(path, 200 + level) % np.uint64(T - 1)).astype(np.int64)
    return np.stack([(first + k * step) % T for k in range(PICK)]) if PICK <= 2 else np.stack([(first + k * (1 + step % 31)) % T for k in range(PICK)])


def _plant(trees: int):
    """Each document's first branches: PICK nodes of each tree. Nodes are told apart by whole minwise values; on go 16 bits of each, as many as comparisons need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(trees, dtype=np.uint64), 5)
        at = _branch(roots, 0)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, T)
            short = (sig >> np.uint32(16)).astype(np.uint16)
            short = pa.array([x.tobytes() for x in short], pa.binary())
            for tree in range(trees):
                for k in range(PICK):
                    pos = at[k, tree]
                    node = mixed(roots[tree] ^ mixed(sig[:, pos].astype(np.uint64) * np.uint64(T) + np.uint64(pos), 6), 7)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("doc_id"), b.column("n"), short], ["node", "doc_id", "n", "sig"])

    return run


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, T)


def _grow(level: int):
    """The next branches of the documents of large nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b.column("sig"))
            path = b.column("node").to_numpy().view(np.uint64)
            at = _branch(path, level)
            for k in range(PICK):
                value = sig[np.arange(len(sig)), at[k]].astype(np.uint64)
                node = mixed(path ^ mixed(value * np.uint64(T) + at[k].astype(np.uint64), 6), 7)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), b.column("doc_id"), b.column("n"), b.column("sig")], ["node", "doc_id", "n", "sig"])

    return run


def _compare(sig: np.ndarray, n: np.ndarray, forest: Forest, who: np.ndarray, percent: int) -> None:
    """Join the pairs of who whose share of equal values is near_share at least and whose sizes allow the similarity.

    In large nodes pairs that are already in one tree are passed over, so a group of alike documents costs one block of comparisons.
    """
    near = near_share(percent) * T
    for s in range(0, len(who), 64):
        own, rest = who[s : s + 64], who[s:]
        if len(who) > 4 * LEAF:
            root = forest.roots()
            if s and (root[rest] == root[rest[0]]).all():
                return
        size = n[own][:, None], n[rest][None, :]
        fit = (100 * np.minimum(*size) >= percent * np.maximum(*size)) & (own[:, None] < rest[None, :])
        if len(who) > 4 * LEAF:
            fit &= root[own][:, None] != root[rest][None, :]
        a, b = np.nonzero(fit)
        for c in range(0, len(a), 20_000):
            i, j = own[a[c : c + 20_000]], rest[b[c : c + 20_000]]
            hit = (sig[i] == sig[j]).sum(axis=1) >= near
            for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                forest.join(x, y)


def _descend(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """A node that fits a task: branch on until nodes are small, compare, and send its forest."""
    ids, n = t.column("doc_id").to_numpy(), t.column("n").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, n = ids[order], n[order]
    sig = _signatures(t.column("sig"))[order]
    forest = Forest(len(ids))
    stack = [(np.arange(len(ids)), t.column("node")[0].as_py() & (2**64 - 1), 0)]
    while stack:
        who, path, depth = stack.pop()
        if len(who) <= LEAF or depth >= DEPTH:
            _compare(sig, n, forest, who, percent)
            continue
        at = _branch(np.array([path], np.uint64), 50 + depth)
        for k in range(PICK):
            pos = int(at[k, 0])
            value = sig[who, pos]
            o = np.argsort(value, kind="stable")
            cut = np.flatnonzero(np.diff(value[o])) + 1
            for part in np.split(who[o], cut):
                if len(part) > 1:
                    child = mixed(np.array([path], np.uint64) ^ mixed(np.array([int(sig[part[0], pos]) * T + pos], np.uint64), 6), 7)
                    stack.append((np.sort(part), int(child[0]), depth + 1))
    yield from _forest_edges(ids, forest)


def _forest_edges(ids: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
    root = forest.roots()
    own = np.flatnonzero(root != np.arange(len(ids)))
    if len(own):
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], ["a", "b"])


def _together(percent: int, counts: Callable) -> Callable:
    """A block of a group -> forest edges of its links, every pair decided by counts(data, sizes).

    counts gives a function (i, others) -> which of the others link with row i. Rows of one id, or of one component found before, are
    in one tree from the start; where components are given, only rows outside the largest (``rest``) meet the others.
    """

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        ids, comp, n = (t.column(c).to_numpy()[order] for c in ("doc_id", "comp", "n"))
        rest = t.column("rest").to_numpy(zero_copy_only=False)[order]
        every = bool(rest.all())
        raw = t.column("data").to_pylist()
        link = counts([raw[i] for i in order.tolist()], n)
        forest = Forest(len(ids))
        _, label = np.unique(comp, return_inverse=True)  # label: of the tree that holds a row
        for i in (np.flatnonzero(ids[1:] == ids[:-1]) + 1).tolist():
            forest.join(i - 1, i)
            label[label == label[i]] = label[i - 1]
        for i in np.flatnonzero(rest).tolist():
            fit = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if every:
                fit[:i] = False  # met before, from the other side
            others = np.flatnonzero(fit)
            if not len(others):
                continue
            for j in others[link(i, others)].tolist():
                if label[j] != label[i]:
                    forest.join(i, j)
                    label[label == label[j]] = label[i]
        yield from _forest_edges(ids, forest)

    return run


def _exactly(percent: int):
    """Exact counts of common shingles."""

    def counts(raw: list[bytes], n: np.ndarray):
        flat = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1]
        at = np.r_[0, np.cumsum(n)]
        mark = np.zeros(len(flat) + 1, bool)

        def link(i: int, others: np.ndarray) -> np.ndarray:
            own = flat[at[i] : at[i + 1]]
            mark[own] = True
            if 4 * n[others].sum() < len(flat):
                common = np.array([np.count_nonzero(mark[flat[at[j] : at[j + 1]]]) for j in others.tolist()])
            else:
                common = np.add.reduceat(mark[flat], at[:-1], dtype=np.int64)[others]
            mark[own] = False
            return 100 * common >= percent * (n[i] + n[others] - common)

        return link

    return counts


def _likely(percent: int):
    """The share of equal minwise values."""

    def counts(raw: list[bytes], n: np.ndarray):
        sig, near = np.frombuffer(b"".join(raw), np.uint16).reshape(-1, T), near_share(percent) * T
        return lambda i, others: (sig[others] == sig[i]).sum(axis=1) >= near

    return counts


def linked(rows: DataFrame, members: DataFrame, percent: int, counts: Callable, bytes_of: Column) -> DataFrame:
    """Forest edges (a, b) of the links within each group of rows(grp, doc_id, n, data); members(grp, doc_id, n) are the same rows without data.

    No pair is lost: within a block all meet; where a large group's blocks and pivots leave several components, the
    documents outside its largest component meet all others.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.sum(bytes_of).alias("_b"))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.ceil(F.col("_b") / BLOCK_BYTES)).cast("long")
    large = table(sizes.select(F.col("grp").alias("_grp"), "_n", blocks.alias("_blocks")).where("_blocks > 1"), "large-groups")
    kind, join = "a long, b long", _together(percent, counts)
    cols = ["grp", "i", "doc_id", "n", "comp", "rest", "data"]
    if not large.limit(1).count():
        alone = rows.select("grp", F.lit(0).cast("long").alias("i"), "doc_id", "n", F.col("doc_id").alias("comp"), F.lit(True).alias("rest"), "data")
        return runs(alone, ["grp", "i"], join, kind, least=2, then=contracted)
    placed = rows.join(large, F.col("grp") == F.col("_grp"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    block = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.col("_blocks"))
    pivot = F.coalesce(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.col("_n")) < PIVOTS, F.lit(False))
    spread = F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).otherwise(F.array(block)))
    placed = placed.withColumn("i", spread).withColumn("comp", F.col("doc_id")).withColumn("rest", F.lit(True)).select(*cols)
    first = table(runs(placed, ["grp", "i"], join, kind, least=2, then=contracted), "first-links")
    # large groups of several components: whatever is outside the largest meets all
    found = components(first)
    own = members.join(large, F.col("grp") == F.col("_grp"), "left_semi").select("grp", "doc_id", "n")
    own = own.join(found, F.col("doc_id") == F.col("id"), "left").select("grp", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("comp"))
    parts = table(own.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(bytes_of).alias("b")), "parts")
    main = parts.groupBy("grp").agg(F.max(F.struct("k", "comp", "b")).alias("main"), F.sum("k").alias("n"), F.sum("b").alias("b")).where("main.k < n")
    cut = lambda n, b: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES)).cast("long")
    main = table(main.select(F.col("grp").alias("_grp"), F.col("main.comp").alias("main"), cut(F.col("n"), F.col("b")).alias("_blocks"), cut(F.col("n") - F.col("main.k"), F.col("b") - F.col("main.b")).alias("_rests")), "several")
    if not main.limit(1).count():
        return first
    again = rows.join(main, F.col("grp") == F.col("_grp")).join(found, F.col("doc_id") == F.col("id"), "left").withColumn("comp", F.coalesce("component_id", "doc_id"))
    again = again.withColumn("rest", F.col("comp") != F.col("main"))
    block, other = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.col("_blocks")), F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.col("_rests"))
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    everyone = again.withColumn("rest", F.lit(False)).withColumn("i", F.explode(F.transform(count("_rests"), lambda r: r * F.col("_blocks") + block)))
    outside = again.where("rest").withColumn("i", F.explode(F.transform(count("_blocks"), lambda k: other * F.col("_blocks") + k)))
    met = everyone.select(*cols).unionByName(outside.select(*cols))
    return first.unionByName(runs(met, ["grp", "i"], join, kind, least=2, then=contracted))


def candidates(sets: DataFrame, trees: int = TREES, percent: int = PERCENT) -> DataFrame:
    """Forest edges (a, b) over sets(doc_id, n, sig) that hold, with high probability, every pair of that similarity or more in one component."""
    kind = "node long, doc_id long, n long, sig binary"
    level, now, out = 0, map_arrow(sets.select("doc_id", "n", "sig"), _plant(trees), kind), None
    add = lambda x: x if out is None else out.unionByName(x)
    while True:
        large = table(now.groupBy("node").agg(F.count(F.lit(1)).alias("n_node")).where(F.col("n_node") > NODE), "large-nodes")
        some = large.limit(1).count() > 0
        hot = large.select(F.col("node").alias("_node"))
        fit = now.join(hot, F.col("node") == F.col("_node"), "left_anti") if some else now
        out = add(runs(fit, ["node"], partial(_descend, percent=percent), "a long, b long", least=2, then=contracted))
        if not some:
            return out
        rest = now.join(hot, F.col("node") == F.col("_node"), "left_semi")
        if level >= DEPTH:
            rest = rest.select(F.col("node").alias("grp"), "doc_id", "n", F.col("sig").alias("data"))
            return add(linked(rest, rest.select("grp", "doc_id", "n"), percent, _likely(percent), F.lit(2 * T)))
        level += 1
        now = map_arrow(table(rest, "large"), _grow(level), kind)


def _full(bits: np.ndarray, width: int):
    """doc_id, values: the sets of the documents whose id's hash is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.flatnonzero(in_bitmap(bits, b.column("h").to_numpy()))
            if len(at):
                b = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingles(x, width).tobytes() for x in texts(b)], pa.binary())], ["doc_id", "values"])

    return run


def near_duplicates(docs: DataFrame, trees: int | None = None, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text): width-word shingles, linked from percent similarity on."""
    trees = trees or trees_for(percent)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = table(map_arrow(own, _sketch(width), "doc_id long, n long, d1 long, d2 long, sig binary"), "sketches")
    able = sketches.where("n > 0 and doc_id is not null")
    # equal sets have equal sizes and sketches; one id may head several sets
    heads = table(able.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("sig").alias("sig")), "heads")
    groups = components(candidates(heads, trees, percent))
    groups = table(groups.unionByName(groups.select(F.col("component_id").alias("id"), "component_id").distinct()), "groups")
    bits = bitmap(groups, F.xxhash64("id"))
    full = map_arrow(own.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").where("doc_id is not null"), _full(bits, width), "doc_id long, values binary")
    full = full.join(groups, F.col("doc_id") == F.col("id")).select(F.col("component_id").alias("grp"), "doc_id", F.xxhash64("values").alias("v"), (F.length("values") / 8).cast("long").alias("n"), F.col("values").alias("data"))
    full = full.dropDuplicates(["doc_id", "v"]).drop("v").where("n > 0")
    members = heads.join(groups, F.col("doc_id") == F.col("id")).select(F.col("component_id").alias("grp"), "doc_id", "n")
    links = linked(full, members, percent, _exactly(percent), 8 * F.col("n"))
    # equal sets are linked too, through their first document
    reps = heads.select(F.col("doc_id").alias("rep"), F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    copies = able.join(reps, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(copies))
    out = sketches.select("doc_id", "n").join(found, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, trees: int | None = None, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near-duplicate an earlier one; all columns. The ids that go are sent to the texts if they are SENT_BYTES at most."""
    key, doc = free(docs, "key", "doc")
    gone = near_duplicates(docs, trees, width, percent).where("not kept").select(F.col("doc_id").alias(doc)).distinct()
    left, gone = docs.withColumn(key, F.col("doc_id").cast("long")), sent(gone, "near-copies")
    return left.join(gone, same(left, gone, (key, doc)), "left_anti").drop(key)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a)
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.least, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(r.least, s.doc_id)) AS kept
FROM s LEFT JOIN reach r ON r.a = s.doc_id
"""
