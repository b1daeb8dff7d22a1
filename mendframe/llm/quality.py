"""Quality rules: fixed word rules, and robust multivariate outliers by language and source.

Each text becomes a vector of transformed rates. For each (lang, source) the minimum covariance determinant is sought as
FAST-MCD does: on START rows of the group (chosen by hash) STARTS small subsets are drawn, each becomes a fit that is
concentrated twice, the BEST of least determinant are concentrated until they stand still, and the least determinant wins. From
there concentration goes on over all rows of the group until no determinant falls by more than SETTLED: keep the SHARE of the
rows nearest by Mahalanobis distance, take their mean and covariance, and again. Only the start comes from the bounded
sample; each step is two aggregations with partial sums over all rows, so a source that holds a third of them only costs its
map tasks, and what a group sends on is one row. Quantiles are read from counts of distances in bins of BIN to the doubling,
so they don't depend on how rows are dealt. Distances are scaled so that a group's median is that of chi-square; documents
beyond CUTOFF are rejected.

FLOOR is added to each variance, so a rate that is constant in a group (often 0) doesn't reject the first small change. A
group of under MIN_ROWS documents that pass the base rules is judged by its language's fit, over all sources; a language of
under MIN_ROWS by the fit over all rows, however few these are. Groups of null lang or source are groups of their own.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows count each; null ids pass
through; an empty table gives none; other columns are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workers import ship
from .common import drop_tables, free, map_arrow, same, sent, table, texts, words

SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbol_rate", "dup_lines", "repeats", "upper", "marks")
P = len(FEATURES)
#: Least variance of each feature, as squared units of its transform.
FLOOR = np.array([0.05, 0.15, 0.08, 0.10, 0.05, 0.08]) ** 2
SHARE, STEPS, SETTLED, MIN_ROWS, BIN = 0.6, 12, 1e-3, 100, 64
#: Rows of a group that the starts are drawn from, subsets drawn, and fits that are concentrated to the end.
START, STARTS, BEST, SEED = 1000, 40, 5, 13
#: What names a fit: its level, and the group's language and source as far as the level tells them apart.
KEYS = ["level", "lang", "source"]
#: Squared distance, so a distance of 10; rates are far from normal, and clean documents must stay.
CUTOFF, CHI_MEDIAN = 100.0, 5.348
#: Words that the rates are shrunk by, as short texts vary more.
PRIOR = 30

#: For counting: bytes that aren't ASCII letters, or not capital ones; and runs of ASCII.
_NO_LETTER = bytes(k for k in range(256) if not (65 <= k <= 90 or 97 <= k <= 122))
_NO_UPPER = bytes(k for k in range(256) if not 65 <= k <= 90)
_ASCII = re.compile(r"[\x00-\x7f]+")

_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"x{i} double" for i in range(P))


def repeated_words(ws: list[str], window: int = 3) -> int:
    """Words in windows that occur twice or more in the text, first ones included."""
    if len(ws) <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in ws], np.int64)
    if len(seen) == len(ws):
        return 0
    code = ids[: len(ids) - window + 1]
    for k in range(1, window):  # pairs get dense numbers, so the product never overflows
        _, dense = np.unique(code, return_inverse=True)
        code = dense.astype(np.int64) * len(seen) + ids[k : len(ids) - window + 1 + k]
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0b\x0c\x0d")]
    return len(lines), len(lines) - len(set(lines))


def measure(text: str) -> tuple[list[int], list[float]]:
    ws = words(text)
    n, chars = len(ws), sum(map(len, ws))
    symbols = sum(map(text.count, SYMBOLS))
    lines, dup = duplicate_lines(text)
    rep = repeated_words(ws)
    raw, more = text.encode(), "" if text.isascii() else _ASCII.sub("", text)
    letters = len(raw.translate(None, _NO_LETTER)) + sum(map(str.isalpha, more))
    upper = len(raw.translate(None, _NO_UPPER)) + sum(map(str.isupper, more))
    rate = lambda a, b: a / (b + PRIOR)
    x = [
        np.log((chars + 5 * PRIOR) / (n + PRIOR)),
        np.log1p(100 * rate(symbols, n)),
        np.sqrt(dup / (lines + 4)),
        np.sqrt(rate(rep, n)),
        np.sqrt(upper / (letters + 4 * PRIOR)),
        np.log1p(rate(max(chars - letters, 0), n)),
    ]
    return [n, chars, symbols, dup, rep], [float(v) for v in x]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"x{i}" for i in range(P))]
    for b in batches:
        both = [measure(x) for x in texts(b)]
        ints = [pa.array([c[k] for c, _ in both], pa.int64()) for k in range(5)]
        reals = [pa.array([v[k] for _, v in both], pa.float64()) for k in range(P)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *ints, *reals], names)


def statistics(docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")), "text")
    return map_arrow(own, _measured, _STATS)


def _distance(mean, inverse) -> F.Column:
    """Squared Mahalanobis distance as one expression; mean and inverse are array columns."""
    d = [F.col(f"x{i}") - mean[i] for i in range(P)]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * inverse[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)))


def fit_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and log-determinant of rows; FLOOR is added to the variances."""
    return _fit(x.mean(axis=0), x.T @ x / len(x))


def _fit(mean: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    cov = second - np.outer(mean, mean)
    cov[np.diag_indices(P)] = np.maximum(np.diag(cov), 0) + FLOOR
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def concentrate(x: np.ndarray, fit: tuple, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step: the fit of the share of rows nearest by the fit given."""
    d = x - fit[0]
    far = np.einsum("ij,jk,ik->i", d, fit[1], d)
    h = max(1, int(np.ceil(share * len(x))))
    return fit_of(x[np.argpartition(far, h - 1)[:h]])


def least_determinant(x: np.ndarray, share: float = SHARE, starts: int = STARTS, best: int = BEST) -> tuple[np.ndarray, np.ndarray, float]:
    """FAST-MCD on rows in memory: of ``starts`` subsets, the ``best`` after two steps go on until they stand still."""
    rng = np.random.default_rng(SEED)
    k = min(len(x), P + 1)
    mid = np.median(x, axis=0)
    spread = 1 / ((1.4826 * np.median(np.abs(x - mid), axis=0)) ** 2 + FLOOR)
    found = [(mid, np.diag(spread), 0.0), *(fit_of(x[rng.choice(len(x), k, replace=False)]) for _ in range(starts))]
    for _ in range(2):
        found = [concentrate(x, f, share) for f in found]
    out = []
    for f in sorted(found, key=lambda f: f[2])[:best]:
        for _ in range(100):
            new = concentrate(x, f, share)
            if new[2] >= f[2] - 1e-9:
                break
            f = new
        out.append(f)
    return min(out, key=lambda f: f[2])


def _started(t: pa.Table) -> pa.Table:
    """The sample of a group -> its first fit."""
    x = np.column_stack([t.column(f"x{i}").to_numpy() for i in range(P)])
    order = np.lexsort(x.T)  # as rows come in any order
    mean, inverse, det = least_determinant(x[order])
    return pa.table({**{k: t.column(k)[:1] for k in KEYS}, "mean": pa.array([mean.tolist()]), "inverse": pa.array([inverse.ravel().tolist()]), "det": pa.array([det])})


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A group's moments -> its mean, inverse covariance and log-determinant."""
    for b in batches:
        fits = []
        for r in b.to_pylist():
            second = np.zeros((P, P))
            for i in range(P):
                for j in range(i, P):
                    second[i, j] = second[j, i] = r[f"s{i}_{j}"] / r["n"]
            fits.append(_fit(np.array([r[f"s{i}"] for i in range(P)]) / r["n"], second))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEYS), pa.array([f[0].tolist() for f in fits], kind), pa.array([f[1].ravel().tolist() for f in fits], kind), pa.array([f[2] for f in fits], pa.float64())], [*KEYS, "mean", "inverse", "det"])


def _with(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with their fit's parameters; null languages and sources match. Spark broadcasts the groups if it has measured them as small."""
    groups = groups.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    return rows.join(groups, same(rows, groups, *((k, f"_{k}") for k in KEYS)), "left").drop(*(f"_{k}" for k in KEYS))


def _levelled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with the level that judges each: 0 its group, 1 its language, 2 all rows; and the rows that each level's fits are made from.

    level, lang and source name the fit; at level 1 source is null, at level 2 lang too. Only groups of MIN_ROWS and more are joined, never the tail of small ones.
    """
    own = rows.withColumnsRenamed({"lang": "_l", "source": "_s"})
    passed = ~F.col("base_failed")
    enough = lambda *by: table(rows.where(passed).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS).select(*by), "levels")
    groups, langs = enough("lang", "source").withColumn("_g", F.lit(True)), enough("lang").withColumn("_h", F.lit(True))
    marked = own.join(groups, same(own, groups, ("_l", "lang"), ("_s", "source")), "left").drop("lang", "source")
    marked = marked.join(langs, same(marked, langs, ("_l", "lang")), "left").drop("lang")
    marked = marked.withColumn("level", F.when(F.col("_g"), 0).when(F.col("_h"), 1).otherwise(2)).drop("_g", "_h")
    marked = table(marked, "levelled")
    names = [F.when(F.col("level") < 2, F.col("_l")).alias("lang"), F.when(F.col("level") < 1, F.col("_s")).alias("source")]
    # a language that no small group looks to needs no fit of its own, nor do all rows if no language is small
    looked = table(marked.where(passed & (F.col("level") > 0)).groupBy("level", F.when(F.col("level") < 2, F.col("_l")).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "looked").drop("n")
    good = marked.where(passed)
    some = looked.where("level = 1").withColumnRenamed("lang", "_lang").drop("level")
    parts = [good.where("level = 0"), good.join(some, same(good, some, ("_l", "_lang")), "left_semi").withColumn("level", F.lit(1))]
    if looked.where("level = 2").limit(1).count():
        parts.append(good.withColumn("level", F.lit(2)))
    fits = reduce(DataFrame.unionByName, (p.select(*KEYS[:1], *names, F.xxhash64("doc_id", *(f"x{i}" for i in range(P))).alias("pick"), *(f"x{i}" for i in range(P))) for p in parts))
    return marked.select("*", *names).drop("_l", "_s"), table(fits, "fits")


_FITTED = "level int, lang string, source string, mean array<double>, inverse array<double>, det double"


def _quantile(far: DataFrame, share: float) -> DataFrame:
    """KEYS, most: the bin of d2 up to which share of a group's rows lie, from counts of bins."""
    held = far.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*KEYS)
    up_to = held.withColumn("up_to", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return up_to.where(F.col("up_to") >= share * F.col("all")).groupBy(*KEYS).agg(F.min("bin").alias("most"))


def robust_fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """level, lang, source, mean, inverse, det, scale: each group's location, inverse scatter, and what makes its median distance chi-square's."""
    xs = [f"x{i}" for i in range(P)]
    # a hash under its share of all hashes comes first, so a large group's tasks send on 2 * START rows together, not each
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    likely = _with(rows, sizes).where(F.abs(F.col("pick").cast("double")) * F.col("n") <= 2.0**63 * 2 * START)
    first = F.row_number().over(Window.partitionBy(*KEYS).orderBy("pick", *xs))
    sample = likely.withColumn("turn", first).where(F.col("turn") <= START).drop("turn", "pick", "n")
    ship(rows.sparkSession)
    fit = table(sample.groupBy(*KEYS).applyInArrow(_started, _FITTED), "mcd")
    bins = F.floor(F.log2(F.greatest("d2", F.lit(1e-12))) * BIN).cast("long")
    distances = lambda fit: _with(rows, fit.select(*KEYS, "mean", "inverse")).withColumn("d2", _distance(F.col("mean"), F.col("inverse"))).drop("mean", "inverse").withColumn("bin", bins)
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)]
    before = None
    for _ in range(steps):
        far = distances(fit)
        kept = _with(far, _quantile(far, SHARE)).where("bin <= most")
        new = table(map_arrow(kept.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *sums), _moved, _FITTED), "mcd")
        drop_tables(rows.sparkSession, fit)
        fit = new
        # one number stands for all groups: their determinants' sum, which falls or stands still
        now = fit.agg(F.sum("det").alias("d"), F.count(F.lit(1)).alias("n")).first()
        if not now.n or before is not None and before - now.d <= SETTLED * now.n:
            break
        before = now.d
    scale = _quantile(distances(fit), 0.5).select(*KEYS, (F.pow(F.lit(2.0), (F.col("most") + 0.5) / BIN) / CHI_MEDIAN).alias("scale"))
    return table(_with(fit, scale), "mcd")


def judge(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance (null where the base failed)."""
    stats = table(statistics(docs), "quality")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    marked = stats.withColumn("base_failed", base)
    levelled, rows = _levelled(marked)
    far = _with(levelled, robust_fit(rows))
    # a scale under 1 would only sharpen groups whose spread is all floor
    distance = F.when(~F.col("base_failed"), _distance(F.col("mean"), F.col("inverse")) / F.greatest("scale", F.lit(1.0)))
    kept = ~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that judge() keeps, all columns; of rows with one id, those stay whose id was kept. The ids that go are sent to the texts if they are SENT_BYTES at most."""
    key, doc = free(docs, "key", "doc")
    bad = judge(docs, **rules).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias(doc))
    left, bad = docs.withColumn(key, F.col("doc_id").cast("long")), sent(bad, "rejected")
    return left.join(bad, same(left, bad, (key, doc)), "left_anti").drop(key)
