"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding: compatibility forms, accents, zero-width characters and case go; Cyrillic and Greek look-alikes become Latin letters;
digits and signs within a word of letters become the letters they imitate. What isn't a letter or digit is a space.

The lexicon holds whole words and word beginnings (stems), with log-odds weights. It starts from SEED and is learnt from
labelled rows: terms whose log-odds of standing in a toxic document are high even two standard errors down. The sample is
bounded: SAMPLE labelled rows at most, by order of a hash of their ids; near copies, which share the least hash of their three-word
shingles, count once, so that the plain words of a copied document don't become lexicon entries. Phrases in EXCEPTIONS
take back the hits inside them. Two numbers, the log of the total weight and the weight per hundred words, go through a
logistic curve fitted on the same sample.

Defined cases: a null or empty text gets the score of no hits; null ids are never training rows; repeated rows are scored each;
without usable labels (none, or one class) the seed lexicon and a fixed curve are used; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table, texts

SAMPLE = 20_000
STEM_LENGTHS = (4, 5, 6, 7)
MIN_DOCS, MIN_WEIGHT = 6, 1.5
SEED = dict.fromkeys("idiot moron stupid loser scum pathetic disgusting worthless imbecile vermin filth scumbag dumbass bastard asshole bitch".split(), 3.0)
EXCEPTIONS = ("idiot proof", "idiot s guide", "stupid simple", "keep it simple stupid", "trash can", "trash bin", "trash bag", "clown fish", "pond scum", "sore loser")
_LOOKALIKE = dict(zip("авеёзкмнорстухіјѕԁɡһԛԝαβεικνορτυχ", "abeezkmhopctyxijsdghqwabeiknoptux", strict=True))
_IMITATED = str.maketrans("013457@$!", "oieastasi")
_MIXED = re.compile(r"(?<=[a-z])[013457@$!]+(?=[a-z])|(?<![a-z0-9])[013457@$]+(?=[a-z]{2})|(?<=[a-z]{2})[013457$]+(?![a-z0-9])")
_SIGNS = str.maketrans("@$!", "   ")


class _Folding(dict):
    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        low = _LOOKALIKE.get(c.lower(), c.lower())
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = ""
        elif c in "@$!" or c.isalnum():
            out = low
        else:
            out = " "
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Folded text, a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    t = f" {text.translate(_FOLDING)} "
    return _MIXED.sub(lambda m: m[0].translate(_IMITATED), t).translate(_SIGNS) if re.search(r"[0-9@$!]", t) else t


@dataclass(frozen=True)
class Model:
    """weights: ' word ' (whole) or ' stem' (beginning) -> weight; curve: bias, log of weight, weight per hundred words."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 2.5, 0.3)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights:
            a.add_word(term, (term, w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (f" {phrase} ", None))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight): the heaviest match at each word's start, without those inside an exception phrase."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    spared = []
    for end, (term, w) in automaton.iter(folded):
        start = end - len(term) + 1
        if w is None:
            spared.append((start, end))
        elif start not in best or w > best[start][1]:
            best[start] = (end, w)
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in spared)]


def features(automaton, text: str) -> tuple[float, float]:
    folded = fold(text)
    total = sum(w for _, _, w in hits(automaton, folded))
    return math.log1p(total), 100 * total / (len(folded.split()) + 50)


def _terms(folded: str) -> set[str]:
    own = set(folded.split())
    return {f" {w} " for w in own if 3 <= len(w) <= 24} | {f" {w[:k]}" for w in own for k in STEM_LENGTHS if k < len(w)}


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        least = []
        for x in texts(b):
            w = x.lower().split()
            least.append(min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0) - 2**63)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(least, pa.int64()), b.column("toxic"), b.column("text")], ["doc_id", "print", "toxic", "text"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic, every = Counter(), Counter()
        for x, y in zip(texts(b), b.column("toxic").to_pylist(), strict=True):
            own = _terms(fold(x))
            every.update(own)
            if y:
                toxic.update(own)
        keys = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([every[k] for k in keys], pa.int64())], ["term", "a", "n"])


def _least_weight(toxic: int, clean: int) -> F.Column:
    """A term's log-odds less two standard errors, over columns a (toxic documents with it) and n (all with it)."""
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    c, d = F.lit(toxic) - F.col("a") + 0.5, F.lit(clean) - (F.col("n") - F.col("a")) + 0.5
    return F.log(a / c) - F.log(b / d) - 2 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _lexicon(terms, toxic: int, clean: int) -> dict[str, float]:
    """Terms whose weight holds two standard errors down. A stem gives way to a longer term that makes up nine tenths of it; a term that begins with a kept stem of like weight adds nothing."""
    strong = {}
    for term, a, n in terms:
        b = n - a
        w = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (clean - b + 0.5))
        if w - 2 * error >= MIN_WEIGHT:
            strong[term] = (a, round(w, 4))
    stems = lambda t: [t[: k + 1] for k in STEM_LENGTHS if k + 1 < len(t.rstrip()) or t[-1] == " " and k + 1 == len(t) - 1]
    longest: dict[str, int] = {}
    for term, (a, _) in strong.items():
        for s in stems(term):
            longest[s] = max(longest.get(s, 0), a)
    out: dict[str, float] = {}
    for term in sorted(strong, key=lambda t: (len(t.rstrip()), t)):
        a, w = strong[term]
        if longest.get(term, 0) < 0.9 * a and not any(out.get(s, -9.0) >= w - 1.0 for s in stems(term)):
            out[term] = w
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    design, beta = np.c_[np.ones(len(x)), x], np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            both = [features(a, x) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array([v[k] for v in both], pa.float64()) for k in range(2))], ["toxic", "x1", "x2"])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels(doc_id, toxic) of rows that aren't held out."""
    seed = {f" {k} ": w for k, w in SEED.items()}
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "text")
    prints = map_arrow(rows, _fingerprint, "doc_id long, print long, toxic int, text string")
    once = table(prints.groupBy("print").agg(F.min_by(F.struct("toxic", "text"), "doc_id").alias("r")).select("r.toxic", "r.text"), "toxic-sample")
    n = {r.toxic: r["count"] for r in once.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(tuple(sorted(seed.items())))
    counted = map_arrow(once, _count_terms, "term string, a long, n long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    strong = counted.where((F.col("a") >= MIN_DOCS) & (_least_weight(n[1], n[0]) >= MIN_WEIGHT - 1e-9)).orderBy("term")
    weights = seed | _lexicon([tuple(r) for r in strong.collect()], n[1], n[0])  # terms of the bounded sample that pass
    model = Model(tuple(sorted(weights.items())))
    x = map_arrow(once, _featured(model), "toxic int, x1 double, x2 double").toPandas()  # SAMPLE rows at most
    return Model(model.weights, curve=_curve(x[["x1", "x2"]].to_numpy(), x["toxic"].to_numpy("float64")))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; scores never use anything but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (b0, b1, b2) = model.automaton(), model.curve
        for b in batches:
            s = []
            for t in texts(b):
                x1, x2 = features(a, t)
                s.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + b1 * x1 + b2 * x2)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(own, run, "doc_id long, held_out boolean, score double, predicted int")
