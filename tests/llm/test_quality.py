"""The minimum covariance determinant against all subsets, and the whole verdict of the quality rules against plain numpy."""

import itertools
import random

import numpy as np

from mendframe.llm import quality


def test_least_determinant_is_that_of_all_subsets():
    rng = np.random.default_rng(3)
    for trial in range(6):
        x = rng.standard_normal((12, quality.P)) * 0.3
        x[:3] += 4 * (trial + 1)
        h = int(np.ceil(quality.SHARE * len(x)))
        best = min(quality.fit_of(x[list(c)])[2] for c in itertools.combinations(range(len(x)), h))
        assert abs(quality.least_determinant(x, starts=300, best=40)[2] - best) < 1e-6


def test_a_third_of_junk_is_no_norm_with_half_the_rows():
    rng = np.random.default_rng(5)
    x = np.r_[rng.standard_normal((130, quality.P)) * 0.2, rng.standard_normal((70, quality.P)) * 0.02 + 3]
    mean, _, _ = quality.least_determinant(x)
    assert np.abs(mean).max() < 0.5


def plain_verdicts(rows):
    """doc -> kept, by numpy on whole groups: MCD with many starts, then distances over the group's median."""
    out, fits, xs = {}, {}, {}
    for i, (text, lang, source) in enumerate(rows):
        counts, x = quality.measure(text or "")
        out[i] = not (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        xs[i] = np.array(x), lang, source
    good = [i for i in out if out[i]]
    groups = {}
    for i in good:
        _, lang, source = xs[i]
        for key in ((0, lang, source), (1, lang, None), (2, None, None)):
            groups.setdefault(key, []).append(i)
    for i in good:
        _, lang, source = xs[i]
        key = next(k for k in ((0, lang, source), (1, lang, None), (2, None, None)) if k[0] == 2 or len(groups[k]) >= quality.MIN_ROWS)
        if key not in fits:
            x = np.array([xs[j][0] for j in groups[key]])
            mean, inverse, _ = quality.least_determinant(x, starts=200, best=20)
            far = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
            fits[key] = mean, inverse, max(1.0, float(np.median(far)) / quality.CHI_MEDIAN)
        mean, inverse, scale = fits[key]
        d = xs[i][0] - mean
        out[i] = bool(d @ inverse @ d / scale <= quality.CUTOFF)
    return out


def test_verdicts_against_numpy(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(rng.randrange(8, 15))) for _ in range(rng.randrange(6, 12)))
    junk = lambda: " ".join(f"{rng.randrange(99)}#$%|<>*&" for _ in range(90))
    shout = lambda: clean().upper()
    rows = [(clean(), "en", "web") for _ in range(220)] + [(clean(), "en", f"s{i % 9}") for i in range(45)] + [(clean(), "de", "web") for _ in range(120)] + [(clean(), None, None) for _ in range(10)]
    rows += [(f(), lang, source) for f in (junk, shout) for lang, source in (("en", "web"), ("en", "s3"), ("de", "web"), (None, None), ("xx", "y"))]
    rows += [("short", "en", "web"), (None, "en", "web"), ("", None, "q"), ("again and again " * 40, "en", "web")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    want = plain_verdicts(rows)
    assert got == want and 10 <= sum(not v for v in want.values()) <= 20
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, v in want.items() if v}
    dealt = {r.doc_id: r.kept for r in quality.judge(df.repartition(7, "source")).collect()}
    assert dealt == got
