"""Large groups of the near-duplicate search, ids with several texts, and columns with clashing names."""

import random

import numpy as np
import pytest

from mendframe.llm import line_dedup, minhash, quality
from mendframe.llm.common import free
from mendframe.llm.streams import Forest


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linked_loses_no_link_between_blocks(spark, monkeypatch, seed):
    """Chains of sets that shift by little: few pairs link, none through a pivot alone; several components in one group."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rng = random.Random(seed)
    sets = []
    for chain in range(5):
        for k in range(rng.randrange(3, 16)):
            sets.append(sorted(range(1000 * chain + 4 * k, 1000 * chain + 4 * k + 40)))
    rng.shuffle(sets)
    forest = Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(set(a) & set(b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                forest.join(i, j)
    rows = [(7, i, len(s), bytearray(np.array(s, np.uint64).tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "grp long, doc_id long, n long, data binary")
    got = Forest(len(sets))
    for r in minhash.linked(df, df.select("grp", "doc_id", "n"), 80, minhash._exactly(80), df.n * 8).collect():
        got.join(r.a, r.b)
    assert got.roots().tolist() == forest.roots().tolist()


def test_one_id_with_several_texts(spark):
    """An id with two texts is one document that has the links of both; each row keeps its own set's size."""
    rng = random.Random(4)
    x, y = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    df = spark.createDataFrame([(5, x), (5, y), (7, x + " end"), (9, y + " end"), (11, "other words here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(5, 59, 5), (5, 59, 5), (7, 60, 5), (9, 60, 5), (11, 2, 11)]


def test_clashing_names(spark):
    rng = random.Random(6)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(7))
    rows = [(i, text() + "\nshared line", "a", "b", "c", "d", "e", "f", "g") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _doc string, _keep string, _dropped string, _hash string, _th string, _ranges string")
    assert free(df, "key", "new") == ["__key", "_new"]
    for out in (line_dedup.dedup_lines(df), minhash.keep_first(df), quality.keep_good(df)):
        assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefg")}
    assert all("shared" not in r.text for r in line_dedup.dedup_lines(df).collect())


def test_large_verdicts_are_joined_by_a_shuffle(spark, monkeypatch):
    from mendframe.llm import common

    rows = [(i, f"line {i}\nshared line") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == near == {i: f"line {i}" for i in range(12)}


def test_secret_recall_through_scan():
    """Held-out samples within a text, short and letter-only ones too: random strings are found, ordinary ones left alone."""
    from mendframe.llm import secrets

    held = secrets.labelled_samples(600, seed=99)
    found = [(bool(secrets.scan(f"see {t}. And more")), y, len(t)) for t, y in held]
    for low, high in ((12, 20), (20, 64)):
        hits = [f for f, y, n in found if y and low <= n < high]
        assert sum(hits) / len(hits) > 0.9
    assert sum(f for f, y, _ in found if not y) / 600 < 0.01


def plain_spans():
    """A scan of one text: base spans by patterns written out here, model spans by a ratio counted from the samples in plain Python."""
    import math
    import re
    from collections import Counter

    from mendframe.llm import secrets

    pairs, firsts = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in secrets.labelled_samples():
        for a, b in zip("\0" + t, t, strict=False):
            pairs[y][a, b] += 1
            firsts[y][a] += 1

    def ratio(t):
        p = lambda y, a, b: math.log((pairs[y][a, b] + 0.02) / (firsts[y][a] + 128 * 0.02))
        return sum(p(1, a, b) - p(0, a, b) for a, b in zip("\0" + t, t, strict=False))

    assign = re.compile("(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")

    def scan(x):
        base = [(m.start(), 0, m.end()) for m in assign.finditer(x) if len(m[1]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 32]
        model = []
        for m in re.finditer(r"\S+", x):
            if len(m[0]) >= 12 and ":" not in m[0] and not any(a < m.end() and m.start() < b for a, _, b in base) and ratio(m[0]) >= 14 and ratio(m[0]) >= 0.9 * len(m[0]):
                model.append((m.start(), 3, m.end()))
        return [(a, ("assign", "access", "hex", "model")[k], b) for a, k, b in sorted(base + model)]

    return scan


def test_secret_spans_against_a_plain_ratio(spark):
    from mendframe.llm import secrets

    rng, scan = random.Random(31), plain_spans()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    items = [" ".join(rng.choice([lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(6, 40))), lambda: "configuration_manager", lambda: "password: " + "x" * rng.randrange(4, 14), lambda: "AKIA" + "Q7" * rng.randrange(3, 9), lambda: "e3" * rng.randrange(12, 20), lambda: "10.24.3.117"])() for _ in range(8)) for _ in range(40)]
    got = {r.doc_id: r.spans for r in secrets.scan_digest(spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")).collect()}
    for i, x in enumerate(items):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, k, b in scan(x)), x
    assert any("model" in s for s in got.values())


def test_more_vectors_get_more_signs():
    from mendframe.llm import embeddings

    assert embeddings.plan(1000, 0.95) == (12, 24) and embeddings.plan(10**9, 0.95)[0] == 24
    for n in (10, 10**6, 10**9):
        bits, tables = embeddings.plan(n, 0.95)
        together = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - together) ** tables <= embeddings.MISSED and n / 2**bits <= embeddings.BUCKET


def test_double_vectors_and_infinities(spark):
    from mendframe.llm import embeddings

    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0 + 1e-9]), (3, [float("inf"), 1.0, 2.0]), (4, [-1.0, -2.0, -3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)], key=str)
