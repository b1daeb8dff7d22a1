"""The induced sort beyond its memory, and the toxicity score against plain Python."""

import math
import random
import time
import tracemalloc

import numpy as np

from mendframe.llm import induced, repeats, toxicity


def prose(n, seed):
    rng = random.Random(seed)
    words = [bytes(97 + rng.randrange(26) for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    return b" ".join(rng.choice(words) for _ in range(n // 4))[:n] + b"\0"


def test_memory_follows_the_limit_and_not_the_text():
    """Texts of 30 and 120 times the tuples that may be in memory."""
    peaks = []
    for n in (15_000, 60_000):
        t = prose(n, 4)
        tracemalloc.start()
        order, common = induced.suffix_order(t, 500)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert order.n == common.n == len(t)
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 3_000_000


def test_far_beyond_memory_is_right():
    t = prose(6000, 5) * 2
    t = t[: len(t) // 2 - 1] + b"\1" + t[len(t) // 2 :]
    order, common = induced.suffix_order(t, 32)
    sa = list(order)
    assert sa == sorted(range(len(t)), key=lambda i: t[i:])
    for x, y, v in list(zip(sa, sa[1:], list(common)[1:], strict=False))[::37]:
        assert t[x : x + v] == t[y : y + v] and t[x + v : x + v + 1] != t[y + v : y + v + 1]


def test_runs_are_read_in_pieces(monkeypatch):
    """Whatever CHUNK is, the same windows stand earlier."""
    rng = random.Random(6)
    base = prose(400, 7)[:-1]
    contents = [base[rng.randrange(100) : 200 + rng.randrange(200)] for _ in range(30)]
    u = induced.byte_units(50)
    whole = induced.earlier_starts(contents, list(range(30)), [0] * 30, u)
    monkeypatch.setattr(induced, "CHUNK", 7)
    pieces = induced.earlier_starts(contents, list(range(30)), [0] * 30, u)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True)) and any(a.any() for a in whole)


def test_array_order_against_sorting():
    """Few and many units, long runs of one unit, and texts that repeat as a whole."""
    rng = random.Random(9)
    for trial in range(300):
        t = [rng.randrange(1, rng.choice([1, 2, 3, 26, 250]) + 1) for _ in range(rng.randrange(0, 120))]
        if trial % 3 == 0:
            t = [x for x in t for _ in range(rng.choice([1, 2, 9]))]
        if trial % 5 == 0:
            t *= 4
        t.append(0)
        got = induced.array_order(np.array(t, rng.choice([np.uint8, np.uint16])))
        assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:]), trial


def test_both_sorts_find_the_same_windows(monkeypatch):
    rng = random.Random(10)
    for trial in range(12):
        base = bytes(rng.choice(b"abcdef \0\1" if trial % 2 else b"abcdef") for _ in range(500))
        contents = [base[(a := rng.randrange(200)) : a + rng.randrange(200)] for _ in range(40)] + [b"a" * k for k in range(1, 150, 9)]
        docs, starts = [k // 3 for k in range(len(contents))], [k % 3 * 1000 for k in range(len(contents))]
        for window in (1, 9, 50):
            u = induced.byte_units(window)
            arrays = induced.earlier_starts(contents, docs, starts, u)
            with monkeypatch.context() as m:
                m.setattr(induced, "IN_MEMORY", 0)
                m.setattr(induced, "CHUNK", 7 if trial % 3 else induced.CHUNK)
                external = induced.earlier_starts(contents, docs, starts, u)
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, external, strict=True)) and any(a.any() for a in arrays)


def test_a_shard_that_fits_memory_is_sorted_by_arrays(monkeypatch):
    """At least four times as fast as the external sort, on prose and on long runs of one byte."""
    for contents in ([prose(170, k)[:-1] for k in range(400)], [b"a" * 160] * 400):
        took = []
        for limit in (induced.IN_MEMORY, 0):
            monkeypatch.setattr(induced, "IN_MEMORY", limit)
            began = time.process_time()
            induced.earlier_starts(contents, list(range(400)), [0] * 400, induced.byte_units())
            took.append(time.process_time() - began)
        monkeypatch.undo()
        assert 4 * took[0] < took[1]


def test_ranges_are_joined_and_hot_windows_found(spark, monkeypatch):
    """Whether anchors are hot or not: the bytes that brute force removes, in ranges that don't touch."""
    rng = random.Random(11)
    passages = [prose(500, k)[:-1].decode() for k in range(5)]
    texts = [None, "", "a" * 250]
    for _ in range(60):
        cuts = [(p, rng.randrange(250)) for p in rng.choices(passages, k=rng.randrange(1, 4))]
        texts.append("é".join(p[a : a + rng.randrange(60, 250)] for p, a in cuts) if rng.random() < 0.8 else texts[-1])
    seen, want = set(), {}
    for i, x in enumerate(texts):
        raw, hit = (x or "").encode(), set()
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                hit.update(range(k, k + 100))
            seen.add(raw[k : k + 100])
        want[i] = hit
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot, rows in ((repeats.HOT, repeats.SLICE_ROWS), (1, 50)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "SLICE_ROWS", rows)
        got = {r.doc_id: [(x.a, x.b + 99) for x in r.ranges] for r in induced.repeated_bytes(docs).collect()}
        assert {i: {k for a, b in r for k in range(a, b)} for i, r in got.items()} == {i: hit for i, hit in want.items() if hit}
        assert all(x[1] < y[0] for r in got.values() for x, y in zip(r, r[1:], strict=False))


def test_score_against_plain_python(spark):
    """Every term looked for at every place."""
    rng = random.Random(8)
    texts = ["you are an id1ot and a l0ser", "idiot proof and idiot s guide, idiots", "", None, "the stupid simple thing is stupid", "scumbag scum", "clean words only", "sore loser pond scum, a loser" + " word" * 300]
    texts += [" ".join(rng.choice(["idiot", "word", "vermin", "trash", "can", "bin", "filthy", "sch", "the"]) for _ in range(60)) for _ in range(30)]
    model = toxicity.Model(tuple(sorted({**{f" {k} ": w for k, w in toxicity.SEED.items()}, " filth": 1.7, " sch": 0.5, " idio": 2.0}.items())), curve=(-3.0, 1.1, 0.2))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, x in enumerate(texts):
        folded = toxicity.fold(x or "")
        spared = [(k, k + len(p) + 2) for p in model.exceptions for k in range(len(folded)) if folded.startswith(f" {p} ", k)]
        total = 0.0
        for k in range(len(folded)):
            own = [(w, t) for t, w in model.weights if folded.startswith(t, k)]
            if own:
                w, t = max(own)
                if not any(a <= k and k + len(t) <= b for a, b in spared):
                    total += w
        z = model.curve[0] + model.curve[1] * math.log1p(total) + model.curve[2] * 100 * total / (len(folded.split()) + 50)
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9, x


def test_empty_tables_null_ids_and_repeated_rows(spark):
    """Operators and stages that work row by row give a row each; packing gives pieces for each."""
    import public_tokenizers

    import corpus_pipeline
    from mendframe.llm import bpe, embeddings, packing, quality

    words = public_tokenizers.path("word_bpe_49k.json")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(None, "one text " * 60), (4, "one text " * 60), (4, "one text " * 60), (5, None), (6, "x" * 200_000)]
    docs = spark.createDataFrame([(i, x, "en", "web", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.where("false")
    for fn in (lambda d: packing.pack(d, words), lambda d: bpe.round_trip(d, ranks, public_tokenizers.PATTERN), quality.judge, lambda d: toxicity.score(d, toxicity.Model(()))):
        assert fn(empty).count() == 0
        got = fn(docs).select("doc_id").distinct().collect()
        assert {r.doc_id for r in got} == {None, 4, 5, 6}
    assert packing.pack(docs, words).where("piece = 0").count() == 5
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, docs, "").count() >= 0, name
