"""The ten operators against brute force on small fixtures: nulls, empty and long texts, repeated rows, ties, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from mendframe.llm import bpe, embeddings, fmindex, induced, line_dedup, minhash, packing, quality, registry, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, h1 long, links string, n long"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
words = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x or "")


def frame(spark, texts):
    """Extra columns have names that the operators use within."""
    return spark.createDataFrame([(i, x, "en", "web" if i % 2 else "news", 7, "x", 3) for i, x in enumerate(texts)], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(5, 160)) for _ in range(25)]
    passage = prose(rng, 70)
    long = prose(rng, 3000, 5000)
    shared = "This LINE stands everywhere"
    out = [*base, base[0], base[0], base[1] + " extra", f"{base[2]} {passage} {base[3]}", f"{passage} {base[4]}", f"x {passage} {passage}", None, "", " \n\t ", "one", long, "ab" * 150, "a" * 260, "é" * 130, "\0\1" * 90, "\0\1" * 90]
    return [*out, *(f"{shared} \n{prose(rng, 8)}\n\n  this line stands everywhere" for _ in range(11))]


def test_suffix_order_against_sorting():
    rng = random.Random(1)
    for trial in range(60):
        n, k = rng.randrange(1, 120), rng.choice([1, 2, 3, 26])
        t = [rng.randrange(1, k + 1) for _ in range(n)] + [0]
        order, common = induced.suffix_order(t, most=rng.choice([4, 1 << 18]))
        sa = sorted(range(len(t)), key=lambda i: t[i:])
        assert list(order) == sa, trial
        for x, y, v in zip(sa, sa[1:], list(common)[1:], strict=False):
            m = 0
            while t[x + m] == t[y + m]:
                m += 1
            assert v == m


def test_external_sort_and_queue_spill():
    rng = random.Random(2)
    items = [(rng.randrange(1000), i) for i in range(5000)]
    assert list(induced.external_sort(iter(items), 64)) == sorted(items)
    q = induced.DiskQueue(32)
    for x in items:
        q.push(x)
    assert [q.pop() for _ in items] == sorted(items) and q.peek() is None


def brute_bytes(texts, window=100):
    seen, hits = set(), []
    for x in texts:
        raw = (x or "").encode()
        hit = set()
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                hit.update(range(i, i + window))
            seen.add(w)
        hits.append((raw, hit))
    return hits


def test_op1_bytes(spark, texts):
    got = {r.doc_id: r for r in induced.suffix_digest(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (raw, hit) in enumerate(brute_bytes(texts)):
        r = got[i]
        spans = sum(k - 1 not in hit for k in hit)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(hit), spans, sha(bytes(c for k, c in enumerate(raw) if k not in hit))), i


def test_op5_words(spark, texts):
    got = {r.doc_id: r for r in fmindex.substring_digest(frame(spark, texts)).collect()}
    first = {}
    for i, x in enumerate(texts):
        w = words(x)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, x in enumerate(texts):
        w, gone = words(x), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), sha(" ".join(v for k, v in enumerate(w) if k not in gone))), i


def test_fm_index_and_wavelet_tree():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, 200)
    tree = fmindex.WaveletTree(v)
    at, s = rng.integers(0, 201, 50), rng.integers(0, 9, 50)
    assert tree.rank(s, at).tolist() == [int((v[:a] == x).sum()) for a, x in zip(at, s, strict=True)]
    assert fmindex.suffix_array(np.r_[v + 1, 0]).tolist() == sorted(range(201), key=lambda i: [*(v[i:] + 1), 0])


def test_op2_secrets(spark):
    items = ["password = hunter22hunter", "api_key: 'short'", "AKIA" + "B" * 12, "AKIA" + "B" * 11, "f" * 32, "f" * 31, "token=abcdefgh password:x", None, "", "é token = 12345678", "Zq8vK2xW9pL4tR7mN1cB6yH3", "configuration_manager_for_remote_clients"]
    got = {r.doc_id: r for r in secrets.scan_digest(frame(spark, items)).collect()}
    for i, x in enumerate(items):
        x = x or ""
        spans = []
        for k, (p, ok) in enumerate([(secrets._ASSIGN, lambda m: len(m[2]) >= 8), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]):
            spans += [(m.start(), k, m.end()) for m in p.finditer(x) if ok(m)]
        r = got[i]
        assert r.base_sha256 == sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))), i
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
    assert got[10].spans == "model:0:24" and got[11].spans == ""
    clean = {r.doc_id: r for r in secrets.redact(frame(spark, items)).collect()}
    assert clean[0].text == "<assign>" and clean[7].text is None and clean[0].links == "x"


def test_secret_model_on_held_out_samples():
    held = secrets.labelled_samples(500, seed=99)
    hit = [(secrets.llr(t) >= secrets.MIN_TOTAL and secrets.llr(t) >= secrets.MIN_PER_CHAR * len(t), y) for t, y in held]
    assert sum(h for h, y in hit if y) / 500 > 0.8 and sum(h for h, y in hit if not y) / 500 < 0.03


def test_op3_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark, texts), path, size=128).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, x in enumerate(texts):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 128)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
        total += at
    assert len(by_seq) <= 1.1 * -(-total // 128) + 1
    assert packing.pack(frame(spark, []), path).count() == 0


def test_best_fit_is_longest_first():
    lengths = np.array([5, 3, 3, 7, 2])
    bins, offs, fill = packing.best_fit(lengths, 10)
    assert fill.max() <= 10 and len(fill) == 2 and sorted(fill.tolist()) == [10, 10]
    bins, offs, done = packing.close(np.full(9000, 1100), 2048, False)
    assert (~done).sum() <= packing.CARRY


def test_packing_plan_is_best_fit():
    rng = np.random.default_rng(6)
    for size, most, n in ((10, 10, 40), (64, 64, 500), (64, 9, 500), (2048, 2048, 3000), (2048, 700, 3000), (5, 5, 0)):
        lengths = rng.integers(1, most + 1, n)
        rows, total = packing.plan(np.bincount(lengths, minlength=size + 1), size)
        _, _, fill = packing.best_fit(lengths, size)
        spots, at = [[] for _ in range(total)], defaultdict(int)
        for x in lengths.tolist():
            i = at[x]
            at[x] += 1
            _, first, b, each, off = max(r for r in rows.tolist() if r[0] == x and r[1] <= i)
            spots[b + (i - first) // each].append((off + (i - first) % each * x, x))
        for own in spots:
            own.sort()
            assert own and all(p + x == q for (p, x), (q, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
        assert sorted(sum(x for _, x in own) for own in spots) == sorted(fill.tolist())


def test_op3_pieces_of_all_tasks_meet(spark):
    """More long pieces in one task than CARRY, each alone in its sequence, and the short pieces that fit them in another."""
    n = packing.CARRY + 900
    docs = spark.createDataFrame([(i, "a " * (4 if i < n else 2)) for i in range(2 * n)], "doc_id long, text string").repartitionByRange(2, "doc_id")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=8).collect()
    assert len(rows) == 2 * n and {r.length for r in rows} == {3, 5}
    assert len({r.sequence_id for r in rows}) == n


def test_op4_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    near = base[:20] + 0.05 * rng.standard_normal((20, 16))
    rows = [[float(v) for v in x] for x in (*base, *near, base[0], base[0] * 2)] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    v = [None if x is None or len(x) != 16 or any(y is None or y != y for y in x) or not any(x) else np.array(x, np.float32).astype(float) for x in rows]
    links = {i: {j for j in range(len(v)) if j != i and v[i] is not None and v[j] is not None and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= 0.95} for i in range(len(v))}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), min(seen), min(seen) == i), i
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_large_buckets_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    df = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(60)], "vec_id long, embedding array<float>")
    assert {(r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {(59, 0)}


def test_op6_round_trip(spark):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    items = ["Hello, world! naïve 日本語 🙂 \x00\x7f", "  spaces\n\n tabs\t1234567", "aaaa" * 500, None, "", "é", "퟿ x"]
    df = frame(spark, items)
    got = {r.doc_id: r for r in bpe.round_trip(df, path, public_tokenizers.PATTERN).collect()}
    for i, x in enumerate(items):
        ids = enc.encode_ordinary(x or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(x or "")), i
    e = bpe.encode(df, path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode(e, path, public_tokenizers.PATTERN).collect()} == {i: x or "" for i, x in enumerate(items)}
    r = e.where("doc_id = 0").first()
    assert r.starts[0] == 0 and r.ends[-1] == len(items[0]) and all(a < b for a, b in zip(r.starts, r.ends, strict=True))


def shingle_set(x):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def brute_components(texts):
    sets = [shingle_set(x) for x in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return sets, [root(i) for i in range(len(texts))]


def test_op7_near_duplicates(spark, texts):
    rng = random.Random(8)
    seed = prose(rng, 90).split()
    near = [" ".join(w if rng.random() > 0.04 else "zz" for w in seed).upper() for _ in range(30)]
    every = [*texts, *near]
    sets, comp = brute_components(every)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, every)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in range(len(every))}
    assert minhash.keep_first(frame(spark, every)).count() == sum(c == i for i, c in enumerate(comp))


def test_nodes_that_stay_large(spark, monkeypatch):
    rng = random.Random(9)
    seed = prose(rng, 200).split()
    near = [" ".join([*seed, f"v{i}"]) for i in range(120)] + [prose(rng, 50) for _ in range(20)]
    monkeypatch.setattr(minhash, "NODE", 16)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "DEPTH", 1)
    _, comp = brute_components(near)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, near)).collect()} == dict(enumerate(comp))


def test_op8_lines(spark, texts):
    keys = lambda x: [line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({65 + k: 97 + k for k in range(26)}) for line in (x or "").split("\n")]
    found = defaultdict(set)
    for i, x in enumerate(texts):
        for k in keys(x):
            found[k].add(i)
    got = {r.doc_id: r for r in line_dedup.line_digest(frame(spark, texts)).collect()}
    clean = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        gone = [bool(k) and len(found[k]) >= 10 for k in keys(x)]
        kept = "\n".join(line for line, g in zip((x or "").split("\n"), gone, strict=True) if not g)
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (len(gone), sum(gone), sha(kept)), i
        assert (clean[i].text or "") == kept and clean[i].links == "x"
    assert any(r.n_dropped for r in got.values())
    first = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, texts), keep_first=True).collect()}
    assert sum("stands everywhere" in (x or "").lower() for x in first.values()) == 1


def test_op9_quality(spark, texts):
    every = [*texts, "x y z " * 40, "# * $ " * 30]
    got = {r.doc_id: r for r in quality.judge(frame(spark, every)).collect()}
    for i, x in enumerate(every):
        w = words(x)
        spots = defaultdict(list)
        for k in range(len(w) - 2):
            spots[tuple(w[k : k + 3])].append(k)
        rep = {k + d for v in spots.values() if len(v) > 1 for k in v for d in range(3)}
        lines = [line for line in (x or "").split("\n") if words(line)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((x or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and (r.kept is False or not r.base_failed)
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(11)
    items = [". ".join(prose(rng, rng.randrange(8, 15)) for _ in range(rng.randrange(6, 12))) for _ in range(150)] + [" ".join(f"{rng.randrange(9)}#$%|<>*&" for _ in range(90))]
    df = spark.createDataFrame([(i, x, None, "s") for i, x in enumerate(items)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert 150 not in kept and len(kept) >= 148


def test_quality_judges_small_groups(spark):
    rng = random.Random(14)
    clean = lambda: ". ".join(prose(rng, rng.randrange(8, 15)) for _ in range(rng.randrange(6, 12)))
    junk = lambda: " ".join(f"{rng.randrange(9)}#$%|<>*&" for _ in range(90))
    rows = [(clean(), "en", "web") for _ in range(150)] + [(clean(), "en", f"s{i % 9}") for i in range(45)] + [(clean(), "xx", None) for _ in range(20)]
    rows += [(junk(), "en", "s3"), (junk(), "en", "alone"), (junk(), "xx", None), (junk(), None, "rare"), (junk(), "en", "web")]
    for part in (rows, rows[150:]):  # the second has no group and no language of MIN_ROWS: all are judged by all
        df = spark.createDataFrame([(i, *x) for i, x in enumerate(part)], "doc_id long, text string, lang string, source string")
        got = {r.doc_id: r for r in quality.judge(df).collect()}
        assert len(got) == len(part) and all(r.base_failed or r.distance is not None for r in got.values())
        assert {i for i, r in got.items() if not r.kept and not r.base_failed} == {i for i, x in enumerate(part) if "#" in x[0]}


def test_op10_toxicity(spark):
    assert toxicity.fold("Y0u are an id1ot").split() == ["you", "are", "an", "idiot"] and "idiot" in toxicity.fold("іdіоt")
    rng = random.Random(12)
    rows = [(i, prose(rng, 40) + (" you zzblork" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(400)]
    docs = frame(spark, [x for _, x, _ in rows] + [None, "", "id10t pr00f", "you are an 1diot"])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert got[400].score == got[401].score and not got[400].predicted
    none = toxicity.train(docs, labels.where("false"))
    fixed = {r.doc_id: r.predicted for r in toxicity.score(docs, none).collect()}
    assert fixed[403] == 1 and fixed[402] == 0


def test_empty_tables(spark):
    empty = frame(spark, [])
    for fn in (induced.suffix_digest, fmindex.substring_digest, minhash.near_duplicates, line_dedup.line_digest, secrets.scan_digest):
        assert fn(empty).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rng = random.Random(13)
    x = prose(rng, 80)
    df = spark.createDataFrame([(None, x), (1, x), (1, x), (2, prose(rng, 60))], "doc_id long, text string")
    for fn in (induced.suffix_digest, fmindex.substring_digest, minhash.near_duplicates, line_dedup.line_digest, secrets.scan_digest):
        assert fn(df).count() == 4


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
