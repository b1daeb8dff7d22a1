"""The pipeline's stages on a small corpus: what goes, what stays, and in which order."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from mendframe.llm import minhash
from test_groups import plain_spans
from test_quality import plain_verdicts
from tokenizers import Tokenizer


def corpus(spark):
    rng = random.Random(21)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(900)}" for _ in range(12)) for _ in range(n))
    items = [text(rng.randrange(6, 12)) + "\nAll rights reserved" for _ in range(30)]
    items += [items[3], items[4] + " more", "too short", None, "", text(8) + "\npassword = hunter22hunter"]
    return spark.createDataFrame([(i, x, "en", "web", len(x or "")) for i, x in enumerate(items)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, "")
    assert {32, 33, 34}.isdisjoint(ids := {r.doc_id for r in good.collect()}) and len(ids) == 33
    lines = stages["line_dedup"](spark, good, "")
    assert not [r for r in lines.collect() if r.text.endswith("reserved") or r.n_chars != len(r.text)] and lines.columns == docs.columns
    once = stages["minhash_near_dedup"](spark, lines, "")
    assert {r.doc_id for r in once.collect()} == ids - {30, 31} and once.columns == docs.columns
    clean = stages["secret_scans"](spark, once, "")
    assert clean.where("doc_id = 35").first().text.endswith("<assign>") and clean.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids - {30, 31}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_near_duplicates_take_five_words(spark):
    """Pairs that differ in k spread words of 100: k = 4 is near by two-word shingles only, k = 1 by five-word ones too."""
    rng = random.Random(22)
    items = []
    for k in (4, 1):
        base = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        items += [" ".join(base), " ".join(f"changed{i}" if i % 20 == 10 and i < 20 * k else w for i, w in enumerate(base))]
    docs = spark.createDataFrame([(i, x, "en", "web", len(x)) for i, x in enumerate(items)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in minhash.keep_first(docs, width=2).collect()) == [0, 2]


# --- plain versions of the five stages, each over (doc_id, text, lang, source) -------


def plain_good(docs):
    kept = plain_verdicts([d[1:] for d in docs])
    return [d for i, d in enumerate(docs) if kept[i]]


def plain_lines(docs, at_least=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    found = Counter(k for d in docs for k in {key(x) for x in (d[1] or "").split("\n")} if k)
    return [(d[0], "\n".join(x for x in (d[1] or "").split("\n") if found[key(x)] < at_least), *d[2:]) for d in docs]


def plain_once(docs, width=5, percent=80):
    sets = []
    for d in docs:
        words = d[1].lower().split()  # the corpus is ASCII
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    first = list(range(len(docs)))
    changed = True
    near = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            least = min(first[i], first[j])
            changed |= first[i] != least or first[j] != least
            first[i] = first[j] = least
    return [d for i, d in enumerate(docs) if first[i] == i]


def plain_clean(docs):
    scan, out = plain_spans(), []
    for d in docs:
        text, at = "", 0
        for a, kind, b in scan(d[1]):
            if a >= at:
                text += d[1][at:a] + f"<{kind}>"
            at = max(at, b)
        out.append((d[0], text + d[1][at:], *d[2:]))
    return out


def plain_pieces(docs, size=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d in docs:
        ids = [*tok.encode(d[1], add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            yield d[0], piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())


def plain_best_fit(lengths, size=2048):
    """Sequences that best fit makes, the longest first."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(size - n)
    return len(left)


def large_corpus():
    """Groups above and below the least size, junk, short texts, lines in 9 and in 12 documents, near and exact copies, secrets of each kind, long texts."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    clean = lambda n=0: ".\n".join(" ".join(word() for _ in range(rng.randrange(8, 15))) for _ in range(n or rng.randrange(7, 12)))
    random_key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    junk = lambda: " ".join(f"{rng.randrange(99)}#$%|<>*&" for _ in range(90))
    items = [(clean(), "en", "web") for _ in range(150)] + [(clean(), "de", f"s{i % 5}") for i in range(40)] + [(clean(500), "en", "books") for _ in range(2)]
    items += [(clean() + "\n  All Rights reserved ", "en", "web") for _ in range(12)] + [(clean() + "\nnine times", "en", "web") for _ in range(9)]
    items += [(clean() + f"\n{s} and {word()}", "en", "s1") for s in ("password = hunter22hunter", "AKIA" + "B7" * 9, "0f" * 20, random_key(), "token: " + "0f" * 20)]
    for i in (0, 3, 155, 190):
        text, lang, source = items[i]
        items += [(text, lang, source), (f"{text} {word()}", lang, source), (text.replace(" ", " x ", 12), lang, source)]
    items += [(junk(), "en", "web"), (junk(), "de", "s1"), (None, "en", "web"), ("", None, None), ("too short", "en", "web"), ("again and again " * 40, "en", "web")]
    rng.shuffle(items)
    return [(i, *x) for i, x in enumerate(items)]


def test_whole_pipeline_against_plain_python(spark, tmp_path):
    docs = large_corpus()
    frame = spark.createDataFrame([(i, x, lang, source, len(x or "")) for i, x, lang, source in docs], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    steps = [("quality_rules", plain_good), ("line_dedup", plain_lines), ("minhash_near_dedup", plain_once), ("secret_scans", plain_clean)]
    assert [*stages] == [*(name for name, _ in steps), "best_fit_packing"]
    sizes = [len(docs)]
    for name, plain in steps:
        before, docs = docs, plain(docs)
        rows = [(i, x, lang, source, len(x or "")) for i, x, lang, source in before]
        got = stages[name](spark, spark.createDataFrame(rows, frame.schema).repartition(5), "")
        assert got.columns == frame.columns
        assert sorted(tuple(r) for r in got.collect()) == sorted((*d, len(d[1])) for d in docs), name
        assert docs != before
        sizes.append(len(docs))
    assert sizes[0] - sizes[1] >= 5 and sizes[1] == sizes[2] and sizes[2] - sizes[3] >= 8 and sizes[3] == sizes[4]
    assert {k for _, x, *_ in docs for k in ("assign", "access", "hex", "model") if f"<{k}>" in x} == {"assign", "access", "hex", "model"}
    frame.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = sorted(plain_pieces(docs))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces and any(p[1] for p in pieces)
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= plain_best_fit([p[3] for p in pieces]) + 1
