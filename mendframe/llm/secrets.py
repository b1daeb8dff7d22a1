"""Secret scans: fixed patterns, and strings that a random-character model explains better than an identifier model.

Two character Markov models (order 1, SMOOTHING added to each count) are trained from labelled samples: random strings of the
usual secret alphabets, and ordinary identifiers and words. Samples are drawn by a rule unless the caller gives labelled strings of
their own. Every token of SHORTEST characters or more is judged, with or without digits or dots: it is a secret when its
log-likelihood ratio per character, and in all, is high enough; the ratio in all keeps short tokens from being secrets by
chance. The patterns' spans are always kept; the models add spans that overlap none of them.

Defined cases: a null or empty text has no spans; rows are scanned one by one, so repeated rows and null ids repeat;
``redact`` keeps all columns and rows. Spans are code points, end exclusive. Long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, texts

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
#: Tokens that the models judge.
SHORTEST, SMOOTHING = 12, 0.02
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{SHORTEST},}}(?![A-Za-z0-9+/_=-])")
#: A sentence's end isn't part of a token.
_TAIL = ".-_/="
MIN_TOTAL, MIN_PER_CHAR = 14.0, 0.9

_WORDS = """account action address agent alert amount array audit author backup balance batch binary block bucket buffer build bytes
cache cancel category channel check client cluster code column command comment commit company config connection contact content
context control count country create current customer data database date debug default delete delivery description detail device
document domain download email enable encoder engine entry error event export factory feature field file filter folder format
frame function gateway global group handler header height history host identifier image import index input instance integer invoice
item job kernel label language layer length level library license line link list listener local location logger login manager market
memory message method metric model module monitor month name network node notes number object offset option order output owner
package page parameter parent parser partition path pattern payment period phone pixel platform player plugin pointer policy port
position prefix price printer process product profile project property protocol provider query queue random range rate reader record
region register release remote render report request reset resource response result return review role root route rule sample scale
schedule schema scope score screen search section select sender sequence series server service session setting shape share signal
size source space stack stage start state status step storage stream string style subject submit summary support switch symbol
system table target task team template test text theme thread time title token topic total trace track transfer type unit update
upload user utility value variable vector version video view volume weight widget width window worker writer year zone""".split()


#: Parts of syllables, for ordinary words of no language in particular.
_ONSETS = "b c d f g h j k l m n p r s t v w z bl br ch cr dr fl fr gl gr kl kr pf pl pr qu sch sh sl sp st str th tr wh zw".split()
_NUCLEI = "a e i o u ai au ea ei eu ie oi ou ue y".split()
_CODAS = ["", "", "", *"b ch ck d ft l ld ll m n nd ng nt p r rt s sch ss st t tz x".split()]


def labelled_samples(n: int = 4000, seed: int = 20240229) -> list[tuple[str, int]]:
    """n strings of each label, 1: random (hex, base64, alphanumeric, letters), 0: ordinary (identifiers, words, paths, versions, dates, dotted numbers)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    alphabets = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    alphabets += [string.ascii_letters, string.ascii_letters + string.digits + "._-"]
    out = [("".join(pick(a) for _ in range(int(rng.integers(SHORTEST, 64)))), 1) for a in (pick(alphabets) for _ in range(n))]
    whole = lambda a, b: str(int(rng.integers(a, b)))
    spoken = lambda: "".join(pick(_ONSETS) + pick(_NUCLEI) + pick(_CODAS) for _ in range(int(rng.integers(3, 7))))
    for k in range(n):
        if k % 4 == 0:  # a word, some with a capital
            out.append((spoken().capitalize() if k % 3 == 0 else spoken(), 0))
            continue
        if k % 16 == 1:
            out.append((pick([".", "-", "/"]).join(whole(0, 256) for _ in range(int(rng.integers(3, 6)))), 0))
            continue
        parts = [pick(_WORDS) for _ in range(int(rng.integers(2, 7)))]
        tail = pick(["", "", str(int(rng.integers(100))), f"v{int(rng.integers(1, 20))}", str(int(rng.integers(1990, 2030))), f"{int(rng.integers(1990, 2030))}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}"])
        joined = pick(["_".join, "-".join, "/".join, "".join, lambda p: p[0] + "".join(x.title() for x in p[1:]), lambda p: "".join(x.title() for x in p), lambda p: "_".join(p).upper()])
        out.append((joined([*parts, tail] if tail else parts), 0))
    return out


@cache
def ratio_table(samples: tuple[tuple[str, int], ...] | None = None) -> np.ndarray:
    """log P(next | this, random) - log P(next | this, ordinary), 128 x 128; byte 0 stands before the first character. samples: labelled ASCII strings, or those drawn by rule."""
    counts = np.full((2, 128, 128), SMOOTHING)
    for text, label in samples or labelled_samples():
        raw = np.frombuffer(b"\0" + text.encode("ascii"), np.uint8)
        np.add.at(counts[label], (raw[:-1], raw[1:]), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


def llr(token: str) -> float:
    """Log-likelihood ratio of an ASCII token; above 0: more likely random."""
    raw = np.frombuffer(b"\0" + token.encode("ascii"), np.uint8)
    return float(ratio_table()[raw[:-1], raw[1:]].sum())


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip(_TAIL)
        end = m.start() + len(token)
        if len(token) >= SHORTEST and not any(a < end and m.start() < b for a, _, b in base) and (v := llr(token)) >= MIN_TOTAL and v >= MIN_PER_CHAR * len(token):
            found.append((m.start(), 3, end))
    return sorted(found)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sums, spans = [[], [], []], [], []
            for x in texts(b):
                found = scan(x)
                for k in range(3):
                    n[k].append(sum(s[1] == k for s in found))
                sums.append(hashlib.sha256(_joined(s for s in found if s[1] < 3).encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.int64()) for v in n), pa.array(sums, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str) -> str:
    out, at = [], 0
    for a, k, b in scan(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret replaced by its kind in angle brackets; overlapping spans become one. Null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = pa.array([None if x is None else redacted(x) for x in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if c == "text" else b.column(c) for c in names], names)

    return map_arrow(docs, run, docs.schema)
