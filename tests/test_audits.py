"""Audits fire on damage and stay quiet without it; boundary cases included."""

import random

import pytest
from pyspark.sql import functions as F

from mendframe.functions import values as V
from mendframe.operators import conventions, crossfile, learning, mining, profiles, provenance, repair, tabular, text
from mendframe.operators import model as M

COLUMNS = "row_key long, customer_id string, name string, amount string, joined string, status string"


def table(spark, n=200, **change):
    rows = []
    for i in range(n):
        r = {"customer_id": f"{100000 + i}", "name": f"Person {i}", "amount": str(1000 + i), "joined": f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", "status": "closed" if i % 3 == 0 else "active"}
        r |= {c: fn(i, r[c]) for c, fn in change.items()}
        rows.append((i, *(r[c.split()[0]] for c in COLUMNS.split(", ")[1:])))
    return spark.createDataFrame(rows, COLUMNS)


def modes(audits):
    return {(r.column, f.mode) for r in audits.collect() for f in r.findings}


@pytest.mark.parametrize(
    "change,expected",
    [
        ({}, set()),
        ({"name": lambda i, v: "JosÃ©" if i < 79 else v}, {("name", "mojibake")}),
        ({"amount": lambda i, v: f"1,{i:03d}"}, {("amount", "numeric_as_text")}),
        ({"status": lambda i, v: "N/A" if i < 59 else v}, {("status", "null_as_string")}),
        ({"name": lambda i, v: f"{i:05d}".ljust(255, "x") if i < 39 else v}, {("name", "truncation")}),
        ({"joined": lambda i, v: ("2-Sep" if i % 2 else "1-Mar") if i < 59 else v}, {("joined", "excel_date_corruption")}),
        ({"customer_id": lambda i, v: str(i * 7 + 1)}, {("customer_id", "leading_zero_loss")}),
        ({"customer_id": lambda i, v: str(i * 7)}, set()),
        ({"name": lambda i, v: "one value of exactly fifty characters, many times!"}, set()),
        ({"name": lambda i, v: f"{i:03d}".ljust(50 if i < 29 else 60, "y")}, set()),
    ],
)
def test_tabular(spark, change, expected):
    assert modes(tabular.audit_columns(table(spark, **change), order_by="row_key")) == expected


def test_too_few_rows(spark):
    a = tabular.audit_columns(table(spark, 20, amount=lambda i, v: "1,234", status=lambda i, v: "N/A"), order_by="row_key")
    assert modes(a) == set() and not any(r.judged for r in a.collect())
    assert tabular.audit_columns(table(spark, 0), order_by="row_key").count() == 0


def test_samples_and_confidence(spark):
    a = tabular.audit_columns(table(spark, status=lambda i, v: "N/A" if i < 59 else "NULL" if i < 80 else v), order_by="row_key")
    r = a.where("column = 'status'").first()
    assert list(r.findings[0].samples) == ["N/A", "NULL"] and r.severity == "suspect"
    assert r.confidence == pytest.approx(1 - 0.15 * 3)
    s = M.summarise(a).first()
    assert s.severity == "suspect" and s.artifacts == 5 and s.flagged == ["column status"] and s.modes == {"null_as_string": 1}
    assert "column status" in M.report(a)
    empty = M.summarise(a.where("false")).first()
    assert empty.severity == "clean" and empty.artifacts == 0 and empty.confidence == 1.0


def test_nulls_and_structure(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(40)], "k int, v string")
    assert modes(tabular.audit_columns(df, order_by="k")) == set()
    rows = spark.createDataFrame([(i, ["a", "b"] if i else ["a"]) for i in range(50)], "row_id long, fields array<string>")
    a = {r.subject: r for r in tabular.audit_rows(rows, ["x", "x"]).collect()}
    assert a["table structure"].findings[0].metric == pytest.approx(0.02) and a["table structure"].severity == "corrupt"
    assert a["table header"].findings[0].mode == "duplicate_columns"
    f = tabular.table_features(rows, 2).first()
    assert f.units == 50 and f.ragged == pytest.approx(0.02)


def test_conventions(spark):
    one = table(spark, joined=lambda i, v: "2-Sep" if i == 77 else v)
    r = conventions.audit_conventions(one, order_by="row_key").where("column = 'joined'").first()
    assert r.findings[0].mode == "convention_break" and r.severity == "suspect" and "2-Sep" in r.findings[0].samples[0]
    half = table(spark, joined=lambda i, v: v if i % 2 else f"{i % 28 + 1}/{i % 12 + 1}/2024")
    assert conventions.audit_conventions(half, order_by="row_key").where("size(findings) > 0 and column = 'joined'").count() == 0
    assert "joined" in conventions.describe_conventions(one.drop("row_key"))
    assert not conventions.audit_conventions(table(spark, 30), order_by="row_key").where("judged").count()


SENTENCE = "In 2019 the survey of 412 households found that 37 percent had changed their main supplier within the previous 18 months. "


def docs(spark, items):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "doc string, text string")


def shattered(s, p, seed=1):
    rng = random.Random(seed)
    return " ".join(w if len(w) < 5 or rng.random() > p else " ".join(w[k : k + 3] for k in range(0, len(w), 3)) for w in s.split())


def test_text(spark):
    clean = SENTENCE * 40
    items = [clean, clean.replace("e", "�"), shattered(clean, 0.95), "".join(c if not c.isdigit() else " " for c in clean), "short", "", None, clean + " (cid:87)" * 20]
    rows = {int(r.subject): r for r in text.audit_text(docs(spark, items), "doc").collect()}
    found = {i: {f.mode for f in r.findings} for i, r in rows.items()}
    assert found[0] == set() and "missing_glyph" in found[1] and found[2] == {"shattered_words"} and found[3] == {"numeric_loss"} and found[7] == {"missing_glyph"}
    assert found[4] == found[5] == found[6] == set() and not rows[4].judged and rows[0].judged
    assert rows[7].findings[0].samples[0] == "(cid:87)" and "U+FFFD" in rows[1].findings[0].samples
    assert all(len(s.split()) >= 3 for s in rows[2].findings[0].samples)


def test_pages(spark):
    pages = spark.createDataFrame([("d", i, SENTENCE * 40 if i != 7 else (SENTENCE * 40).replace("a", "\x01")) for i in range(20)], "doc string, page int, text string")
    bad = text.audit_pages(pages, "doc", "page").where("severity = 'corrupt'").collect()
    assert [r.page_no for r in bad] == [7] and bad[0].subject == "page 7"


def test_profiles(spark):
    a = tabular.audit_columns(table(spark, name=lambda i, v: "JosÃ©", amount=lambda i, v: f"1,{i:03d}"), order_by="row_key")
    raw = profiles.apply_profile(a, profiles.RAW).where("column = 'amount'").first()
    up = profiles.apply_profile(a, profiles.PROFILES["analytics"]).where("column = 'amount'").first()
    off = profiles.apply_profile(a, profiles.PROFILES["search_index"]).where("column = 'amount'").first()
    assert raw.severity == "suspect" and up.severity == "corrupt" and not up.usable and off.severity == "clean" and off.suppressed[0].severity == "suspect"
    both = {r.profile: r for r in profiles.compare_profiles(a).collect()}
    assert both["classification"].reported == 0 and both["classification"].blockers == "-" and both["raw"].reported == 2
    own = profiles.custom("mine", numeric_as_text=0)
    assert own.weight_for("numeric_as_text") == 0 and own.weight_for("anything") == 1


def test_repairs(spark):
    df = table(spark, name=lambda i, v: "JosÃ©" if i < 100 else v, amount=lambda i, v: f"1,{i:03d}", status=lambda i, v: "N/A" if i < 50 else v, joined=lambda i, v: "2-Sep" if i < 50 else v, customer_id=lambda i, v: str(i * 7 + 1))
    a = tabular.audit_columns(df, order_by="row_key")
    r = repair.repair_columns(df, a, order_by="row_key")
    got = {(x.column, x["mode"]): x.changed for x in r.repairs.collect()}
    assert got == {("name", "mojibake"): 100, ("amount", "numeric_as_text"): 200, ("status", "null_as_string"): 50}
    assert {(x.column, x["mode"]): x.affected for x in r.refusals.collect()} == {("joined", "excel_date_corruption"): 50, ("customer_id", "leading_zero_loss"): 200}
    assert r.df.where("row_key = 3").first().amount == "1003" and r.df.where("row_key = 3").first().joined == "2-Sep"
    lossy = repair.repair_columns(df, a, allow_lossy=True, order_by="row_key")
    assert lossy.df.where("row_key = 0").first().customer_id == "001"
    assert "can't be undone" in repair.summarise_recoverability([r])
    assert repair.fix_duplicate_headers(["a", "b", "a"]) == ["a__1", "b", "a__2"] and repair.fix_duplicate_headers(["a"]) is None


def test_provenance(spark, tmp_path):
    df = table(spark, amount=lambda i, v: f"1,{i:03d}", joined=lambda i, v: "2-Sep" if i < 50 else v)
    ann = provenance.annotate(df, tabular.audit_columns(df, order_by="row_key"), "row_key")
    n = ann.notes.where("row_key = 5").orderBy("column").collect()
    assert [(x.column, x.original, x.value, x.action) for x in n] == [("amount", "1,005", "1005", "repaired"), ("joined", "2-Sep", "2-Sep", "unrepairable")]
    assert ann.changed_cells().count() == 200 and ann.needs_review().count() == 50
    path, notes = provenance.write_csv(ann, str(tmp_path / "t"), inline=True)
    assert spark.read.option("header", True).csv(path).where("row_key = 5").first()["amount__original"] == "1,005"
    provenance.write_jsonl(ann, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).where("_provenance is not null").count() == 200
    assert provenance.review_sheet(ann, 10).count("\n") == 11


def test_crossfile(spark):
    h = spark.createDataFrame([("a", ["customer_id", "x"]), ("b", ["CustomerID", "x"]), ("c", ["customer_id", "x"])], "source string, header array<string>")
    a = crossfile.audit_headers(h).first()
    assert {f.mode for f in a.findings} == {"inconsistent_headers", "odd_file_out"} and list(a.findings[1].samples) == ["b"]
    assert not crossfile.audit_headers(h.where("source = 'a'")).first().findings


def brute_sweep(values, bad, below):
    best = {}
    vs = sorted(set(values))
    for c in [*vs, *((a + b) / 2 for a, b in zip(vs, vs[1:], strict=False))]:
        hit = [v <= c if below else v >= c for v in values]
        tp, fp = sum(h and b for h, b in zip(hit, bad, strict=True)), sum(h and not b for h, b in zip(hit, bad, strict=True))
        nb = sum(bad)
        best[round(c, 9)] = (tp / nb + (len(bad) - nb - fp) / (len(bad) - nb)) / 2
    return best


@pytest.mark.parametrize("direction", [learning.ABOVE, learning.BELOW])
def test_sweep(spark, direction):
    rng = random.Random(3)
    data = [("f", round(rng.random() + (0.3 if (i % 3 == 0) == (direction == learning.ABOVE) else 0), 2), i % 3 == 0) for i in range(80)]
    df = spark.createDataFrame(data, "feature string, value double, bad boolean")
    got = {round(r.candidate, 9): r.balanced for r in learning.threshold_sweep(df, {"f": direction}).collect()}
    want = brute_sweep([v for _, v, _ in data], [b for _, _, b in data], direction == learning.BELOW)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    learned = learning.learned_thresholds(df, {"f": 9.0 if direction == learning.ABOVE else -9.0}, {"f": direction}).first()
    assert learned.adopted and learned.after == pytest.approx(max(want.values())) and learned.before == 0.5


def test_pipeline_learns(spark, tmp_path):
    log = learning.FeedbackLog(spark, str(tmp_path / "log"))
    seen = []
    pipe = learning.Pipeline(spark, [learning.TextDetector()], log, on_quarantine=lambda df: seen.append(df.count()))
    items = [SENTENCE * 40 + " " * (2 if i % 2 else 0) for i in range(60)]
    pipe.audit(spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "subject string, text string"))
    own = log.all().select("record_id", F.when(F.col("subject").cast("int") % 2 == 1, "discard").otherwise("keep").alias("label"))
    pipe.label_many(own)
    assert pipe.thresholds_for(pipe.detectors[0])["glyph_rate"] < V.THRESHOLDS["glyph_suspect"]
    assert log.labelled().count() == 60 and seen and "glyph_rate" in pipe.learning_report()
    with pytest.raises(KeyError):
        pipe.label("no such record", "keep")
    with pytest.raises(RuntimeError):
        learning.Pipeline(spark, [learning.TextDetector()]).label("x", "keep")


def test_mining(spark):
    rej = docs(spark, [f"text number {i}  >>> end" for i in range(20)])
    keep = docs(spark, [f"text number {i} and more" for i in range(30)])
    rules = mining.propose_rules(rej, keep).collect()
    assert ("character_class", "Co") in {(r.kind, r.signature) for r in rules} and ("marker_string", ">>>") in {(r.kind, r.signature) for r in rules}
    assert all(r.lift == 999.0 and r.precision == 1.0 for r in rules if r.signature in ("Co", ">>>"))
    assert mining.propose_rules(rej.limit(5), keep).count() == 0
    u = spark.createDataFrame([("never", 0, 0, 3), ("useless", 50, 0, 0), ("good", 40, 30, 2)], "name string, fired long, agreed long, missed long")
    assert mining.review_detectors(u) == (["good"], ["never", "useless"])
    assert "candidate rule" in mining.evolution_report(mining.propose_rules(rej, keep), u)
