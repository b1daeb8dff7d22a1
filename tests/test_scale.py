"""What keeps cost in proportion to the input: rows dealt to all cores, work done once, patterns that read a text once."""

import collections
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mendframe.functions import cells as C
from mendframe.functions import texts as T
from mendframe.functions import values as V
from mendframe.operators import learning, mining, provenance, tabular
from mendframe.plans import queries
from mendframe.plans import tables as D
from mendframe.plans.solve import solve_rows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def apply(spark, items, **fns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string")
    return spark.createDataFrame(df.select("i", *(f(F.col("v")).alias(k) for k, f in fns.items())).collect()).orderBy("i").drop("i").collect()


def test_tables_of_one_row_group_go_to_all_cores(spark):
    assert D.table(spark, SF, "customer").rdd.getNumPartitions() == 1
    for df in (D.vendor(spark, SF), D.ragged_parts(spark, SF)):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_cells_with_unicode_space_and_without(spark):
    rng = random.Random(3)
    ends = ["", " ", "\t", "\x1c", "\x85", "\xa0", " ", " ", " ", "　", "​", "\n", "\r\n"]
    cores = ["", "1,234", "12", "-1.5e3", "12,34", "N/A", "\\N", "--", "?", "#NULL!", "NULL()", "2-Sep", "2-sep", "31-Jan", "13-Foo", "x", "1 234", "\xe2\x80\x99", "caf\xc3\xa9", "$1,000", "(1,000)", "5 %"]
    items = [rng.choice(ends) + c + rng.choice(ends) for c in cores for _ in range(12)] + [e + e for e in ends]
    strip = lambda c: F.btrim(c, F.lit(V.SPACE))
    pairs = {
        "blank": (C.is_blank, lambda c: strip(c) == ""),
        "plain": (C.is_plain_number, lambda c: strip(c).rlike(V.PLAIN_NUMBER)),
        "formatted": (C.is_formatted_number, lambda c: c.rlike(V.FORMATTED_NUMBER)),
        "excel": (C.is_excel_date, lambda c: F.length(strip(c)).between(5, 6) & strip(c).rlike(V.EXCEL_DATE)),
        "number": (C.fix_numeric_text, lambda c: F.when(strip(c).contains(",") & strip(c).rlike(V.PLAIN_NUMBER), F.replace(strip(c), F.lit(","), F.lit("")))),
        "null": (C.fix_null_string, lambda c: F.when(strip(c).isin(*V.NULL_LIKE), F.lit(""))),
        "gene": (C.restore_gene, lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in V.GENES.items() for x in kv)), strip(c))),
    }
    new = apply(spark, items, **{k: f for k, (f, _) in pairs.items()}, some=lambda c: F.coalesce(C.restore_gene(C.repaired(c)), C.repaired(c)) != c, may=C.may_change)
    old = apply(spark, items, **{k: f for k, (_, f) in pairs.items()})
    for x, a, b in zip(items, new, old, strict=True):
        assert [a[k] for k in pairs] == [b[k] for k in pairs], repr(x)
        assert a.may or not a.some, repr(x)


@pytest.mark.parametrize("part", ["clean", "quarantine"])
def test_solve_repairs_once(spark, part):
    rows = spark.range(60).select(F.struct(F.lit(0).alias("block"), F.col("id").alias("line")).alias("row_id"), F.when(F.col("id") % 20 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("N/A"), F.concat(F.repeat(F.lit("x"), 47), F.lpad(F.col("id").cast("string"), 3, "0")))).alias("fields"))
    s = solve_rows(rows, ["a", "b"])
    assert s.limits == {"b": 50} and s.counts().first()[:2] == (0, 60)
    assert {r["mode"]: r.affected for r in s.actions().collect()} == {"null_as_string": 57, "ragged_rows": 3, "truncation": 57}
    assert plan(getattr(s, part)).count("try_validate_utf8") + plan(getattr(s, part)).count("tryValidateUtf8") <= 3  # as often as the one repair names it
    assert plan(s.actions()).count("Union") == 0


def test_tokens_with_digits_are_counted_in_one_reading(spark):
    rng = random.Random(5)
    alphabet = "ab1٣ß­\x00\x07\x85\xa0  　​\x1c \n\t(-'é\U0001d7d8𐐀"
    items = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * 300_000]
    got = apply(spark, items, tokens=T.token_count, digits=lambda c: F.regexp_count(c, F.lit(T.DIGIT_TOKEN)), bad=lambda c: F.regexp_count(c, F.lit(V.UNDECODED_FAST)), old=lambda c: F.regexp_count(c, F.lit(V.UNDECODED)))
    for x, r in zip(items, got, strict=True):
        tokens = x.translate({ord(s): " " for s in V.SPACE}).split(" ")
        assert r.tokens == sum(map(bool, tokens)) and r.digits == sum(any(unicodedata.category(c) == "Nd" for c in t) for t in tokens) and r.bad == r.old, repr(x)
    # a token without a digit was read again from each of its letters
    assert not re.search(r"\*\\p\{Nd\}", T.DIGIT_TOKEN) and T.DIGIT_TOKEN.endswith("*+")


def test_notes_go_to_files_of_bounded_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(provenance, "ROWS_PER_FILE", 20)
    own = spark.range(150).coalesce(1).selectExpr("id AS row_key", "'N/A' AS status", "concat('line', chr(10), id) AS other")
    ann = provenance.annotate(own, tabular.audit_columns(own, ["status", "other"], with_samples=False), "row_key")
    for path, n in zip(provenance.write_csv(ann, f"{tmp_path}/t"), (150, 150), strict=True):
        back = spark.read.option("header", True).option("multiLine", True).csv(path)
        assert back.count() == n and len(back.inputFiles()) == 8


def test_thresholds_are_learnt_from_one_reading(spark, tmp_path):
    src = str(tmp_path / "labels")
    spark.range(200).selectExpr("if(id % 2 = 0, 'a', 'z') AS feature", "(id % 40) / 10 AS value", "id % 40 > 30 AS bad").write.parquet(src)
    d = {"a": 2.0, "z": 1.0}
    own = learning.learned_thresholds(spark.read.parquet(src), d, {"a": learning.ABOVE, "z": learning.BELOW})
    rows = {r.feature: r for r in own.collect()}
    assert rows["a"].adopted and rows["a"].threshold == 3.2 and rows["a"].after == 1.0 and rows["z"].threshold == 3.9 and rows["z"].after == 0.5
    # default 2.0: of 75 good ones 25 are flagged; below 1.0 of 25 bad ones none is, and 35 of 75 good ones aren't spared
    assert rows["a"].before == pytest.approx((1 + (80 - 30) / 80) / 2) and rows["z"].before == pytest.approx((0 + (75 - 25) / 75) / 2)
    final = own._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]  # the plan that ran
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") == 2


def test_shapes_classes_and_markers_as_by_tokens(spark):
    rng = random.Random(7)
    words = ["ONE", "TWO", "THREE", "ΑΒΓΔ", "ÄÖÜ", "STRASSE", "STRAßE", "ÿÿÿ", "Ÿab", "AB", "ABC1", "123", "---", "x", "é", "maма", "αbc", "βγδ", "жжжж", "word", "aaaa", "..", ">>>", "(cid:7)", "_", "½", "\U0001d400\U0001d401\U0001d402", "­", "\x07"]
    items = [rng.choice(["", " "]) + rng.choice([" ", " ", "\n", "\x85"]).join(rng.choice(words[: rng.choice([8, 29])]) for _ in range(rng.randrange(12))) + rng.choice(["", "\n"]) for _ in range(400)]
    space = f"[{V.SPACE_CLASS}]"
    token = lambda c: F.regexp_extract_all(c, F.lit(f"[^{V.SPACE_CLASS}]+"), F.lit(0))
    caps = lambda c: F.array_join(F.transform(token(c), lambda t: F.when((t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 2), "C").otherwise(".")), "").contains("CCCC")
    mixed = lambda c: F.exists(token(c), lambda t: sum((t.rlike(rf"[\p{{{s}}}&&\p{{L}}]").cast("int") for s in ("IsLatin", "IsCyrillic", "IsGreek")), F.lit(0)) > 1)
    single = lambda c: F.exists(token(c), lambda t: t.rlike(r"^\p{L}$"))
    runs = lambda c: F.regexp_extract_all(c, F.lit(rf"[^\p{{L}}\p{{N}}_{V.SPACE_CLASS}]{{2,6}}"), F.lit(0))
    got = apply(spark, items, shapes=T.token_shapes, caps=caps, mixed=mixed, single=single, classes=T.char_classes, markers=T.markers, runs=runs, repeat=lambda c: c.rlike(rf"((?!{space}).)\1{{3,}}"))
    for x, r in zip(items, got, strict=True):
        assert [s in r.shapes for s in ("ALLCAPS_RUN", "MIXED_SCRIPT", "ISOLATED_LETTER", "REPEATED_CHAR")] == [r.caps, r.mixed, r.single, r.repeat], repr(x)
        n = collections.Counter(unicodedata.category(c) for c in x)
        assert r.classes == pytest.approx({k: v * 1000 / len(x) for k, v in n.items()}), repr(x)
        assert set(r.runs) <= set(r.markers), repr(x)
    assert sum(r.caps for r in got) > 20 and sum(r.mixed for r in got) > 20


def test_rules_are_mined_in_one_reading(spark, tmp_path):
    src = str(tmp_path / "docs")
    spark.range(100).selectExpr("if(id % 4 = 0, concat('some text ', id, ' >>> ~~'), concat('other text ', id)) AS text", "id % 4 = 0 AS rejected").write.parquet(src)
    docs = spark.read.parquet(src)
    own = mining.propose_rules(docs.where("rejected"), docs.where("not rejected"))
    assert {(r.kind, r.signature): r.support for r in own.collect()} == {("marker_string", ">>>"): 25, ("marker_string", "~~"): 25, ("character_class", "Sm"): 25}
    own = mining.proposals(docs)
    assert own.count() == 3 and own.collect()[0].kind in ("marker_string", "character_class")
    assert own._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 1


def test_catalogue_tables_go_to_all_cores(spark, monkeypatch):
    seen = []
    whole = queries.catalog.audit_query
    monkeypatch.setattr(queries.catalog, "audit_query", lambda df, name, **k: seen.append(df.rdd.getNumPartitions()) or whole(df, name, **k))
    own = queries.catalog_audit(spark, SF)
    assert sorted(own.columns) == ["findings", "severity", "table"]
    assert len(seen) == 5 and min(seen) >= spark.sparkContext.defaultParallelism
