"""Registered queries over files, sinks, the catalogue and the feedback loop. Files are written from the given tables to the session's shared folder first, then read back by the library."""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import conventions, learning, mining, profiles, provenance, repair, tabular, text
from ..operators import model as M
from ..sources import catalog, detect, readers
from ..workers import new_folder
from . import tables as D
from .queries import _annotated, queries, query
from .scan import scan
from .solve import solve_to_files, solve_to_tables

# --- sources -----------------------------------------------------------------------


def _rows(spark: SparkSession, folder: str, names: list[str], *more: str) -> DataFrame:
    """The rows of all sources in a folder, by the names given, with facts of their sources."""
    out = [s.rows.select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)), F.lit(",".join(s.header)).alias("header"), *(F.lit(getattr(s, m)).alias(m) for m in more)) for s in readers.resolve(spark, folder, on_error="raise")]
    return reduce(DataFrame.unionByName, out)


def _as_lines(df: DataFrame, line: str, name: str) -> str:
    folder = new_folder(df.sparkSession, name)
    df.selectExpr(f"{line} AS value").write.text(folder)
    return folder


@query
def source_delimited(spark, sf_dir):
    """A Latin-1 file with semicolons, some of them within quotes."""
    own, folder = D.table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) AS k", "concat('Zoë; ', c_name) AS name", "c_mktsegment AS segment"), new_folder(spark, "delimited")
    own.coalesce(1).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(folder)
    return _rows(spark, folder, ["k", "name", "segment"], "encoding", "delimiter", "kind")


@query
def source_line_breaks(spark, sf_dir):
    """Quoted line breaks in every fiftieth row, the first of them far into the file."""
    name = "CASE WHEN c_custkey % 50 = 49 AND c_custkey > 300 THEN concat(c_name, '\n', 'second line') ELSE c_name END AS name"
    own, folder = D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", name, "c_mktsegment AS segment").orderBy("k"), new_folder(spark, "breaks")
    own.coalesce(1).write.option("header", True).csv(folder)
    return _rows(spark, folder, ["k", "name", "segment"])


@query
def source_json_lines(spark, sf_dir):
    """Line-delimited JSON with nested cells; every hundredth line is broken and left out."""
    own = D.table(spark, sf_dir, "customer").coalesce(1).sortWithinPartitions("c_custkey")
    folder = _as_lines(own, "CASE WHEN c_custkey % 100 = 99 THEN 'not json' ELSE to_json(named_struct('k', c_custkey, 'tag', named_struct('s', 'Jos\xc3\xa9', 'n', c_nationkey))) END", "jsonl")
    return _rows(spark, folder, ["k", "tag"], "kind")


@query
def source_json_document(spark, sf_dir):
    """One JSON document per part file: an object around a list of records, some without a key."""
    own, folder = D.table(spark, sf_dir, "supplier").coalesce(1), new_folder(spark, "json")
    record = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))).otherwise(F.to_json(F.struct(F.col("s_suppkey").alias("k"))))
    own.agg(F.concat(F.lit('{"items": ['), F.array_join(F.array_sort(F.collect_list(record)), ", "), F.lit("]}")).alias("value")).write.text(folder)
    return _rows(spark, folder, ["k", "name"], "kind")


def workbook_of(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet with its texts in line."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


@query
def source_workbook(spark, sf_dir):
    """The nations in a workbook, from bytes in memory."""
    nations = [[str(v) for v in r] for r in D.table(spark, sf_dir, "nation").collect()]  # 25 rows
    [s] = readers.from_bytes(spark, workbook_of([["k", "name", "region"], *nations]), "nations.xlsx")
    return s.rows.select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(s.header)), F.lit(s.name).alias("source"))


@query
def source_text(spark, sf_dir):
    """A text file in Windows-1252."""
    names = [r.n_name for r in D.table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]  # 25 rows
    [s] = readers.from_bytes(spark, "\n".join(f"“{n}” – a nation" for n in names).encode("cp1252"), "names.txt")
    return s.text.select("text", F.lit(s.encoding).alias("encoding"), F.lit(s.kind).alias("kind"))


HEADS = [
    ("zip", b"PK\x03\x04", "x.xlsx"),
    ("parquet misnamed", b"PAR1\x15", "x.csv"),
    ("orc", b"ORC\x01", "x.orc"),
    ("pdf", b"%PDF-1.7", "x.pdf"),
    ("lines", b'{"a": 1}\n{"a": 2}\n', "x.jsonl"),
    ("document", b'{"a": [\n1]}\n', "x.json"),
    ("tabs", b"a\tb\n1\t2\n3\t4\n5\t6\n", "x.tsv"),
    ("semicolons", b"a;b\n1;2\n3;4\n5;6\n", "x.csv"),
    ("two lines", b"a,b\n1,2\n", "x.csv"),
    ("prose", "Ünter allen, die da sind.\nNichts.\n".encode(), "x.txt"),
]


@query
def sniffed_kinds(spark, sf_dir):
    found = [(name, *detect.sniff_kind(head, hint)) for name, head, hint in HEADS]
    return spark.createDataFrame([(n, k, d or "-", bool(notes)) for n, k, d, notes in found], "name string, kind string, delimiter string, noted boolean")


BYTES = [
    ("ascii", b"plain"),
    ("utf-8", "naïve".encode()),
    ("marked", b"\xef\xbb\xbfx"),
    ("windows", "naïve – “x”".encode("cp1252")),
    ("latin", b"na\xefve \x81"),
    ("utf-16", "abc".encode("utf-16")),
    ("little", "plain text".encode("utf-16-le")),
    ("big", "plain text".encode("utf-16-be")),
    ("twice", "JosÃ©".encode()),
]


@query
def detected_encodings(spark, sf_dir):
    found = [(name, *detect.detect_encoding(raw), detect.looks_like_utf16(raw)) for name, raw in BYTES]
    return spark.createDataFrame(found, "name string, encoding string, damage long, utf16 boolean")


@query
def detected_dialects(spark, sf_dir):
    found = [(name, *detect.detect_dialect(x)) for name, x in (("semicolons", "a;b\n1;2\n3;4\n"), ("pipes", "a|b\n'x'|2\n'y'|4\n"), ("one column", "a\nb\nc\n"), ("commas", 'a,b\n"1,5",2\n"3,0",4\n'))]
    return spark.createDataFrame([(n, d) for n, d, _ in found], "name string, delimiter string")


@query
def resolved_targets(spark, sf_dir):
    """A folder with data, prose, a broken file and files that aren't data, and a target that isn't there."""
    folder = new_folder(spark, "mixed")
    for name, raw in (("a.csv", b"x,y\n1,2\n3,4\n5,6\n"), ("b.json", b'[{"k": 1}]'), ("c.json", b'[{"k": 1'), ("d.txt", b"Some prose. More of it.\nAnd more.\n"), ("e.dat", b"a;b\n1;2\n3;4\n5;6\n"), ("README.md", b"no"), ("run.log", b"no"), ("empty.csv", b"")):
        readers.put(spark, raw, name, folder)
    found = readers.resolve(spark, [folder, f"{folder}/run.log", f"{folder}/missing.csv", f"{folder}/*.dat"])
    return spark.createDataFrame([(s.name, s.kind) for s in found], "name string, kind string")


@query
def inventory_kinds(spark, sf_dir):
    folder = new_folder(spark, "kinds")
    for k in range(3):
        readers.put(spark, b"x,y\n1,2\n3,4\n5,6\n", f"t{k}.csv", folder)
    readers.put(spark, b'[{"k": 1}]', "b.json", folder)
    return spark.createDataFrame([(x.strip(),) for x in readers.inventory(spark, folder).splitlines()], "line string")


@query
def catalog_rows(spark, sf_dir):
    """A bound query over a table of the session's catalogue, as text, without a limit."""
    D.table(spark, sf_dir, "orders").createOrReplaceTempView("mf_orders")
    try:  # the rows' plan is made here; the session keeps no view
        return catalog.read_rows(spark, "SELECT o_orderkey, o_custkey, o_orderpriority FROM mf_orders WHERE o_custkey >= :least", {"least": 40}, limit=None)
    finally:
        spark.catalog.dropTempView("mf_orders")


@query
def catalog_names(spark, sf_dir):
    for t in ("region", "nation"):
        D.table(spark, sf_dir, t).createOrReplaceTempView(f"mf_list_{t}")
    tried = [(t, catalog.quote_ident(t)) for t in catalog.list_tables(spark) if t.startswith("mf_list_")]
    for bad in ("a; DROP TABLE b", "a b", "x`y"):
        try:
            tried.append((bad, catalog.quote_ident(bad)))
        except ValueError:
            tried.append((bad, "refused"))
    for t in ("region", "nation"):
        spark.catalog.dropTempView(f"mf_list_{t}")
    return spark.createDataFrame(tried, "name string, quoted string")


# --- sinks -------------------------------------------------------------------------


def _vendor_file(spark: SparkSession, sf_dir: str) -> str:
    """The vendor table as one file with semicolons; every fiftieth row has a field too many."""
    own, folder = D.vendor(spark, sf_dir), new_folder(spark, "vendor")
    line = F.concat(F.array_join(F.array(*(C.cell(c) for c in D.VENDOR)), ";"), F.when(F.col("row_key") % 50 == 0, ";extra").otherwise(""))
    head = spark.createDataFrame([(";".join(D.VENDOR), -1)], "value string, row_key long")
    own.select(line.alias("value"), "row_key").unionByName(head).coalesce(1).sortWithinPartitions("row_key").select("value").write.text(folder)
    [(path, _, _)] = [x for x in readers._files(spark, folder) if detect.is_data(x[0], x[1])]
    return path


@query
def solved_files(spark, sf_dir):
    """The clean file of a solved one, read back."""
    paths = solve_to_files(spark, _vendor_file(spark, sf_dir), new_folder(spark, "solved"))
    return spark.read.option("header", True).csv(paths["clean"]).select(*(F.coalesce(c, F.lit("")).alias(c) for c in D.VENDOR))


@query
def solved_quarantine_file(spark, sf_dir):
    paths = solve_to_files(spark, _vendor_file(spark, sf_dir), new_folder(spark, "solved"))
    return spark.read.option("header", True).csv(paths["quarantine"]).select("name", F.col("__reason").alias("reason"))


@query
def solved_tables(spark, sf_dir):
    """Rows of the clean and the quarantine table, and how many of the latter bear a time."""
    folder = new_folder(spark, "tables")
    name = f"mf_{folder.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    solve_to_tables(spark, _vendor_file(spark, sf_dir), f"{name}.vendor")
    apart = spark.table(f"{name}.vendor_quarantine").agg(F.count(F.lit(1)).alias("quarantined"), F.count("__quarantined_at").alias("timed"))
    return spark.table(f"{name}.vendor").agg(F.count(F.lit(1)).alias("clean")).join(apart, how="cross")  # one row each


@query
def written_notes(spark, sf_dir):
    """The provenance notes as CSV, read back."""
    _, path = provenance.write_csv(_annotated(spark, sf_dir), f"{new_folder(spark, 'notes')}/vendor")
    own = spark.read.option("header", True).option("multiLine", True).csv(path)
    return own.select(F.col("row_key").cast("long").alias("row_key"), "column", F.coalesce("original", F.lit("")).alias("original"), F.coalesce("value", F.lit("")).alias("value"), "mode", "action")


@query
def written_records(spark, sf_dir):
    """Records with their provenance as JSON lines, read back."""
    path = provenance.write_jsonl(_annotated(spark, sf_dir), f"{new_folder(spark, 'records')}/vendor")
    own = spark.read.schema("row_key long, name string, status string, revenue string, _provenance array<struct<mode:string>>").json(path)
    return own.select("row_key", "name", "status", "revenue", F.coalesce(F.array_join(F.array_sort(F.transform("_provenance", lambda n: n["mode"])), ","), F.lit("")).alias("modes"))


@query
def note_filters(spark, sf_dir):
    ann = _annotated(spark, sf_dir)
    return ann.summary().join(ann.changed_cells().agg(F.count(F.lit(1)).alias("changed")), how="cross").join(ann.needs_review().agg(F.count(F.lit(1)).alias("to_review")), how="cross")  # one row each


# --- audits ------------------------------------------------------------------------


@query
def duplicate_columns(spark, sf_dir):
    own = tabular.duplicate_columns(spark, ["id", "name", "id", "amount", "name", "x"])
    return M.exploded(own, "subject", "units").select("subject", "units", "mode", "severity", F.array_join("samples", ",").alias("samples"))


@query
def row_audit(spark, sf_dir):
    """Structure and columns of rows with a field too many here and there, with the first of these as evidence."""
    own = tabular.audit_rows(D.ragged_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"], "row_id")
    return M.exploded(own, "subject").select("subject", "mode", "severity", F.array_join("samples", "|").alias("samples"))


@query
def described_conventions(spark, sf_dir):
    lines = conventions.describe_conventions(D.table(spark, sf_dir, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit(None).cast("string").alias("empty"))).splitlines()
    return spark.createDataFrame([(x,) for x in lines], "line string")


def _three_files(spark: SparkSession) -> str:
    folder = new_folder(spark, "scanned")
    for name, first in (("a", "customer_id"), ("b", "CustomerID"), ("c", "customer_id")):
        readers.put(spark, (f"{first},joined,amount\n" + "".join(f'{100000 + i},2024-01-{i % 28 + 1:02d},"1,{i:03d}"\n' for i in range(80))).encode(), f"{name}.csv", folder)
    return folder


@query
def scanned_folder(spark, sf_dir):
    own = scan(spark, _three_files(spark)).audits.where(F.size("findings") > 0)
    return M.exploded(own, "source", "subject").select(F.element_at(F.split("source", "/"), -1).alias("source"), "subject", "mode", "severity")


@query
def scanned_for_use(spark, sf_dir):
    """The same for analytics: the worst of each source."""
    own = scan(spark, _three_files(spark), profiles.PROFILES["analytics"]).per_source()
    return own.select(F.element_at(F.split("source", "/"), -1).alias("source"), "severity", "findings")


@query
def custom_profile(spark, sf_dir):
    """A use that cares for mojibake and not at all for words for missing values."""
    a = tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False)
    own = profiles.apply_profile(a, profiles.custom("mine", mojibake=0.5, null_as_string=0.0, truncation=2.0))
    return own.select("column", "severity", F.size("findings").cast("long").alias("reported"), F.size("suppressed").cast("long").alias("suppressed"))


@query
def recoverability(spark, sf_dir):
    """The lines of the summary of what was repaired and what can't be."""
    own = D.vendor(spark, sf_dir)
    done = repair.repair_columns(own, tabular.audit_columns(own, D.VENDOR, with_samples=False), order_by="row_key")
    return spark.createDataFrame([(x,) for x in repair.summarise_recoverability([done]).splitlines()[:-1]], "line string")


@query
def plurals(spark, sf_dir):
    return spark.createDataFrame([(M.plural(n, "row"),) for n in (0, 1, 2, 1234567)], "said string")


# --- the feedback loop -------------------------------------------------------------


def _log(spark: SparkSession, sf_dir: str) -> learning.FeedbackLog:
    """A log of documents with their features: labelled where labels has them, discard for low quality."""
    log = learning.FeedbackLog(spark, new_folder(spark, "log"))
    docs = text.text_features(D.table(spark, sf_dir, "documents").join(D.table(spark, sf_dir, "labels"), "doc_id"))
    names = ("glyph_rate", "fragment_ratio", "digit_rate")
    features = F.create_map(*(x for c in names for x in (F.lit(c), F.round(c, 9))))
    log.append(docs.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").cast("string").alias("subject"), F.lit(learning.TextDetector().name).alias("detector"), features.alias("features"), F.lit("suspect").alias("severity"), F.col("doc_id").cast("double").alias("ts"), "quality"))
    labels = D.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"), F.when(F.col("quality") == 0, "discard").otherwise("keep").alias("label"))
    learning.Pipeline(spark, [learning.TextDetector()], log).label_many(labels)
    return log


@query
def feedback_log(spark, sf_dir):
    """The latest line of each record, after labels came in."""
    return _log(spark, sf_dir).all().select("record_id", "label", "severity", "ts")


@query
def thresholds_in_force(spark, sf_dir):
    """Defaults, with those over them that labels earned."""
    d = learning.TextDetector()
    own = learning.Pipeline(spark, [d], _log(spark, sf_dir)).thresholds_for(d)
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in own.items()], "feature string, threshold double")


@query
def pipeline_audit(spark, sf_dir):
    """Audits by the detectors in the pipeline, without a log: default thresholds."""
    docs = D.table(spark, sf_dir, "documents").withColumn("subject", F.col("doc_id").cast("string"))
    own = learning.Pipeline(spark, [learning.TextDetector()]).audit(docs)
    return own.select("subject", "detector", F.size("findings").cast("long").alias("n_findings"), "severity")


@query
def pipeline_quarantine(spark, sf_dir):
    """The report of unlabelled records that aren't clean: worst and newest first, fifty of them."""
    log = learning.FeedbackLog(spark, new_folder(spark, "log"))
    own = text.audit_text(D.table(spark, sf_dir, "documents"), "doc_id", with_samples=False)
    log.append(own.select(F.col("subject").alias("record_id"), "subject", F.lit("text").alias("detector"), "severity", F.col("subject").cast("double").alias("ts")))
    return learning.Pipeline(spark, [learning.TextDetector()], log).quarantine(50).select("record_id", "severity", "ts")


@query
def proposed_rules(spark, sf_dir):
    """All mined rules with their strength."""
    own = mining.proposals(D.mined_documents(spark, sf_dir))
    return own.select("kind", "signature", "support", F.round("precision", 6).alias("precision"), F.round("lift", 4).alias("lift"), F.round("strength", 3).alias("strength"))


__all__ = ["queries"]  # those of the queries module and these
