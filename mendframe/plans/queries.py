"""The registered queries over the library's operators. Their DuckDB SQL is in oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import texts as T
from ..functions import values as V
from ..operators import conventions, crossfile, learning, mining, profiles, provenance, repair, tabular, text
from ..operators import model as M
from ..sources import catalog
from ..workers import dealt, new_folder
from . import tables as D
from .solve import solve_rows

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _flat(audits: DataFrame, *keys: str) -> DataFrame:
    """Findings without evidence texts."""
    return M.exploded(audits, *keys).drop("detail", "samples", "location")


# --- texts -------------------------------------------------------------------------


@query
def text_features(spark, sf_dir):
    own = text.text_features(D.table(spark, sf_dir, "documents"))
    return own.select("doc_id", "tokens", "judged", F.round("glyph_rate", 9).alias("glyph_rate"), F.round("fragment_ratio", 9).alias("fragment_ratio"), F.round("digit_rate", 9).alias("digit_rate"))


@query
def text_findings(spark, sf_dir):
    return _flat(text.audit_text(D.table(spark, sf_dir, "documents"), "doc_id", with_samples=False))


@query
def text_audit(spark, sf_dir):
    """The flagship: every document's severity and confidence."""
    a = text.audit_text(D.table(spark, sf_dir, "documents"), "doc_id", with_samples=False)
    return a.select("subject", "units", "judged", F.size("findings").cast("long").alias("n_findings"), "severity", F.round("confidence", 6).alias("confidence"))


@query
def text_severity_summary(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    a = text.audit_text(docs, "doc_id", with_samples=False).join(docs.select(F.col("doc_id").cast("string").alias("subject"), "source"), "subject")
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("judged").alias("n_judged"), F.count_if(F.col("severity") == M.CORRUPT).alias("n_corrupt"), F.count_if(F.col("severity") == M.SUSPECT).alias("n_suspect"))


@query
def text_glyphs(spark, sf_dir):
    own = text.audit_text(D.damaged_documents(spark, sf_dir), "doc_id", with_samples=False)
    return _flat(own).where("mode = 'missing_glyph'")


@query
def shatter_runs(spark, sf_dir):
    """How many runs of fragments a document has, and its longest."""
    runs = F.regexp_extract_all(F.col("mask"), F.lit("F{3,}"), F.lit(0))
    own = D.table(spark, sf_dir, "documents").select("doc_id", T.fragment_mask(C.cell("text")).alias("mask")).withColumn("runs", runs)
    return own.select("doc_id", F.length("mask").cast("long").alias("n_words"), F.size("runs").cast("long").alias("n_runs"), F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0)).cast("long").alias("longest"))


@query
def conversation_audit(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations")
    return _flat(text.audit_pages(turns, "conv_id", "turn", with_samples=False), "doc", "page_no")


@query
def page_glyphs(spark, sf_dir):
    own = D.table(spark, sf_dir, "pages")
    return own.select("page_id", T.token_count(C.cell("html")).alias("tokens"), F.round(T.glyph_rate(C.cell("html")), 9).alias("glyph_rate"))


# --- columns -----------------------------------------------------------------------


@query
def column_metrics(spark, sf_dir):
    m = tabular.column_metrics(tabular.cells(D.vendor(spark, sf_dir), D.VENDOR))
    return m.select("column", "n", "m", "mojibake", "formatted", "plain", "nullish", "excel", F.col("longest").cast("long").alias("longest"), "digits", F.col("digit_min").cast("long").alias("digit_min"), F.col("digit_max").cast("long").alias("digit_max"), "padded")


@query
def tabular_audit(spark, sf_dir):
    return _flat(tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False), "column")


@query
def tabular_samples(spark, sf_dir):
    a = tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, order_by="row_key")
    return M.exploded(a, "column").select("column", "mode", F.array_join("samples", "|").alias("samples"))


@query
def tabular_severity(spark, sf_dir):
    a = tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False)
    return a.select("column", "units", "judged", "severity", F.round("confidence", 6).alias("confidence"))


@query
def audit_summary(spark, sf_dir):
    s = M.summarise(tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False))
    return s.select("severity", "artifacts", "artifacts_judged", "confidence", F.array_join("flagged", ",").alias("flagged"))


@query
def lineitem_audit(spark, sf_dir):
    """All columns of the largest table."""
    m = tabular.column_metrics(tabular.cells(catalog.as_text(D.table(spark, sf_dir, "lineitem")), D.LINEITEM))
    return m.select("column", "n", "m", "mojibake", "formatted", "nullish", "excel", "digits", "padded")


@query
def ragged_audit(spark, sf_dir):
    return _flat(tabular.ragged_rows(D.ragged_parts(spark, sf_dir), 3))


@query
def table_features(spark, sf_dir):
    return tabular.table_features(D.ragged_parts(spark, sf_dir), 3)


@query
def duplicate_headers(spark, sf_dir):
    header = ["id", "name", "id", "amount", "name"]
    return spark.createDataFrame(list(enumerate(repair.fix_duplicate_headers(header))), "pos long, name string")


@query
def column_shapes(spark, sf_dir):
    own = D.table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name")
    return conventions.shape_counts(tabular.cells(own, own.columns)).select("column", "shape", "n")


@query
def column_conventions(spark, sf_dir):
    own = conventions.conventions(conventions.shape_counts(tabular.cells(D.vendor(spark, sf_dir), D.VENDOR, "row_key")))
    return own.select("column", "m", "top_n", "top_shape", "others", "breaks")


@query
def convention_breaks(spark, sf_dir):
    return _flat(conventions.audit_conventions(D.vendor(spark, sf_dir), D.VENDOR, "row_key", with_samples=False), "column")


@query
def order_date_shapes(spark, sf_dir):
    own = D.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    return conventions.shape_counts(tabular.cells(own, own.columns)).select("column", "shape", "n")


# --- repairs -----------------------------------------------------------------------


def _repaired(spark, sf_dir, column, fix):
    v = F.col(column)
    return D.vendor(spark, sf_dir).select("row_key", fix(v).alias("fixed"), (F.coalesce(fix(v), v) != v).alias("changed"))


@query
def mojibake_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, "name", C.fix_mojibake)


@query
def numeric_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, "revenue", C.fix_numeric_text)


@query
def null_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, "status", C.fix_null_string)


@query
def gene_restore(spark, sf_dir):
    return _repaired(spark, sf_dir, "gene", C.restore_gene)


@query
def leading_zero_pad(spark, sf_dir):
    own = D.vendor(spark, sf_dir)
    width = repair.modal_widths(own, ["zip_code"], "row_key")["zip_code"]
    return own.select("row_key", F.coalesce(C.pad_digits(F.col("zip_code"), F.lit(width)), "zip_code").alias("padded"))


def _fixed(spark, sf_dir, **options):
    own = D.vendor(spark, sf_dir)
    return repair.repair_columns(own, tabular.audit_columns(own, D.VENDOR, with_samples=False), order_by="row_key", **options)


@query
def repair_table(spark, sf_dir):
    return _fixed(spark, sf_dir).df


@query
def repair_counts(spark, sf_dir):
    return _fixed(spark, sf_dir, allow_lossy=True).repairs.select("column", "mode", "recoverability", "changed", "total")


@query
def repair_refusals(spark, sf_dir):
    return _fixed(spark, sf_dir).refusals.select("column", "mode", "affected")


def _solved(spark, sf_dir):
    own = D.vendor(spark, sf_dir)
    key = F.struct(F.lit(0).cast("long").alias("block"), F.col("row_key").alias("line")).alias("row_id")
    cols = F.array(*(C.cell(c) for c in D.VENDOR))
    wide = F.array(*(C.cell(c) for c in D.VENDOR), F.lit("extra"))
    return solve_rows(own.select(key, F.when(F.col("row_key") % 50 == 0, wide).otherwise(cols).alias("fields")), D.VENDOR)


@query
def solve_clean(spark, sf_dir):
    return _solved(spark, sf_dir).clean


@query
def solve_quarantine(spark, sf_dir):
    return _solved(spark, sf_dir).routed.where("kind is not null").select(F.col("row_id.line").alias("row_key"), "kind")


@query
def solve_actions(spark, sf_dir):
    return _solved(spark, sf_dir).actions()


@query
def solve_counts(spark, sf_dir):
    return _solved(spark, sf_dir).counts().withColumn("recovered_fraction", F.round("recovered_fraction", 6))


# --- profiles, provenance, files ---------------------------------------------------


@query
def profile_rescore(spark, sf_dir):
    a = tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False)
    out = None
    for p in profiles.ALL:
        own = profiles.apply_profile(a, p).select("profile", "column", "severity", "usable", F.size("findings").cast("long").alias("reported"), F.size("suppressed").cast("long").alias("suppressed"))
        out = own if out is None else out.unionByName(own)
    return out


@query
def profile_compare(spark, sf_dir):
    return profiles.compare_profiles(tabular.audit_columns(D.vendor(spark, sf_dir), D.VENDOR, with_samples=False))


@query
def crossfile_headers(spark, sf_dir):
    return crossfile.field_spellings(D.headers(spark)).select("key", F.array_join("spellings", " / ").alias("spellings"))


@query
def crossfile_layouts(spark, sf_dir):
    return crossfile.odd_sources(D.headers(spark))


def _annotated(spark, sf_dir):
    own = D.vendor(spark, sf_dir)
    return provenance.annotate(own, tabular.audit_columns(own, D.VENDOR, with_samples=False), "row_key")


@query
def provenance_notes(spark, sf_dir):
    return _annotated(spark, sf_dir).notes.select("row_key", "column", "original", "value", "mode", "action")


@query
def provenance_records(spark, sf_dir):
    return provenance.provenance_records(_annotated(spark, sf_dir))


@query
def review_queue(spark, sf_dir):
    return provenance.review_queue(_annotated(spark, sf_dir), 200).select("row_key", "column", "mode", "action")


@query
def catalog_audit(spark, sf_dir):
    """Worst severity and number of findings of every small table."""
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey")):
        own = catalog.audit_query(catalog.as_text(dealt(D.table(spark, sf_dir, name), key)), name)
        out = own if out is None else out.unionByName(own)
    return catalog.table_verdicts(out)


# --- learning and mining -----------------------------------------------------------


def _labelled(spark, sf_dir):
    docs = text.text_features(D.table(spark, sf_dir, "documents").join(D.table(spark, sf_dir, "labels"), "doc_id"))
    each = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(c, 9).alias("value")) for c in ("glyph_rate", "fragment_ratio", "digit_rate")))
    return docs.select((F.col("quality") == 0).alias("bad"), F.explode(each).alias("x")).select("x.feature", "x.value", "bad")


@query
def threshold_sweep(spark, sf_dir):
    own = learning.threshold_sweep(_labelled(spark, sf_dir), learning.TextDetector().directions())
    return own.select("feature", F.round("candidate", 6).alias("candidate"), "midpoint", F.round("balanced", 6).alias("balanced"))


@query
def learned_thresholds(spark, sf_dir):
    d = learning.TextDetector()
    own = learning.learned_thresholds(_labelled(spark, sf_dir), d.default_thresholds(), d.directions())
    return own.select("feature", F.round("before", 9).alias("before"), F.round("threshold", 9).alias("threshold"), F.round("after", 9).alias("after"), "adopted")


def _mined(found: DataFrame) -> DataFrame:
    return found.select("kind", "signature", "support", F.round("precision", 6).alias("precision"), F.round("lift", 4).alias("lift"))


@query
def mine_char_classes(spark, sf_dir):
    return _mined(mining.mine_char_classes(D.mined_documents(spark, sf_dir)))


@query
def mine_token_shapes(spark, sf_dir):
    return _mined(mining.mine_token_shapes(D.mined_documents(spark, sf_dir)))


@query
def mine_markers(spark, sf_dir):
    return _mined(mining.mine_markers(D.mined_documents(spark, sf_dir)))


@query
def detector_utility(spark, sf_dir):
    """How often each text finding agrees with a low quality label."""
    docs = D.table(spark, sf_dir, "documents").join(D.table(spark, sf_dir, "labels"), "doc_id")
    own = text.audit_text(docs, "doc_id", with_samples=False).join(docs.select(F.col("doc_id").cast("string").alias("subject"), (F.col("quality") == 0).alias("bad")), "subject")
    modes = ("missing_glyph", "shattered_words", "numeric_loss")
    own = own.select("bad", F.transform("findings", lambda f: f["mode"]).alias("modes"))
    each = own.select("bad", F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.array_contains("modes", m).alias("on")) for m in modes))).alias("x"))
    counts = each.groupBy("x.name").agg(F.count_if("x.on").alias("fired"), F.count_if(F.col("x.on") & F.col("bad")).alias("agreed"), F.count_if(~F.col("x.on") & F.col("bad")).alias("missed"))
    return mining.verdicts(counts).select("name", "fired", "agreed", "missed", "verdict")


# --- streaming ---------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str):
    from ..streaming import stats

    schema = D.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.when(F.col("event_id") % 7 == 0, "N/A").otherwise(F.col("event_type"))
    value = F.format_string("%d,%03d", (F.col("event_id") % 900 + 1).cast("int"), (F.col("event_id") % 1000).cast("int"))
    fields = F.array(F.col("event_id").cast("string"), kind, value)
    rows = events.select(F.when(F.col("event_id") % 100 == 0, F.array_append(fields, "extra")).otherwise(fields).alias("fields"))
    out = new_folder(spark, "stream")
    stats.solve_stream(rows, ["event_id", "event_type", "value"], out, f"{out}/checkpoint").awaitTermination()
    return stats.StreamResult(spark, out)


@query
def stream_repair(spark, sf_dir):
    return _streamed(spark, sf_dir).clean().select("event_id", "event_type", "value")


@query
def stream_column_stats(spark, sf_dir):
    return _flat(_streamed(spark, sf_dir).audits(), "subject", "units")


@query
def stream_quarantine(spark, sf_dir):
    return _streamed(spark, sf_dir).quarantine().select(F.get("fields", F.lit(0)).alias("event_id"), F.col("__reason").alias("reason"))


__all__ = ["queries", "V"]
