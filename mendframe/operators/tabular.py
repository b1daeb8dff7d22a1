"""Column audits of tables of text: one pass of partial sums for all columns, then small passes over flagged columns only.

``column_metrics`` unfolds rows to (column, cell) inside the map task and sums per column, so a task sends one row per column
however many rows it read. What depends on a column's longest value (cut values) is a second pass over the columns that may be cut,
and samples are a third over flagged cells of columns with findings; a sample is the first by row order, kept by a limited
row_number that Spark applies before the shuffle.

Cells are text; null is the empty string. A column of under 30 cells isn't judged: only mojibake and spreadsheet dates are reported.
An empty table gives audits of 0 units without findings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import values as V
from . import model as M

#: Rows a column's worth of metrics holds; the audit of a table brings one such row per column to the driver.
_METRICS = "col_idx int, column string, n long, m long, mojibake long, formatted long, plain long, nullish long, excel long, longest int, digits long, digit_min int, digit_max int, padded boolean"


def cells(df: DataFrame, columns: list[str], order_by: str | None = None) -> DataFrame:
    """(row_key, col_idx, column, v): a row per cell. row_key is order_by's value, or null."""
    key = F.col(order_by) if order_by else F.lit(None).cast("long")
    packed = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column"), C.cell(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(columns)))
    return df.select(key.alias("row_key"), F.explode(packed).alias("c")).select("row_key", "c.col_idx", "c.column", "c.v")


def field_cells(rows: DataFrame, header: list[str], order_by: str | None = None, of_null: bool = True) -> DataFrame:
    """As cells(), from rows with an array ``fields``: short rows are padded, fields beyond the header left out. of_null False: rows without fields give no cells.

    An inner explode would make Spark test the array below it first, and so work out every field twice.
    """
    key = F.col(order_by) if order_by else F.lit(None).cast("long")
    names = F.array(*(F.lit(h) for h in header))
    idx = F.sequence(F.lit(0), F.lit(len(header) - 1))
    packed = F.transform(idx, lambda i: F.struct(i.alias("col_idx"), F.get(names, i).alias("column"), F.coalesce(F.get(F.col("fields"), i), F.lit("")).alias("v")))
    packed = packed if of_null else F.when(F.col("fields").isNotNull(), packed)
    return rows.select(key.alias("row_key"), F.explode_outer(packed).alias("c")).where("c is not null").select("row_key", "c.col_idx", "c.column", "c.v")


def column_metrics(long: DataFrame) -> DataFrame:
    """A row of counters per column of cells()."""
    v = F.col("v")
    full = ~C.is_blank(v)
    length, digits = F.length(v), C.is_digits(v)
    return (
        long.groupBy("col_idx", "column")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(full).alias("m"),
            F.count_if(C.has_mojibake(v)).alias("mojibake"),
            F.count_if(full & C.is_formatted_number(v)).alias("formatted"),
            F.count_if(full & C.is_plain_number(v)).alias("plain"),
            F.count_if(C.is_null_like(v)).alias("nullish"),
            F.count_if(full & C.is_excel_date(v)).alias("excel"),
            F.max(F.when(full, length)).alias("longest"),
            F.count_if(digits).alias("digits"),
            F.min(F.when(digits, length)).alias("digit_min"),
            F.max(F.when(digits, length)).alias("digit_max"),
            F.coalesce(F.bool_or(F.when(digits, v.startswith("0"))), F.lit(False)).alias("padded"),
        )
    )


def at_longest(long: DataFrame, longest: dict[int, int]) -> DataFrame:
    """(col_idx, at, different): cells as long as the column's longest, and how many different ones, for the named columns."""
    on = F.lit(False)
    for i, n in longest.items():
        on = on | ((F.col("col_idx") == i) & (F.length("v") == n))
    own = long.where(on & ~C.is_blank(F.col("v")))
    return own.groupBy("col_idx", "v").agg(F.count(F.lit(1)).alias("k")).groupBy("col_idx").agg(F.sum("k").alias("at"), F.count(F.lit(1)).alias("different"))


def thresholds(own: dict[str, float] | None = None) -> dict[str, float]:
    return V.THRESHOLDS | (own or {})


def column_findings(t: dict[str, float]) -> Column:
    """The findings array over columns of metrics, at and different; samples are left empty."""
    c = F.col
    share = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    judged = c("n") >= t["min_rows"]
    loc = F.format_string("column '%s'", c("column"))
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    moji, fmt, cut, null, zero = share("mojibake", "n"), share("formatted", "m"), share("at", "m"), share("nullish", "n"), share("digits", "m")
    return M.gather(
        F.when((c("mojibake") > 0) & (moji >= t["mojibake_suspect"]), M.finding("mojibake", F.when(moji >= t["mojibake_corrupt"], M.CORRUPT).otherwise(M.SUSPECT), moji, F.when(moji >= t["mojibake_corrupt"], t["mojibake_corrupt"]).otherwise(t["mojibake_suspect"]), F.concat(pct(moji), F.lit(" of cells hold UTF-8 that was read as Latin-1")), location=loc)),
        F.when(judged & (fmt >= t["numeric_as_text"]) & (c("formatted") >= 30), M.finding("numeric_as_text", M.SUSPECT, fmt, t["numeric_as_text"], F.concat(pct(fmt), F.lit(" of values are numbers in display format; a cast will fail")), location=loc)),
        F.when(judged & (c("at") >= 3) & (share("different", "at") >= t["truncation_diversity"]) & (cut >= t["truncation"]), M.finding("truncation", M.SUSPECT, cut, t["truncation"], F.format_string("%d values are exactly %d characters long, the longest there are: they were cut", c("at"), c("longest")), location=loc)),
        F.when(judged & (c("nullish") > 0) & (null >= t["null_string"]), M.finding("null_as_string", M.SUSPECT, null, t["null_string"], F.format_string("%d values are words for a missing value", c("nullish")), location=loc)),
        F.when((c("excel") >= t["excel_date"]) & (c("excel") < c("m") * 0.5), M.finding("excel_date_corruption", M.CORRUPT, c("excel"), t["excel_date"], F.format_string("%d values look like identifiers that a spreadsheet made into dates", c("excel")), location=loc)),
        F.when(judged & c("column").rlike(V.ID_NAME) & (c("digit_min") < c("digit_max")) & ~c("padded") & (zero >= t["leading_zero"]), M.finding("leading_zero_loss", M.SUSPECT, zero, t["leading_zero"], F.format_string("identifiers of %d to %d digits, none padded: leading zeros were probably lost", c("digit_min"), c("digit_max")), location=loc)),
    )


def _flag(mode: str, longest: dict[int, int]) -> Column:
    """Whether a cell is evidence of a mode."""
    v = F.col("v")
    if mode == "truncation":
        on = F.lit(False)
        for i, n in longest.items():
            on = on | ((F.col("col_idx") == i) & (F.length(v) == n))
        return on & ~C.is_blank(v)
    return {
        "numeric_as_text": ~C.is_blank(v) & C.is_formatted_number(v),
        "null_as_string": C.is_null_like(v),
        "excel_date_corruption": C.is_excel_date(v),
        "leading_zero_loss": C.is_digits(v),
    }[mode]


def samples(long: DataFrame, wanted: list[tuple[int, str]], longest: dict[int, int]) -> dict[tuple[int, str], list[str]]:
    """Evidence of each (col_idx, mode): first cells in row order, or the commonest markers and null words. At most five rows for each come to the driver."""
    out: dict[tuple[int, str], list[str]] = {}
    by_mode: dict[str, list[int]] = {}
    for i, mode in wanted:
        by_mode.setdefault(mode, []).append(i)
    parts = []
    for mode, idx in by_mode.items():
        own = long.where(F.col("col_idx").isin(*idx))
        if mode == "mojibake":
            hit = own.where(C.has_mojibake(F.col("v")))
            found = F.array_compact(F.array(*(F.when(F.col("v").contains(m), m) for m in V.MOJIBAKE_MARKERS)))
            ranked = hit.select("col_idx", F.explode(found).alias("s")).groupBy("col_idx", "s").count()
            order = [F.desc("count"), F.col("s")]
        elif mode == "null_as_string":
            ranked = own.where(_flag(mode, longest)).groupBy("col_idx", F.col("v").alias("s")).agg(F.count(F.lit(1)).alias("count"), F.min("row_key").alias("first"))
            order = [F.desc("count"), F.col("first"), F.col("s")]
        else:
            text = F.concat(F.substring("v", 1, 40), F.lit("...")) if mode == "truncation" else F.col("v")
            ranked = own.where(_flag(mode, longest)).select("col_idx", "row_key", text.alias("s"))
            order = [F.col("row_key"), F.col("s")]
        most = 3 if mode == "truncation" else 5
        top = ranked.withColumn("k", F.row_number().over(Window.partitionBy("col_idx").orderBy(*order))).where(F.col("k") <= most)
        parts.append(top.select("col_idx", F.lit(mode).alias("mode"), "k", "s"))
    if parts:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        for r in sorted(every.collect(), key=lambda r: (r.col_idx, r.mode, r.k)):
            out.setdefault((r.col_idx, r.mode), []).append(r.s)
    return out


def audit_cells(long: DataFrame, own_thresholds: dict[str, float] | None = None, with_samples: bool = True) -> DataFrame:
    """A row per column: subject, col_idx, column, units, judged, findings, severity, confidence."""
    return audited(long, own_thresholds, with_samples)[0]


def audited(long: DataFrame, own_thresholds: dict[str, float] | None = None, with_samples: bool = True, narrowed: Callable[[list[int]], DataFrame] | None = None) -> tuple[DataFrame, dict[int, int]]:
    """As audit_cells(), and the longest length of columns that may be cut. narrowed gives the cells of some columns alone, if these are cheaper to make."""
    spark, t = long.sparkSession, thresholds(own_thresholds)
    metrics = column_metrics(long).collect()  # one row per column
    longest = {r.col_idx: r.longest for r in metrics if r.longest in V.LENGTH_LIMITS and r.n >= t["min_rows"]}
    few = narrowed(sorted(longest)) if narrowed and longest else long
    cut = {r.col_idx: r for r in at_longest(few, longest).collect()} if longest else {}
    rows = [(*r, cut[r.col_idx].at if r.col_idx in cut else None, cut[r.col_idx].different if r.col_idx in cut else None) for r in sorted(metrics, key=lambda r: r.col_idx)]
    base = spark.createDataFrame(rows, _METRICS + ", at long, different long").withColumn("findings", column_findings(t))
    if with_samples:
        wanted = [(r.col_idx, f.mode) for r in base.select("col_idx", "findings").collect() for f in r.findings]
        if wanted:
            got = samples(long, wanted, longest)
            entries = [(i, mode, s) for (i, mode), s in got.items()]
            seen = F.create_map(*(x for i, mode, s in entries for x in (F.lit(f"{i}:{mode}"), F.array(*(F.lit(v) for v in s)))))
            base = base.withColumn("findings", F.transform("findings", lambda f: f.withField("samples", F.coalesce(F.element_at(seen, F.concat(F.col("col_idx").cast("string"), F.lit(":"), f["mode"])), f["samples"]))))
    audits = base.select(F.concat(F.lit("column "), F.col("column")).alias("subject"), "col_idx", "column", F.col("n").alias("units"), (F.col("n") >= t["min_rows"]).alias("judged"), "findings")
    return M.scored(audits), longest


def audit_columns(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None, thresholds: dict[str, float] | None = None, with_samples: bool = True) -> DataFrame:
    """Audits of the named columns (all but order_by)."""
    columns = columns or [c for c in df.columns if c != order_by]
    return audit_cells(cells(df, columns, order_by), thresholds, with_samples)


# --- the table as a whole --------------------------------------------------------


def ragged_rows(rows: DataFrame, width: int, t: dict[str, float] | None = None, order_by: str | None = None) -> DataFrame:
    """One audit of rows(fields) whose number of fields isn't ``width``; its row exists even if there is no finding. With a row key, the first five such rows are its evidence."""
    t = thresholds(t)
    off = F.size("fields") != width
    metrics = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))
    rate = F.try_divide(F.col("off").cast("double"), F.col("n").cast("double"))
    bad = rate >= t["ragged_corrupt"]
    first = rows.where(off).orderBy(order_by).select(order_by, F.size("fields").alias("c")).limit(5).collect() if order_by else []  # a top-k, not a sort
    samples = [f"row {k.line if hasattr(k := r[0], 'line') else k}: {r.c} fields" for r in first]
    found = F.when(
        (F.col("off") > 0) & (rate >= t["ragged_suspect"]),
        M.finding("ragged_rows", F.when(bad, M.CORRUPT).otherwise(M.SUSPECT), rate, F.when(bad, t["ragged_corrupt"]).otherwise(t["ragged_suspect"]), F.format_string("%d of %d rows have another number of fields than the header", "off", "n"), F.array(*map(F.lit, samples)).cast("array<string>"), "table structure"),
    )
    return M.scored(metrics.select(F.lit("table structure").alias("subject"), F.col("n").alias("units"), F.lit(True).alias("judged"), M.gather(found).alias("findings")))


def duplicate_columns(spark, header: list[str]) -> DataFrame:
    """One audit of a header; names that stand twice are a finding."""
    twice = [h for h, n in Counter(header).items() if n > 1]
    rows = spark.range(1).select(F.lit("table header").alias("subject"), F.lit(len(header)).cast("long").alias("units"), F.lit(True).alias("judged"))
    found = M.finding("duplicate_columns", M.SUSPECT, None, None, f"{M.plural(len(twice), 'name')} used more than once", F.array(*(F.lit(h) for h in twice[:5])), "table header") if twice else F.lit(None).cast(M.FINDING)
    return M.scored(rows.withColumn("findings", M.gather(found)))


def audit_rows(rows: DataFrame, header: list[str], order_by: str | None = None, own_thresholds: dict[str, float] | None = None) -> DataFrame:
    """All audits of a table given as rows(fields): structure and header if they have findings, then every column."""
    keep = ["subject", "units", "judged", "findings", "severity", "confidence"]
    whole = ragged_rows(rows, len(header), own_thresholds, order_by).select(keep).unionByName(duplicate_columns(rows.sparkSession, header).select(keep))
    columns = audit_cells(field_cells(rows, header, order_by), own_thresholds).select(keep)
    return whole.where(F.size("findings") > 0).unionByName(columns)


def table_features(rows: DataFrame, width: int) -> DataFrame:
    """One row of rates over all cells as they stand: units, judged, mojibake_rate, null_string, ragged, excel_date."""
    v = lambda f: F.aggregate("fields", F.lit(0).cast("long"), lambda acc, x: acc + F.when(f(x), 1).otherwise(0))
    sums = rows.agg(
        F.count(F.lit(1)).alias("units"),
        F.coalesce(F.sum(F.size("fields")), F.lit(0)).cast("double").alias("cells"),
        F.coalesce(F.sum(v(C.has_mojibake)), F.lit(0)).alias("a"),
        F.coalesce(F.sum(v(C.is_null_like)), F.lit(0)).alias("b"),
        F.count_if(F.size("fields") != width).alias("c"),
        F.coalesce(F.sum(v(C.is_excel_date)), F.lit(0)).cast("double").alias("excel_date"),
    )
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b).cast("double"), F.lit(1.0))
    return sums.select("units", (F.col("units") >= V.THRESHOLDS["min_rows"]).alias("judged"), per("a", "cells").alias("mojibake_rate"), per("b", "cells").alias("null_string"), per("c", "units").alias("ragged"), "excel_date")


def header_key(name: str) -> str:
    """A header's name without case and punctuation."""
    return re.sub(r"[\W_]", "", name.lower())
