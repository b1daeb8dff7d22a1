"""Values that break their own column's convention: shapes, their shares, and the exceptions.

Shapes are made in the map task and counted with partial sums. A column of under 40 filled cells isn't judged; one whose commonest
shape has under 90 % of them has no convention; more than 5 % of exceptions are a second format, not damage. Of equally common shapes
the one that stands first in row order counts (without an order, the least by text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import values as V
from . import model as M
from .tabular import cells


def shape_counts(long: DataFrame) -> DataFrame:
    """(col_idx, column, shape, n, first): filled cells by shape."""
    return long.where(~C.is_blank(F.col("v"))).groupBy("col_idx", "column", C.shape(F.col("v")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first"))


def conventions(counts: DataFrame) -> DataFrame:
    """A row per column: m filled cells, the top shape and its share, the number of other shapes and cells."""
    top = F.min_by("shape", F.struct((-F.col("n")).alias("a"), F.col("first").alias("b"), F.col("shape").alias("c")))
    own = counts.groupBy("col_idx", "column").agg(F.sum("n").alias("m"), F.max("n").alias("top_n"), top.alias("top_shape"), (F.count(F.lit(1)) - 1).alias("others"))
    return own.withColumn("share", F.col("top_n") / F.col("m")).withColumn("breaks", F.col("m") - F.col("top_n"))


def audit_conventions(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None, dominance: float = V.THRESHOLDS["dominance"], with_samples: bool = True) -> DataFrame:
    """A row per column: subject, col_idx, column, units, judged, findings, severity, confidence."""
    columns = columns or [c for c in df.columns if c != order_by]
    return audit_cell_conventions(cells(df, columns, order_by), dominance, with_samples)


def audit_cell_conventions(long: DataFrame, dominance: float = V.THRESHOLDS["dominance"], with_samples: bool = True) -> DataFrame:
    t, spark = V.THRESHOLDS, long.sparkSession
    counts = shape_counts(long)
    units = long.groupBy("col_idx", "column").agg(F.count(F.lit(1)).alias("units"))
    rows = units.join(conventions(counts).drop("column"), "col_idx", "left").collect()  # one row per column
    broken = {r.col_idx: r.top_shape for r in rows if r.m and r.m >= t["min_values"] and r.share >= dominance and 0 < r.breaks <= t["max_anomaly"] * r.m}
    found: dict[int, list[str]] = {}
    if broken and with_samples:
        top = F.create_map(*(F.lit(x) for kv in broken.items() for x in kv))
        off = long.where(F.col("col_idx").isin(*broken) & ~C.is_blank(F.col("v"))).withColumn("shape", C.shape(F.col("v"))).where(F.col("shape") != F.element_at(top, F.col("col_idx")))
        rare = counts.where(F.col("col_idx").isin(*broken)).select("col_idx", "shape", (F.col("n") < t["isolation"]).alias("rare"))
        # whether a column has a rare shape is asked of its shapes, not of its cells
        some = rare.join(F.broadcast(spark.createDataFrame(list(broken.items()), "col_idx int, top string")), "col_idx").where("shape <> top").groupBy("col_idx").agg(F.max("rare").alias("some"))
        off = off.join(rare, ["col_idx", "shape"]).join(F.broadcast(some), "col_idx")  # a row per column
        own = off.where(F.col("rare") | ~F.col("some")).withColumn("k", F.row_number().over(Window.partitionBy("col_idx").orderBy("row_key", "v"))).where("k <= 5")
        for r in sorted(own.select("col_idx", "k", F.format_string("'%s' (shape '%s')", "v", "shape").alias("s")).collect(), key=lambda r: (r.col_idx, r.k)):
            found.setdefault(r.col_idx, []).append(r.s)
    data = [(r.col_idx, r.column, r.units, r.m or 0, r.breaks or 0, r.top_shape, r.share, r.col_idx in broken, found.get(r.col_idx, [])) for r in sorted(rows, key=lambda r: r.col_idx)]
    base = spark.createDataFrame(data, "col_idx int, column string, units long, m long, breaks long, top_shape string, share double, broken boolean, evidence array<string>")
    rate = F.try_divide(F.col("breaks").cast("double"), F.col("m").cast("double"))
    detail = F.format_string("%.0f%% of values look like '%s'; %d do not", F.col("share") * 100, "top_shape", "breaks")
    hit = F.when(F.col("broken"), M.finding("convention_break", F.when(rate < 0.01, M.SUSPECT).otherwise(M.CORRUPT), rate, t["max_anomaly"], detail, F.col("evidence"), F.format_string("column '%s'", "column")))
    audits = base.select(F.concat(F.lit("column "), "column").alias("subject"), "col_idx", "column", "units", (F.col("m") >= t["min_values"]).alias("judged"), M.gather(hit).alias("findings"))
    return M.scored(audits)


def describe_conventions(df: DataFrame, columns: list[str] | None = None) -> str:
    """A line per column: its convention, or why it has none."""
    columns = columns or df.columns
    long = cells(df, columns)
    rows = {r.col_idx: r for r in conventions(shape_counts(long)).collect()}
    lines = []
    for i, c in enumerate(columns):
        r = rows.get(i)
        if r is None or r.m < V.THRESHOLDS["min_values"]:
            lines.append(f"{c}: too few values to tell ({r.m if r else 0})")
        elif r.share >= V.THRESHOLDS["dominance"]:
            lines.append(f"{c}: {r.share:.1%} follow '{r.top_shape}'" + (f", {M.plural(r.others, 'other shape')}" if r.others else ""))
        else:
            lines.append(f"{c}: no dominant pattern (commonest '{r.top_shape}' at {r.share:.1%})")
    return "\n".join(lines)
