"""Column statistics that merge, and a stream that repairs rows as they come.

Each micro-batch becomes partial counters by (column, length bucket), with the least and the greatest hash of a bucket's cells, which tell
whether it holds two different ones; partials are
appended with their batch id and merged by sum, so a batch that is run again replaces its own. Lengths over a table's limits fall into
buckets of ten, which bounds a column's rows whatever the input. The stream has its own rules: plain numbers count, any mojibake is at
least suspect, null words are stripped first, a cut needs two different values, and undecodable characters are judged per column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import cells as C
from ..functions import values as V
from ..operators import model as M
from ..operators.tabular import field_cells
from ..plans.solve import fixed_cell

SUMS = ("seen", "non_empty", "chars", "mojibake", "numeric", "nullish", "excel", "digit_bearing", "controls")


def partials(long: DataFrame) -> DataFrame:
    """(col_idx, column, length, counters, held): a row per column and length bucket. long: col_idx, column, v."""
    v = F.col("v")
    s = C.strip(v)
    n = F.length(v)
    bucket = F.when(s == "", -1).when(n.isin(*V.LENGTH_LIMITS), n).otherwise((F.floor(n / 10) * 10 + F.lit(1)).cast("int"))
    own = long.withColumn("length", bucket).withColumn("full", s != "")
    counted = own.groupBy("col_idx", "column", "length").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("full").alias("non_empty"),
        F.sum(n).cast("long").alias("chars"),
        F.count_if(C.has_stream_mojibake(v)).alias("mojibake"),
        F.count_if(F.col("full") & s.rlike(V.PLAIN_NUMBER)).alias("numeric"),
        F.count_if(F.col("full") & s.isin(*V.NULL_LIKE)).alias("nullish"),
        F.count_if(F.col("full") & C.is_excel_date(v)).alias("excel"),
        F.count_if(v.rlike(r"\p{Nd}")).alias("digit_bearing"),
        F.sum(C.control_count(v)).cast("long").alias("controls"),
        F.max(F.when(F.col("full"), n)).alias("longest"),
        # two hashes are enough to tell one repeated value from several
        F.min(F.when(n.isin(*V.LENGTH_LIMITS), F.xxhash64(v))).alias("low"),
        F.max(F.when(n.isin(*V.LENGTH_LIMITS), F.xxhash64(v))).alias("high"),
    )
    return counted


def merged(parts: DataFrame) -> DataFrame:
    """Partials of any number of batches, summed."""
    return parts.groupBy("col_idx", "column", "length").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("longest").alias("longest"), F.min("low").alias("low"), F.max("high").alias("high"))


def finalise(parts: DataFrame, min_rows: int = 30) -> DataFrame:
    """A row per column: subject, units, judged, findings, severity, confidence by the stream's rules."""
    m = merged(parts)
    top = m.groupBy("col_idx", "column").agg(*(F.sum(c).alias(c) for c in SUMS), F.max("longest").alias("longest"), F.max_by(F.struct("length", "non_empty", "low", "high"), F.struct("longest")).alias("last"))
    c = F.col
    share = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    judged, loc = c("seen") >= min_rows, F.format_string("column '%s'", c("column"))
    cut = F.try_divide(c("last.non_empty").cast("double"), c("non_empty").cast("double"))
    at_limit = c("longest").isin(*V.LENGTH_LIMITS) & (c("last.length") == c("longest")) & (c("last.non_empty") >= 3) & (c("last.low") < c("last.high"))
    glyph = share("controls", "chars") * 1000
    moji, num, null = share("mojibake", "seen"), share("numeric", "non_empty"), share("nullish", "seen")
    found = M.gather(
        F.when(c("mojibake") > 0, M.finding("mojibake", F.when(moji >= 0.02, M.CORRUPT).otherwise(M.SUSPECT), moji, 0.002, F.format_string("%d values hold UTF-8 that was read as Latin-1", c("mojibake")), location=loc)),
        F.when(judged & (num >= 0.95) & (c("numeric") >= min_rows), M.finding("numeric_as_text", M.SUSPECT, num, 0.95, "numbers kept as text", location=loc)),
        F.when(judged & at_limit & (cut >= 0.03), M.finding("truncation", M.SUSPECT, cut, 0.03, F.format_string("%d values are exactly %d characters long", c("last.non_empty"), c("longest")), location=loc)),
        F.when(judged & (c("nullish") > 0) & (null >= 0.01), M.finding("null_as_string", M.SUSPECT, null, 0.01, F.format_string("%d values are words for a missing value", c("nullish")), location=loc)),
        F.when((c("excel") >= 2) & (c("excel") < c("non_empty") * 0.5), M.finding("excel_date_corruption", M.CORRUPT, c("excel"), 2.0, F.format_string("%d values look like spreadsheet dates", c("excel")), location=loc)),
        F.when(glyph >= 0.5, M.finding("missing_glyph", F.when(glyph >= 3.0, M.CORRUPT).otherwise(M.SUSPECT), glyph, 0.5, F.format_string("%.2f undecodable characters per 1000", glyph), location=loc)),
    )
    return M.scored(top.select(F.concat(F.lit("column "), "column").alias("subject"), "col_idx", "column", c("seen").alias("units"), judged.alias("judged"), found.alias("findings")))


def solve_stream(rows: DataFrame, header: list[str], out: str, checkpoint: str, fix_genes: bool = True, progress: Callable[[int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """rows: a streaming frame with ``fields``. Writes clean rows, quarantined rows and partial statistics under ``out``, a folder per batch.

    A batch that runs again after a failure overwrites its own folders, so nothing counts twice.
    """
    width = len(header)

    def batch(df: DataFrame, batch_id: int) -> None:
        own = df.withColumn("fields", F.transform("fields", C.cell)).withColumn("ragged", F.size("fields") != width)
        own = own.persist()
        try:
            fixed = F.transform("fields", lambda v: fixed_cell(v, fix_genes))
            own.where(~F.col("ragged")).select(fixed.alias("f")).select(*(F.get("f", F.lit(i)).alias(h) for i, h in enumerate(header))).write.mode("overwrite").parquet(f"{out}/clean/batch={batch_id}")
            own.where("ragged").select("fields", F.lit("field count mismatch").alias("__reason")).write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
            partials(field_cells(own.where(~F.col("ragged")), header)).write.mode("overwrite").parquet(f"{out}/stats/batch={batch_id}")
            if progress:
                progress(own.count())
        finally:
            own.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class StreamResult:
    """What a stream has written so far."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out

    def clean(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/clean")

    def quarantine(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/quarantine")

    def audits(self) -> DataFrame:
        return finalise(self.spark.read.parquet(f"{self.out}/stats"))

    def recovered_fraction(self) -> float:
        kept, lost = self.clean().count(), self.quarantine().count()
        return kept / (kept + lost) if kept + lost else 1.0

    def report(self) -> str:
        kept, lost = self.clean().count(), self.quarantine().count()
        lines = [f"{M.plural(kept, 'row')} written, {lost:,} in quarantine"]
        lines += [f"  {r.subject}: {r.severity}" for r in self.audits().orderBy("col_idx").collect()]
        return "\n".join(lines)
