"""From a damaged table to three outputs: clean rows, quarantined rows with a reason, and what was done.

Reversible damage is repaired cell by cell, rows whose damage can't be undone go to quarantine, and nothing is guessed. Everything is a
projection of the input; one aggregation over the repaired cells finds the columns that were cut at a length limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import model as M
from ..operators import tabular
from ..sources.readers import Source, from_frame, open_source

_CHANGE = "array<struct<mode:string,before:string,after:string>>"


@dataclass
class Solution:
    """clean: text columns; quarantine: the fields as they came (array) and __reason; actions: (mode, description, affected)."""

    header: list[str]
    routed: DataFrame
    limits: dict[str, int]
    encoding: str = "utf-8"
    delimiter: str = ","
    _actions: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def clean(self) -> DataFrame:
        return self.routed.where("reason is null").select(*(F.get("fixed", F.lit(i)).alias(h) for i, h in enumerate(self.header)))

    @property
    def quarantine(self) -> DataFrame:
        return self.routed.where("reason is not null").select("row_id", "fields", F.col("reason").alias("__reason"))

    def counts(self) -> DataFrame:
        """One row: kept, quarantined, recovered_fraction (1 for no row)."""
        own = self.routed.agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("quarantined"))
        return own.withColumn("recovered_fraction", F.coalesce(F.try_divide(F.col("kept").cast("double"), (F.col("kept") + F.col("quarantined")).cast("double")), F.lit(1.0)))

    def actions(self) -> DataFrame:
        """(mode, affected): cells repaired in kept or quarantined rows of the right width, and rows put apart."""
        kinds = F.array_compact(F.array("kind"))
        modes = F.when(F.col("changes").isNull(), kinds).otherwise(F.concat(F.transform("changes", lambda c: c["mode"]), kinds))
        return self.routed.select(F.explode_outer(modes).alias("mode")).where("mode is not null").groupBy("mode").agg(F.count(F.lit(1)).alias("affected"))

    def report(self) -> str:
        c = self.counts().first()
        lines = [f"{M.plural(c.kept, 'row')} usable, {c.quarantined:,} in quarantine, {c.recovered_fraction:.1%} recovered", f"read as {self.encoding}, delimiter {self.delimiter!r}"]
        lines += [f"  {r['mode']}: {r.affected:,}" for r in self.actions().orderBy("mode").collect()]
        return "\n".join(lines)


def fixed_cell(v: Column, genes: bool) -> Column:
    """A struct of the repaired cell and the modes that changed it."""
    once = C.repaired(v)
    gene = C.restore_gene(once) if genes else F.lit(None).cast("string")
    return F.coalesce(gene, once)


def _repaired_cells(fields: Column) -> Column:
    """Each cell with what every repair makes of it (null: nothing), so that later columns read results instead of repairing again. Cells that no repair can touch are passed on after one test."""
    none = F.lit(None).cast("string")
    of = lambda v, hit, *made: F.struct(v.alias("before"), F.lit(hit).alias("hit"), *(m.alias(k) for m, (k, _) in zip(made, C.CELL_REPAIRS, strict=True)))
    return F.transform(fields, lambda v: F.when(C.may_change(v), of(v, True, *(fix(v) for _, fix in C.CELL_REPAIRS))).otherwise(of(v, False, none, none, none)))


def _settled_cells(cells: Column) -> Column:
    """before, hit, once (the first repair that applies), and that repair's mode."""
    modes = [m for m, _ in C.CELL_REPAIRS]
    once = lambda c: F.when(c["hit"], F.coalesce(*(c[m] for m in modes), c["before"])).otherwise(c["before"])
    mode = lambda c: F.when(c["hit"], F.coalesce(*(F.when(c[m].isNotNull(), F.lit(m)) for m in modes)))
    return F.transform(cells, lambda c: F.struct(c["before"].alias("before"), c["hit"].alias("hit"), once(c).alias("once"), mode(c).alias("mode")))


def _with_genes(cells: Column, genes: bool) -> Column:
    return F.transform(cells, lambda c: c.withField("gene", F.when(c["hit"], C.restore_gene(c["once"])) if genes else F.lit(None).cast("string")))


def _changes(c: Column) -> Column:
    first = F.when(c["once"] != c["before"], F.struct(c["mode"].alias("mode"), c["before"].alias("before"), c["once"].alias("after")))
    gene = F.when(c["gene"] != c["once"], F.struct(F.lit("excel_date_corruption").alias("mode"), c["once"].alias("before"), c["gene"].alias("after")))
    return F.array_compact(F.array(first, gene)).cast(_CHANGE)


def _fixed(own: DataFrame, fields: str, genes: bool) -> DataFrame:
    """Adds fixed (the repaired cells) and changes; both are null for rows that are ragged or have no fields."""
    cells = F.when(~F.col("ragged"), _repaired_cells(F.col(fields))) if "ragged" in own.columns else _repaired_cells(F.col(fields))
    own = own.withColumn("cells", cells).withColumn("cells", _settled_cells(F.col("cells"))).withColumn("cells", _with_genes(F.col("cells"), genes))
    changes = F.flatten(F.transform(F.filter("cells", lambda c: c["hit"]), _changes))
    return own.withColumn("fixed", F.transform("cells", lambda c: F.coalesce(c["gene"], c["once"]))).withColumn("changes", changes).drop("cells")


def solve_rows(rows: DataFrame, header: list[str], fix_genes: bool = True, quarantine_truncated: bool = True, encoding: str = "utf-8", delimiter: str = ",") -> Solution:
    """rows(row_id, fields). Rows of another width than the header are ragged; null fields are empty."""
    width = len(header)
    own = rows.withColumn("fields", F.transform("fields", C.cell)).withColumn("ragged", F.size("fields") != width)

    def narrowed(some: list[int]) -> DataFrame:
        picked = own.select("row_id", F.when(~F.col("ragged"), F.array(*(F.get("fields", F.lit(i)) for i in some))).alias("fields"))
        packed = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.get("fixed", F.lit(k)).alias("v")) for k, i in enumerate(some)))
        return _fixed(picked, "fields", fix_genes).select(F.explode_outer(packed).alias("c")).select("c.*").where("v is not null")

    every = _fixed(own, "fields", fix_genes)  # null for ragged rows
    limits: dict[int, int] = {}
    if quarantine_truncated and width:
        kept = every.select("row_id", F.col("fixed").alias("fields"))
        audits, longest = tabular.audited(tabular.field_cells(kept, header, of_null=False), with_samples=False, narrowed=narrowed)
        cut = [r.col_idx for r in audits.select("col_idx", F.expr("exists(findings, f -> f.mode = 'truncation')").alias("cut")).where("cut").collect()]
        limits = {i: longest[i] for i in cut}
    reason, kind = F.when(F.col("ragged"), F.format_string(f"%d fields where the header has {width}", F.size("fields"))), F.when(F.col("ragged"), "ragged_rows")
    for i, n in sorted(limits.items()):
        hit = F.length(F.get("fixed", F.lit(i))) == n
        reason = reason.when(hit, F.lit(f"value in '{header[i]}' was cut at {n} characters; the rest is not in this file"))
        kind = kind.when(hit, "truncation")
    # as rows of an outer explode, since a condition on them would be worked out below, with all repairs, once more
    verdict = F.explode_outer(F.array(F.struct(reason.alias("reason"), kind.alias("kind")))).alias("verdict")
    return Solution(header, every.select("*", verdict).select(*every.columns, "verdict.*"), {header[i]: n for i, n in limits.items()}, encoding, delimiter)


def solve(spark: SparkSession, source: str | DataFrame | Source, fix_genes: bool = True, quarantine_truncated: bool = True, order_by: str | None = None) -> Solution:
    """A path to a file, a DataFrame, or an opened source with rows."""
    if isinstance(source, str):
        source = open_source(spark, source)[0]
    elif isinstance(source, DataFrame):
        source = from_frame(source, "table", order_by=order_by)
    if source.rows is None:
        raise ValueError(f"{source.name} holds no table")
    return solve_rows(source.rows, source.header, fix_genes, quarantine_truncated, source.encoding, source.delimiter)


def solve_to_tables(spark: SparkSession, source: str | DataFrame | Source, name: str, mode: str = "append", **options) -> dict[str, int]:
    """Clean rows go to the table ``name``, rows put apart to ``name``_quarantine with their reason and time. Counts of both; the session's default table format is used."""
    s = solve(spark, source, **options)
    s.clean.write.mode(mode).saveAsTable(name)
    s.quarantine.withColumn("__quarantined_at", F.current_timestamp()).write.mode(mode).saveAsTable(f"{name}_quarantine")
    c = s.counts().first()
    return {"clean": c.kept, "quarantine": c.quarantined}


def solve_to_files(spark: SparkSession, source: str, out_dir: str, **options) -> dict[str, str]:
    """Folders <stem>.clean, <stem>.quarantine (if any) and <stem>.report under out_dir, as CSV and text."""
    s = solve(spark, source, **options)
    stem = f"{out_dir}/{source.rstrip('/').rsplit('/', 1)[-1].rsplit('.', 1)[0]}"
    paths = {"clean": f"{stem}.clean", "report": f"{stem}.report"}
    s.clean.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(paths["clean"])
    if s.counts().first().quarantined:
        paths["quarantine"] = f"{stem}.quarantine"
        width = max(len(s.header), s.quarantine.agg(F.max(F.size("fields"))).first()[0])
        names = [s.header[i] if i < len(s.header) else f"__field{i}" for i in range(width)]
        s.quarantine.select(*(F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)), "__reason").write.mode("overwrite").option("header", True).csv(paths["quarantine"])
    spark.createDataFrame([(s.report(),)], "value string").write.mode("overwrite").text(paths["report"])
    return paths
