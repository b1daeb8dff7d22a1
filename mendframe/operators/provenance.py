"""What happened to each cell: notes of repairs and refusals, and writers that carry them along.

Notes are made from the original and the repaired cell of the same row, in one pass and without a join; a refused mode notes the cells
that are its evidence. Writers join notes to rows by the row key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import values as V
from . import repair as R

#: Of a CSV file. Values may hold line breaks, so that a file is read by one task; it grows with no table.
ROWS_PER_FILE = 100_000


def _rank():
    return F.when(F.col("action") == "unrepairable", 0).when(F.col("action") == "flagged", 1).otherwise(2)


@dataclass
class Annotated:
    """rows: the repaired table with its row key; notes: (row_key, column, original, value, mode, action, recoverability, note)."""

    rows: DataFrame
    notes: DataFrame
    order_by: str

    def changed_cells(self) -> DataFrame:
        return self.notes.where("action <> 'unrepairable'")

    def needs_review(self) -> DataFrame:
        return self.notes.where("action in ('unrepairable', 'flagged')")

    def summary(self) -> DataFrame:
        return self.notes.groupBy("mode", "action").agg(F.count(F.lit(1)).alias("cells"))


def _limits(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """The length at which each of these columns was cut: that of its longest filled cell."""
    if not columns:
        return {}
    cells = {c: C.cell(F.col(f"`{c}`")) for c in columns}
    row = df.agg(*(F.max(F.when(~C.is_blank(v), F.length(v))).alias(f"n{i}") for i, v in enumerate(cells.values()))).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i]}


def annotate(df: DataFrame, audits: DataFrame, order_by: str, allow_lossy: bool = False) -> Annotated:
    """df: text columns and a row key. Each changed cell is noted with the repair that changed it last; evidence of a refused mode is noted as it stands."""
    fixed = R.repair_columns(df, audits, allow_lossy, order_by)
    widths = R.modal_widths(df, [c for c, m in fixed.modes.items() if "leading_zero_loss" in m], order_by) if allow_lossy else {}
    parts, limits = [], _limits(df, [c for c, m in fixed.modes.items() if "truncation" in m])
    for c, modes in fixed.modes.items():
        v = C.cell(F.col(f"`{c}`"))
        steps = R.steps(c, modes, widths)
        if steps:
            final = steps[-1][2]
            mode = F.coalesce(*(F.when(a != b, F.lit(m)) for m, a, b in reversed(steps)))
            parts.append(F.when(v != final, F.struct(F.lit(c).alias("column"), v.alias("original"), final.alias("value"), mode.alias("mode"))))
        for m in modes:
            if m in V.IRRECOVERABLE:
                on = {"excel_date_corruption": C.is_excel_date(v), "truncation": F.length(v) == limits.get(c, -1)}.get(m)
                if on is not None:
                    parts.append(F.when(on, F.struct(F.lit(c).alias("column"), v.alias("original"), v.alias("value"), F.lit(m).alias("mode"))))
    kind = "array<struct<column:string,original:string,value:string,mode:string>>"
    each = df.select(F.col(order_by).alias("row_key"), F.explode(F.array_compact(F.array(*parts)).cast(kind) if parts else F.array().cast(kind)).alias("n")).select("row_key", "n.*")
    refused = F.col("mode").isin(*V.IRRECOVERABLE)
    text = F.create_map(*(F.lit(x) for m in R.NOTES for x in (m, R.NOTES[m])), *(F.lit(x) for m in V.IRRECOVERABLE for x in (m, " -> ".join(R.REFUSALS[m]))))
    notes = (
        each.withColumn("action", F.when(refused, "unrepairable").when(F.col("mode") == "leading_zero_loss", "flagged").otherwise("repaired"))
        .withColumn("recoverability", F.when(refused, R.IRRECOVERABLE).when(F.col("mode") == "leading_zero_loss", R.LOSSY).otherwise(R.REVERSIBLE))
        .withColumn("note", F.element_at(text, F.col("mode")))
    )
    return Annotated(fixed.df, notes, order_by)


def with_originals(ann: Annotated) -> DataFrame:
    """Rows with <column>__original for each column that was changed (null where the cell wasn't)."""
    changed = ann.changed_cells()
    columns = sorted(r[0] for r in changed.select("column").distinct().collect())  # at most the table's columns
    if not columns:
        return ann.rows
    wide = changed.groupBy("row_key").agg(*(F.first(F.when(F.col("column") == c, F.col("original")), ignorenulls=True).alias(f"{c}__original") for c in columns))
    return ann.rows.join(wide.withColumnRenamed("row_key", ann.order_by), ann.order_by, "left")


def provenance_records(ann: Annotated) -> DataFrame:
    """(row_key, record): a JSON record per row, with _provenance where notes exist."""
    entry = F.struct(*(F.col(c) for c in ("column", "original", "value", "mode", "action", "recoverability", "note")))
    notes = ann.notes.groupBy("row_key").agg(F.array_sort(F.collect_list(entry)).alias("_provenance")).withColumnRenamed("row_key", "_mf_key")
    joined = ann.rows.join(notes, F.col(ann.order_by) == F.col("_mf_key"), "left")
    return joined.select(F.col(ann.order_by).alias("row_key"), F.to_json(F.struct(*(F.col(c) for c in ann.rows.columns), "_provenance")).alias("record"))


def write_csv(ann: Annotated, path: str, inline: bool = False) -> tuple[str, str]:
    """The table and its notes as two folders of CSV files: path and path.provenance."""
    for df, folder in ((with_originals(ann) if inline else ann.rows, path), (ann.notes, f"{path}.provenance")):
        df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(folder)
    return path, f"{path}.provenance"


def write_jsonl(ann: Annotated, path: str) -> str:
    provenance_records(ann).select("record").write.mode("overwrite").text(path)
    return path


def review_queue(ann: Annotated, limit: int = 200) -> DataFrame:
    """The first notes to look at: what can't be repaired, then what was guessed, then repairs; a top-k, not a full sort."""
    return ann.notes.withColumn("priority", _rank()).orderBy("priority", "column", "row_key").limit(limit)


def review_sheet(ann: Annotated, limit: int = 200) -> str:
    """The review queue as a markdown table."""
    rows = review_queue(ann, limit).collect()
    lines = ["| row | column | original | value | mode | action |", "|---|---|---|---|---|---|"]
    esc = lambda x: str(x).replace("|", "\\|").replace("\n", " ")[:80]
    lines += [f"| {r.row_key} | {esc(r.column)} | {esc(r.original)} | {esc(r.value)} | {r.mode} | {r.action} |" for r in rows]
    return "\n".join(lines)


def latest(notes: DataFrame) -> DataFrame:
    """Of several notes of one cell the most serious."""
    w = Window.partitionBy("row_key", "column").orderBy(_rank())
    return notes.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
