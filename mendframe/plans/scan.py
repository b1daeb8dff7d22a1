"""Everything under a path, audited and rolled up: tables by column and convention, texts as documents, and findings across files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conventions, crossfile, tabular
from ..operators import model as M
from ..operators.profiles import Profile, apply_profile
from ..operators.text import audit_text
from ..sources.readers import Source, resolve

_KEEP = ["subject", "units", "judged", "findings", "severity", "confidence"]


@dataclass
class ScanResult:
    """audits: a row per source and subject; unreadable: what couldn't be opened, and why."""

    audits: DataFrame | None
    sources: list[Source]
    unreadable: dict[str, str]

    def per_source(self) -> DataFrame:
        """(source, severity, findings, confidence): the worst of each source; sources go by where they come from, not by name."""
        return self.audits.groupBy("source").agg(M.named(F.max(M.rank(F.col("severity")))).alias("severity"), F.sum(F.size("findings")).alias("findings"), F.min("confidence").alias("confidence"))

    def severity(self) -> str:
        if self.audits is None:
            return M.CLEAN
        return self.audits.agg(M.named(F.coalesce(F.max(M.rank(F.col("severity"))), F.lit(0)))).first()[0]

    def report(self, limit: int = 50) -> str:
        lines = [f"{M.plural(len(self.sources), 'source')}, {self.severity()}"]
        if self.audits is not None:
            for r in self.per_source().orderBy(F.desc(M.rank(F.col("severity"))), "confidence", "source").limit(limit).collect():
                lines.append(f"  {r.source}: {r.severity}, {M.plural(r.findings, 'finding')}")
        lines += [f"  {k}: unreadable, {v}" for k, v in self.unreadable.items()]
        return "\n".join(lines)


def audit_source(s: Source) -> DataFrame:
    """Audits of one source."""
    if s.rows is not None:
        long = tabular.field_cells(s.rows, s.header, "row_id")
        breaks = conventions.audit_cell_conventions(long).where(F.size("findings") > 0).select(_KEEP)
        out = tabular.audit_rows(s.rows, s.header, "row_id").select(_KEEP).unionByName(breaks)
    else:
        out = audit_text(s.text.withColumn("name", F.lit(s.name)), "name").select(_KEEP)
    return out.withColumn("source", F.lit(s.origin if "#" not in s.name else f"{s.origin}#{s.name.rsplit('#', 1)[1]}"))


def scan(spark: SparkSession, target: str, profile: Profile | None = None, recursive: bool = True, on_error: str = "report") -> ScanResult:
    """With a profile, severities are rescored for its use and suppressed findings are left out."""
    found = list(resolve(spark, target, recursive, on_error))
    good = [s for s in found if s.kind != "unreadable"]
    parts = [audit_source(s) for s in good]
    tables = [s for s in good if s.rows is not None]
    if len(tables) > 1:
        headers = spark.createDataFrame([(s.origin, s.header) for s in tables], "source string, header array<string>")
        parts.append(crossfile.audit_headers(headers).where(F.size("findings") > 0).select(_KEEP).withColumn("source", F.lit("across files")))
    audits = reduce(DataFrame.unionByName, parts) if parts else None
    if audits is not None and profile is not None:
        audits = apply_profile(audits, profile).select(*_KEEP, "source")
    return ScanResult(audits, good, {s.origin: "; ".join(s.notes) for s in found if s.kind == "unreadable"})
