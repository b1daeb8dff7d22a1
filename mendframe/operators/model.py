"""Findings, severity, confidence and roll-ups.

An audit is a row: subject, units, judged, findings (array of structs), severity, confidence. The worst finding decides; averages
never soften it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLEAN, SUSPECT, CORRUPT = "clean", "suspect", "corrupt"
RANK = {CLEAN: 0, SUSPECT: 1, CORRUPT: 2}
FINDING = "struct<mode:string,severity:string,metric:double,threshold:double,detail:string,samples:array<string>,location:string>"
FINDINGS = f"array<{FINDING}>"


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(mode: str, severity, metric, threshold, detail="", samples=None, location="") -> Column:
    samples = F.array().cast("array<string>") if samples is None else samples
    return F.struct(
        F.lit(mode).alias("mode"),
        _text(severity).alias("severity"),
        (metric if isinstance(metric, Column) else F.lit(metric)).cast("double").alias("metric"),
        (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double").alias("threshold"),
        _text(detail).alias("detail"),
        samples.alias("samples"),
        _text(location).alias("location"),
    ).cast(FINDING)


def gather(*found: Column) -> Column:
    """An array of the findings that are not null."""
    return F.array_compact(F.array(*found)).cast(FINDINGS)


def rank(severity: Column) -> Column:
    return F.when(severity == CORRUPT, 2).when(severity == SUSPECT, 1).otherwise(0)


def named(rank_: Column) -> Column:
    return F.element_at(F.array(F.lit(CLEAN), F.lit(SUSPECT), F.lit(CORRUPT)), (rank_ + 1).cast("int"))


def severity(findings: Column) -> Column:
    """The worst severity of an array of findings."""
    return named(F.coalesce(F.array_max(F.transform(findings, lambda f: rank(f["severity"]))), F.lit(0)))


def penalty(sev: Column, metric: Column, threshold: Column) -> Column:
    over = F.when(metric.isNotNull() & (F.coalesce(threshold, F.lit(0.0)) != 0), F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.abs(F.try_divide(metric, threshold))))).otherwise(1.0)
    return F.when(sev == CORRUPT, 0.45).otherwise(0.15) * over


def confidence(findings: Column) -> Column:
    """1 for no findings; each takes off by severity and by how far it is past its threshold, three times at most."""
    left = F.aggregate(findings, F.lit(1.0), lambda acc, f: acc - penalty(f["severity"], f["metric"], f["threshold"]))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), left))


def scored(audits: DataFrame) -> DataFrame:
    """Adds severity and confidence to rows with findings."""
    return audits.withColumn("severity", severity(F.col("findings"))).withColumn("confidence", confidence(F.col("findings")))


def exploded(audits: DataFrame, *keys: str) -> DataFrame:
    """A row per finding: the keys (subject by default) and the finding's fields.

    An inner explode would make Spark test the array below it first, and so work out every finding twice.
    """
    keys = keys or ("subject",)
    return audits.select(*keys, F.explode_outer("findings").alias("f")).where("f is not null").select(*keys, "f.*")


def plural(n: int, noun: str) -> str:
    return f"{n:,} {noun}" if n == 1 else f"{n:,} {noun}s"


def summarise(audits: DataFrame, flagged: bool = True) -> DataFrame:
    """One row: severity, artifacts, artifacts_judged, confidence, modes (mode -> count), flagged (subjects with findings, sorted; empty if not asked for).

    The mean confidence is over judged artifacts, or over all if none was judged, rounded to three places; 1 for no artifact.
    flagged grows with the number of flagged artifacts; for many leave it out and use ``audits.where(size(findings) > 0)``.
    """
    modes = exploded(audits).groupBy("mode").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mode", "n")))).alias("modes"))
    judged = F.count_if("judged")
    mean = F.when(judged > 0, F.avg(F.when(F.col("judged"), F.col("confidence")))).otherwise(F.avg("confidence"))
    rolled = audits.agg(
        named(F.coalesce(F.max(rank(F.col("severity"))), F.lit(0))).alias("severity"),
        F.count(F.lit(1)).alias("artifacts"),
        F.when(judged > 0, judged).otherwise(F.count(F.lit(1))).alias("artifacts_judged"),
        F.coalesce(F.round(mean, 3), F.lit(1.0)).alias("confidence"),
        (F.array_sort(F.collect_list(F.when(F.size("findings") > 0, F.col("subject")))) if flagged else F.array().cast("array<string>")).alias("flagged"),
    )
    return rolled.join(modes, how="cross")  # one row on each side


def worst_first(audits: DataFrame) -> DataFrame:
    return audits.orderBy(F.desc(rank(F.col("severity"))), "confidence", "subject")


def report(audits: DataFrame, limit: int = 50) -> str:
    """The worst artifacts as text; only ``limit`` rows come to the driver."""
    s = summarise(audits, flagged=False).first()
    lines = [f"{s.severity}: {plural(s.artifacts, 'artifact')}, {s.artifacts_judged} judged, confidence {s.confidence:.3f}"]
    for r in worst_first(audits).limit(limit).collect():
        state = f"{r.severity}, confidence {r.confidence:.2f}" if r.judged else "not judged: too little data"
        lines.append(f"{r.subject}: {state} ({plural(r.units, 'unit')})")
        lines += [f"  [{f.severity}] {f.mode}: {f.detail}" for f in r.findings]
    return "\n".join(lines)
