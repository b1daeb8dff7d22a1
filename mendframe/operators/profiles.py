"""Severity for a declared use: a mode's weight raises, lowers or suppresses its findings.

A weight of 0 suppresses, 2 or more raises by a rank, 0.5 or less lowers by one. Suppressed findings are kept apart with their own
severity. Weights are literals of the plan (a map of tens of entries), so nothing is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from . import model as M


@dataclass(frozen=True)
class Profile:
    name: str
    weights: tuple[tuple[str, float], ...] = ()

    def weight_for(self, mode: str) -> float:
        return dict(self.weights).get(mode, 1.0)

    def weight(self, mode: Column) -> Column:
        if not self.weights:
            return F.lit(1.0)
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for m, w in self.weights for x in (m, float(w)))), mode), F.lit(1.0))


PROFILES = {use: Profile(use, tuple((mode, float(w[i])) for mode, w in V.WEIGHTS.items())) for i, use in enumerate(V.USES)}
RAW = Profile("raw")
ALL = (*PROFILES.values(), RAW)


def custom(name: str, **weights: float) -> Profile:
    return Profile(name, tuple(sorted(weights.items())))


def rescored(severity: Column, weight: Column) -> Column:
    step = F.when(weight >= 2, 1).when(weight <= 0.5, -1).otherwise(0)
    return M.named(F.greatest(F.lit(0), F.least(F.lit(2), M.rank(severity) + step)))


def apply_profile(audits: DataFrame, profile: Profile) -> DataFrame:
    """Audits with findings rescored, the suppressed ones in ``suppressed``, severity and confidence of what is reported, and usable."""
    w = lambda f: profile.weight(f["mode"])
    out = audits.withColumn("suppressed", F.filter("findings", lambda f: w(f) == 0))
    out = out.withColumn("findings", F.transform(F.filter("findings", lambda f: w(f) != 0), lambda f: f.withField("severity", rescored(f["severity"], w(f)))))
    return M.scored(out).withColumn("profile", F.lit(profile.name)).withColumn("usable", F.col("severity") != M.CORRUPT)


def compare_profiles(audits: DataFrame, profiles: tuple[Profile, ...] = ALL) -> DataFrame:
    """A row per profile, in the order given: profile, worst, reported, blockers (sorted corrupt modes, or -). One pass over the findings."""
    f = M.exploded(audits, "subject")
    packed = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(p.name).alias("profile"), p.weight(F.col("mode")).alias("w")) for i, p in enumerate(profiles)))
    rows = f.select("mode", "severity", F.explode(packed).alias("p")).select("mode", "p.k", "p.profile", "p.w", rescored(F.col("severity"), F.col("p.w")).alias("now"))
    on = F.col("w") != 0
    counted = rows.groupBy("k").agg(
        F.max(F.when(on, M.rank(F.col("now")))).alias("worst"),
        F.count_if(on).alias("reported"),
        F.array_sort(F.collect_set(F.when(on & (F.col("now") == M.CORRUPT), F.col("mode")))).alias("modes"),
    )
    every = audits.sparkSession.createDataFrame([(i, p.name) for i, p in enumerate(profiles)], "k int, profile string")
    joined = every.join(counted, "k", "left")
    return joined.orderBy("k").select("profile", M.named(F.coalesce("worst", F.lit(0))).alias("worst"), F.coalesce("reported", F.lit(0).cast("long")).alias("reported"), F.when(F.size("modes") > 0, F.array_join("modes", ", ")).otherwise("-").alias("blockers"))
