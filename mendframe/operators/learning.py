"""Thresholds learnt from keep and discard labels, an append-only log of features, and the loop of audit, label and refit.

The sweep over all candidate thresholds of all features is one sort: cumulative counts over each feature's distinct values give the
balanced accuracy of every cut, so labels are never looped over on the driver.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from . import model as M
from .text import text_features, text_findings

ABOVE, BELOW = "above_is_bad", "below_is_bad"
LOG_SCHEMA = "record_id string, subject string, detector string, features map<string,double>, severity string, ts double, label string, note string"


class Detector(Protocol):
    """What the pipeline runs. features() adds a map column ``features`` to rows with ``subject``; findings() reads thresholds."""

    name: str

    def features(self, artifacts: DataFrame) -> DataFrame: ...

    def findings(self, thresholds: dict[str, float]) -> Column: ...

    def default_thresholds(self) -> dict[str, float]: ...

    def directions(self) -> dict[str, str]: ...


class TextDetector:
    """The text audit as a detector; artifacts are (subject, text)."""

    name = "text"

    def features(self, artifacts: DataFrame) -> DataFrame:
        own = text_features(artifacts)
        return own.withColumn("features", F.create_map(*(x for c in ("glyph_rate", "fragment_ratio", "digit_rate") for x in (F.lit(c), F.col(c)))))

    def findings(self, thresholds: dict[str, float]) -> Column:
        t = {"glyph_suspect": thresholds["glyph_rate"], "shattered_suspect": thresholds["fragment_ratio"], "numeric_loss_suspect": thresholds["digit_rate"]}
        t |= {"glyph_corrupt": max(t["glyph_suspect"], V.THRESHOLDS["glyph_corrupt"]), "shattered_corrupt": max(t["shattered_suspect"], V.THRESHOLDS["shattered_corrupt"]), "numeric_loss_corrupt": min(t["numeric_loss_suspect"], V.THRESHOLDS["numeric_loss_corrupt"])}
        return text_findings(F.col("subject"), t, with_samples=False)

    def default_thresholds(self) -> dict[str, float]:
        t = V.THRESHOLDS
        return {"glyph_rate": t["glyph_suspect"], "fragment_ratio": t["shattered_suspect"], "digit_rate": t["numeric_loss_suspect"]}

    def directions(self) -> dict[str, str]:
        return {"glyph_rate": ABOVE, "fragment_ratio": ABOVE, "digit_rate": BELOW}


class TabularDetector:
    """Table features as a detector; artifacts are (subject, mojibake_rate, null_string, ragged, excel_date), a row per table (see table_features)."""

    name = "tabular"
    rates = ("mojibake_rate", "null_string", "ragged", "excel_date")

    def features(self, artifacts: DataFrame) -> DataFrame:
        return artifacts.withColumn("features", F.create_map(*(x for c in self.rates for x in (F.lit(c), F.col(c).cast("double")))))

    def findings(self, thresholds: dict[str, float]) -> Column:
        modes = {"mojibake_rate": "mojibake", "null_string": "null_as_string", "ragged": "ragged_rows", "excel_date": "excel_date_corruption"}
        value = lambda c: F.element_at("features", c)
        return M.gather(*(F.when((value(c) > 0) & (value(c) >= thresholds[c]), M.finding(m, M.CORRUPT if c == "excel_date" else M.SUSPECT, value(c), thresholds[c], location=F.col("subject"))) for c, m in modes.items()))

    def default_thresholds(self) -> dict[str, float]:
        t = V.THRESHOLDS
        return {"mojibake_rate": t["mojibake_suspect"], "null_string": t["null_string"], "ragged": t["ragged_suspect"], "excel_date": t["excel_date"]}

    def directions(self) -> dict[str, str]:
        return dict.fromkeys(self.rates, ABOVE)


def counted(labelled: DataFrame) -> DataFrame:
    """labelled(feature, value, bad) -> (feature, value, b, g): bad and good items of each value. All that is learnt follows from these, so that features are worked out once and Spark reuses the shuffle."""
    return labelled.groupBy("feature", "value").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g"))


def threshold_sweep(labelled: DataFrame, directions: dict[str, str]) -> DataFrame:
    """labelled(feature, value, bad) -> (feature, candidate, midpoint, balanced): every distinct value, and every midpoint of neighbours.

    An item counts as flagged at the candidate or beyond it in the feature's direction. Sorted once by feature and value; values of
    one feature are pre-counted, so its window holds distinct values only.
    """
    return _sweep(counted(labelled), directions)


def _sweep(values: DataFrame, directions: dict[str, str]) -> DataFrame:
    w = Window.partitionBy("feature")
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.withColumns({"b_upto": F.sum("b").over(upto), "g_upto": F.sum("g").over(upto), "b_all": F.sum("b").over(w), "g_all": F.sum("g").over(w), "next": F.lead("value").over(w.orderBy("value"))})
    below = F.col("feature").isin(*([f for f, d in directions.items() if d == BELOW] or [""]))
    at = rows.select("feature", F.explode(F.array(F.struct(F.col("value").alias("candidate"), F.lit(False).alias("midpoint")), F.struct(((F.col("value") + F.col("next")) / 2).alias("candidate"), F.lit(True).alias("midpoint")))).alias("c"), "b", "g", "b_upto", "g_upto", "b_all", "g_all")
    at = at.select("feature", "c.*", "b", "g", "b_upto", "g_upto", "b_all", "g_all").where("candidate is not null")
    b_above = F.col("b_all") - F.col("b_upto") + F.when(F.col("midpoint"), 0).otherwise(F.col("b"))
    g_above = F.col("g_all") - F.col("g_upto") + F.when(F.col("midpoint"), 0).otherwise(F.col("g"))
    tp = F.when(below, F.col("b_upto")).otherwise(b_above)
    fp = F.when(below, F.col("g_upto")).otherwise(g_above)
    return at.select("feature", "candidate", "midpoint", balanced(tp, F.col("b_all"), fp, F.col("g_all")).alias("balanced"))


def balanced(tp: Column, bad: Column, fp: Column, good: Column) -> Column:
    """(sensitivity + specificity) / 2; an empty class counts 0."""
    share = lambda a, n: F.coalesce(F.try_divide(a.cast("double"), n.cast("double")), F.lit(0.0))
    return (share(tp, bad) + share(good - fp, good)) / 2


def baseline(labelled: DataFrame, defaults: dict[str, float], directions: dict[str, str]) -> DataFrame:
    """(feature, default, before): the balanced accuracy of each default."""
    return _baseline(counted(labelled), defaults, directions)


def _baseline(values: DataFrame, defaults: dict[str, float], directions: dict[str, str]) -> DataFrame:
    table = F.create_map(*(F.lit(x) for f, v in defaults.items() for x in (f, float(v))))
    below = F.col("feature").isin(*([f for f, d in directions.items() if d == BELOW] or [""]))
    flagged = F.when(below, F.col("value") <= F.col("default")).otherwise(F.col("value") >= F.col("default"))
    own = values.withColumn("default", F.element_at(table, F.col("feature"))).withColumn("flagged", flagged)
    some = lambda n: F.coalesce(F.sum(F.when(F.col("flagged"), F.col(n))), F.lit(0))
    return own.groupBy("feature", "default").agg(balanced(some("b"), F.sum("b"), some("g"), F.sum("g")).alias("before"))


def learned_thresholds(labelled: DataFrame, defaults: dict[str, float], directions: dict[str, str]) -> DataFrame:
    """(feature, default, before, threshold, after, adopted): the best cut of each feature, adopted if it gains 0.03 or more.

    Of equally good cuts the first counts: values before midpoints, each from the least up. Without 40 labels, ten of each class, nothing is adopted.
    """
    values = counted(labelled)
    sweep = _sweep(values, directions)
    best = sweep.groupBy("feature").agg(F.max("balanced").alias("after"), F.min_by("candidate", F.struct((-F.col("balanced")).alias("a"), F.col("midpoint").alias("b"), F.col("candidate").alias("c"))).alias("threshold"))
    size = values.groupBy("feature").agg(F.sum("b").alias("n_bad"), F.sum("g").alias("n_good"))
    enough = (F.col("n_bad") + F.col("n_good") >= V.MIN_LABELS) & (F.least("n_bad", "n_good") >= V.MIN_PER_CLASS)
    joined = _baseline(values, defaults, directions).join(best, "feature").join(size, "feature")
    return joined.select("feature", "default", "before", "threshold", "after", (enough & (F.col("after") >= F.col("before") + V.MIN_GAIN)).alias("adopted"))


class FeedbackLog:
    """Records as parquet files in a folder, appended and never rewritten; of a record's lines the last counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, records: DataFrame) -> None:
        """records: the columns of LOG_SCHEMA but for those left out, which are null."""
        fields = self.spark.createDataFrame([], LOG_SCHEMA).schema
        own = records.select(*(F.col(f.name).cast(f.dataType) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        own.withColumn("seq", F.lit(time.time_ns())).write.mode("append").parquet(self.path)

    def lines(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG_SCHEMA + ", seq long").parquet(self.path)
        except Exception as e:  # a log without a line has no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG_SCHEMA + ", seq long")

    def all(self) -> DataFrame:
        """The latest line of each record."""
        last = Window.partitionBy("record_id").orderBy(F.desc("seq"))
        return self.lines().withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")

    def labelled(self) -> DataFrame:
        return self.all().where("label is not null")

    def unlabelled(self) -> DataFrame:
        return self.all().where("label is null")


class Pipeline:
    """Audits artifacts with detectors whose thresholds follow the labels in the log."""

    def __init__(self, spark: SparkSession, detectors: list[Detector], log: FeedbackLog | None = None, on_quarantine: Callable[[DataFrame], None] | None = None):
        self.spark, self.detectors, self.log, self.on_quarantine = spark, detectors, log, on_quarantine
        self._cache: dict[tuple[str, int], dict[str, float]] = {}

    def _labelled(self, d: Detector) -> DataFrame:
        features = d.default_thresholds()
        own = self.log.labelled().where((F.col("detector") == d.name) & F.col("label").isin("keep", "discard"))
        each = F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.element_at("features", f), F.lit(0.0)).alias("value")) for f in features))
        return own.select((F.col("label") == "discard").alias("bad"), F.explode(each).alias("x")).select("x.feature", "x.value", "bad")

    def fit(self, d: Detector) -> DataFrame:
        """A row per feature of what labels say about its threshold."""
        return learned_thresholds(self._labelled(d), d.default_thresholds(), d.directions())

    def thresholds_for(self, d: Detector) -> dict[str, float]:
        """Defaults, with the adopted thresholds over them; fitted again only when the number of labels has changed."""
        if self.log is None:
            return d.default_thresholds()
        key = (d.name, self.log.labelled().count())
        if key not in self._cache:
            adopted = {r.feature: r.threshold for r in self.fit(d).where("adopted").collect()} if key[1] >= V.MIN_LABELS else {}
            self._cache[key] = d.default_thresholds() | adopted
        return self._cache[key]

    def audit(self, artifacts: DataFrame) -> DataFrame:
        """record_id, subject, detector, features, findings, severity, confidence of each artifact and detector; features go to the log, verdicts don't."""
        parts = []
        for d in self.detectors:
            own = d.features(artifacts).withColumn("findings", d.findings(self.thresholds_for(d)))
            record = F.concat_ws("-", F.lit(d.name), F.col("subject"), F.lit(uuid.uuid4().hex))
            parts.append(M.scored(own.select(record.alias("record_id"), F.col("subject").cast("string").alias("subject"), F.lit(d.name).alias("detector"), "features", "findings")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if self.log is not None:
            self.log.append(out.select("record_id", "subject", "detector", "features", "severity", F.lit(time.time()).alias("ts")))
        if self.on_quarantine:
            self.on_quarantine(out.where(F.col("severity") == M.CORRUPT))
        return out

    def quarantine(self, limit: int = 50) -> DataFrame:
        """Unlabelled records that aren't clean, worst and newest first."""
        own = self.log.unlabelled().where(F.col("severity") != M.CLEAN)
        return own.orderBy(F.desc(M.rank(F.col("severity"))), F.desc("ts"), "record_id").limit(limit)

    def label(self, record_id: str, label: str, note: str = "") -> None:
        if self.log is None:
            raise RuntimeError("a pipeline without a log can't be taught")
        own = self.log.all().where(F.col("record_id") == record_id)
        if not own.limit(1).count():
            raise KeyError(record_id)
        self.log.append(own.withColumn("label", F.lit(label)).withColumn("note", F.lit(note)))

    def label_many(self, labels: DataFrame) -> None:
        """labels(record_id, label): one append for all of them."""
        if self.log is None:
            raise RuntimeError("a pipeline without a log can't be taught")
        self.log.append(self.log.all().drop("label").join(labels.select("record_id", "label"), "record_id"))

    def learning_report(self) -> str:
        lines = []
        for d in self.detectors:
            n = self.log.labelled().where(F.col("detector") == d.name).count() if self.log else 0
            lines.append(f"{d.name}: {M.plural(n, 'label')}")
            if self.log and n >= V.MIN_LABELS:
                lines += [f"  {r.feature}: {r.default} -> {r.threshold:.4g} ({r.before:.2f} -> {r.after:.2f})" + ("" if r.adopted else ", not adopted") for r in self.fit(d).orderBy("feature").collect()]
            else:
                lines.append(f"  defaults hold until there are {V.MIN_LABELS}")
        return "\n".join(lines)
