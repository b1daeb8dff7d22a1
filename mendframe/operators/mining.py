"""Rules mined from labelled texts: features that stand in rejected texts and hardly in kept ones. Nothing is applied; rules are proposed.

Each text becomes its category rates, token shapes and markers in the map task; counts by feature use partial sums, so only the
features themselves travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import values as V
from ..functions.cells import cell
from .model import plural

CATEGORY_NAMES = {
    "Cc": "control", "Cf": "format", "Co": "private use", "Cn": "unassigned", "Zs": "space", "So": "symbol", "Sk": "modifier symbol", "Po": "punctuation", "Ps": "open bracket", "Pe": "close bracket",
    "Lu": "uppercase letter", "Ll": "lowercase letter", "Lo": "other letter", "Nd": "digit", "No": "other number", "Sm": "mathematical symbol", "Sc": "currency", "Mn": "combining mark",
}


def labelled(rejected: DataFrame, kept: DataFrame, text: str = "text") -> DataFrame:
    """(text, rejected) of two frames."""
    return rejected.select(cell(text).alias("text"), F.lit(True).alias("rejected")).unionByName(kept.select(cell(text).alias("text"), F.lit(False).alias("rejected")))


def totals(docs: DataFrame) -> DataFrame:
    """n_r and n_k; one row."""
    return docs.agg(F.count_if("rejected").alias("n_r"), F.count_if(~F.col("rejected")).alias("n_k"))


def _gated(rows: DataFrame) -> DataFrame:
    """support, precision and lift gates over r (rejected texts), k (kept texts) and the rates r_rate and k_rate."""
    precision = F.col("r") / (F.col("r") + F.col("k"))
    lift = F.when(F.col("k_rate") > 0, F.try_divide("r_rate", "k_rate")).otherwise(V.MAX_LIFT)
    out = rows.withColumn("support", F.col("r")).withColumn("precision", precision).withColumn("lift", F.least(lift, F.lit(V.MAX_LIFT)))
    return out.where((F.col("r") >= V.MIN_SUPPORT) & (precision >= V.MIN_PRECISION) & (lift >= V.MIN_LIFT))


#: What texts are mined for: kind -> the features of a text as (signature, rate); the rate of what stands in a set is 1.
CLASSES, SHAPES, MARKERS = "character_class", "token_shape", "marker_string"
_FEATURE = "array<struct<kind:string,signature:string,rate:double>>"
_TOTAL = "*"


def _features(kind: str, text: Column) -> Column:
    if kind == CLASSES:
        return F.transform(F.map_entries(T.char_classes(text)), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("signature"), e["value"].alias("rate")))
    found = T.token_shapes(text) if kind == SHAPES else T.markers(text)
    return F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("signature"), F.lit(1.0).alias("rate")))


def mine(docs: DataFrame, *kinds: str) -> DataFrame:
    """kind, signature, support, precision, lift of all features of these kinds, in one reading of docs: (text, rejected).

    A text counts once among the totals as a feature of its own, so that they need no further reading. Categories go by their mean rate
    per 1000 characters, sets by the share of texts.
    """
    total = F.array(F.struct(F.lit(_TOTAL).alias("kind"), F.lit("").alias("signature"), F.lit(1.0).alias("rate")))
    every = F.concat(total.cast(_FEATURE), *(F.coalesce(_features(k, F.col("text")), F.array()).cast(_FEATURE) for k in kinds))
    of = lambda x: F.coalesce(F.sum(F.when(x, F.col("rate"))), F.lit(0.0))
    bad = F.col("rejected")
    sums = (
        docs.select("rejected", F.explode_outer(every).alias("f")).select("rejected", "f.*")
        .groupBy("kind", "signature")
        .agg(F.count_if(bad).alias("r"), F.count_if(~bad).alias("k"), of(bad).alias("r_sum"), of(~bad).alias("k_sum"))
    )
    # a condition on kind would be tested below the sums, and another choice of sums be another shuffle: either would read the texts twice
    whole = F.col("kind") == _TOTAL
    n = sums.agg(*(F.coalesce(F.max(F.when(whole, F.greatest(F.col(x), F.col(f"{x}_sum").cast("long")))), F.lit(0)).alias(f"n_{x}") for x in "rk"))
    rates = sums.withColumn("r", F.when(whole, 0).otherwise(F.col("r"))).join(F.broadcast(n), how="cross").withColumn("r_rate", F.col("r_sum") / F.greatest("n_r", F.lit(1))).withColumn("k_rate", F.col("k_sum") / F.greatest("n_k", F.lit(1)))  # one row broadcast
    common = (F.col("n_r") >= V.MIN_SUPPORT) & ((F.col("kind") != CLASSES) | (F.col("r_rate") >= 0.1))
    return _gated(rates.where(common)).select("kind", "signature", "support", "precision", "lift")


def mine_char_classes(docs: DataFrame) -> DataFrame:
    """kind, signature, support, precision, lift of categories by mean rate per 1000 characters. docs: (text, rejected)."""
    return mine(docs, CLASSES)


def mine_token_shapes(docs: DataFrame) -> DataFrame:
    return mine(docs, SHAPES)


def mine_markers(docs: DataFrame) -> DataFrame:
    return mine(docs, MARKERS)


def propose_rules(rejected: DataFrame, kept: DataFrame, text: str = "text") -> DataFrame:
    """All proposals with their strength (precision x lift up to 20 x root of support), strongest first; none for under eight rejects."""
    return proposals(labelled(rejected, kept, text))


def proposals(docs: DataFrame) -> DataFrame:
    """As propose_rules(), from docs: (text, rejected)."""
    every = mine(docs, CLASSES, SHAPES, MARKERS)
    names = F.create_map(*(F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv))
    text_ = (
        F.when(F.col("kind") == "character_class", F.concat(F.lit("Unicode category "), "signature", F.lit(" ("), F.coalesce(F.element_at(names, F.col("signature")), F.lit("other")), F.lit(") is far commoner in rejects")))
        .when(F.col("kind") == "token_shape", F.concat(F.lit("token shape "), "signature", F.lit(" marks rejects")))
        .otherwise(F.concat(F.lit("marker '"), "signature", F.lit("' stands almost only in rejects")))
    )
    strength = F.col("precision") * F.least("lift", F.lit(20.0)) * F.sqrt("support")
    return every.withColumn("description", text_).withColumn("strength", strength).orderBy(F.desc("strength"), "kind", "signature")


def verdicts(utilities: DataFrame) -> DataFrame:
    """utilities(name, fired, agreed, missed) -> with precision and verdict: retire, noisy, misses more than it finds, or keep."""
    precision = F.try_divide(F.col("agreed").cast("double"), F.col("fired").cast("double"))
    retire = (F.col("fired") == 0) | ((F.col("fired") >= V.USELESS_AFTER) & (F.col("agreed") == 0))
    verdict = F.when(retire, "retire").when(precision < 0.3, "noisy").when(F.col("missed") > F.col("agreed"), "misses more than it finds").otherwise("keep")
    return utilities.withColumn("precision", F.coalesce(precision, F.lit(0.0))).withColumn("verdict", verdict)


def review_detectors(utilities: DataFrame) -> tuple[list[str], list[str]]:
    """Names to keep and names to retire."""
    rows = verdicts(utilities).select("name", "verdict").collect()  # one row per detector
    return [r.name for r in rows if r.verdict != "retire"], [r.name for r in rows if r.verdict == "retire"]


def evolution_report(proposals: DataFrame, utilities: DataFrame | None = None, limit: int = 10) -> str:
    lines = []
    if utilities is not None:
        lines.append("Detectors on this corpus")
        lines += [f"  {r.name}: fired {r.fired}, agreed {r.agreed}, missed {r.missed}: {r.verdict}" for r in verdicts(utilities).orderBy("name").collect()]
    n = proposals.count()
    if not n:
        return "\n".join([*lines, f"No rule proposed: the detectors cover the failures, or there are fewer than {V.MIN_SUPPORT} rejects."])
    lines.append(f"{plural(n, 'candidate rule')}, none of them active; a pattern is not a cause:")
    lines += [f"  {r.description} (support {r.support}, precision {r.precision:.0%}, lift {r.lift:.1f}x)" for r in proposals.orderBy(F.desc("strength")).limit(limit).collect()]
    return "\n".join(lines)
