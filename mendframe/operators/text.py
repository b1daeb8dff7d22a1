"""Audits of extracted texts: undecodable characters, shattered words, lost digits. One row in, one row out; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import values as V
from ..functions.cells import cell
from . import model as M


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds tokens, judged, glyph_rate, fragment_ratio, digit_rate and the fragment mask; null texts are empty."""
    body = cell(text)
    df = df.withColumn("_body", body).withColumn("tokens", T.token_count(F.col("_body"))).withColumn("_mask", T.fragment_mask(F.col("_body")))
    return (
        df.withColumn("judged", F.col("tokens") >= V.THRESHOLDS["min_tokens"])
        .withColumn("glyph_rate", T.glyph_rate(F.col("_body")))
        .withColumn("fragment_ratio", T.fragment_ratio(F.col("_mask")))
        .withColumn("digit_rate", T.digit_rate(F.col("_body"), F.col("tokens")))
    )


def _two(rate: Column, suspect: float, corrupt: float, below: bool = False) -> tuple[Column, Column, Column]:
    """Whether a rate is a finding, its severity, and the threshold that it crossed."""
    bad = rate <= corrupt if below else rate >= corrupt
    return (rate <= suspect if below else rate >= suspect), F.when(bad, M.CORRUPT).otherwise(M.SUSPECT), F.when(bad, corrupt).otherwise(suspect)


def text_findings(subject: Column, t: dict[str, float] | None = None, with_samples: bool = True) -> Column:
    """The findings array over the columns of text_features()."""
    t = V.THRESHOLDS | (t or {})
    c = F.col
    none = F.array().cast("array<string>")
    g_on, g_sev, g_t = _two(c("glyph_rate"), t["glyph_suspect"], t["glyph_corrupt"])
    s_on, s_sev, s_t = _two(c("fragment_ratio"), t["shattered_suspect"], t["shattered_corrupt"])
    d_on, d_sev, d_t = _two(c("digit_rate"), t["numeric_loss_suspect"], t["numeric_loss_corrupt"], below=True)
    return M.gather(
        F.when(g_on, M.finding("missing_glyph", g_sev, c("glyph_rate"), g_t, F.format_string("%.2f undecodable characters per 1000", "glyph_rate"), T.glyph_samples(c("_body")) if with_samples else none, subject)),
        F.when(s_on, M.finding("shattered_words", s_sev, c("fragment_ratio"), s_t, F.format_string("%.1f%% of words stand in runs of fragments", c("fragment_ratio") * 100), T.fragment_samples(c("_body"), c("_mask")) if with_samples else none, subject)),
        F.when((c("digit_rate") >= 0) & d_on, M.finding("numeric_loss", d_sev, c("digit_rate"), d_t, F.format_string("only %.3f%% of tokens hold a digit", c("digit_rate") * 100), none, subject)),
    )


def audit_text(df: DataFrame, subject: str, text: str = "text", thresholds: dict[str, float] | None = None, with_samples: bool = True) -> DataFrame:
    """A row per text: subject, units (tokens), judged, findings, severity, confidence."""
    own = text_features(df.select(F.col(subject).cast("string").alias("subject"), F.col(text).alias("text")))
    return M.scored(own.select("subject", F.col("tokens").alias("units"), "judged", text_findings(F.col("subject"), thresholds, with_samples).alias("findings")))


def audit_pages(df: DataFrame, doc: str, page_no: str, text: str = "text", with_samples: bool = True) -> DataFrame:
    """A row per page: doc, page_no and the audit; the subject is ``page n``."""
    own = text_features(df.select(F.col(doc).alias("doc"), F.col(page_no).alias("page_no"), F.concat(F.lit("page "), F.col(page_no).cast("string")).alias("subject"), F.col(text).alias("text")))
    return M.scored(own.select("doc", "page_no", "subject", F.col("tokens").alias("units"), "judged", text_findings(F.col("subject"), None, with_samples).alias("findings")))
