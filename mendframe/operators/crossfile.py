"""Findings across tables: fields named differently, and layouts that disagree. Input: headers(source, header array<string>), a row per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model as M


def field_spellings(headers: DataFrame) -> DataFrame:
    """(key, spellings): fields spelt more than one way across tables; the key is the name in lower case, letters and digits only."""
    names = headers.select(F.explode("header").alias("name")).withColumn("key", F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]", "")).where("key <> ''")
    return names.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("spellings")).where(F.size("spellings") > 1)


def layouts(headers: DataFrame) -> DataFrame:
    """(layout, n, first): tables by their sorted lower-case names."""
    return headers.groupBy(F.array_sort(F.transform("header", F.lower)).alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("first"))


def odd_sources(headers: DataFrame) -> DataFrame:
    """(source): tables beside the commonest layout, if at least two tables and 60 % of all have that layout. Of equals the one with the least source counts."""
    by = layouts(headers)
    top = by.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.max("n").alias("most"), F.min_by("layout", F.struct((-F.col("n")).alias("a"), "first")).alias("common"))
    # one row, so Spark broadcasts it
    joined = headers.withColumn("layout", F.array_sort(F.transform("header", F.lower))).join(F.broadcast(top), how="cross")
    return joined.where("kinds > 1 and most >= 2 and most >= 0.6 * all and layout <> common").select("source")


def audit_headers(headers: DataFrame) -> DataFrame:
    """One audit row, subject ``across files``; findings need two tables or more."""
    spelt, odd = field_spellings(headers).select(F.array_join("spellings", " / ").alias("x")), odd_sources(headers).select(F.col("source").alias("x"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    first = lambda df, name: df.orderBy("x").limit(5).agg(F.array_sort(F.collect_list("x")).alias(name))
    row = count(headers, "units")
    for one in (count(spelt, "fields"), first(spelt, "spelt"), count(odd, "odd"), first(odd, "who")):
        row = row.join(one, how="cross")  # one row each
    found = M.gather(
        F.when((F.col("units") > 1) & (F.col("fields") > 0), M.finding("inconsistent_headers", M.SUSPECT, F.col("fields"), None, F.format_string("%d fields are named differently across files", "fields"), F.col("spelt"), "across files")),
        F.when((F.col("units") > 1) & (F.col("odd") > 0), M.finding("odd_file_out", M.SUSPECT, F.col("odd"), None, F.format_string("%d files have another layout than the rest", "odd"), F.col("who"), "across files")),
    )
    return M.scored(row.select(F.lit("across files").alias("subject"), "units", F.lit(True).alias("judged"), found.alias("findings")))
