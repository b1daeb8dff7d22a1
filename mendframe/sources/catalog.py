"""Tables of the session's catalogue or of a database behind JDBC, read as text and audited."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cell
from ..operators import model as M
from ..operators.conventions import audit_conventions
from ..operators.tabular import audit_columns

_PART = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Rows after which reads stop unless told otherwise.
LIMIT = 100_000
_LOG = logging.getLogger("mendframe")


def _upto(df: DataFrame, limit: int | None, what: str) -> DataFrame:
    if limit is None:
        return df
    _LOG.warning("%s: reads stop at %d rows; limit=None reads all", what, limit)
    return df.limit(limit)


def quote_ident(name: str) -> str:
    """A dotted name in backticks; any part beyond letters, digits and underscores is refused."""
    parts = name.split(".")
    if not all(_PART.fullmatch(p) for p in parts):
        raise ValueError(f"not a plain identifier: {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(cell(F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_rows(spark: SparkSession, query: str, params: dict | None = None, limit: int | None = LIMIT) -> DataFrame:
    """A query's rows as text. Parameters are bound, never pasted. limit None: all rows."""
    return _upto(as_text(spark.sql(query, args=params or {})), limit, "query")


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, limit: int | None = LIMIT, **partition) -> DataFrame:
    """A table behind JDBC as text; partition: column, lowerBound, upperBound, numPartitions for a parallel read."""
    quote_ident(table)
    df = as_text(spark.read.jdbc(url, table, properties={"fetchsize": "10000"} | (properties or {}), **partition))
    return _upto(df, limit, table)


def audit_query(df: DataFrame, name: str, order_by: str | None = None, with_samples: bool = False) -> DataFrame:
    """Column audits and broken conventions of one table, with its name; conventions count only where they have findings."""
    keep = ["subject", "units", "judged", "findings", "severity", "confidence"]
    columns = audit_columns(df, order_by=order_by, with_samples=with_samples).select(keep)
    breaks = audit_conventions(df, order_by=order_by, with_samples=with_samples).where(F.size("findings") > 0).select(keep)
    return columns.unionByName(breaks).withColumn("table", F.lit(name))


def audit_table(spark: SparkSession, table: str, where: str | None = None, limit: int | None = LIMIT) -> tuple[DataFrame, bool]:
    """(audits, truncated): truncated if the limit was reached."""
    df = spark.sql(f"SELECT * FROM {quote_ident(table)}")
    df = df.where(where) if where else df
    df = as_text(df if limit is None else df.limit(limit))
    return audit_query(df, table), limit is not None and df.count() >= limit


def audit_database(spark: SparkSession, tables: list[str] | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Audits of all tables in one frame."""
    out = None
    for t in tables if tables is not None else list_tables(spark):
        own, cut = audit_table(spark, t, limit=limit)
        own = own.withColumn("truncated", F.lit(cut))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no tables")
    return out


def table_verdicts(audits: DataFrame) -> DataFrame:
    """(table, severity, findings): the worst of each table."""
    return audits.groupBy("table").agg(M.named(F.max(M.rank(F.col("severity")))).alias("severity"), F.sum(F.size("findings")).alias("findings"))


def report(audits: DataFrame) -> str:
    rows = table_verdicts(audits).orderBy(F.desc(M.rank(F.col("severity"))), "table").collect()  # one row per table
    return "\n".join(f"{r.table}: {r.severity}, {M.plural(r.findings, 'finding')}" for r in rows)
