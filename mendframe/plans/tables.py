"""The tables that queries run over: the given ones, and some with damage by a fixed rule, spelt the same for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..workers import dealt

#: Integer division differs between the two dialects.
_DIV = {"spark": "div", "duckdb": "//"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendor_columns(dialect: str) -> dict[str, str]:
    """Damaged columns over customer, by its key."""
    d, k = _DIV[dialect], "c_custkey"
    thousands = f"(1000 + ({k} * 37) % 900000)"
    return {
        "row_key": f"cast({k} as bigint)",
        "name": f"CASE WHEN {k} % 3 = 0 THEN concat('Jos\xc3\xa9 ', c_name) ELSE c_name END",
        "revenue": f"concat(cast({thousands} {d} 1000 as varchar(20)), ',', lpad(cast({thousands} % 1000 as varchar(20)), 3, '0'))",
        "gene": f"CASE {k} % 4 WHEN 0 THEN '2-Sep' ELSE 'TP53' END",
        "status": f"CASE {k} % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'NULL' ELSE 'active' END",
        "zip_code": f"cast({k} * 7 + 1 as varchar(20))",
        "notes": f"CASE WHEN {k} % 10 = 0 THEN substr(concat(repeat('x', 250), lpad(cast({k} as varchar(20)), 5, '0')), 1, 255) ELSE 'ok' END",
        "joined": f"CASE WHEN {k} = 77 THEN '2-Sep' ELSE concat('2020-', lpad(cast(1 + {k} % 12 as varchar(20)), 2, '0'), '-', lpad(cast(1 + {k} % 28 as varchar(20)), 2, '0')) END",
        "segment": "c_mktsegment",
    }


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
VENDOR = ["name", "revenue", "gene", "status", "zip_code", "notes", "joined", "segment"]


def vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").selectExpr(*(f"{e} AS {c}" for c, e in vendor_columns("spark").items()))


def vendor_sql() -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in vendor_columns("duckdb").items()) + " FROM customer"


#: Every hundredth row of part has a field too many.
RAGGED = "CASE WHEN p_partkey % 100 = 0 THEN {a}p_name, p_brand, p_type, 'extra'{b} ELSE {a}p_name, p_brand, p_type{b} END"


def ragged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey AS row_id", RAGGED.format(a="array(", b=")") + " AS fields")


RAGGED_SQL = f"SELECT p_partkey AS row_id, {RAGGED.format(a='[', b=']')} AS fields FROM part"

#: Documents with damage: a replaced letter, glyph marks, or none.
DAMAGED_TEXT = "CASE doc_id % 4 WHEN 0 THEN replace(text, 'e', '�') WHEN 1 THEN concat(text, repeat(' (cid:87)', 20)) ELSE text END"


def damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{DAMAGED_TEXT} AS text")


DAMAGED_SQL = f"SELECT doc_id, {DAMAGED_TEXT} AS text FROM documents"

#: Rejected documents carry artefacts that kept ones lack.
MINED_TEXT = "CASE WHEN l.quality = 0 THEN concat(d.text, ' >>> (cid:12) ~~ PAGE BREAK HERE NOW TODAY') ELSE d.text END"


def mined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")
    return docs.join(labels, "doc_id").selectExpr(f"coalesce({MINED_TEXT}, '') AS text", "l.quality = 0 AS rejected")


MINED_SQL = f"SELECT coalesce({MINED_TEXT}, '') AS text, l.quality = 0 AS rejected FROM documents d JOIN labels l USING (doc_id)"

#: Headers of tables as separate exports might spell them.
HEADERS = [("a.csv", ["customer_id", "joined", "amount"]), ("b.csv", ["CustomerID", "joined", "amount"]), ("c.csv", ["customer_id", "joined", "amount"]), ("d.csv", ["customer_id", "Joined", "amount"])]
HEADERS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', [{', '.join(repr(h) for h in hs)}])" for s, hs in HEADERS) + ") t(source, header)"


def headers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HEADERS, "source string, header array<string>")
