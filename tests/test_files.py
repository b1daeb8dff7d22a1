"""The queries over files, sinks, the catalogue and the feedback loop against their SQL, and faults that once passed unseen."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from mendframe.operators import conventions, provenance, tabular
from mendframe.plans import file_oracles, file_queries
from mendframe.sources import catalog

DATA = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(file_oracles.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = file_queries.queries()[name](spark, str(DATA))
    want = con.execute(file_oracles.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_only_the_columns_own_limit_is_noted(spark):
    """A column cut at 255 holds intact cells of 50 characters, which is a limit elsewhere."""
    rows = [(i, f"{i:05d}".ljust(255, "x")) for i in range(40)] + [(40 + i, f"{i:05d}".ljust(50, "y")) for i in range(20)] + [(60 + i, "short") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, note string")
    audits = tabular.audit_columns(df, ["note"], "k", with_samples=False)
    notes = provenance.annotate(df, audits, "k").notes.where("mode = 'truncation'").collect()
    assert sorted(r.row_key for r in notes) == list(range(40))


def test_convention_samples_prefer_rare_shapes(spark):
    rows = [(i, f"{i:03d}-AB") for i in range(400)] + [(400 + i, f"x{i}") for i in range(9)] + [(409, "odd one out!")]
    df = spark.createDataFrame(rows, "k long, code string")
    [a] = conventions.audit_conventions(df, ["code"], "k").collect()
    assert len(a.findings) == 1 and any("odd one out!" in s for s in a.findings[0].samples)


def test_limited_reads_are_told(spark, caplog):
    spark.range(30).createOrReplaceTempView("mf_thirty")
    with caplog.at_level("WARNING", "mendframe"):
        assert catalog.read_rows(spark, "SELECT * FROM mf_thirty", limit=10).count() == 10
    assert "stop at 10 rows" in caplog.text
    spark.catalog.dropTempView("mf_thirty")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries_leave_no_views(spark):
    for name in ("catalog_rows", "catalog_names"):
        assert file_queries.queries()[name](spark, str(DATA)).count() > 0
    assert not [t for t in catalog.list_tables(spark) if t.startswith("mf_")]


def test_the_rest_stands_without_the_llm_package(tmp_path):
    shutil.copytree(ROOT / "mendframe", tmp_path / "mendframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)
