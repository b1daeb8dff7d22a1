"""What tasks share with the driver: the package's files, and a folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's files to the Python workers as one small archive, once a session. Readers and operators that map in Python call it."""
    sc = spark.sparkContext
    if getattr(sc, "_mendframe_shipped", False):
        return
    top = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="mendframe-")  # of the driver; it serves the archive from there
    atexit.register(shutil.rmtree, held, True)
    with zipfile.ZipFile(f"{held}/{top.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(f"{held}/{top.name}.zip")
    sc._mendframe_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that driver and executors share: under spark.checkpoint.dir, or under a new local folder where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mendframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out to two tasks for each core, by unique keys or in turn.

    For narrow tables whose cells take much CPU: a columnar file of a few MB holds a million rows in one row group, which one task reads
    whatever the number of cores. Deal the columns that are read, before they are widened.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
