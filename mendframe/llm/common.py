"""Shared helpers: Arrow mapping, shared-folder tables, column selection."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship

#: Bytes that separate words, as a class of Python and Java patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: What ends a word, for str.translate and str.split.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD_SPACE = {ord(c): " " for c in SPACES}
FOLD_CASE = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Keep Arrow batches small, as texts may be very long; smaller settings stay."""
    if int(spark.conf.get(_BATCH_ROWS)) > rows:
        spark.conf.set(_BATCH_ROWS, str(rows))
    spark.conf.set(_BATCH_BYTES, size)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches. A worker that has ended its task gives free memory back, as it may stay idle beside others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mendframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Paths of the tables made so far, deleted at the interpreter's exit or by drop_tables().
_MADE: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete the tables behind dfs, or all that table() has made: for long sessions, once the results that read them are written."""
    own = [p for p in _MADE if any(f"{p.rpartition('/')[2]}/" in f for d in dfs for f in d.inputFiles())] if dfs else _MADE[:]
    for path in own:
        _delete(spark, path)
        _MADE.remove(path)


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_tables(spark)
    except Exception:  # noqa: BLE001 - the session is gone; the folder is its owner's to clear
        return


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: it is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mendframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _MADE:
        atexit.register(_drop_at_exit, spark)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of verdicts that may go to every executor.
SENT_BYTES = 32 << 20


def small(own: DataFrame, width: Column | int = 16) -> DataFrame:
    """A table, to be broadcast if its bytes (width a row) are SENT_BYTES at most: so texts stay where they are; more are joined by a shuffle."""
    size = own.agg(F.sum(width if isinstance(width, Column) else F.lit(width)).alias("b")).first().b or 0
    return F.broadcast(own) if size <= SENT_BYTES else own


def sent(verdicts: DataFrame, name: str, width: Column | int = 16) -> DataFrame:
    """verdicts as a table, broadcast if it is small."""
    return small(table(verdicts, name), width)


def free(df: DataFrame, *names: str) -> list[str]:
    """names with as many underscores before them as it takes to clash with no column of df."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in held:
            n = f"_{n}"
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, *keys: tuple[str, str]) -> Column:
    """Null-safe equality of the named columns."""
    out = None
    for a, b in keys:
        on = left[a].eqNullSafe(right[b])
        out = on if out is None else out & on
    return out


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null: empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def words(text: str) -> list[str]:
    if text.isascii():
        text = text.translate(FOLD_SPACE)
    else:  # translate is slow beyond ASCII
        for c in SPACES[1:]:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def fold_case(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
