"""Small helpers shared by the operators: column names, scratch tables."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch_path

_SCRATCH: list[str] = []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that no column of ``df`` has (whatever
    its case), so that an extra column of the caller never clashes."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str):
    """Column by exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def saved(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared scratch folder and read back.

    Cuts the lineage: later stages read committed files, so a lost executor
    costs only its own tasks, and one evaluation serves every reader (row
    order and partition numbers stored in it cannot change on recomputation).
    ``release``: have the driver's JVM collect its garbage then, which lets
    Spark's cleaner delete the shuffle files that only this write needed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _SCRATCH.append(path)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def new_path(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    _SCRATCH.append(path)
    return path


def discard(table: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing will read it again."""
    _SCRATCH.remove(table.scratch_path)
    _delete(table.sparkSession, table.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this driver, once their results are stored."""
    while _SCRATCH:
        _delete(spark, _SCRATCH.pop())


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a Python worker keeps between tasks for one kind of work (tables,
    encoders). Another kind of work gives it up: a worker outlives many stages,
    and an executor has several."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
    return _KEPT[owner]


def lean(work):
    """``work`` for ``mapInArrow``, giving freed memory back when a task ends: idle
    workers stay for later stages, several to an executor."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()
    return run


def give_back() -> None:
    """Return freed memory of this process to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library's
    if trim:
        trim(0)


#: Rows and bytes of an Arrow batch of documents. A document may be long, and a
#: batch lies in memory several times (JVM, socket, Python, strings).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for what runs inside; the session's settings come back."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], min(BATCH_ROWS, int(before[0])) if int(before[0]) > 0 else BATCH_ROWS)
        spark.conf.set(names[1], BATCH_BYTES)
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def documents(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand documents to Python in small batches
    (a caller's smaller setting stays)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def text_or_empty(column: str = "text"):
    return F.coalesce(quoted(column).cast("string"), F.lit(""))
