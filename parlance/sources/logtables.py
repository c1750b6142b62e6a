"""Append-only log tables (S2-S9, S11-S13) as Parquet / CSV under a shared folder.

Writes are set-wise: one task-committed write per batch of rows instead of a
commit per row. A retried write of the same batch goes to the same
``batch=<id>`` directory with overwrite, so retries do not duplicate rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.sources.tables import CONVERSATION_LOG, MODEL_COMPARISON, MODEL_METRICS, TRAINING_DATA


def append(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append rows; with a batch id the write is idempotent per batch."""
    if batch_id is None:
        df.write.mode("append").parquet(path)
    else:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def exists(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a table written batch by batch: the newest compacted folder and the
    batches behind it. The folders are named once, so a compaction that ends meanwhile
    changes nothing for this reader (until ``remove_compacted``)."""
    through = max(_numbers(spark, f"{path}/compacted", "through="), default=None)
    folders = [] if through is None else [f"{path}/compacted/through={through}"]
    folders += [f"{path}/batch={b}" for b in _numbers(spark, path, "batch=") if through is None or b > through]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema, file_bytes: int = K.COMPACTED_BYTES) -> int | None:
    """Fold all batch folders into one folder of files of about ``file_bytes``; the number
    of the last batch in it (None: nothing to do). The folder appears whole, by a
    rename; the batches stay until ``remove_compacted``. One compaction at a time."""
    batches, done = _numbers(spark, path, "batch="), max(_numbers(spark, f"{path}/compacted", "through="), default=None)
    last = max(batches, default=None)
    if last is None or last == done:
        return None
    new = spark._jvm.org.apache.hadoop.fs.Path
    store = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/batch={b}" for b in batches if done is None or b > done] + ([] if done is None else [f"{path}/compacted/through={done}"])
    files = max(1, -(-sum(store.getContentSummary(new(f)).getLength() for f in folders) // file_bytes))
    draft = f"{path}/compacted/draft-{uuid.uuid4().hex[:12]}"
    read_batches(spark, path, schema).repartition(files).write.parquet(draft)
    target = new(f"{path}/compacted/through={last}")
    if store.exists(target) or not store.rename(new(draft), target):
        raise RuntimeError(f"{path} was compacted meanwhile")
    return last


def remove_compacted(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest compacted one replaces, once no reader has
    them open; their number."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    store = new(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = _numbers(spark, f"{path}/compacted", "through=")
    old = [f"{path}/batch={b}" for b in _numbers(spark, path, "batch=") if done and b <= done[-1]]
    old += [f"{path}/compacted/through={n}" for n in done[:-1]]
    for folder in old:
        store.delete(new(folder), True)
    return len(old)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Conversation log rows with the time also as text."""
    df = spark.read.schema(CONVERSATION_LOG).parquet(path)
    return df.withColumn("timestamp_text", F.col("timestamp").cast("string"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs without the id column."""
    return spark.read.schema(TRAINING_DATA).parquet(path).drop("id").withColumn(
        "timestamp", F.col("timestamp").cast("string"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_METRICS).parquet(path)


def bulk_load(support: DataFrame, prefix: str = K.DATASET_ID_PREFIX) -> DataFrame:
    """Prepared support corpus -> training rows with source 'dataset'.

    Rows empty or null in either cleaned text are dropped (an empty field
    reads back as null from CSV); intent / category default to 'unknown'
    only when the column is absent.
    """
    df = (support.withColumn("__i", F.nullif(F.col("clean_instruction"), F.lit("")))
          .withColumn("__r", F.nullif(F.col("clean_response"), F.lit("")))
          .dropna(subset=["__i", "__r"]))
    intent = F.col("intent") if "intent" in df.columns else F.lit("unknown")
    category = F.col("category") if "category" in df.columns else F.lit("unknown")
    return df.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"),
                     F.col("__i").alias("instruction"), F.col("__r").alias("response"),
                     intent.alias("intent"), category.alias("category"),
                     F.lit("dataset").alias("source"), F.current_timestamp().alias("timestamp"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index, overwrite; multi-line text fields quoted."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("multiLine", True).csv(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def comparison_records(spark: SparkSession, path: str) -> DataFrame:
    """Model comparison table as JSON records; one error record if it is missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.range(1).select(F.to_json(F.struct(F.lit(K.MISSING_RESULTS).alias("error"))).alias("record"))
    df = read_csv(spark, path, MODEL_COMPARISON)
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
