"""Readers for the given tables and schemas of the tables the library writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table (Parquet). Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the session has cores.

    A Parquet row group is read by one task, so a file written as one large
    row group would run all per-row text work on one core. Used where heavy
    per-row work (cleaning, tokenizing) sits directly on a scan with no
    shuffle before it. On a cluster the input has many more row groups than
    cores and this returns ``df`` as is; only an undersized scan pays one
    shuffle, of the columns selected before the call.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


# Conversation log: one row per scored user turn (append-only).
CONVERSATION_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_message", T.StringType()),
    T.StructField("bot_response", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("intent_confidence", T.DoubleType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sentiment_confidence", T.DoubleType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("escalated", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Training pairs (append-only).
TRAINING_DATA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Model metrics history (append-only).
MODEL_METRICS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
])

# Chat request and feedback records (stream sources).
CHAT_REQUEST = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_name", T.StringType()),
])

# A message as it arrives, with its id and time.
MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("turn", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
])

FEEDBACK = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("comment", T.StringType()),
])

# Model comparison table.
MODEL_COMPARISON = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("cv_f1", T.DoubleType()),
    T.StructField("auc", T.DoubleType()),
])


def first_present(columns, preferred, fallback=None):
    """First name of ``preferred`` found in ``columns``, else ``fallback``."""
    for name in preferred:
        if name in columns:
            return name
    return fallback


def text_column(df: DataFrame) -> str:
    """Text column: text, review_body, sentence, review, else the first string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return first_present(df.columns, ["text", "review_body", "sentence", "review"],
                         strings[0] if strings else None)


def label_column(df: DataFrame) -> str | None:
    return first_present(df.columns, ["label", "stars", "sentiment", "rating"])


def require_columns(df: DataFrame, required) -> list[str]:
    """Missing required columns (empty when all are present)."""
    return [c for c in required if c not in df.columns]


def shape_report(df: DataFrame, dataset: str, required=()) -> DataFrame:
    """One row: dataset, row count, column count, column list and missing required columns.

    The row count is one partial aggregate; the column facts come from the schema.
    """
    missing = require_columns(df, required)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(dataset).alias("dataset"), "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(missing)).alias("missing"),
        F.lit(not missing).alias("has_required"))
