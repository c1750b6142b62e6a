"""Structured Streaming jobs (R1-R5): the online loop as streams.

Every job reads a file stream, applies the same DataFrame functions as its
batch twin, and writes through ``foreachBatch`` into ``batch=<id>`` folders
with overwrite, so a retried micro-batch replaces its own output instead of
duplicating it. State (session counts, dashboard totals) lives in Spark's
aggregation state store under the checkpoint location. Tests and the query
catalogue run them with ``availableNow`` and read the sinks back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import turns
from parlance.session import scratch_path
from parlance.sources import logtables, modelstore


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A given table as a file stream (its schema read from the footer). All
    waiting files go into one micro-batch unless ``max_files`` says otherwise."""
    path = f"{sf_dir.rstrip('/')}/{name}*.parquet"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


#: How a live dashboard refreshes (a caller passes it as ``trigger``).
DASHBOARD_TRIGGER = {"processingTime": "30 seconds"}


def _run(query_builder, spark: SparkSession, name: str, trigger: dict | None = None) -> str:
    """Start a stream, wait for it, return its output folder. The default trigger
    takes what is there and ends; another one runs until the stream is stopped."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = query_builder(out).option("checkpointLocation", ckpt).trigger(**(trigger or {"availableNow": True})).start()
    _finished(q)
    return out


def _finished(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def score_messages(messages: DataFrame) -> DataFrame:
    """Stateless per-message scoring of user turns (no reply candidate)."""
    user = messages.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_message"), F.lit(None).cast("string").alias("reply"))
    return turns.score_turns(user)


def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = score_messages(file_stream(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "sentiment", "sentiment_confidence", "intent", "intent_confidence", "escalate",
        "response", "model_used")

    def build(out):
        return src.writeStream.foreachBatch(lambda df, bid: logtables.append(df, out, bid))

    return spark.read.parquet(_run(build, spark, "stream_scoring")).drop("batch")


def score_by_store(spark: SparkSession, root: str, out: str):
    """``foreachBatch`` function: user turns scored by the newest models published in
    ``root`` when the batch starts; each row carries their version. A repeated batch
    replaces its rows (and may use newer models for all of them)."""
    held: dict = {}

    def sink(df, bid):
        newest = max(modelstore.versions(spark, root), default=None)
        if newest not in held:
            held.clear()
            held[newest] = modelstore.load(spark, root, ("sentiment", "intent"), newest)[1]
        m = held[newest]
        user = df.where(F.col("role") == "user").select(
            "conv_id", "turn", F.col("text").alias("user_message"), F.lit(None).cast("string").alias("reply"))
        scored = turns.score_turns_by_models(user, m["sentiment"], m["intent"])
        logtables.append(scored.withColumn("model_version", F.lit(newest)), out, bid)

    return sink


def stream_scoring_model(messages: DataFrame, root: str, out: str, checkpoint: str) -> None:
    """Score a message stream by the model store until all waiting files are done."""
    q = (messages.writeStream.foreachBatch(score_by_store(messages.sparkSession, root, out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    _finished(q)


def stream_two_sinks(spark: SparkSession, sf_dir: str):
    """Each micro-batch is persisted once and written to the log and the
    training table under its batch id (retry-safe)."""
    scored = score_messages(file_stream(spark, sf_dir, "conversations"))
    log_path = scratch_path(spark, "stream_log")
    train_path = scratch_path(spark, "stream_training")

    def sink(df, bid):
        df.persist()
        try:
            logtables.append(turns.log_rows(df), log_path, bid)
            logtables.append(turns.training_rows(df), train_path, bid)
        finally:
            df.unpersist()

    def build(out):
        return scored.writeStream.foreachBatch(sink)

    _run(build, spark, "stream_two_sinks")
    return spark.read.parquet(log_path), spark.read.parquet(train_path)


def _complete(spark: SparkSession, agg: DataFrame, name: str, trigger: dict | None = None) -> DataFrame:
    """Run an aggregating stream in complete mode; return the last full result.
    Every batch writes its own folder, so a failure leaves the one before it."""
    def build(out):
        return agg.writeStream.outputMode("complete").foreachBatch(lambda df, bid: logtables.append(df, out, bid))

    out = _run(build, spark, name, trigger)
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{out}/batch={last}")


def _updated(spark: SparkSession, agg: DataFrame, key: str, name: str) -> DataFrame:
    """Run an aggregating stream in update mode: a batch writes the rows that it
    changed; a key's newest row counts."""
    def build(out):
        return agg.writeStream.outputMode("update").foreachBatch(lambda df, bid: logtables.append(df, out, bid))

    rows = spark.read.parquet(_run(build, spark, name))
    kept = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(*[F.max_by(c, "batch").alias(c) for c in kept])


def stream_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = file_stream(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    agg = msgs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).withColumn(
        "turn_count", F.floor(F.col("messages") / 2).cast("bigint"))
    return _updated(spark, agg, "conv_id", "stream_session_counts")


def stream_dashboard(spark: SparkSession, sf_dir: str, trigger: dict | None = None) -> DataFrame:
    scored = score_messages(file_stream(spark, sf_dir, "conversations"))
    agg = scored.groupBy().agg(
        F.count(F.lit(1)).alias("total_conversations"),
        F.count_if(F.col("escalate")).alias("total_escalations"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"))
    return _complete(spark, agg, "stream_dashboard", trigger)


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = file_stream(spark, sf_dir, "events")
    r = ev.select(F.col("user_id").cast("string").alias("session_id"),
                  F.least(F.floor(F.col("value") / 50) + 1, F.lit(5)).cast("int").alias("rating"))
    agg = r.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_feedback"),
                                      F.round(F.avg("rating"), 6).alias("avg_rating"),
                                      F.count_if(F.col("rating") <= 2).alias("low_ratings"))
    return _updated(spark, agg, "session_id", "stream_feedback")
