"""Message and feedback intake as streams.

Messages arrive as JSON lines. What is not a message goes to a reject table with a
reason; a message that is delivered twice counts once; sessions keep their messages
as state; a user turn meets its reply by a join of two streams; the dashboard is a
table of windows whose rows merge. Every sink writes ``batch=<id>`` folders with
overwrite, so a repeated micro-batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parlance.functions import constants as K
from parlance.functions.labels import stable_bucket
from parlance.functions.text import strip_ws
from parlance.operators import turns
from parlance.sources import logtables
from parlance.sources.tables import FEEDBACK, MESSAGE
from parlance.streaming.jobs import _finished

CORRUPT = "_corrupt_record"


def json_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """JSON lines of a folder as a stream: the declared fields, and the line itself in
    ``_corrupt_record`` where it cannot be read as them."""
    reader = spark.readStream.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def sifted(messages: DataFrame) -> DataFrame:
    """Messages with ``reason``, null for those to take: malformed line, no id, no
    message, blank message, no time. Absent session and user take the defaults."""
    absent = lambda c: F.col(c).isNull()
    reason = (F.when(F.col(CORRUPT).isNotNull(), "malformed").when(absent("message_id"), "no id").when(absent("message"), "no message")
              .when(strip_ws("message") == "", "blank message").when(absent("sent_at"), "no time"))
    return messages.withColumns({"reason": reason, "session_id": F.coalesce("session_id", F.lit(K.DEFAULT_SESSION)),
                                 "user_name": F.coalesce("user_name", F.lit(K.DEFAULT_USER))})


def _start(df: DataFrame, checkpoint: str, sink, mode: str = "append"):
    return (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _to(path: str):
    return lambda df, bid: logtables.append(df, path, bid)


def take_in(messages: DataFrame, out: str, rejects: str, checkpoint: str, delay: str = K.INTAKE_DELAY) -> None:
    """Accepted messages to ``out``, each id once (a repeat within ``delay`` of the newest
    message is dropped), the others with reason, line and what could be read of it to ``rejects``."""
    s = sifted(messages)
    good = (s.where("reason is null").drop("reason", CORRUPT).withWatermark("sent_at", delay)
            .dropDuplicatesWithinWatermark(["message_id"]))
    # All fields are read here too: the reader judges a line by the fields it is asked for.
    bad = s.where("reason is not null").withColumnRenamed(CORRUPT, "line")
    for q in [_start(good, f"{checkpoint}/accepted", _to(out)), _start(bad, f"{checkpoint}/rejected", _to(rejects))]:
        _finished(q)


# --- session histories as state --------------------------------------------------

HISTORY = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                        T.StructField("message", T.StringType()), T.StructField("position", T.LongType()), T.StructField("previous", T.StringType())])


class SessionMemory(StatefulProcessor):
    """A session's messages by turn, each kept for ``ttl_ms`` after it came (None: for
    ever). A message whose turn is held already is a repeat and gives nothing."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getMapState("messages", "turn bigint", "role string, message string", self.ttl_ms)
        self.last = handle.getValueState("last", "position bigint, message string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        position, previous = self.last.get() if self.last.exists() else (0, None)
        came = pd.concat(list(rows)).sort_values("turn", kind="stable")
        out = []
        for turn, role, message in zip(came["turn"], came["role"], came["message"]):
            turn = int(turn)
            if self.messages.containsKey((turn,)):
                continue
            self.messages.updateValue((turn,), (role, message))
            position += 1
            out.append((key[0], turn, role, message, position, previous))
            previous = message
        if out:
            self.last.update((position, previous))
        yield pd.DataFrame(out, columns=HISTORY.names)

    def close(self) -> None:
        pass


def remember_sessions(messages: DataFrame, out: str, checkpoint: str, ttl_ms: int | None = None) -> None:
    """Each message with its position in its session and the message before it, from
    state that outlives the batch."""
    spark = messages.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    kept = messages.select("session_id", "turn", "role", "message").where("session_id is not null and turn is not null")
    history = kept.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionMemory(ttl_ms), outputStructType=HISTORY, outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime")
    try:  # map state needs this provider
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # With expiry there is always another (empty) batch, so what waits is one batch.
        trigger = {"availableNow": True} if ttl_ms is None else {"once": True}
        _finished(history.writeStream.outputMode("update").foreachBatch(_to(out)).option("checkpointLocation", checkpoint).trigger(**trigger).start())
    finally:
        spark.conf.set(provider, before)


# --- turn and reply of two streams -----------------------------------------------

def pair_streams(users: DataFrame, replies: DataFrame, out: str, checkpoint: str, delay: str = K.INTAKE_DELAY,
                 within: str = K.REPLY_WITHIN) -> None:
    """Each user turn with the reply of the next turn of its session that was sent
    ``within`` that time; without one (null reply) once the watermark says that none
    can come. State of both sides is dropped behind the watermark."""
    u = (users.where("role = 'user'").select("session_id", "turn", F.col("message").alias("user_message"), "sent_at").withWatermark("sent_at", delay).alias("u"))
    r = (replies.where("role = 'assistant'").select("session_id", (F.col("turn") - 1).alias("turn"), F.col("message").alias("reply"), F.col("sent_at").alias("replied_at"))
         .withWatermark("replied_at", delay).alias("r"))
    same = F.expr(f"u.session_id = r.session_id and u.turn = r.turn and replied_at >= sent_at and replied_at <= sent_at + interval {within}")
    pairs = u.join(r, same, "leftOuter").select("u.session_id", "u.turn", "user_message", "reply")
    _finished(_start(pairs, checkpoint, _to(out)))


# --- dashboard windows that merge --------------------------------------------------

def windowed_totals(scored: DataFrame, width: str = K.DASHBOARD_WINDOW) -> DataFrame:
    """Per tumbling window of ``sent_at``: counts, and a sketch of the sessions. Rows of
    several windows (or several tables) merge by sums and by the sketches' union."""
    return scored.groupBy(F.window("sent_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("conversations"), F.count_if("escalate").alias("escalations"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"), F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.hll_sketch_agg("session_id", K.SKETCH_BITS).alias("sessions")).select(
        F.col("w.start").alias("start"), "conversations", "escalations", "positive", "negative", "sessions")


def score_feed(messages: DataFrame) -> DataFrame:
    """Scored user turns of the message feed, with their time."""
    user = messages.where("role = 'user'").select(F.col("session_id").alias("conv_id"), "turn", F.col("message").alias("user_message"),
                                                  F.lit(None).cast("string").alias("reply"), "sent_at")
    return turns.score_turns(user)


def refresh_dashboard(messages: DataFrame, out: str, checkpoint: str, delay: str = K.INTAKE_DELAY) -> None:
    """Keep the window table: a batch writes only the windows that it changed."""
    totals = windowed_totals(score_feed(messages.withWatermark("sent_at", delay)))
    _finished(_start(totals, checkpoint, _to(out), "update"))


def merged_dashboard(spark: SparkSession, out: str) -> DataFrame:
    """One row from the newest row of every window."""
    rows = spark.read.parquet(out)
    kept = [c for c in rows.columns if c not in ("start", "batch")]
    newest = rows.groupBy("start").agg(*[F.max_by(c, "batch").alias(c) for c in kept])
    return newest.agg(*[F.sum(c).alias(c) for c in ("conversations", "escalations", "positive", "negative")],
                      F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"), F.count(F.lit(1)).alias("windows"))


# --- feedback ------------------------------------------------------------------------

def take_feedback(feedback: DataFrame, out: str, rejects: str, summary: str, checkpoint: str) -> None:
    """Ratings of 1 to 5 appended to ``out``, others (and unreadable lines) to ``rejects``;
    per batch, sums and counts by session that merge are added to ``summary``. All
    from one evaluation of the batch."""
    def sink(df, bid):
        df.persist()
        try:
            good = df.where("reason is null").drop("reason", CORRUPT)
            logtables.append(good, out, bid)
            logtables.append(df.where("reason is not null").select("reason", "session_id", "rating", F.col(CORRUPT).alias("line")), rejects, bid)
            logtables.append(good.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"),
                                                            F.count_if(F.col("rating") <= 2).alias("low")), summary, bid)
        finally:
            df.unpersist()

    ok = F.col("rating").between(1, 5)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("rating").isNull(), "no rating").when(~ok, "rating out of range")
    _finished(_start(feedback.withColumn("reason", reason), checkpoint, sink))


# --- feeds derived from the given tables ------------------------------------------------

def message_feed(conversations: DataFrame) -> DataFrame:
    """The conversations as messages with an id and a time: a session starts at a minute
    drawn from its id, turns follow by half a minute."""
    start = K.FEED_START + stable_bucket(F.col("conv_id").cast("string"), K.FEED_MINUTES) * 60
    return conversations.select(turns.turn_id().alias("message_id"), F.col("conv_id").cast("string").alias("session_id"),
                                F.lit(None).cast("string").alias("user_name"), "role", "turn", F.col("text").alias("message"),
                                F.timestamp_seconds(start + F.col("turn") * 30).alias("sent_at"))


def land_messages(feed: DataFrame, path: str) -> None:
    feed.write.mode("append").json(path)


def land_closing(spark: SparkSession, path: str, days: int = 400) -> None:
    """A turn and a reply far behind all others, in a session of their own: they move
    the watermark past every message before them."""
    at = F.timestamp_seconds(F.lit(K.FEED_START + days * 86400))
    rows = spark.range(2).select(F.lit("~").alias("message_id"), F.lit(K.CLOSING_SESSION).alias("session_id"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.col("id").alias("turn"),
                                 F.lit("end").alias("message"), at.alias("sent_at"))
    rows.coalesce(1).write.mode("append").json(path)


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return json_stream(spark, path, FEEDBACK)


def message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    return json_stream(spark, path, MESSAGE, max_files)
