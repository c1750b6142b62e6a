"""Log tables and their analytics (flows C-D, S4-S9, A1-A16, W1-W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions.text import strip_ws
from parlance.operators import logs, turns
from parlance.plans import sqlfrag as Q
from parlance.plans.corpus_plans import SUPPORT_CORPUS_SQL, support_prepared
from parlance.plans.registry import Tables, plan
from parlance.plans.turn_plans import SCORED_SQL, scored_turns
from parlance.session import scratch_path
from parlance.sources import logtables
from parlance.sources.tables import CONVERSATION_LOG, TRAINING_DATA

# --- the tables -----------------------------------------------------------------

LOG_SQL = f"""
SELECT {Q.TURN_ID} AS id, session_id, user_message, response AS bot_response, intent,
       intent_confidence, sentiment, sentiment_confidence, model_used, escalate::INTEGER AS escalated
FROM ({SCORED_SQL})
"""

BULK_SQL = f"""
SELECT '{K.DATASET_ID_PREFIX}' || id AS id, clean_instruction AS instruction, clean_response AS response,
       'unknown' AS intent, 'unknown' AS category, 'dataset' AS source
FROM ({SUPPORT_CORPUS_SQL}) WHERE clean_instruction <> '' AND clean_response <> ''
"""

USER_ROWS_SQL = f"""
SELECT '{K.USER_ID_PREFIX}' || {Q.TURN_ID} AS id, user_message AS instruction, response, intent, category,
       'user' AS source
FROM ({SCORED_SQL})
"""

TRAINING_SQL = f"({BULK_SQL}) UNION ALL ({USER_ROWS_SQL})"


def conversation_log(spark, sf_dir):
    return turns.log_rows(scored_turns(spark, sf_dir))


def bulk_rows(spark, sf_dir):
    sc = support_prepared(spark, sf_dir)
    return logtables.bulk_load(sc)


def user_rows(spark, sf_dir):
    return turns.training_rows(scored_turns(spark, sf_dir), prefix=K.USER_ID_PREFIX)


def training_table(spark, sf_dir):
    return bulk_rows(spark, sf_dir).unionByName(user_rows(spark, sf_dir))


_WRITTEN: dict[tuple, str] = {}


def _written(spark, sf_dir, name: str, build):
    """A log table, written by the first query of this application that reads it (as
    the online flow would have) and read from the shared folder by all."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN or not logtables.exists(spark, _WRITTEN[key]):
        path = scratch_path(spark, f"written-{name}")
        logtables.append(build(spark, sf_dir), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def written_log(spark, sf_dir):
    return spark.read.schema(CONVERSATION_LOG).parquet(_written(spark, sf_dir, "log", conversation_log))


def written_training(spark, sf_dir):
    return spark.read.schema(TRAINING_DATA).parquet(_written(spark, sf_dir, "training", training_table))


@plan("conversation_log", sql=LOG_SQL.replace("escalate::INTEGER AS escalated",
                                              "escalate::INTEGER AS escalated, true AS has_timestamp"),
      ids=("S4", "S7", "T25", "T28", "R2"))
def conversation_log_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "conversation_log")
    logtables.append(conversation_log(spark, sf_dir), path)
    back = logtables.read_log(spark, path)
    return back.drop("timestamp").withColumn("has_timestamp", F.col("timestamp_text").isNotNull()).drop(
        "timestamp_text")


@plan("training_pairs", sql=USER_ROWS_SQL, ids=("S5", "T11"))
def training_pairs(spark, sf_dir):
    return user_rows(spark, sf_dir).drop("timestamp")


@plan("bulk_load", sql=BULK_SQL, ids=("S9", "F3", "F8", "F15"))
def bulk_load(spark, sf_dir):
    return bulk_rows(spark, sf_dir).drop("timestamp")


@plan("training_head", sql=f"""
SELECT instruction, response, intent, category, source FROM ({TRAINING_SQL}) ORDER BY id LIMIT 100
""", ids=("S8", "W2", "U1"))
def training_head(spark, sf_dir):
    t = written_training(spark, sf_dir)
    return t.orderBy("id").limit(100).select("instruction", "response", "intent", "category", "source")


# --- A5-A11 -----------------------------------------------------------------------

@plan("log_totals", sql=f"""
SELECT (SELECT count(*) FROM ({LOG_SQL})) AS total_conversations,
       (SELECT count(*) FILTER (WHERE escalated = 1) FROM ({LOG_SQL})) AS total_escalations,
       (SELECT count(*) FROM ({TRAINING_SQL})) AS total_training_data
""", ids=("A6", "A1"))
def log_totals(spark, sf_dir):
    return logs.totals(written_log(spark, sf_dir), written_training(spark, sf_dir))


@plan("intent_distribution", sql=f"SELECT intent, count(intent) AS count FROM ({LOG_SQL}) GROUP BY intent",
      ids=("A5",))
def intent_distribution(spark, sf_dir):
    return logs.grouped_count(written_log(spark, sf_dir), "intent")


@plan("sentiment_distribution", sql=f"""
SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       count(*) FILTER (WHERE sentiment IS NULL OR sentiment NOT IN ('positive', 'neutral', 'negative')) AS other
FROM ({LOG_SQL})
""", ids=("A7",))
def sentiment_distribution(spark, sf_dir):
    return logs.sentiment_distribution(written_log(spark, sf_dir))


@plan("most_common_intent", sql=f"""
WITH g AS (SELECT intent, count(*) AS count, min(id) AS first FROM ({LOG_SQL}) WHERE intent IS NOT NULL GROUP BY intent),
t AS (SELECT * FROM g ORDER BY count DESC, first LIMIT 1)
SELECT coalesce(t.intent, 'N/A') AS most_common_intent, coalesce(t.count, 0) AS count
FROM (SELECT 1 AS k) o LEFT JOIN t ON true
""", ids=("A8",))
def most_common_intent(spark, sf_dir):
    return logs.most_common(written_log(spark, sf_dir), "intent")


@plan("message_totals", sql=f"""
SELECT count(*) AS total_rows, count(*) * 2 AS total_messages, count(DISTINCT session_id) AS total_sessions
FROM ({LOG_SQL})
""", ids=("A9", "A10"))
def message_totals(spark, sf_dir):
    log = written_log(spark, sf_dir)
    return log.agg(F.count(F.lit(1)).alias("total_rows"), (F.count(F.lit(1)) * 2).alias("total_messages"),
                   F.count_distinct("session_id").alias("total_sessions"))


@plan("turn_counts", sql="""
SELECT conv_id, count(*) AS messages, floor(count(*) / 2)::BIGINT AS turn_count
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id
""", ids=("A11", "R3"))
def turn_counts(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.where(F.col("role").isin("user", "assistant"))
    return logs.turn_counts(c, "conv_id")


@plan("recent_turns", sql=f"""
SELECT id, session_id, {Q.preview('user_message', K.PREVIEW_CHARS)} AS message_preview,
       {Q.preview('bot_response', K.PREVIEW_CHARS)} AS response_preview,
       coalesce(intent, 'N/A') AS intent, coalesce(sentiment, 'N/A') AS sentiment,
       CASE WHEN escalated = 1 THEN 'Yes' ELSE 'No' END AS escalated
FROM ({LOG_SQL}) ORDER BY id DESC LIMIT {K.DASHBOARD_ROWS}
""", ids=("W1", "T22", "T23"))
def recent_turns(spark, sf_dir):
    return logs.recent(written_log(spark, sf_dir))


@plan("session_history", sql="""
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
FROM conversations WHERE role IN ('user', 'assistant')
""", ids=("W8", "W9"))
def session_history(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.where(F.col("role").isin("user", "assistant"))
    # Messages are ranked whole: (conv_id, turn) may be null or repeated, so it cannot join them.
    return logs.session_history(c.select("conv_id", "turn", "role", "text"), "conv_id", F.col("turn").asc_nulls_last())


@plan("escalated_only", sql=f"SELECT id, session_id, sentiment FROM ({LOG_SQL}) WHERE escalated = 1",
      ids=("F6",))
def escalated_only(spark, sf_dir):
    return written_log(spark, sf_dir).where(F.col("escalated") == 1).select("id", "session_id", "sentiment")


@plan("blank_messages", sql=f"""
SELECT count(*) FILTER (WHERE {Q.strip_ws('text')} <> '') AS accepted,
       count(*) FILTER (WHERE {Q.strip_ws('text')} = '' OR text IS NULL) AS rejected
FROM conversations WHERE role = 'user'
""", ids=("F7", "T24"))
def blank_messages(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    blank = F.col("text").isNull() | (strip_ws("text") == "")
    return c.agg(F.count_if(~blank).alias("accepted"), F.count_if(blank).alias("rejected"))


# --- events as metric / loss / rating logs ---------------------------------------

def metric_log(spark, sf_dir):
    """events as a model-metrics history: event_type -> model, value -> score."""
    e = Tables(spark, sf_dir).events
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("model_name"),
                    F.col("value").alias("accuracy"), F.col("ts").cast("timestamp").alias("timestamp"))


@plan("metrics_history", sql="""
SELECT event_id AS id, event_type AS model_name, value AS accuracy,
       lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous,
       coalesce(CAST(lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS VARCHAR), 'N/A') AS previous_text
FROM events
""", ids=("W4", "S6", "T23"))
def metrics_history(spark, sf_dir):
    m = logs.previous_value(metric_log(spark, sf_dir), "model_name", ["timestamp", "id"], "accuracy")
    return m.select("id", "model_name", "accuracy", "previous",
                    F.coalesce(F.col("previous").cast("string"), F.lit("N/A")).alias("previous_text"))


@plan("latest_metrics", sql="""
WITH top AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 4)
SELECT event_type AS model_name, arg_min(value, (ts, event_id)) AS previous_literal,
       arg_max(value, (ts, event_id)) AS previous_latest
FROM top GROUP BY event_type
""", ids=("W3",))
def latest_metrics(spark, sf_dir):
    return logs.latest_by_name(metric_log(spark, sf_dir), "model_name", "accuracy", "timestamp")


@plan("best_so_far", sql="""
SELECT event_id AS id, event_type AS model_name,
       max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM events
""", ids=("W7",))
def best_so_far(spark, sf_dir):
    m = logs.running_max(metric_log(spark, sf_dir), "model_name", ["timestamp", "id"], "accuracy")
    return m.select("id", "model_name", "best_so_far")


def loss_log(spark, sf_dir):
    """events as a training-loss log: event_type -> run, day -> epoch, value -> loss."""
    e = Tables(spark, sf_dir).events
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("run"),
                    F.dayofmonth("ts").alias("epoch"), F.col("ts"), F.col("value").alias("loss"))


@plan("training_log_rollup", sql=f"""
SELECT event_type AS run, dayofmonth(ts)::INTEGER AS epoch, count(*) AS batches,
       count(*) FILTER (WHERE NOT isnan(value) AND value <= {K.LOSS_LIMIT}) AS valid_batches,
       round(coalesce(sum(value) FILTER (WHERE NOT isnan(value) AND value <= {K.LOSS_LIMIT}), 0.0)
             / greatest(count(*) FILTER (WHERE NOT isnan(value) AND value <= {K.LOSS_LIMIT}), 1), 6) AS avg_loss,
       round(coalesce(sum(value) FILTER (WHERE NOT isnan(value) AND value <= {K.LOSS_LIMIT_RELAXED}), 0.0)
             / greatest(count(*) FILTER (WHERE NOT isnan(value) AND value <= {K.LOSS_LIMIT_RELAXED}), 1), 6) AS avg_loss_relaxed
FROM events GROUP BY 1, 2
""", ids=("A15",))
def training_log_rollup(spark, sf_dir):
    rolled = logs.loss_rollup(loss_log(spark, sf_dir), "run", "epoch", "loss",
                              {"": K.LOSS_LIMIT, "_relaxed": K.LOSS_LIMIT_RELAXED})
    return rolled.select("run", "epoch", "batches", "valid_batches", F.round("avg_loss", 6).alias("avg_loss"),
                         F.round("avg_loss_relaxed", 6).alias("avg_loss_relaxed"))


@plan("progress_rows", sql="""
WITH r AS (SELECT event_id, event_type AS run, dayofmonth(ts)::INTEGER AS epoch, value AS loss,
                  row_number() OVER (PARTITION BY event_type, dayofmonth(ts) ORDER BY ts, event_id) AS batch
           FROM events)
SELECT event_id, run, epoch, batch, loss, batch % 100 = 0 AS every_100 FROM r WHERE batch % 10 = 0
""", ids=("A16",))
def progress_rows(spark, sf_dir):
    from parlance.operators.ordered import row_number_within
    r = row_number_within(loss_log(spark, sf_dir), ["run", "epoch"], ["ts", "id"], out="batch")
    return r.where(F.col("batch") % 10 == 0).select(
        F.col("id").alias("event_id"), "run", "epoch", "batch", "loss", (F.col("batch") % 100 == 0).alias("every_100"))


def ratings(spark, sf_dir):
    """events as 1-5 ratings: value binned in steps of 50, capped at 5."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", F.col("user_id").cast("string").alias("session_id"),
                    F.least(F.floor(F.col("value") / 50) + 1, F.lit(5)).cast("int").alias("rating"))


RATINGS_SQL = "SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, least(floor(value / 50) + 1, 5)::INTEGER AS rating FROM events"


@plan("rating_bucket", sql=f"""
WITH r AS ({RATINGS_SQL}), m AS (SELECT max(rating) AS mx FROM r)
SELECT event_id, rating, CASE WHEN mx >= 4 THEN (CASE WHEN rating >= 4 THEN 'positive' WHEN rating <= 2 THEN 'negative' ELSE 'neutral' END)
                              ELSE (CASE WHEN rating = 1 THEN 'positive' ELSE 'negative' END) END AS sentiment
FROM r, m
""", ids=("T12",))
def rating_bucket(spark, sf_dir):
    r = L.rating_to_sentiment(ratings(spark, sf_dir), "rating", "sentiment")
    return r.select("event_id", "rating", "sentiment")


@plan("feedback_summary", sql=f"""
SELECT session_id, count(*) AS n_feedback, round(avg(rating), 6) AS avg_rating,
       count(*) FILTER (WHERE rating <= 2) AS low_ratings
FROM ({RATINGS_SQL}) GROUP BY session_id
""", ids=("R5",))
def feedback_summary(spark, sf_dir):
    return logs_feedback(ratings(spark, sf_dir))


def logs_feedback(r):
    return r.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_feedback"),
                                       F.round(F.avg("rating"), 6).alias("avg_rating"),
                                       F.count_if(F.col("rating") <= 2).alias("low_ratings"))
