"""Streaming queries (R1-R5), each run with availableNow and compared with
the batch SQL of the same computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import turns
from parlance.plans import sqlfrag as Q
from parlance.plans.log_plans import RATINGS_SQL
from parlance.plans.model_plans import published_turn_models
from parlance.plans.registry import Tables, plan
from parlance.plans.turn_plans import SCORED_SQL
from parlance.session import scratch_path
from parlance.sources import modelstore
from parlance.streaming import jobs

# Stream scoring has no reply candidate: the reply is the default unless escalated.
STREAM_SCORED_SQL = SCORED_SQL.replace("reply IS NOT NULL AND length(reply)", "false AND length(reply)")


@plan("stream_scoring", sql=f"""
SELECT conv_id, turn, sentiment, sentiment_confidence, intent, intent_confidence, escalate, response, model_used
FROM ({STREAM_SCORED_SQL})
""", ids=("R1", "S10", "M7"))
def stream_scoring(spark, sf_dir):
    return jobs.stream_scoring(spark, sf_dir)


@plan("stream_scoring_model", sql="""
SELECT conv_id, turn, 1 AS model_version, true AS same_as_batch FROM conversations WHERE role = 'user'
""", ids=("R1", "M7", "M8", "S12"))
def stream_scoring_model(spark, sf_dir):
    """Messages scored by the published models as a stream, compared row by row with
    the batch scoring by the same version."""
    root, version = published_turn_models(spark, sf_dir)
    out = scratch_path(spark, "stream-model-out")
    jobs.stream_scoring_model(jobs.file_stream(spark, sf_dir, "conversations"), root, out, scratch_path(spark, "stream-model-ckpt"))
    _, m = modelstore.load(spark, root, ("sentiment", "intent"), version)
    user = Tables(spark, sf_dir).conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_message"), F.lit(None).cast("string").alias("reply"))
    compared = ["sentiment", "sentiment_confidence", "intent", "intent_confidence", "escalate", "response"]
    batch = turns.score_turns_by_models(user, m["sentiment"], m["intent"]).select(
        "conv_id", "turn", F.struct(*compared).alias("b"))
    s = spark.read.parquet(out).select("conv_id", "turn", "model_version", F.struct(*compared).alias("s"))
    return s.join(batch, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "model_version", F.col("s").eqNullSafe(F.col("b")).alias("same_as_batch"))


@plan("stream_two_sinks", sql=f"""
SELECT {Q.TURN_ID} AS id, session_id, escalate::INTEGER AS escalated, true AS in_training
FROM ({STREAM_SCORED_SQL})
""", ids=("R2", "S4", "S5"))
def stream_two_sinks(spark, sf_dir):
    log, train = jobs.stream_two_sinks(spark, sf_dir)
    t = train.select("id").withColumn("in_training", F.lit(True))
    return log.select("id", "session_id", "escalated").join(t, "id", "left")


@plan("stream_session_counts", sql="""
SELECT conv_id, count(*) AS messages, floor(count(*) / 2)::BIGINT AS turn_count
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id
""", ids=("R3", "A11"))
def stream_session_counts(spark, sf_dir):
    return jobs.stream_session_counts(spark, sf_dir)


@plan("stream_dashboard", sql=f"""
SELECT count(*) AS total_conversations, count(*) FILTER (WHERE escalate) AS total_escalations,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative
FROM ({STREAM_SCORED_SQL})
""", ids=("R4", "A6", "A7"))
def stream_dashboard(spark, sf_dir):
    return jobs.stream_dashboard(spark, sf_dir)


@plan("stream_feedback", sql=f"""
SELECT session_id, count(*) AS n_feedback, round(avg(rating), 6) AS avg_rating,
       count(*) FILTER (WHERE rating <= 2) AS low_ratings
FROM ({RATINGS_SQL}) GROUP BY session_id
""", ids=("R5",))
def stream_feedback(spark, sf_dir):
    return jobs.stream_feedback(spark, sf_dir)
