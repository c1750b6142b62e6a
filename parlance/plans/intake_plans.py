"""Message and feedback intake queries: JSON feeds derived from the given tables,
run as streams with availableNow and compared with the batch SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.plans import sqlfrag as Q
from parlance.plans.log_plans import LOG_SQL, conversation_log
from parlance.plans.registry import Tables, plan
from parlance.plans.stream_plans import STREAM_SCORED_SQL
from parlance.plans.turn_plans import PAIRS_SQL
from parlance.session import scratch_path
from parlance.sources import logtables
from parlance.sources.tables import CONVERSATION_LOG
from parlance.streaming import intake


def _paths(spark, name: str, *parts: str):
    root = scratch_path(spark, name)
    return [f"{root}/{p}" for p in parts]


def _feed(spark, sf_dir):
    return intake.message_feed(Tables(spark, sf_dir).conversations)


def faulty_lines(feed):
    """The user turns as JSON lines with faults by turn number: half a line, no message,
    a blank message; some lines come twice, some name no session."""
    n = F.col("turn")
    m = F.when(n % 10 == 8, F.lit("  ")).when(n % 10 != 6, F.col("message"))
    line = F.when(n % 10 == 4, F.expr("substring(line, 1, length(line) div 2)")).otherwise(F.col("line"))
    lines = feed.where("role = 'user'").withColumn("line", F.to_json(F.struct("message_id", F.when(n % 4 != 0, F.col("session_id")).alias("session_id"),
                                                                              "role", "turn", m.alias("message"), "sent_at")))
    times = F.when((n % 4 == 2) & (n % 10 != 4), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return lines.select(line.alias("value"), F.explode(times)).select("value")


@plan("stream_intake", sql=f"""
WITH u AS (SELECT *, {Q.TURN_ID} AS id,
                  CASE WHEN turn % 10 = 4 THEN 'malformed' WHEN turn % 10 = 6 OR text IS NULL THEN 'no message'
                       WHEN turn % 10 = 8 OR {Q.strip_ws('text')} = '' THEN 'blank message' ELSE 'accepted' END AS outcome,
                  CASE WHEN turn % 4 = 2 AND turn % 10 <> 4 THEN 2 ELSE 1 END AS sent
           FROM conversations WHERE role = 'user')
SELECT outcome, id AS message_id, CASE WHEN turn % 4 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE {Q.q(K.DEFAULT_SESSION)} END AS session_id,
       {Q.q(K.DEFAULT_USER)} AS user_name, text AS message, 1::BIGINT AS n FROM u WHERE outcome = 'accepted'
UNION ALL SELECT outcome, NULL, NULL, NULL, NULL, sum(sent)::BIGINT FROM u WHERE outcome <> 'accepted' GROUP BY outcome
""", ids=("S10", "R1", "R2", "F7"))
def stream_intake(spark, sf_dir):
    """A JSON line feed with faults, taken in: accepted messages once each, and the
    number of rejected lines by reason."""
    src, out, rejects, ckpt = _paths(spark, "intake", "src", "out", "rejects", "ckpt")
    faulty_lines(_feed(spark, sf_dir)).write.text(src)
    intake.take_in(intake.message_stream(spark, src), out, rejects, ckpt)
    good = spark.read.parquet(out).select(F.lit("accepted").alias("outcome"), "message_id", "session_id", "user_name", "message", F.lit(1).cast("long").alias("n"))
    bad = spark.read.parquet(rejects).groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad, allowMissingColumns=True)


@plan("stream_session_memory", sql="""
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS message,
       row_number() OVER w AS position, lag(text) OVER w AS previous
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""", ids=("R3", "W8", "W9"))
def stream_session_memory(spark, sf_dir):
    """Every message with its position in its session and the message before it, from
    per-session state."""
    src, out, ckpt = _paths(spark, "memory", "src", "out", "ckpt")
    intake.land_messages(_feed(spark, sf_dir), src)
    intake.remember_sessions(intake.message_stream(spark, src), out, ckpt)
    return spark.read.parquet(out).select("session_id", "turn", "role", "message", "position", "previous")


@plan("stream_turn_pairs", sql=f"""
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, user_message, reply FROM ({PAIRS_SQL})
""", ids=("J4", "R1"))
def stream_turn_pairs(spark, sf_dir):
    """User turns and replies of two streams, joined with a watermark."""
    src, out, ckpt = _paths(spark, "pairs", "src", "out", "ckpt")
    intake.land_messages(_feed(spark, sf_dir), src)
    intake.land_closing(spark, src)
    intake.pair_streams(intake.message_stream(spark, src), intake.message_stream(spark, src), out, ckpt)
    pairs = spark.read.parquet(out).select("session_id", "turn", "user_message", "reply")
    return pairs.where(F.col("session_id") != K.CLOSING_SESSION)


@plan("stream_dashboard_windows", sql=f"""
SELECT count(*) AS conversations, count(*) FILTER (WHERE escalate) AS escalations,
       count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
       true AS sessions_close
FROM ({STREAM_SCORED_SQL})
""", ids=("R4", "A2", "A6", "A7", "A10"))
def stream_dashboard_windows(spark, sf_dir):
    """The dashboard from merged windows; the sketched number of sessions is compared
    with the exact one (four standard errors)."""
    src, out, ckpt = _paths(spark, "windows", "src", "out", "ckpt")
    intake.land_messages(_feed(spark, sf_dir), src)
    intake.refresh_dashboard(intake.message_stream(spark, src), out, ckpt)
    exact = Tables(spark, sf_dir).conversations.where("role = 'user'").agg(F.count_distinct("conv_id").alias("exact"))
    close = F.abs(F.col("sessions") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 4 * 1.04 / (2 ** (K.SKETCH_BITS / 2)))
    return intake.merged_dashboard(spark, out).crossJoin(F.broadcast(exact)).select(
        "conversations", "escalations", "positive", "negative", close.alias("sessions_close"))


@plan("stream_feedback_intake", sql="""
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE (floor(value / 50) + 1)::INTEGER END AS rating FROM events)
SELECT session_id, count(*) FILTER (WHERE rating BETWEEN 1 AND 5) AS n, coalesce(sum(rating) FILTER (WHERE rating BETWEEN 1 AND 5), 0)::BIGINT AS total,
       count(*) FILTER (WHERE rating BETWEEN 1 AND 2) AS low, count(*) FILTER (WHERE rating IS NULL) AS unrated,
       count(*) FILTER (WHERE NOT rating BETWEEN 1 AND 5) AS out_of_range
FROM r GROUP BY session_id
""", ids=("R5", "F7"))
def stream_feedback_intake(spark, sf_dir):
    """Feedback lines derived from events, appended, rejected and summed from one batch;
    each session's accepted sums and rejected counts, read back from the three sinks."""
    src, out, rejects, summary, ckpt = _paths(spark, "feedback", "src", "out", "rejects", "summary", "ckpt")
    e = Tables(spark, sf_dir).events
    rating = F.when(F.col("event_id") % 50 != 7, (F.floor(F.col("value") / 50) + 1).cast("int"))
    e.select(F.col("user_id").cast("string").alias("session_id"), rating.alias("rating"), F.col("props").alias("comment")).write.json(src)
    intake.take_feedback(intake.feedback_stream(spark, src), out, rejects, summary, ckpt)
    sums = spark.read.parquet(summary).groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("low").alias("low"))
    appended = spark.read.parquet(out).groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
    bad = spark.read.parquet(rejects).groupBy("session_id").agg(F.count_if(F.col("reason") == "no rating").alias("unrated"),
                                                                F.count_if(F.col("reason") == "rating out of range").alias("out_of_range"))
    j = sums.join(appended, "session_id", "full").join(bad, "session_id", "full").na.fill(0)
    same = F.when(F.col("n") == F.col("rows"), F.col("n"))  # null where the sinks disagree
    return j.select("session_id", same.alias("n"), "total", "low", "unrated", "out_of_range")


@plan("log_compaction", sql=f"""
SELECT id, session_id, bot_response, intent, sentiment, escalated FROM ({LOG_SQL})
""", ids=("S4", "S7", "R2"))
def log_compaction(spark, sf_dir):
    """The log appended in batches, compacted, appended to, compacted again, and read."""
    path, = _paths(spark, "compacted-log", "log")
    log = conversation_log(spark, sf_dir)
    part = F.pmod(F.xxhash64("id"), F.lit(4))
    for batch in range(4):
        logtables.append(log.where(part == batch), path, batch)
        if batch in (1, 2):
            logtables.compact(spark, path, CONVERSATION_LOG)
    logtables.remove_compacted(spark, path)
    return logtables.read_batches(spark, path, CONVERSATION_LOG).select("id", "session_id", "bot_response", "intent", "sentiment", "escalated")


@plan("session_records", sql="""
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS messages, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts,
       to_timestamp(min(b) + min(turn) * 30)::TIMESTAMP AS first_at, to_timestamp(max(b) + max(turn) * 30)::TIMESTAMP AS last_at
FROM (SELECT *, 1704067200 + ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT % 20160 * 60 AS b FROM conversations)
GROUP BY conv_id
""", ids=("W8", "R3"))
def session_records(spark, sf_dir):
    """One record per session: its messages in order, with their times' span. A record
    holds its session by definition; text and role travel once, to the group."""
    feed = _feed(spark, sf_dir)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "message", "sent_at")))
    r = feed.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), ordered.alias("m"))
    return r.select("session_id", "messages", F.col("m.role").alias("roles"), F.col("m.message").alias("texts"),
                    F.array_min("m.sent_at").alias("first_at"), F.array_max("m.sent_at").alias("last_at"))
