"""Log-table analytics (flow D): totals, distributions, recent rows, histories.

All aggregation runs before anything leaves the cluster; several counts share
one scan (``count_if``), and single-row results are combined with one-row
joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions.text import preview
from parlance.operators.ordered import grouped_scan, row_number_within

SENTIMENT_CLASSES = ("positive", "neutral", "negative")


def totals(log: DataFrame, training: DataFrame) -> DataFrame:
    a = log.agg(F.count(F.lit(1)).alias("total_conversations"),
                F.count_if(F.col("escalated") == 1).alias("total_escalations"))
    b = training.agg(F.count(F.lit(1)).alias("total_training_data"))
    return a.crossJoin(b)


def grouped_count(log: DataFrame, col: str) -> DataFrame:
    """(value, count of non-null values): a null group shows a count of 0."""
    return log.groupBy(col).agg(F.count(col).alias("count"))


def sentiment_distribution(log: DataFrame, col: str = "sentiment") -> DataFrame:
    s = F.col(col)
    return log.agg(*[F.count_if(s == c).alias(c) for c in SENTIMENT_CLASSES],
                   F.count_if(s.isNull() | ~s.isin(*SENTIMENT_CLASSES)).alias("other"))


def most_common(log: DataFrame, col: str, order_col: str = "id", default: str = "N/A") -> DataFrame:
    """Most frequent value; ties go to the value seen first; default if none."""
    g = (log.where(F.col(col).isNotNull()).groupBy(col)
         .agg(F.count(F.lit(1)).alias("count"), F.min(order_col).alias("__first")))
    top = g.orderBy(F.desc("count"), F.col("__first")).limit(1)
    one = log.sparkSession.range(1).select(F.lit(1).alias("__k"))
    j = one.join(top.withColumn("__k", F.lit(1)), "__k", "left")
    return j.select(F.coalesce(F.col(col), F.lit(default)).alias(f"most_common_{col}"),
                    F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def recent(log: DataFrame, n: int = K.DASHBOARD_ROWS, chars: int = K.PREVIEW_CHARS) -> DataFrame:
    """Newest n rows by id, with previews and display values."""
    top = log.orderBy(F.desc("id")).limit(n)
    return top.select("id", "session_id",
                      preview("user_message", chars).alias("message_preview"),
                      preview("bot_response", chars).alias("response_preview"),
                      F.coalesce("intent", F.lit("N/A")).alias("intent"),
                      F.coalesce("sentiment", F.lit("N/A")).alias("sentiment"),
                      F.when(F.col("escalated") == 1, "Yes").otherwise("No").alias("escalated"))


def session_history(messages: DataFrame, session: str, order) -> DataFrame:
    """Messages with their 1-based position in the session (skew-safe rank)."""
    return row_number_within(messages, [session], [order], out="position")


def turn_counts(messages: DataFrame, session: str) -> DataFrame:
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages")).withColumn(
        "turn_count", F.floor(F.col("messages") / 2).cast("bigint"))


def previous_value(df: DataFrame, group: str, order_cols, value: str, out: str = "previous") -> DataFrame:
    """lag(value) per group (a null group is a group): rank rows (skew-safe), then
    join each row to the row ranked one lower; the key (group, rank) is unique."""
    ranked = row_number_within(df, [group], order_cols, out="__rn")
    prev = ranked.select(F.col(group).alias("__g"), (F.col("__rn") + 1).alias("__rn2"),
                         F.col(value).alias(out))
    j = ranked.join(prev, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__rn") == F.col("__rn2")), "left")
    return j.drop("__g", "__rn2", "__rn")


def running_max(df: DataFrame, group: str, order_cols, value: str, out: str = "best_so_far") -> DataFrame:
    return grouped_scan(df, [group], order_cols, {out: ("max", value)})


def latest_by_name(metrics: DataFrame, name: str, value: str, ts: str, n: int = 4) -> DataFrame:
    """Among the newest n rows: per name the value of the oldest row (what a
    dict filled newest-first ends with) and of the newest row."""
    top = metrics.orderBy(F.desc(ts), F.desc("id")).limit(n)
    return top.groupBy(name).agg(
        F.min_by(value, F.struct(F.col(ts), F.col("id"))).alias("previous_literal"),
        F.max_by(value, F.struct(F.col(ts), F.col("id"))).alias("previous_latest"))


def loss_rollup(log: DataFrame, run: str, epoch: str, loss: str, limits: dict) -> DataFrame:
    """Mean loss per (run, epoch) over valid batches (not NaN, <= limit) for each
    named limit, in one aggregate (``valid_batches`` is that of the limit named
    ""); the divisor is at least 1, so an epoch without valid batches reports 0."""
    def valid(limit):
        return ~F.isnan(F.col(loss)) & F.col(loss).isNotNull() & (F.col(loss) <= limit)

    means = [(F.coalesce(F.sum(F.when(valid(x), F.col(loss))), F.lit(0.0))
              / F.greatest(F.count_if(valid(x)), F.lit(1))).alias(f"avg_loss{name}") for name, x in limits.items()]
    return log.groupBy(run, epoch).agg(F.count(F.lit(1)).alias("batches"),
                                       F.count_if(valid(limits[""])).alias("valid_batches"), *means)
