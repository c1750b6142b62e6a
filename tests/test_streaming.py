"""Each stream, run with availableNow, equals its batch twin."""

from pyspark.sql import functions as F

from parlance.operators import logs
from parlance.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def _conv(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


def test_stream_scoring_equals_batch(spark):
    cols = ["conv_id", "turn", "sentiment", "sentiment_confidence", "intent", "escalate", "response"]
    s = jobs.stream_scoring(spark, SMALL).select(*cols)
    b = jobs.score_messages(_conv(spark)).select(*cols)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_two_sinks_same_rows(spark):
    log, train = jobs.stream_two_sinks(spark, SMALL)
    n_user = _conv(spark).where(F.col("role") == "user").count()
    assert log.count() == n_user == train.count()
    assert log.select("id").exceptAll(train.select("id")).count() == 0


def test_session_counts_equal_batch(spark):
    s = jobs.stream_session_counts(spark, SMALL)
    b = logs.turn_counts(_conv(spark).where(F.col("role").isin("user", "assistant")), "conv_id")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
