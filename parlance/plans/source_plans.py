"""Sources and sinks as queries: requests, CSV, appended tables, code maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions.text import strip_ws
from parlance.operators import encode
from parlance.plans import sqlfrag as Q
from parlance.plans.corpus_plans import SUPPORT_CORPUS_SQL, support_prepared
from parlance.plans.log_plans import TRAINING_SQL, bulk_rows, metric_log, user_rows
from parlance.plans.registry import Tables, plan
from parlance.session import scratch_path
from parlance.sources import logtables
from parlance.sources.tables import CHAT_REQUEST


def requests(spark, sf_dir):
    """User turns as request records (JSON text); each fourth names no session."""
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    session = F.when(F.col("turn") % 4 != 0, F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.col("text").alias("message"), session.alias("session_id"))).alias("body"))


@plan("request_intake", sql=f"""
SELECT conv_id, turn, text AS message,
       CASE WHEN turn % 4 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE {Q.q(K.DEFAULT_SESSION)} END AS session_id,
       {Q.q(K.DEFAULT_USER)} AS user_name, coalesce({Q.strip_ws('text')} <> '', false) AS accepted
FROM conversations WHERE role = 'user'
""", ids=("S10", "F7"))
def request_intake(spark, sf_dir):
    """Requests parsed with their declared schema; absent fields take the defaults,
    blank messages are marked as rejected."""
    r = requests(spark, sf_dir).withColumn("r", F.from_json("body", CHAT_REQUEST))
    return r.select("conv_id", "turn", F.col("r.message").alias("message"),
                    F.coalesce("r.session_id", F.lit(K.DEFAULT_SESSION)).alias("session_id"),
                    F.coalesce("r.user_name", F.lit(K.DEFAULT_USER)).alias("user_name"),
                    F.coalesce(strip_ws("r.message") != "", F.lit(False)).alias("accepted"))


@plan("csv_roundtrip", sql=f"""
SELECT id, nullif(clean_instruction, '') AS clean_instruction, nullif(clean_response, '') AS clean_response,
       instruction_len, response_len FROM ({SUPPORT_CORPUS_SQL})
""", ids=("S1", "S2"))
def csv_roundtrip(spark, sf_dir):
    """The prepared corpus written as CSV and read back (empty text reads as null)."""
    df = support_prepared(spark, sf_dir).select("id", "clean_instruction", "clean_response", "instruction_len", "response_len")
    path = scratch_path(spark, "support-csv")
    logtables.write_csv(df, path)
    return logtables.read_csv(spark, path, df.schema)


@plan("training_roundtrip", sql=f"""
SELECT instruction, response, intent, category, source, true AS has_timestamp FROM ({TRAINING_SQL})
""", ids=("S5", "S8", "S9"))
def training_roundtrip(spark, sf_dir):
    """Corpus rows loaded and user rows appended to one table, then scanned."""
    path = scratch_path(spark, "training")
    for k, rows in enumerate((bulk_rows(spark, sf_dir), user_rows(spark, sf_dir))):
        logtables.append(rows, path, batch_id=k)
    back = logtables.read_training(spark, path)
    return back.select("instruction", "response", "intent", "category", "source", F.col("timestamp").isNotNull().alias("has_timestamp"))


@plan("metrics_roundtrip", sql="""
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS model_name, value AS accuracy, event_id % 2 = 0 AS first_append FROM events
""", ids=("S6",))
def metrics_roundtrip(spark, sf_dir):
    """Metric rows appended in two writes and read back with unique ids."""
    path = scratch_path(spark, "metrics")
    m = metric_log(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "model_name", "accuracy", "timestamp")
    for k in range(2):
        logtables.append(m.where(F.pmod(F.col("id").cast("long"), F.lit(2)) == k), path, batch_id=k)
    back = logtables.read_metrics(spark, path)
    return back.select("id", "model_name", "accuracy", (F.pmod(F.col("id").cast("long"), F.lit(2)) == 0).alias("first_append"))


@plan("code_map", sql="""
WITH dim AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS code
             FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT d.doc_id, d.lang, dim.code, dim.lang AS name FROM documents d JOIN dim ON d.lang = dim.lang
""", ids=("S13", "J1", "J2"))
def code_map(spark, sf_dir):
    """A fitted code map written, read again, and used both ways."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    path = scratch_path(spark, "code-map")
    logtables.append(encode.fit_codes(d, "lang", "code"), path, batch_id=0)
    dim = spark.read.parquet(path).select("lang", "code")
    coded = encode.apply_codes(d, dim, "lang", "code")
    return encode.lookup_names(coded, dim, "code", "code", "lang", "name").select("doc_id", "lang", "code", "name")


@plan("comparison_table", sql="""
SELECT event_type AS name, round(avg(value) / 1000, 6) AS accuracy, NULL::VARCHAR AS error FROM events GROUP BY event_type
UNION ALL SELECT NULL, NULL, 'Results not found'
""", ids=("S11", "U4"))
def comparison_table(spark, sf_dir):
    """A comparison table stored as CSV and served as records; a missing table
    gives one error record."""
    path = scratch_path(spark, "comparison")
    m = metric_log(spark, sf_dir).groupBy(F.col("model_name").alias("name")).agg(
        F.round(F.avg("accuracy") / 1000, 6).alias("accuracy"))
    none = F.lit(None).cast("double")
    logtables.write_csv(m.select("name", "accuracy", *[none.alias(c) for c in ("precision", "recall", "f1", "cv_f1", "auc")]), path)
    records = logtables.comparison_records(spark, path).unionByName(logtables.comparison_records(spark, path + "-missing"))
    r = records.select(F.from_json("record", "name string, accuracy double, error string").alias("r"))
    return r.select("r.name", "r.accuracy", "r.error")


@plan("class_names", sql="""
SELECT vec_id, label % 3 AS code,
       CASE label % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' ELSE 'neutral' END AS three_classes,
       CASE label % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END AS two_classes
FROM embeddings
""", ids=("T13",))
def class_names(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", (F.col("label") % 3).alias("code"))
    return e.select("vec_id", "code", L.code_to_sentiment("code", 3).alias("three_classes"),
                    L.code_to_sentiment("code", 2).alias("two_classes"))
