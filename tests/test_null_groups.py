"""Null groups, leading nulls and large keys: no row is lost or merged."""

from pyspark.sql import functions as F

from parlance.operators import encode, logs, splits, tfidf, turns
from parlance.operators.ordered import grouped_scan
from parlance.streaming import jobs


def test_null_group_spans_partitions(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 10 == 0, "g").alias("g"),
                                 F.when(F.col("id") > 20, F.col("id")).alias("v"))
    got = {r.id: r for r in grouped_scan(df, ["g"], ["id"], {"rn": ("count", None), "s": ("sum", "v")}, 4).collect()}
    none = [i for i in range(400) if i % 10]
    assert [got[i].rn for i in none] == list(range(1, 361))
    total = 0
    for i in none:
        total += i if i > 20 else 0
        assert got[i].s == (total if i > 20 else None)


def test_running_sum_over_leading_nulls_of_a_chunk(spark):
    df = spark.range(40).select("id", F.lit("a").alias("g"), F.when(F.col("id") < 10, F.lit(1)).alias("v"))
    got = [r.s for r in grouped_scan(df, ["g"], ["id"], {"s": ("sum", "v")}, 4).orderBy("id").collect()]
    assert got == list(range(1, 11)) + [10] * 30


def test_previous_value_of_null_group(spark):
    df = spark.range(100).select("id", F.lit(None).cast("string").alias("g"), (F.col("id") * 2).alias("v"))
    got = logs.previous_value(df, "g", ["id"], "v").collect()
    assert sorted((r.id, r.previous) for r in got if r.id) == [(i, 2 * i - 2) for i in range(1, 100)]


def test_session_history_keeps_null_and_repeated_turns(spark, tmp_path):
    from parlance.plans.log_plans import session_history

    rows = [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (1, None, "user", "c"), (1, 1, "user", "d"), (1, 2, "user", "e"),
            (1, 2, "assistant", "f"), (2, 1, "system", "g")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.text: (r.conv_id, r.turn, r.role, r.position) for r in session_history(spark, str(tmp_path)).collect()}
    assert {k: v[:3] for k, v in got.items()} == {r[3]: r[:3] for r in rows if r[2] != "system"}
    position = {k: v[3] for k, v in got.items()}
    assert (position["a"], position["b"], position["d"], position["c"]) == (1, 2, 1, 4)
    assert {position["e"], position["f"]} == {2, 3}
    assert session_history(spark, str(tmp_path)).count() == 6


def test_stratified_split_keeps_null_class(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 4 != 0, F.concat(F.lit("c"), F.col("id") % 2)).alias("c"))
    got = splits.stratified_split(df, "id", "c")
    assert got.count() == 400
    assert got.where("c is null and split = 'test'").count() == 20


def test_loss_rollup_keeps_null_runs(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 1, 50.0), ("a", None, 4.0)], "run string, epoch int, loss double")
    got = {(r.run, r.epoch): (r.batches, r.valid_batches, r.avg_loss, r.avg_loss_x)
           for r in logs.loss_rollup(df, "run", "epoch", "loss", {"": 10.0, "_x": 100.0}).collect()}
    assert got == {(None, 1): (2, 1, 2.0, 26.0), ("a", None): (1, 1, 4.0, 4.0)}


def test_turn_keys_have_no_limit(spark):
    rows = [(1, 10_000), (2, 0), (10 ** 11, 5), (10 ** 18, 10 ** 9), (0, 99), (0, 100)]
    got = spark.createDataFrame(rows, "conv_id long, turn long").select("conv_id", "turn", turns.turn_id().alias("id")).orderBy("id").collect()
    assert [(r.conv_id, r.turn) for r in got] == sorted(rows) and len({r.id for r in got}) == len(rows)


def test_pair_cosine_of_turns_that_shared_an_id(spark):
    rows = [(1, 10_000, "alpha beta", "alpha beta"), (2, 0, "alpha beta", "gamma delta"), (3, 1, "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, a string, b string").withColumn("id", turns.turn_id())
    got = [r.similarity for r in tfidf.pair_cosine(df, "id", "a", "b").orderBy("id").collect()]
    assert abs(got[0] - 1) < 1e-12 and got[1:] == [0, 0]
    plan = tfidf.pair_cosine(df, "id", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_turn_scoring_cleans_once(spark):
    from parlance.plans.turn_plans import turn_scoring

    plan = turn_scoring(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_unseen_label_is_an_error(spark):
    import pytest

    dim = encode.fit_codes(spark.createDataFrame([("a",), ("b",)], "x string"), "x")
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    with pytest.raises(Exception, match="unseen label: z"):
        encode.apply_codes(df, dim, "x", unknown="error").collect()
    assert encode.apply_codes(df.where("x = 'a'"), dim, "x", unknown="error").first().code == 0


def test_stream_over_several_files_and_a_replayed_batch(spark, tmp_path):
    conv = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    conv.write.parquet(str(tmp_path / "conversations.parquet"))
    for k in range(3):
        part = conv.where(F.pmod("turn", F.lit(3)) == k).coalesce(1)
        part.write.parquet(str(tmp_path / f"in/part{k}.parquet"))
    source = jobs.file_stream(spark, str(tmp_path), "conversations")
    assert source.schema == conv.schema
    reader = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*.parquet"))
    agg = reader.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    got = jobs._updated(spark, agg, "conv_id", "several")
    want = conv.where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    from parlance.sources import logtables

    out = str(tmp_path / "replayed")
    for _ in range(2):
        logtables.append(want, out, batch_id=4)
    assert spark.read.parquet(out).count() == want.count()
