"""Golden rows for the column functions (cleaning, escalation, override, ...)."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as TX
from parlance.operators import logs, turns

CLEAN_CASES = [
    ("A B", "a b"), ("x y", "x y"), ("a\u000bb", "a b"), ("a\u001cb", "a b"),
    ("a\u001fb", "a b"), ("a\u0085b", "a b"), ("a　b", "a b"), ("a​b", "ab"),
    ("a﻿b", "ab"), ("a᠎b", "ab"), ("İstanbul", "istanbul"), ("K", "k"),
    ("café!", "caf!"), ("see http://a.b/c?d e", "see e"), ("see http://a b", "see b"),
    ("wwww awwwb", "a"), ("http", "http"), ("it's 5%?", "it's 5?"), ("  lead\t", "lead"), ("", ""),
]


def _one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", CLEAN_CASES)
def test_clean_text_golden(spark, raw, expected):
    assert _one(spark, raw, TX.clean_text("x")) == expected


MORE_CLEAN_CASES = [
    ("Hello, WORLD!!  visit www.x.y now\n\nok?", "hello, world!! visit now ok?"), ("x y z", "x y z"),
    ("hhttp://x", "h"), ("www", "www"), ("wwwx", ""), ("h", "h"), ("w", "w"), ("\u00e9http://x\u00e9", ""),
    ("a\nwww.x\n", "a"), ("ht tp", "ht tp"), ("http x", "http x"), ("hw", "hw"), ("wh", "wh"), ("x\u0085", "x"),
    (" www.a", ""), ("HTTP://X", ""), ("ahttpsb wwa wwwww", "a wwa"), ("\u00e9\u00e9 h \u00e9 w", "h w"),
]


def test_clean_text_of_urls_and_odd_characters(spark):
    cases = MORE_CLEAN_CASES
    got = spark.createDataFrame([(c[0],) for c in cases], "x string").select(TX.clean_text("x").alias("r")).collect()
    assert [r["r"] for r in got] == [c[1] for c in cases]


def test_clean_text_of_a_long_run_of_url_starts(spark):
    # each "httphwhw" is a URL, the last one runs into "www.x": "hwhw", then 300 times "a"
    assert _one(spark, "hwhw ahttp" * 300 + "www.x " * 50, TX.clean_text("x")) == "hwhw" + " a" * 300


def test_word_count_and_flags(spark):
    df = spark.createDataFrame([("",), ("a b c",), ("hi? there!",)], "x string")
    rows = df.select(TX.word_count("x").alias("w"), TX.has_char("x", "?").alias("q"),
                     TX.has_char("x", "!").alias("e")).collect()
    assert [(r.w, r.q, r.e) for r in rows] == [(0, 0, 0), (3, 0, 0), (2, 1, 1)]


@pytest.mark.parametrize("text,expected", [
    ("Whatever you say", True), ("Never again!", True), ("all fine here", False), ("That is illegal", True),
])
def test_escalation_substring(spark, text, expected):
    assert _one(spark, text, TX.escalation_trigger("x")) is expected


def test_escalation_word_boundary_mode(spark):
    assert _one(spark, "Whatever you say", TX.escalation_trigger("x", word_boundary=True)) is False
    assert _one(spark, "I hate this", TX.escalation_trigger("x", word_boundary=True)) is True


@pytest.mark.parametrize("text,label,conf,exp_label,exp_conf", [
    ("great but awful", "negative", 0.5, "positive", 0.9775),
    ("awful", "positive", 0.5, "negative", 0.99),
    ("awful", "positive", 0.6, "positive", 0.69),
    ("goodness", "negative", 0.5, "negative", 0.575),
])
def test_override_and_calibration(spark, text, label, conf, exp_label, exp_conf):
    df = spark.createDataFrame([(text, label, conf)], "x string, s string, c double")
    o = df.select(L.keyword_override("s", "c", TX.clean_text("x")).alias("o"))
    r = o.select("o.sentiment", L.calibrate("o.confidence").alias("cal")).first()
    assert (r.sentiment, r.cal) == (exp_label, exp_conf)


@pytest.mark.parametrize("raw,expected", [(0.74, True), (0.73, False)])
def test_escalation_by_score(spark, raw, expected):
    df = spark.createDataFrame([("ok", "negative", raw)], "x string, s string, c double")
    assert df.select(L.escalate("x", "s", L.calibrate("c")).alias("e")).first().e is expected


def test_rating_buckets(spark):
    five = spark.createDataFrame([(5,), (4,), (3,), (2,), (1,)], "r int")
    got = [r.sentiment for r in L.rating_to_sentiment(five, "r").orderBy(F.desc("r")).collect()]
    assert got == ["positive", "positive", "neutral", "negative", "negative"]
    small = spark.createDataFrame([(1,), (0,), (3,)], "r int")
    got = {r.r: r.sentiment for r in L.rating_to_sentiment(small, "r").collect()}
    assert got == {1: "positive", 0: "negative", 3: "negative"}


def test_small_text_helpers(spark):
    assert _one(spark, "track_order", TX.category_of("x")) == "TRACK"
    assert _one(spark, "Hi there. Bye.", TX.first_sentence("x")) == "Hi there"
    assert _one(spark, "a" * 50, TX.preview("x", 50)) == "a" * 50
    assert _one(spark, "a" * 51, TX.preview("x", 50)) == "a" * 50 + "..."
    assert _one(spark, "Customer: q Support: the answer", TX.text_after("x", "Support:")) == " the answer"


def test_reply_length_rule(spark):
    df = spark.createDataFrame([("x" * 10,), ("x" * 11,)], "g string")
    reply, source = turns.choose_reply("g")
    got = [r.s for r in df.select(source.alias("s")).collect()]
    assert got == ["Default", "GPT-2 + Dataset Context"]


def test_loss_rollup_limits(spark):
    df = spark.createDataFrame([("r", 1, float("nan")), ("r", 1, 10.0), ("r", 1, 10.01), ("r", 2, 99.0)],
                               "run string, epoch int, loss double")
    got = {r.epoch: (r.valid_batches, r.avg_loss) for r in logs.loss_rollup(df, "run", "epoch", "loss", {"": 10.0}).collect()}
    assert got == {1: (1, 10.0), 2: (0, 0.0)}


def test_grouped_count_null_group(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "intent string")
    got = {r.intent: r["count"] for r in logs.grouped_count(df, "intent").collect()}
    assert got == {"a": 2, None: 0}


def test_previous_metric_literal_and_latest(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "A", 0.7, t), (2, "A", 0.8, t + dt.timedelta(hours=1))],
                               "id long, model_name string, accuracy double, timestamp timestamp")
    r = logs.latest_by_name(df, "model_name", "accuracy", "timestamp").first()
    assert (r.previous_literal, r.previous_latest) == (0.7, 0.8)


# Values away from a rounding tie, as the reference's metrics are.
FORMAT_VALUES = [0.7561547479, 0.5902696366, 0.0, 1.0, 0.12344, 0.99996, 0.6426, 0.5096, 0.7145, 123.45678]


def test_fixed_and_percent_match_python_format(spark):
    df = spark.createDataFrame([(v,) for v in FORMAT_VALUES] + [(None,)], "x double")
    got = df.select("x", TX.fixed("x").alias("f"), TX.percent("x").alias("p")).collect()
    for r in got:
        if r.x is None:
            assert r.f is None and r.p is None
        else:
            assert r.f == f"{r.x:.4f}" and r.p == f"{r.x:.2%}"


def test_training_text_templates(spark):
    df = spark.createDataFrame([("where is my order", "It ships today.")], "i string, r string")
    r = df.select(TX.chat_text("i", "r").alias("c"), TX.dialogue_text("i", "r").alias("d")).first()
    assert r.c == ("<|system|>\nYou are a helpful e-commerce customer support assistant.\n</s>\n"
                   "<|user|>\nwhere is my order\n</s>\n<|assistant|>\nIt ships today.\n</s>")
    assert r.d == "Customer: where is my order Support: It ships today.<|endoftext|>"


def test_shape_report_and_landing(spark):
    from parlance.session import scratch_path
    from parlance.sources import landing
    from parlance.sources.tables import shape_report

    df = spark.createDataFrame([(1, "a,b\nc"), (2, None)], "id long, text string")
    rep = shape_report(df, "t", ["text", "clean_response"]).first()
    assert (rep.n_rows, rep.n_columns, rep.columns, rep.missing, rep.has_required) == (
        2, 2, "id,text", "clean_response", False)
    path = scratch_path(spark, "landing-test")
    assert landing.land(spark, df, "t", path, fmt="csv").first().records == 2
    back = spark.read.schema(df.schema).option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path)
    assert sorted(back.collect()) == sorted(df.collect())


def test_texts_without_a_url_are_cleaned_by_runs_as_by_the_two_passes(spark):
    """The same result as URL removal, character filter and white space in turn, for
    both ways of cleaning; no replacing pattern runs over a text without a URL."""
    import random

    rng = random.Random(5)
    parts = ["a", "B", "h", "w", "http", "www", "ww", "htt", "x9", " ", "  ", "\t", "\x1c", "\x85", " ", "　", "%", "é", "İ", "K",
             "\U0001f389", "?", ".", "'", "_", "[", "\\"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(600)] + [None, "", " ", "%", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    low = F.lower("x")
    turn = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, TX.URL_PATTERN, ""), TX.NON_KEPT_CHARS, ""), TX.WS_RUN, " "))
    got = df.select("x", TX.clean_text("x").alias("got"), turn.alias("want"))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    plan = got.select("got")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "CASE WHEN (Contains" in plan


def test_vector_tokens_are_those_between_word_boundaries(spark):
    texts = ["a bc, d_e f", "été à l'école", "x́y ź", "ab‍cd e", "12 3 4a", "", None, "हिन्दी a", "-ab-", "a" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    bounded = F.regexp_extract_all(F.lower("x"), F.lit(r"(?U)\b\w\w+\b"), 0)
    assert df.where(~TX.vector_tokens("x").eqNullSafe(bounded)).collect() == []
    assert r"\b" not in TX.VECTOR_TOKEN  # a boundary is looked for at every character
