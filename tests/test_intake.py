"""Message intake: rejects, repeats, session state, joined streams, windows, compaction."""

import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.sources import logtables
from parlance.streaming import intake

AT = "2024-01-01T00:{:02d}:00.000Z"


def _drop(folder, name, lines):
    """One file of the feed; later names are later files."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text("".join(f"{x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)}\n" for x in lines), encoding="utf-8")


def _message(i, turn=0, role="user", text="hello", session="s1", at=0, **more):
    return {"message_id": i, "session_id": session, "role": role, "turn": turn, "message": text, "sent_at": AT.format(at)} | more


def _rows(spark, path, *columns):
    return sorted((tuple(r) for r in spark.read.parquet(str(path)).select(*columns).collect()), key=repr)


def test_faulty_lines_land_where_stated_and_repeats_once(spark, tmp_path):
    src, out, bad, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "bad", tmp_path / "ckpt"

    def run():
        intake.take_in(intake.message_stream(spark, str(src)), str(out), str(bad), str(ckpt))

    _drop(src, "a", [_message("m1", text="é <b>"), '{"message_id": "m2", "mess', _message("m3", text=" \t"), {"message_id": "m4", "sent_at": AT.format(1)},
                     {"message_id": "m5", "message": "plain", "sent_at": AT.format(2)}, {"message": "no id", "sent_at": AT.format(2)},
                     {"message_id": "m6", "message": "no time"}, _message("m1", text="é <b>", at=3), _message("m7", turn="seven")])
    run()
    _drop(src, "b", [_message("m5", text="again", at=4), _message("m8", at=5)])
    run()
    run()
    assert _rows(spark, out, "message_id", "session_id", "user_name", "message") == [
        ("m1", "s1", K.DEFAULT_USER, "é <b>"), ("m5", K.DEFAULT_SESSION, K.DEFAULT_USER, "plain"), ("m8", "s1", K.DEFAULT_USER, "hello")]
    reasons = sorted(r.reason for r in spark.read.parquet(str(bad)).collect())
    assert reasons == ["blank message", "malformed", "malformed", "no id", "no message", "no time"]
    assert '{"message_id": "m2", "mess' in {r.line for r in spark.read.parquet(str(bad)).collect()}


def test_session_memory_outlives_batches_and_ignores_repeats(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"

    def run():
        intake.remember_sessions(intake.message_stream(spark, str(src)), str(out), str(ckpt))

    first = [_message("a", 1, "assistant", "hi"), _message("b", 0, "user", "hello"), _message("c", 0, "user", None, "s2"), _message("d", 5, session=None)]
    _drop(src, "a", first)
    run()
    _drop(src, "b", [_message("e", 2, "user", "more"), _message("f", 1, "assistant", None, "s2")])
    _drop(src, "c", first)  # the first file delivered again
    run()
    assert _rows(spark, out, "session_id", "turn", "role", "message", "position", "previous") == [
        ("s1", 0, "user", "hello", 1, None), ("s1", 1, "assistant", "hi", 2, "hello"), ("s1", 2, "user", "more", 3, "hi"),
        ("s2", 0, "user", None, 1, None), ("s2", 1, "assistant", None, 2, None)]


def test_session_memory_forgets_after_its_time(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"

    def run():
        intake.remember_sessions(intake.message_stream(spark, str(src)), str(out), str(ckpt), ttl_ms=1)

    for name in "ab":  # the same message long after: the first one is forgotten
        _drop(src, name, [_message("a", 0)])
        run()
    assert _rows(spark, out, "turn", "position") == [(0, 1), (0, 1)]


def test_streams_of_turns_and_replies(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"

    def run():
        intake.pair_streams(intake.message_stream(spark, str(src)), intake.message_stream(spark, str(src)), str(out), str(ckpt), "10 minutes", "5 minutes")

    _drop(src, "a", [_message("u1", 0, at=0, text="q1"), _message("u2", 0, session="s2", at=1, text="q2"), _message("u3", 0, session="s3", at=1, text="q3")])
    run()
    _drop(src, "b", [_message("r1", 1, "assistant", "late but in time", at=4), _message("r2", 1, "assistant", "too late", "s2", at=20),
                     _message("r4", 1, "assistant", "reply without a turn", "s4", at=3)])
    run()
    got = _rows(spark, out, "session_id", "user_message", "reply")
    assert ("s1", "q1", "late but in time") in got and not any(r[0] == "s4" for r in got)
    intake.land_closing(spark, str(src))
    run()
    got = [r for r in _rows(spark, out, "session_id", "user_message", "reply") if r[0] != K.CLOSING_SESSION]
    assert got == [("s1", "q1", "late but in time"), ("s2", "q2", None), ("s3", "q3", None)]


def test_windows_merge_over_batches(spark, tmp_path):
    src, out, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "ckpt"
    texts = ["I want to speak to a manager now", "thank you great", "terrible awful bad", "hello"]
    rows = [_message(f"m{i}", i, "user", texts[i % 4], f"s{i % 7}") | {"sent_at": f"2024-01-{1 + i % 3:02d}T00:00:00.000Z"} for i in range(40)]
    for k in range(3):
        _drop(src, f"f{k}", rows[k::3])
        intake.refresh_dashboard(intake.message_stream(spark, str(src)), str(out), str(ckpt), "10 days")
    r = intake.merged_dashboard(spark, str(out)).first()
    assert (r.conversations, r.sessions, r.windows) == (40, 7, 3)
    feed = spark.read.schema(intake.MESSAGE).json(str(src))
    want = intake.score_feed(feed).agg(F.count_if("escalate").alias("e"), F.count_if(F.col("sentiment") == "positive").alias("p"), F.count_if(F.col("sentiment") == "negative").alias("n")).first()
    assert (r.escalations, r.positive, r.negative) == tuple(want) and r.escalations > 0


def test_feedback_is_appended_rejected_and_summed(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("out", "bad", "sum", "ckpt")]
    src = tmp_path / "src"
    _drop(src, "a", [{"session_id": "a", "rating": 5, "comment": "ok"}, {"session_id": "a", "rating": 0}, {"session_id": "b"}, "{oops", {"session_id": None, "rating": 2}])
    intake.take_feedback(intake.feedback_stream(spark, str(src)), *paths)
    _drop(src, "b", [{"session_id": "a", "rating": 1}, {"session_id": "b", "rating": 6}])
    intake.take_feedback(intake.feedback_stream(spark, str(src)), *paths)
    assert _rows(spark, paths[0], "session_id", "rating") == [("a", 1), ("a", 5), (None, 2)]
    assert _rows(spark, paths[1], "reason", "session_id") == [
        ("malformed", None), ("no rating", "b"), ("rating out of range", "a"), ("rating out of range", "b")]
    total = spark.read.parquet(paths[2]).groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("low").alias("l"))
    assert sorted((tuple(r) for r in total.collect()), key=repr) == [("a", 2, 6, 1), (None, 1, 2, 1)]


def test_compaction_is_whole_and_repeatable(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long"

    def ids():
        return sorted(r.k for r in logtables.read_batches(spark, path, spark.createDataFrame([], schema).schema).collect())

    schema_type = spark.createDataFrame([], schema).schema
    assert ids() == [] and logtables.compact(spark, path, schema_type) is None
    for b in range(3):
        logtables.append(spark.range(b * 10, b * 10 + 10).toDF("k"), path, b)
    held = logtables.read_batches(spark, path, schema_type)  # opened before the compaction
    assert logtables.compact(spark, path, schema_type) == 2
    assert logtables.compact(spark, path, schema_type) is None
    assert ids() == list(range(30)) and held.count() == 30
    logtables.append(spark.range(30, 40).toDF("k"), path, 3)
    logtables.append(spark.range(30, 40).toDF("k"), path, 3)  # a repeated batch
    (tmp_path / "t" / "compacted" / "draft-abc").mkdir()  # left by one that broke off
    assert ids() == list(range(40))
    assert logtables.compact(spark, path, schema_type) == 3
    assert logtables.remove_compacted(spark, path) == 5
    assert ids() == list(range(40)) and not (tmp_path / "t" / "batch=3").exists()


@pytest.mark.parametrize("delay", ["1 day"])
def test_empty_feeds_give_empty_tables(spark, tmp_path, delay):
    src, out, bad, ckpt = tmp_path / "src", tmp_path / "out", tmp_path / "bad", tmp_path / "ckpt"
    _drop(src, "a", [])
    intake.take_in(intake.message_stream(spark, str(src)), str(out), str(bad), str(ckpt), delay)
    assert not out.exists() or spark.read.schema(intake.MESSAGE).parquet(str(out)).count() == 0
