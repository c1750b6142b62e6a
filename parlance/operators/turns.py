"""Turn pairing and turn scoring (the online flow as a set-wise DataFrame job)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions import scoring as S
from parlance.functions import text as TX
from parlance.operators import models


def pair_turns(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant reply at turn + 1 of the same session.

    An equi-join on (conv_id, turn): the key is unique per message, so no
    session, however long, lands in one task. Turns without a reply keep a
    null ``reply``.
    """
    user = (conversations.where(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("user_message")))
    bot = (conversations.where(F.col("role") == "assistant")
           .select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")))
    return user.join(bot, on=["conv_id", "turn"], how="left")


def turn_id(conv="conv_id", turn="turn", prefix: str = "") -> Column:
    """Text key of a turn: unique for any session and turn number, and its text
    order is the order of (session, turn) for numbers from 0."""
    parts = [F.lpad(F.col(c).cast("string"), K.ID_DIGITS, "0") for c in (conv, turn)]
    return F.concat(F.lit(prefix), parts[0], F.lit(":"), parts[1])


def _prepared(df: DataFrame, text_col: str) -> DataFrame:
    """Cleaned text, its words and its keyword tokens as columns, so that every
    later rule reads them by name and no plan repeats the cleaning regex."""
    df = df.withColumn("__clean", TX.clean_text(text_col))
    return df.withColumns({"__words": TX.words("__clean"), "__tokens": TX.keyword_tokens("__clean")})


def _sentiment(df: DataFrame, p_positive=None) -> DataFrame:
    p = p_positive if p_positive is not None else S.lexicon_positive_probability("__clean", "__tokens", "__words")
    df = df.withColumn("__p", p)
    code, conf = S.binary_prediction("__p")
    return _calibrated(df.withColumns({"__s": L.code_to_sentiment(code, 2), "__conf": conf}).drop("__p"))


def _calibrated(df: DataFrame) -> DataFrame:
    """Sentiment and confidence from the predicted ones (__s, __conf): keyword
    override, then calibration."""
    df = df.withColumn("__over", L.keyword_override("__s", "__conf", tokens="__tokens"))
    return (df.withColumn("sentiment", F.col("__over.sentiment"))
            .withColumn("sentiment_confidence", L.calibrate("__over.confidence"))
            .drop("__over", "__s", "__conf"))


def _intent(df: DataFrame) -> DataFrame:
    logits = S.lang_logits("__words")
    names = {k: f"__logit_{k}" for k in logits}
    df = df.withColumns({names[k]: lg for k, lg in logits.items()})
    df = df.withColumn("__peak", F.greatest(*names.values()))
    intent, confidence = S.softmax_choice({k: F.col(n) for k, n in names.items()}, F.col("__peak"))
    return df.withColumns({"intent": intent, "intent_confidence": confidence}).drop("__peak", *names.values())


_PREPARED = ("__clean", "__words", "__tokens")


def score_sentiment(df: DataFrame, text_col: str, p_positive=None) -> DataFrame:
    """Sentiment and calibrated confidence of each row.

    ``p_positive`` is the positive-class probability column of any two-class
    scorer; by default the fixed lexicon scorer.
    """
    return _sentiment(_prepared(df, text_col), p_positive).drop(*_PREPARED)


def score_intent(df: DataFrame, text_col: str) -> DataFrame:
    return _intent(_prepared(df, text_col)).drop(*_PREPARED)


def choose_reply(grounded, generated=None):
    """(reply, source): a grounded candidate longer than 10 characters, else a
    generated one, else the fixed default."""
    g = F.col(grounded) if isinstance(grounded, str) else grounded
    ok_g = g.isNotNull() & (F.length(g) > K.REPLY_MIN_LEN)
    if generated is None:
        gen = F.lit(None).cast("string")
    else:
        gen = F.col(generated) if isinstance(generated, str) else generated
    ok_gen = gen.isNotNull() & (F.length(gen) > K.REPLY_MIN_LEN)
    reply = F.when(ok_g, g).when(ok_gen, gen).otherwise(F.lit(K.DEFAULT_REPLY))
    source = (F.when(ok_g, F.lit(K.SOURCE_GROUNDED)).when(ok_gen, F.lit(K.SOURCE_GENERATED))
              .otherwise(F.lit(K.SOURCE_DEFAULT)))
    return reply, source


def score_turns(pairs: DataFrame, word_boundary: bool = False, p_positive=None) -> DataFrame:
    """Score user turns: sentiment, intent, escalation, reply and its source.

    Input columns: conv_id, turn, user_message, reply (candidate). Output adds
    session_id, sentiment, sentiment_confidence, intent, intent_confidence,
    escalate, response, model_used, category.
    """
    df = _intent(_sentiment(_prepared(pairs, "user_message"), p_positive)).drop(*_PREPARED)
    return _answered(df, word_boundary)


def score_turns_by_models(pairs: DataFrame, sentiment: PipelineModel, intent: PipelineModel,
                          word_boundary: bool = False) -> DataFrame:
    """``score_turns`` with trained text classifiers in place of the fixed scorers;
    keyword override, calibration, escalation and reply are the same."""
    df = _prepared(pairs, "user_message")
    df = _calibrated(models.classify(sentiment, df, "__clean", "__s", "__conf"))
    df = models.classify(intent, df, "__clean", "intent", "intent_confidence")
    df = df.withColumn("intent_confidence", F.round("intent_confidence", K.INTENT_DIGITS)).drop(*_PREPARED)
    return _answered(df, word_boundary)


def _answered(df: DataFrame, word_boundary: bool) -> DataFrame:
    """Escalation, reply and its source for turns with sentiment and intent."""
    reply, source = choose_reply("reply")
    esc = L.escalate("user_message", "sentiment", "sentiment_confidence", word_boundary=word_boundary)
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return (df.withColumn("session_id", F.col("conv_id").cast("string"))
            .withColumn("escalate", esc)
            .withColumn("response", F.when(F.col("escalate"), L.escalation_reply(key)).otherwise(reply))
            .withColumn("model_used", F.concat(F.lit(K.MODEL_USED_PREFIX),
                                               F.when(F.col("escalate"), F.lit(K.SOURCE_ESCALATION))
                                               .otherwise(source)))
            .withColumn("category", TX.category_of("intent")))


def log_rows(scored: DataFrame) -> DataFrame:
    """Scored turns as conversation-log rows (the log table's columns)."""
    return scored.select(
        turn_id().alias("id"),
        "session_id", "user_message", F.col("response").alias("bot_response"),
        "intent", "intent_confidence", "sentiment", "sentiment_confidence", "model_used",
        F.col("escalate").cast("int").alias("escalated"),
        F.current_timestamp().alias("timestamp"),
    )


def training_rows(scored: DataFrame, source: str = "user", prefix: str = "") -> DataFrame:
    """Scored turns as training pairs; category is the intent's upper prefix."""
    return scored.select(
        turn_id(prefix=prefix).alias("id"),
        F.col("user_message").alias("instruction"), F.col("response").alias("response"),
        "intent", "category", F.coalesce(F.lit(source), F.lit("user")).alias("source"),
        F.current_timestamp().alias("timestamp"),
    )
