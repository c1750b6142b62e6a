"""Label, confidence and escalation column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions.text import escalation_trigger, has_any, keyword_tokens


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rating_to_sentiment(df: DataFrame, col: str, out: str = "sentiment", max_from: DataFrame | None = None) -> DataFrame:
    """Map a rating / label column to a sentiment name.

    Numeric column: if its maximum is >= 4, ratings >= 4 are positive, <= 2
    negative, others neutral; otherwise 1 is positive and all else negative.
    A text column is lower-cased. The maximum is a one-row aggregate joined
    back (a broadcast of exactly one row).
    """
    dtype = dict(df.dtypes)[col]
    if dtype in ("string",):
        return df.withColumn(out, F.lower(F.col(col)))
    mx = (max_from if max_from is not None else df).agg(F.max(col).alias("__label_max"))
    x = F.col(col)
    mapped = (F.when(F.col("__label_max") >= 4,
                     F.when(x >= 4, "positive").when(x <= 2, "negative").otherwise("neutral"))
              .otherwise(F.when(x == 1, "positive").otherwise("negative")))
    return df.crossJoin(F.broadcast(mx)).withColumn(out, mapped).drop("__label_max")


def code_to_sentiment(code, n_classes) -> Column:
    """Class code -> name: 2 classes {0: negative, 1: positive}, else
    {0: negative, 1: neutral, 2: positive}; unknown codes are neutral."""
    code = _col(code)
    n = n_classes if isinstance(n_classes, Column) else F.lit(n_classes)
    two = F.when(code == 0, "negative").when(code == 1, "positive").otherwise("neutral")
    three = (F.when(code == 0, "negative").when(code == 1, "neutral")
             .when(code == 2, "positive").otherwise("neutral"))
    return F.when(n == 2, two).otherwise(three)


def keyword_override(sentiment, confidence, cleaned=None, tokens=None) -> Column:
    """Below 0.6 confidence a positive word wins first, then a negative word.

    ``tokens``: the keyword tokens where a column already holds them.
    Returns struct(sentiment, confidence) before calibration.
    """
    s, c = _col(sentiment), _col(confidence)
    toks = keyword_tokens(cleaned) if tokens is None else _col(tokens)
    low = c < K.OVERRIDE_BELOW
    pos = low & has_any(toks, K.POSITIVE_WORDS)
    neg = low & has_any(toks, K.NEGATIVE_WORDS)
    return F.struct(
        F.when(pos, "positive").when(neg, "negative").otherwise(s).alias("sentiment"),
        F.when(pos, F.lit(K.OVERRIDE_POSITIVE_CONF))
        .when(neg, F.lit(K.OVERRIDE_NEGATIVE_CONF))
        .otherwise(c.cast("double")).alias("confidence"),
    )


def calibrate(confidence) -> Column:
    """round(min(c * 1.15, 0.99), 4)."""
    return F.round(F.least(_col(confidence) * K.CALIBRATION_FACTOR, F.lit(K.CALIBRATION_CAP)),
                   K.CALIBRATION_DIGITS)


def escalate(text, sentiment, calibrated, triggers=None, word_boundary: bool = False) -> Column:
    """Trigger phrase in the message, or negative with calibrated confidence > 0.85."""
    return (escalation_trigger(text, triggers, word_boundary)
            | ((_col(sentiment) == "negative") & (_col(calibrated) > K.ESCALATION_CONFIDENCE)))


def stable_bucket(key, modulus: int, seed: int | None = None) -> Column:
    """Reproducible bucket in [0, modulus) from md5 of the key text.

    Same value in DuckDB: ('0x' || substr(md5(key), 1, 8))::BIGINT % modulus.
    """
    k = _col(key).cast("string")
    if seed is not None:
        k = F.concat(F.lit(f"{seed}:"), k)
    h = F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(modulus))


def escalation_reference(key) -> Column:
    """ESC- number in [10000, 99998], deterministic per key."""
    span = K.ESCALATION_ID_HIGH - K.ESCALATION_ID_LOW
    return (F.lit(K.ESCALATION_ID_LOW) + stable_bucket(key, span)).cast("bigint")


def escalation_reply(key) -> Column:
    return F.concat(F.lit(K.ESCALATION_REPLY), escalation_reference(key).cast("string"))


def sentiment_code(sentiment) -> Column:
    """{negative: 0, neutral: 1, positive: 2}; unknown -> null (quarantined by callers)."""
    s = _col(sentiment)
    expr = None
    for name, code in K.SENTIMENT_CODES.items():
        expr = F.when(s == name, F.lit(code)) if expr is None else expr.when(s == name, F.lit(code))
    return expr.otherwise(F.lit(None).cast("int"))
