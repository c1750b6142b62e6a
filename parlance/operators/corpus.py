"""Corpus preparation (flow A): dedup, null drops, cleaning, labels, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions import text as TX
from parlance.operators.encode import apply_codes, fit_codes
from parlance.operators.ordered import first_by
from parlance.sources.tables import label_column, text_column


def dedup_rows(df: DataFrame, order_col: str) -> DataFrame:
    """Drop rows equal in every column but ``order_col``; keep the first."""
    keys = [c for c in df.columns if c != order_col]
    return first_by(df, keys, order_col)


def text_features(df: DataFrame, clean_col: str, prefix: str = "") -> DataFrame:
    return (df.withColumn(f"{prefix}text_len", TX.char_len(clean_col))
            .withColumn(f"{prefix}word_count", TX.word_count(clean_col))
            .withColumn(f"{prefix}has_exclaim", TX.has_char(clean_col, "!"))
            .withColumn(f"{prefix}has_question", TX.has_char(clean_col, "?")))


def sentiment_corpus(raw: DataFrame, order_col: str, stopwords=None) -> DataFrame:
    """Raw (text, label) rows -> cleaned, labelled, featurised corpus.

    Full-row duplicates dropped (first kept), rows with any null dropped,
    text column and label column chosen by name preference.
    """
    tcol, lcol = text_column(raw.drop(order_col)), label_column(raw)
    df = dedup_rows(raw, order_col).dropna(how="any")
    df = df.withColumn("clean_text", TX.clean_text(tcol))
    # dedup keeps every label value, so the label maximum and the set of
    # sentiments are those of the raw complete rows: both come from the label
    # column alone, without cleaning any text
    complete = raw.dropna(how="any").select(lcol)
    df = L.rating_to_sentiment(df, lcol, "sentiment", max_from=complete)
    dim = fit_codes(L.rating_to_sentiment(complete, lcol, "sentiment", max_from=complete),
                    "sentiment", "sentiment_encoded")
    df = apply_codes(df, dim, "sentiment", "sentiment_encoded", unknown="drop")
    df = text_features(df, "clean_text")
    return df.withColumn("stopword_ratio", TX.stopword_ratio("clean_text", stopwords))


def support_corpus(raw: DataFrame, order_col: str) -> DataFrame:
    """Raw (instruction, response[, intent, category]) -> cleaned, encoded, featurised."""
    df = dedup_rows(raw, order_col).dropna(subset=["instruction", "response"])
    df = (df.withColumn("clean_instruction", TX.clean_text("instruction"))
          .withColumn("clean_response", TX.clean_text("response")))
    for col in ("intent", "category"):
        if col in df.columns:
            dim = fit_codes(df, col, f"{col}_encoded")
            df = apply_codes(df, dim, col, f"{col}_encoded", unknown="null")
    return (df.withColumn("instruction_len", TX.char_len("clean_instruction"))
            .withColumn("response_len", TX.char_len("clean_response"))
            .withColumn("instruction_words", TX.word_count("clean_instruction"))
            .withColumn("response_words", TX.word_count("clean_response"))
            .withColumn("has_question", TX.has_char("clean_instruction", "?")))


def length_filter(df: DataFrame, instruction: str, response: str, bounds=K.LENGTH_STRICT) -> DataFrame:
    """Rows with both texts present and len(response) < r, len(instruction) < i."""
    r, i = bounds
    return df.where(F.col(response).isNotNull() & F.col(instruction).isNotNull()
                    & (F.length(response) < r) & (F.length(instruction) < i))


def length_filter_report(df: DataFrame, instruction: str, response: str) -> DataFrame:
    """Original / kept / removed counts for the strict and relaxed bounds, one scan."""
    def kept(bounds):
        r, i = bounds
        cond = (F.col(response).isNotNull() & F.col(instruction).isNotNull()
                & (F.length(response) < r) & (F.length(instruction) < i))
        return F.count_if(cond)
    agg = df.agg(F.count(F.lit(1)).alias("original"),
                 kept(K.LENGTH_STRICT).alias("kept_strict"),
                 kept(K.LENGTH_RELAXED).alias("kept_relaxed"))
    return (agg.withColumn("removed_strict", F.col("original") - F.col("kept_strict"))
            .withColumn("removed_relaxed", F.col("original") - F.col("kept_relaxed")))


def value_counts(df: DataFrame, col: str, by_key: bool = False) -> DataFrame:
    """Counts of non-null values, most frequent first (or ordered by value)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return vc.orderBy(col) if by_key else vc.orderBy(F.desc("count"), F.col(col))


def keep_top_classes(df: DataFrame, col: str, k: int = K.TOP_CLASSES) -> DataFrame:
    """Rows whose class is among the k most frequent (ties by value)."""
    top = value_counts(df, col).limit(k).select(col)
    return df.join(F.broadcast(top), on=col, how="left_semi")
