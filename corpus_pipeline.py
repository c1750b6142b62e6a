"""Corpus pipeline: toxicity, near-duplicate documents, repeated strings, source
mix, packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``; all but the
last return the columns of ``documents``.

Defined results follow the operators': a null or empty text is never toxic for
its words and stays; a document without labels is judged like any other; extra
columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from parlance.llm.support import fresh, quoted, saved
from parlance.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), train=lambda key: toxicity.fold_of(key, 5) != 0)
    score, = fresh(docs, "toxicity")
    return toxicity.scored(docs, lexicon, score=score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-gram Jaccard of 0.8 or more."""
    return jaccard_join.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur elsewhere; n_chars follows."""
    out = suffix_dedup.cleaned(docs)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*map(quoted, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; documents repeat by epoch."""
    out = mixing.mixed_documents(docs)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind)).select(*map(quoted, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed 2048-token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The stages learn weights and use a tokenizer library, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is stored and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}", release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
