"""Reproducible splits, folds and samples.

Random row choices of another RNG cannot be reproduced; the contract is the
fraction, determinism and stratification. Buckets come from md5 of the key so
the same split is computable in SQL engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions.labels import stable_bucket
from parlance.operators.ordered import row_number_within

BUCKETS = 10000


def hash_split(df: DataFrame, key: str, test_fraction: float = K.TEST_FRACTION,
               seed: int = K.SEED, out: str = "split") -> DataFrame:
    """'train' / 'test' by md5 bucket of the key; no shuffle, no state."""
    b = stable_bucket(key, BUCKETS, seed)
    cut = int(round((1.0 - test_fraction) * BUCKETS))
    return df.withColumn(out, F.when(b < cut, F.lit("train")).otherwise(F.lit("test")))


def stratified_split(df: DataFrame, key: str, by: str, test_fraction: float = K.TEST_FRACTION,
                     seed: int = K.SEED, out: str = "split") -> DataFrame:
    """Per class, the ceil(fraction * n_class) rows of lowest hash are 'test'.

    Exact per-class fractions; the within-class rank is computed without
    sending a class to one task (see ``ordered.grouped_scan``).
    """
    h = stable_bucket(key, 1 << 32, seed)
    ranked = row_number_within(df.withColumn("__h", h), [by], ["__h", key], out="__rn")
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    # A null class is a class of its own: its rows are split like any other's.
    sizes = sizes.withColumnRenamed(by, "__by")
    j = ranked.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    n_test = F.ceil(F.col("__n") * F.lit(test_fraction))
    return (j.withColumn(out, F.when(F.col("__rn") <= n_test, F.lit("test")).otherwise(F.lit("train")))
            .drop("__h", "__rn", "__n"))


def folds(df: DataFrame, key: str, k: int = K.CV_FOLDS, seed: int = K.SEED, out: str = "fold") -> DataFrame:
    return df.withColumn(out, stable_bucket(key, k, seed).cast("int"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = K.SEED) -> DataFrame:
    """n rows of lowest seeded hash (a top-n, merged from per-partition top-n)."""
    return df.orderBy(stable_bucket(key, 1 << 32, seed), F.col(key)).limit(n)


def positional_split(df: DataFrame, order_cols, train_fraction: float = K.POSITIONAL_TRAIN_FRACTION,
                     out: str = "split") -> DataFrame:
    """First floor(fraction * N) rows in ``order_cols`` order are 'train'."""
    ranked = row_number_within(df, [], order_cols, out="__pos")
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    j = ranked.crossJoin(F.broadcast(total))
    cut = F.floor(F.col("__n") * F.lit(train_fraction))
    return (j.withColumn(out, F.when(F.col("__pos") <= cut, F.lit("train")).otherwise(F.lit("val")))
            .withColumnRenamed("__pos", "position").drop("__n"))


#: Sample keys that part a range, and rows that a top-k settles.
CUTS, FEW = 64, 10_000


def cut_key(df: DataFrame, order_cols, position: int, few: int = FEW):
    """The order columns (a Row) of the row at the 1-based ``position``, without ordering
    all rows: the rows are counted by the ranges between a few sampled keys, then
    those of the one range that holds the position, until a top-k settles it. Each
    round is one aggregate over narrow keys; the driver sees at most CUTS keys."""
    rows = df.select(F.struct(*order_cols).alias("k"))
    fields = rows.schema["k"].dataType.fields

    def literal(row):
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])

    left, seed = position, 0
    while True:
        n, least, most = rows.agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
        if not 0 < left <= n:
            raise ValueError(f"no row at position {position}")
        if least == most:
            return least
        if n <= few:
            return rows.orderBy("k").limit(left).agg(F.max("k")).first()[0]
        drawn = F.xxhash64(F.lit(seed), *[F.col(f"k.`{f.name}`") for f in fields])
        keys = rows.orderBy(drawn).limit(CUTS).select("k").distinct().orderBy("k").collect()
        keys = [r[0] for r in keys if r[0] != most]  # a range beyond the last key is never empty
        seed += 1
        if not keys:
            continue
        beyond = sum(((F.col("k") > literal(k)).cast("int") for k in keys[1:]), (F.col("k") > literal(keys[0])).cast("int"))
        counts = dict(rows.groupBy(beyond.alias("r")).count().collect())  # at most CUTS + 1 rows
        at = 0
        while left > counts.get(at, 0):
            left -= counts.get(at, 0)
            at += 1
        if at:
            rows = rows.where(F.col("k") > literal(keys[at - 1]))
        if at < len(keys):
            rows = rows.where(F.col("k") <= literal(keys[at]))


def head_split(df: DataFrame, order_cols, train_fraction: float = K.POSITIONAL_TRAIN_FRACTION, out: str = "split") -> DataFrame:
    """``positional_split`` without positions: rows up to the cut key are 'train', so no
    row is ranked, moved or checkpointed. Rows equal in all order columns stay
    together."""
    cut = int(df.count() * train_fraction)
    if not cut:
        return df.withColumn(out, F.lit("val"))
    last = cut_key(df, order_cols, cut)
    key = F.struct(*order_cols)
    kinds = df.select(key.alias("k")).schema["k"].dataType.fields
    bound = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds])
    return df.withColumn(out, F.when(key <= bound, F.lit("train")).otherwise(F.lit("val")))
