"""Nearest-centroid class scores for vector rows (the multi-class scorer of X3-X7).

Centroids are per-class means of each dimension (a partial aggregate); the
model is classes x dimensions numbers, packed into one row and broadcast.
Scores are computed in-row with array functions: softmax of minus the squared
distance to each centroid, argmax with the lowest class winning ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_rows(df: DataFrame, vec: str, label: str) -> DataFrame:
    """(label, c): one row per class with its centroid array."""
    per_dim = (df.select(F.col(label).alias("label"), F.posexplode(vec).alias("j", "x"))
               .groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("c"))


def fit(df: DataFrame, vec: str, label: str) -> DataFrame:
    """One row: classes (sorted) and their centroid arrays."""
    return fit_rows(df, vec, label).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("model"))


def score(df: DataFrame, vec: str, model: DataFrame) -> DataFrame:
    """Adds ``probs`` (array in class order), ``classes``, ``predicted``, ``confidence``.

    A lambda body only reads lambda variables: an outer expression inside a
    lambda is recomputed for every array element.
    """
    j = df.crossJoin(F.broadcast(model))
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    j = j.withColumn("__v", v)
    j = j.withColumn("__s", F.transform(
        "model",
        lambda m: -F.aggregate(F.zip_with(F.col("__v"), m["c"], lambda a, b: (a - b) * (a - b)),
                               F.lit(0.0), lambda acc, x: acc + x)))
    j = j.withColumn("__mx", F.array_max("__s"))
    # per-row scalars enter the lambdas as arrays (array_repeat), never as
    # expressions the optimizer could inline into a lambda body
    j = j.withColumn("__e", F.zip_with("__s", F.array_repeat("__mx", F.size("__s")),
                                       lambda s, m: F.exp(s - m)))
    j = j.withColumn("__tot", F.aggregate("__e", F.lit(0.0), lambda acc, x: acc + x))
    j = j.withColumn("probs", F.zip_with("__e", F.array_repeat("__tot", F.size("__e")), lambda e, t: e / t))
    j = j.withColumn("classes", F.transform("model", lambda m: m["label"]))
    best = F.array_position(F.col("__s"), F.col("__mx"))
    return (j.withColumn("predicted", F.element_at("classes", best.cast("int")))
            .withColumn("confidence", F.array_max("probs"))
            .drop("__v", "__s", "__mx", "__e", "__tot", "model"))
