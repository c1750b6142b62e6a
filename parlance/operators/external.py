"""External models as scorers (P3): a model object applied to Arrow batches.

When a model lives outside Spark (a NumPy / ONNX / framework object), it is
applied with ``pyspark.ml.functions.predict_batch_udf``: each Python worker
builds the predict function once and calls it on Arrow batches, so rows
never pass through Python one at a time. The rows stay where Spark put them;
only the model travels, after its size has been counted.

A model of more than ``MAX_MODEL_VALUES`` values stays a table: its classes are
dealt into blocks, rows meet one block at a time, and a row's partial results
(best score, its class, sum of exponentials) are merged. Neither the driver nor a
task holds the whole model then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest model (number of values) shipped inside the scorer's closure.
MAX_MODEL_VALUES = 50_000_000
# Values of a block of classes, and rows that meet it at once, beyond that.
BLOCK_VALUES, BLOCK_ROWS = 1_000_000, 8192

SCORE_TYPE = T.StructType([
    T.StructField("predicted", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])


def batch_scorer(make_predict_fn, dims: int, batch_size: int = 4096):
    """Column function: array<float> of length ``dims`` -> struct(predicted, confidence)."""
    return predict_batch_udf(make_predict_fn, return_type=SCORE_TYPE, batch_size=batch_size,
                             input_tensor_shapes=[[dims]])


def centroid_predictor(model: DataFrame):
    """``make_predict_fn`` for a fitted nearest-centroid model (one row, see ``centroids.fit``).

    The model is classes x dimensions values; it is read once and closed over, so
    Spark ships it with the task like any broadcast. ``score_centroids`` counts its
    values first.
    """
    row = model.first()
    entries = row["model"] if row is not None else []
    labels = np.array([e["label"] for e in entries], dtype=np.int32)
    cents = np.array([e["c"] for e in entries], dtype=np.float64)

    def make_predict_fn():
        def predict(x: np.ndarray):
            x = x.astype(np.float64)
            # minus squared distance, summed per class as ``centroids.score`` does
            s = np.empty((x.shape[0], len(labels)))
            for k in range(len(labels)):
                d = x - cents[k]
                s[:, k] = -(d * d).sum(axis=1)
            mx = s.max(axis=1, keepdims=True)
            e = np.exp(s - mx)
            probs = e / e.sum(axis=1, keepdims=True)
            best = s.argmax(axis=1)  # first maximum: the lowest class wins ties
            return {"predicted": labels[best], "confidence": probs.max(axis=1)}
        return predict
    return make_predict_fn, cents.shape[1] if cents.size else 0


def score_with(df: DataFrame, vec: str, make_predict_fn, dims: int) -> DataFrame:
    """Adds ``predicted`` and ``confidence`` from an external predict function."""
    scored = df.withColumn("__score", batch_scorer(make_predict_fn, dims)(F.col(vec)))
    return scored.select("*", "__score.predicted", "__score.confidence").drop("__score")


def score_in_blocks(df: DataFrame, key: str, vec: str, classes: DataFrame,
                    block_values: int = BLOCK_VALUES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``predicted`` and ``confidence`` from class rows (label, c) of any number.

    ``key`` is unique and not null. A null vector, or one that holds a null, gets
    null results; the lowest class wins ties; no classes, null results."""
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("c")).alias("d")).first()
    blocks = max(1, -(-size.n * max(size.d or 0, 1) // block_values))
    deals = max(1, -(-df.count() // block_rows))
    rows = (df.select(F.col(key).alias("k"), F.col(vec).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", F.isnull))
            .select("k", F.transform("v", lambda x: x.cast("double")).alias("v"),
                    F.pmod(F.xxhash64("k"), F.lit(deals)).alias("deal"),
                    F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")))
    model = classes.select(F.col("label").cast("int").alias("label"), "c", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"))

    def part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"k": left["k"][:0], "top": [], "label": [], "total": []})
        x = np.stack(left["v"].to_list()).astype(np.float64)
        top, label, total = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, c in sorted(zip(right["label"], right["c"]), key=lambda e: e[0]):
            d = x - np.asarray(c, np.float64)
            s = -(d * d).sum(axis=1)
            higher = np.maximum(top, s)
            total = total * np.exp(top - higher) + np.exp(s - higher)
            label = np.where(s > top, k, label)
            top = higher
        return pd.DataFrame({"k": left["k"].to_numpy(), "top": top, "label": label, "total": total})

    kind = df.schema[key].dataType.simpleString()
    parts = rows.groupBy("block", "deal").cogroup(model.groupBy("block", "deal")).applyInPandas(
        part, f"k {kind}, top double, label int, total double")
    # At most one part per block and row.
    merged = parts.groupBy("k").agg(F.min(F.struct((-F.col("top")).alias("low"), "label")).alias("best"),
                                    F.collect_list(F.struct("top", "total")).alias("parts"))
    whole = F.aggregate(F.zip_with("parts", F.array_repeat(-F.col("best.low"), F.size("parts")),
                                   lambda q, m: q["total"] * F.exp(q["top"] - m)), F.lit(0.0), lambda a, y: a + y)
    merged = merged.select(F.col("k").alias("__k"), F.col("best.label").alias("predicted"), (1 / whole).alias("confidence"))
    return df.join(merged, F.col(key) == F.col("__k"), "left").drop("__k")


def score_centroids(df: DataFrame, key: str, vec: str, classes: DataFrame) -> DataFrame:
    """``predicted`` and ``confidence`` from class rows (label, c): in a closure where the
    model is small, else block by block."""
    if (classes.agg(F.sum(F.size("c"))).first()[0] or 0) > MAX_MODEL_VALUES:
        return score_in_blocks(df, key, vec, classes)
    make_fn, dims = centroid_predictor(classes.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("model")))
    return score_with(df, vec, make_fn, dims)
