"""Evaluation metrics as aggregations.

Everything starts from a confusion aggregate ``(y, p, n)``, which is a
partial aggregate (bounded by classes squared), or from per-score counts for
ROC / AUC. Running sums over the distinct scores use ``grouped_scan``, so no
window without a partition key runs over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import grouped_scan


def confusion(df: DataFrame, y: str, p: str, dense: bool = True, classes: DataFrame | None = None) -> DataFrame:
    """(actual, predicted, count); dense over all classes seen in y or p, or over
    the given ones (column ``c``) on both axes."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    if not dense:
        return counts
    if classes is None:
        classes = (df.select(F.col(y).alias("c")).union(df.select(F.col(p).alias("c")))
                   .where(F.col("c").isNotNull()).distinct())
    grid = classes.select(F.col("c").alias("actual")).crossJoin(classes.select(F.col("c").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint")))


def per_class(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """(by..., class, tp, support, n_pred, precision, recall, f1); 0 where undefined.

    One pass: each row counts once as an actual and once as a predicted
    class (a two-element explode), summed by a single partial aggregate.
    """
    by = list(by or [])
    hit = (F.col(y) == F.col(p)).cast("int")
    ev = df.select(*by, F.explode(F.array(
        F.struct(F.col(y).alias("class"), F.lit(1).alias("a"), F.lit(0).alias("q"), hit.alias("t")),
        F.struct(F.col(p).alias("class"), F.lit(0).alias("a"), F.lit(1).alias("q"), F.lit(0).alias("t")),
    )).alias("e"))
    j = ev.groupBy(*by, F.col("e.class").alias("class")).agg(
        F.sum("e.t").cast("bigint").alias("tp"), F.sum("e.a").cast("bigint").alias("support"),
        F.sum("e.q").cast("bigint").alias("n_pred"))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f1", f1)


def summary(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Per group: accuracy and support-weighted precision / recall / F1."""
    by = list(by or [])
    pc = per_class(df, y, p, by)
    g = pc.groupBy(*by) if by else pc
    w = g.agg(F.sum("support").alias("n"), F.sum("tp").alias("correct"),
              F.sum(F.col("precision") * F.col("support")).alias("wp"),
              F.sum(F.col("recall") * F.col("support")).alias("wr"),
              F.sum(F.col("f1") * F.col("support")).alias("wf"))
    return w.select(*by, (F.col("correct") / F.col("n")).alias("accuracy"),
                    (F.col("wp") / F.col("n")).alias("precision"),
                    (F.col("wr") / F.col("n")).alias("recall"),
                    (F.col("wf") / F.col("n")).alias("f1"))


def weighted_f1(counts: dict) -> float:
    """Support-weighted F1 of a confusion {(actual, predicted): rows}; 0 where undefined."""
    total, out = sum(counts.values()), 0.0
    for c in sorted({y for y, _ in counts}):
        support = sum(n for (y, _), n in counts.items() if y == c)
        predicted, hit = sum(n for (_, p), n in counts.items() if p == c), counts.get((c, c), 0)
        prec, rec = hit / predicted if predicted else 0.0, hit / support
        out += (2 * prec * rec / (prec + rec) if prec + rec else 0.0) * support / total
    return out


def report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per-class rows plus 'macro avg' and 'weighted avg' rows (label as string)."""
    pc = per_class(df, y, p).where(F.col("support") > 0)
    rows = pc.select(F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    macro = pc.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    n = F.sum("support")
    weighted = pc.agg(F.lit("weighted avg").alias("label"),
                      (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def score_counts(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """(by..., score, pos, neg) per distinct score."""
    by = list(by or [])
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def roc_points(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """(by..., threshold, fpr, tpr) at every distinct score, highest first."""
    by = list(by or [])
    sc = score_counts(df, y, score, by).withColumn("__neg_score", -F.col("score"))
    cum = grouped_scan(sc, by, ["__neg_score"], {"tp": ("sum", "pos"), "fp": ("sum", "neg")})
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")) if by else \
        sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(tot, by) if by else cum.crossJoin(F.broadcast(tot))
    return j.select(*by, F.col("score").alias("threshold"),
                    F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                    F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))


def auc(df: DataFrame, y: str, score: str, by=None) -> DataFrame:
    """Tie-aware ROC AUC (= trapezoid area): sum over scores of
    pos(s) * (neg below s + neg(s) / 2), over P * N."""
    by = list(by or [])
    sc = score_counts(df, y, score, by)
    cum = grouped_scan(sc, by, ["score"], {"__neg_upto": ("sum", "neg")})
    part = cum.withColumn("__c", F.col("pos") * (F.col("__neg_upto") - F.col("neg") + 0.5 * F.col("neg")))
    g = part.groupBy(*by) if by else part
    agg = g.agg(F.sum("__c").alias("__u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  F.col("__u") / (F.col("P") * F.col("N"))).alias("auc"))
