"""Spark ML classifiers on the long-form TF-IDF.

One feature implementation (``features``) serves both the SQL-checked queries
and the models; the estimators are Spark ML's, trained distributed.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from parlance.functions import constants as K
from parlance.operators import features, metrics, trees
from parlance.session import scratch_path
from parlance.sources.landing import stored


def featurize(train: DataFrame, test: DataFrame, id_col: str, text_col: str):
    """Fit the classifiers' TF-IDF on train; (train_vec, test_vec, model, n_terms).

    The vectors are stored once, without the texts: an iterative fit and its folds
    read the stored table.
    """
    model = features.fit_tfidf(train, id_col, text_col)
    tr, te = (features.stored_features(model, d) for d in (train, test))
    return tr, te, model, len(features.vocabulary_of(model))


def sized(df: DataFrame, n_rows: int, rows_per_partition: int = K.ML_ROWS_PER_PARTITION) -> DataFrame:
    """Fewer partitions for a small training set (no shuffle).

    An iterative fit runs one job per iteration; on a few hundred rows the
    task overhead of many partitions dominates. A set that has work for every
    core keeps them busy, and a large set keeps its partitions: the target grows
    with the row count.
    """
    busy = min(df.sparkSession.sparkContext.defaultParallelism, n_rows // K.ML_LEAST_ROWS_PER_TASK)
    target = max(1, busy, -(-n_rows // rows_per_partition))
    return df.coalesce(target) if df.rdd.getNumPartitions() > target else df


def logistic(n_train: int, c: float = K.LR_C, label: str = "label") -> LogisticRegression:
    """L2 logistic regression; C * sum(loss) + |w|^2 / 2 equals Spark's
    mean(loss) + regParam * |w|^2 / 2 for regParam = 1 / (C * n)."""
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=K.LR_MAX_ITER,
                              regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0,
                              standardization=False, tol=K.LR_TOL)


def tree(label: str = "label", depth: int = K.DT_MAX_DEPTH, leaf: int = K.DT_MIN_LEAF) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=depth,
                                  minInstancesPerNode=leaf, seed=K.SEED)


def evaluate(model, test: DataFrame, label: str = "label", name: str = "model", binary: bool = True) -> DataFrame:
    """One metrics row: accuracy, weighted precision / recall / F1 and AUC.

    P2: ``model`` is any fitted Spark ML classification model.
    """
    pred = model.transform(test).withColumn("y", F.col(label).cast("int")).withColumn(
        "p", F.col("prediction").cast("int"))
    s = metrics.summary(pred, "y", "p")
    if binary:
        scored = pred.withColumn("score", vector_to_array("probability")[1])
        a = metrics.auc(scored, "y", "score")
    else:
        a = s.sparkSession.range(1).select(F.lit(None).cast("double").alias("auc"))
    return s.crossJoin(a).select(F.lit(name).alias("name"), "*")


def fitted(estimator, rows: DataFrame, n_rows: int):
    """``estimator`` fitted on ``rows``. Spark's own tree reads every term of a row, present
    or not, in every pass: it grows the trees of few rows, which are dealt over the cores
    where a sparse fit would do with one partition; ``trees`` grows the same tree of more
    rows from the terms present."""
    if by_columns(estimator, rows, n_rows):
        return trees.fit([estimator], rows)[0]
    return estimator.fit(dealt(rows, n_rows) if isinstance(estimator, DecisionTreeClassifier) else rows)


def by_columns(estimator, rows: DataFrame, n_rows: int) -> bool:
    """Whether a tree of so many rows is grown from its rows' entries."""
    return trees.fits(estimator, rows) and n_rows > K.ML_DENSE_TREE_ROWS


def tree_tasks(spark, n_rows: int) -> int:
    """Tasks that a tree's pass over ``n_rows`` rows is worth."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-n_rows // K.ML_TREE_ROWS_PER_PARTITION)))


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` in as many partitions as a tree's passes need; a set that has more keeps them."""
    target = tree_tasks(rows.sparkSession, n_rows)
    return rows.repartition(target) if rows.rdd.getNumPartitions() < target else rows


def side_by_side(spark, tasks, workers: int) -> list:
    """Results of the functions ``tasks`` in their order, ``workers`` at a time. Each has
    its own copy of the thread's job properties: two threads that share one take
    each other's execution id away."""
    with ThreadPool(max(1, min(workers, len(tasks)))) as pool:
        return pool.map(lambda f: f(), [inheritable_thread_target(spark)(t) for t in tasks], chunksize=1)


@dataclass
class Validated:
    """Mean and deviation over the folds by grid point; the best point's model of all rows."""

    avgMetrics: list[float]
    stdMetrics: list[float]
    bestModel: object


def cross_validate(estimator, data: DataFrame, grid=None, folds: int = K.CV_FOLDS, label: str = "label",
                   fold_col: str = "fold") -> Validated:
    """Weighted F1 on hash folds for every point of the grid; the best one's model of all rows.

    Points that differ in a tree's depth alone share one fit per fold, of the deepest:
    a tree grows level by level, so the shallower one is its upper part.
    """
    spark, grid = data.sparkSession, grid or [{}]
    sizes = {r[0]: r[1] for r in data.groupBy(fold_col).count().collect()}
    n = sum(sizes.values())
    for k in range(folds):
        if not 0 < sizes.get(k, 0) < n:
            raise ValueError(f"fold {k} of {folds} has {sizes.get(k, 0)} of {n} rows: none to fit on or to measure")
    is_tree = isinstance(estimator, DecisionTreeClassifier)
    groups: dict[tuple, list[int]] = {}
    for i, point in enumerate(grid):
        others = tuple(sorted((p.name, v) for p, v in point.items() if p.name != "maxDepth"))
        groups.setdefault(others if is_tree else (i,), []).append(i)

    sparse = by_columns(estimator, data, n - max(sizes.values()))

    def measured(k: int, sets: list[list[int]]) -> list[tuple[int, int, float]]:
        rows, held = data.where(F.col(fold_col) != k), data.where(F.col(fold_col) == k)
        if not is_tree:
            ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="f1")
            return [(k, i, ev.evaluate(estimator.fit(rows, grid[i]).transform(held))) for points in sets for i in points]
        deepest = [max((estimator.copy(grid[i]) for i in points), key=lambda e: e.getMaxDepth()) for points in sets]
        grown = trees.fit(deepest, rows) if sparse else [fitted(e, rows, n - sizes[k]) for e in deepest]
        out = []
        for points, model in zip(sets, grown):
            depths = [estimator.copy(grid[i]).getMaxDepth() for i in points]
            scores = f1_by_depth(model, held, depths, label)
            out += [(k, i, scores[d]) for i, d in zip(points, depths)]
        return out

    workers = min(K.CV_PARALLELISM, max(2, spark.sparkContext.defaultParallelism // tree_tasks(spark, n))) if is_tree and not sparse else K.CV_PARALLELISM
    # The trees of a fold that are grown from its rows by feature share them.
    shares = [[*groups.values()]] if sparse else [[points] for points in groups.values()]
    tasks = [lambda k=k, sets=sets: measured(k, sets) for k in range(folds) for sets in shares]
    scores = np.zeros((folds, len(grid)))
    for found in side_by_side(spark, tasks, workers):
        for k, i, score in found:
            scores[k, i] = score
    avg, std = scores.mean(axis=0), scores.std(axis=0)
    return Validated(avg.tolist(), std.tolist(), fitted(estimator.copy(grid[int(np.argmax(avg))]), data, n))


def depth_predictions(spark, model, depths) -> DataFrame:
    """(leaf, depth, prediction): what the tree cut at each depth predicts for the rows
    of a leaf. The nodes are read from the saved model, numbered as a walk from left
    to right meets them; its leaves are numbered in the same order."""
    path = scratch_path(spark, "tree")
    model.write().save(path)
    nodes = {r.id: r for r in spark.read.parquet(f"{path}/data").select("id", "prediction", "leftChild", "rightChild").collect()}
    rows, leaf, walk = [], 0, [(0, ())]
    while walk:
        at, above = walk.pop()
        node = nodes[at]
        path_down = (*above, node.prediction)
        if node.leftChild < 0:
            rows += [(float(leaf), d, path_down[min(d, len(path_down) - 1)]) for d in sorted({*depths})]
            leaf += 1
        else:
            walk += [(node.rightChild, path_down), (node.leftChild, path_down)]
    return spark.createDataFrame(rows, "leaf double, depth int, prediction double")


def f1_by_depth(model, held: DataFrame, depths, label: str = "label") -> dict[int, float]:
    """Weighted F1 on ``held`` of the tree cut at each depth: the rows are counted by leaf
    and label once."""
    counts = model.copy({model.leafCol: "leaf"}).transform(held).groupBy("leaf", F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cut = counts.join(F.broadcast(depth_predictions(held.sparkSession, model, depths)), "leaf")
    found = cut.groupBy("depth", "y", F.col("prediction").alias("p")).agg(F.sum("n").alias("n")).collect()
    return {d: metrics.weighted_f1({(r.y, r.p): r.n for r in found if r.depth == d}) for d in {*depths}}


def fold_rows(n_train: int, folds: int) -> int:
    """Rows that a fit inside ``folds``-fold cross-validation sees."""
    return max(1, n_train * (folds - 1) // folds)


def lr_grid(lr: LogisticRegression, n_train: int):
    """C in {0.01, 0.1, 1, 10} as regParam = 1 / (C * n); the solver axis collapses."""
    return ParamGridBuilder().addGrid(lr.regParam, [1.0 / (c * max(n_train, 1)) for c in K.LR_GRID_C]).build()


def dt_grid(dt: DecisionTreeClassifier):
    """depth {10, 20, 30} (None -> 30, Spark's maximum) x leaf {1, 2, 4}."""
    return (ParamGridBuilder().addGrid(dt.maxDepth, K.DT_GRID_DEPTH)
            .addGrid(dt.minInstancesPerNode, K.DT_GRID_LEAF).build())


def fit_text_classifier(train: DataFrame, id_col: str, text_col: str, class_col: str) -> PipelineModel:
    """Text in, class name out: TF-IDF, logistic regression over the class names of
    ``train`` (in alphabetical order) and the name of the likeliest class, as one
    pipeline that can be saved. Rows without text or class are not learned from."""
    # Filtered as read: a filter before would make a computed text a second time, in the scan.
    train = stored(train.where(F.col(class_col).isNotNull()).select(id_col, text_col, class_col), "classifier-rows")
    train = train.where(F.col(text_col).isNotNull())
    tfidf_model = features.fit_tfidf(train, id_col, text_col)
    indexer = StringIndexer(inputCol=class_col, outputCol="label", stringOrderType="alphabetAsc").fit(train)
    rows = features.stored_features(tfidf_model, indexer.transform(train).select(text_col, "label"))
    n = rows.count()
    family = "binomial" if len(indexer.labels) <= 2 else "multinomial"
    fitted = logistic(n).setFamily(family).fit(sized(rows, n))
    names = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=indexer.labels)
    return PipelineModel(stages=[*tfidf_model.stages, fitted, names])


def classify(model: PipelineModel, df: DataFrame, text_col: str, name: str, confidence: str) -> DataFrame:
    """``df`` with the likeliest class of its text and that class's probability. The
    pipeline reads ``text_col`` whatever the column it was fitted on was called."""
    fitted_on = model.stages[0].getInputCol()
    d = df.withColumn(fitted_on, F.col(text_col)) if fitted_on != text_col else df
    d = model.transform(d).withColumn(confidence, F.array_max(vector_to_array("probability")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], F.col("predicted_class").alias(name), confidence)
