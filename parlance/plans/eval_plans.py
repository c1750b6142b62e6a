"""Evaluation queries on fixed-weight scorers.

Binary: ``labels.quality`` of the sentiment corpus against the lexicon
scorer. Multi-class: ``embeddings.label`` against a nearest-centroid scorer
fitted on the same table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import scoring as S
from parlance.functions import text as TX
from parlance.operators import centroids, external, metrics, splits
from parlance.plans import sqlfrag as Q
from parlance.plans.corpus_plans import SENTIMENT_CORPUS_SQL, sentiment_corpus
from parlance.sources.landing import stored
from parlance.plans.registry import Tables, plan
from parlance.session import checkpoint_root

# --- SQL building blocks -------------------------------------------------------------

BINARY_SQL = f"""
sc AS ({SENTIMENT_CORPUS_SQL}),
b AS (SELECT doc_id, label AS y, {Q.lexicon_p('clean_text')} AS score,
             CASE WHEN {Q.lexicon_p('clean_text')} > 0.5 THEN 1 ELSE 0 END AS p,
             {Q.bucket('doc_id', K.CV_FOLDS, K.SEED)}::INTEGER AS fold FROM sc)
"""

CENTROID_SQL = """
ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS j FROM embeddings),
cen AS (SELECT label AS k, j, avg(x) AS m FROM ex GROUP BY label, j),
d AS (SELECT ex.vec_id, cen.k, -sum((ex.x - cen.m) * (ex.x - cen.m)) AS s FROM ex JOIN cen ON ex.j = cen.j GROUP BY ex.vec_id, cen.k),
mx AS (SELECT vec_id, max(s) AS ms FROM d GROUP BY vec_id),
pr AS (SELECT d.vec_id, d.k, exp(d.s - mx.ms) / sum(exp(d.s - mx.ms)) OVER (PARTITION BY d.vec_id) AS prob, d.s = mx.ms AS is_max
       FROM d JOIN mx ON d.vec_id = mx.vec_id),
mc AS (SELECT pr.vec_id, e.label AS y, min(pr.k) FILTER (WHERE is_max) AS p, max(prob) AS confidence
       FROM pr JOIN embeddings e ON pr.vec_id = e.vec_id GROUP BY pr.vec_id, e.label)
"""


def prf_sql(src: str, by: list[str] | None = None) -> str:
    """CTEs c, sup, prd, tp, pc (per class), f (with f1) over ``src(y, p[, by])``."""
    by = by or []
    g = "".join(f"{b}, " for b in by)
    using = ", ".join(by + ["class"])
    return f"""
c AS (SELECT {g}y AS actual, p AS predicted, count(*) AS n FROM {src} GROUP BY ALL),
sup AS (SELECT {g}actual AS class, sum(n) AS support FROM c GROUP BY ALL),
prd AS (SELECT {g}predicted AS class, sum(n) AS n_pred FROM c GROUP BY ALL),
tpc AS (SELECT {g}actual AS class, n AS tp FROM c WHERE actual = predicted),
pc AS (SELECT {g}class, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
       FROM sup FULL JOIN prd USING ({using}) LEFT JOIN tpc USING ({using})),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
"""


def summary_sql(by: list[str] | None = None) -> str:
    by = by or []
    g = "".join(f"{b}, " for b in by)
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {g}sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
       sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM f {grp}"""


def auc_sql(src: str, by: list[str] | None = None) -> str:
    by = by or []
    g = "".join(f"{b}, " for b in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""
sc2 AS (SELECT {g}score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {src} GROUP BY ALL),
cu AS (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_upto FROM sc2),
au AS (SELECT {g}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_upto - neg + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
       FROM cu {grp})
"""


def _r(c: str) -> str:
    return f"round({c}, 6) AS {c}"


# --- Spark sides ----------------------------------------------------------------------

def binary_scored(spark, sf_dir):
    sc = sentiment_corpus(spark, sf_dir)
    p = S.lexicon_positive_probability("clean_text")
    code, _ = S.binary_prediction(p)
    scored = splits.folds(sc.select("doc_id", F.col("label").alias("y"), p.alias("score"), code.alias("p")),
                          "doc_id", K.CV_FOLDS)
    # One narrow row per document, read by every metric branch: written once
    # to the shared checkpoint folder instead of re-cleaning the text per branch.
    checkpoint_root(spark)
    return scored.checkpoint(eager=True)


def centroid_scored(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    model = centroids.fit(e, "embedding", "label")
    return centroids.score(e, "embedding", model).select("vec_id", F.col("label").alias("y"),
                                                         F.col("predicted").alias("p"), "probs", "classes",
                                                         "confidence")


def _round_all(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@plan("accuracy_prf", sql=f"WITH {BINARY_SQL}, {prf_sql('b')} SELECT {', '.join(_r(c) for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM ({summary_sql()})",
      ids=("X1", "X2"))
def accuracy_prf(spark, sf_dir):
    s = metrics.summary(binary_scored(spark, sf_dir), "y", "p")
    return _round_all(s, ["accuracy", "precision", "recall", "f1"])


REPORT_TAIL = """
SELECT CAST(class AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM f WHERE support > 0
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM f WHERE support > 0
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), sum(support) FROM f WHERE support > 0
"""


@plan("classification_report", sql=f"WITH {BINARY_SQL}, {prf_sql('b')} {REPORT_TAIL}", ids=("X3",))
def classification_report(spark, sf_dir):
    r = metrics.report(binary_scored(spark, sf_dir), "y", "p")
    return _round_all(r, ["precision", "recall", "f1"])


@plan("confusion_matrix", sql=f"""
WITH {BINARY_SQL},
cls AS (SELECT y AS c FROM b UNION SELECT p FROM b),
cn AS (SELECT y AS actual, p AS predicted, count(*) AS n FROM b GROUP BY 1, 2)
SELECT a.c AS actual, q.c AS predicted, coalesce(cn.n, 0) AS count
FROM cls a, cls q LEFT JOIN cn ON cn.actual = a.c AND cn.predicted = q.c
""", ids=("X4",))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(binary_scored(spark, sf_dir), "y", "p")


@plan("roc_points", sql=f"""
WITH {BINARY_SQL},
sc2 AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM b GROUP BY score),
cu AS (SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc2)
SELECT round(score, 6) AS threshold, round(CASE WHEN N > 0 THEN fp / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN tp / P END, 6) AS tpr FROM cu
""", ids=("X5",))
def roc_points(spark, sf_dir):
    r = metrics.roc_points(binary_scored(spark, sf_dir), "y", "score")
    return _round_all(r, ["threshold", "fpr", "tpr"])


@plan("auc", sql=f"WITH {BINARY_SQL}, {auc_sql('b')} SELECT round(auc, 6) AS auc FROM au", ids=("X6",))
def auc(spark, sf_dir):
    return _round_all(metrics.auc(binary_scored(spark, sf_dir), "y", "score"), ["auc"])


@plan("centroid_report", sql=f"WITH {CENTROID_SQL}, {prf_sql('mc')} {REPORT_TAIL}", ids=("X3", "M8", "T14"))
def centroid_report(spark, sf_dir):
    r = metrics.report(centroid_scored(spark, sf_dir), "y", "p")
    return _round_all(r, ["precision", "recall", "f1"])


@plan("centroid_confusion", sql=f"""
WITH {CENTROID_SQL},
cls AS (SELECT y AS c FROM mc UNION SELECT p FROM mc),
cn AS (SELECT y AS actual, p AS predicted, count(*) AS n FROM mc GROUP BY 1, 2)
SELECT a.c AS actual, q.c AS predicted, coalesce(cn.n, 0) AS count
FROM cls a, cls q LEFT JOIN cn ON cn.actual = a.c AND cn.predicted = q.c
""", ids=("X4",))
def centroid_confusion(spark, sf_dir):
    return metrics.confusion(centroid_scored(spark, sf_dir), "y", "p")


@plan("per_class_f1", sql=f"""
WITH {CENTROID_SQL}, {prf_sql('mc')}
SELECT class, round(f1, 6) AS f1, support, f1 >= {K.GOOD_F1} AS good FROM f WHERE support > 0 ORDER BY f1 DESC, class
""", ids=("W6", "X3", "F13"))
def per_class_f1(spark, sf_dir):
    pc = metrics.per_class(centroid_scored(spark, sf_dir), "y", "p").where(F.col("support") > 0)
    return pc.select("class", F.round("f1", 6).alias("f1"), "support", (F.col("f1") >= K.GOOD_F1).alias("good")).orderBy(F.desc("f1"), "class")


@plan("confusion_topk", sql=f"""
WITH {CENTROID_SQL},
top AS (SELECT y FROM mc GROUP BY y ORDER BY count(*) DESC, y LIMIT {K.TOP_CLASSES}),
cn AS (SELECT y AS actual, p AS predicted, count(*) AS n FROM mc GROUP BY 1, 2)
SELECT a.y AS actual, b.y AS predicted, coalesce(cn.n, 0) AS count
FROM top a, top b LEFT JOIN cn ON cn.actual = a.y AND cn.predicted = b.y
""", ids=("X4", "F12", "W5"))
def confusion_topk(spark, sf_dir):
    from parlance.operators.corpus import value_counts
    s = centroid_scored(spark, sf_dir).select("y", "p")
    top = value_counts(s, "y").limit(K.TOP_CLASSES).select(F.col("y").alias("c"))
    return metrics.confusion(s, "y", "p", classes=top)


@plan("auc_ovr", sql=f"""
WITH {CENTROID_SQL},
ov AS (SELECT pr.k AS class, pr.prob AS score, (e.label = pr.k)::INTEGER AS y FROM pr JOIN embeddings e ON pr.vec_id = e.vec_id),
{auc_sql('ov', ['class'])}
SELECT round(avg(auc), 6) AS mean_auc, count(*) AS n_classes FROM au
""", ids=("X7", "E3"))
def auc_ovr(spark, sf_dir):
    s = centroid_scored(spark, sf_dir)
    long = s.select("vec_id", "y", F.posexplode_outer("probs").alias("i", "score"), "classes")
    long = long.select(F.element_at("classes", F.col("i") + 1).alias("class"), "score",
                       (F.col("y") == F.element_at("classes", F.col("i") + 1)).cast("int").alias("y"))
    a = metrics.auc(long, "y", "score", by=["class"])
    return a.agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.count(F.lit(1)).alias("n_classes"))


# --- X8: comparison of two fixed models -----------------------------------------------

COMPARISON_BASE_SQL = f"""
WITH {BINARY_SQL},
maj AS (SELECT y AS mp FROM b GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
both_ AS (SELECT 'Lexicon' AS name, doc_id, y, p, score, fold FROM b
          UNION ALL SELECT 'Majority', doc_id, y, maj.mp, 1.0, fold FROM b, maj),
{prf_sql('both_', ['name'])},
full_ AS ({summary_sql(['name'])}),
ff AS (SELECT name, fold, y, p FROM both_),
c2 AS (SELECT name, fold, y AS actual, p AS predicted, count(*) AS n FROM ff GROUP BY ALL),
sup2 AS (SELECT name, fold, actual AS class, sum(n) AS support FROM c2 GROUP BY ALL),
prd2 AS (SELECT name, fold, predicted AS class, sum(n) AS n_pred FROM c2 GROUP BY ALL),
tp2 AS (SELECT name, fold, actual AS class, n AS tp FROM c2 WHERE actual = predicted),
pc2 AS (SELECT name, fold, class, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
        FROM sup2 FULL JOIN prd2 USING (name, fold, class) LEFT JOIN tp2 USING (name, fold, class)),
m2 AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM pc2),
f2 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m2),
folds_ AS (SELECT name, fold, sum(f1 * support) / sum(support) AS f1 FROM f2 GROUP BY name, fold),
cv AS (SELECT name, avg(f1) AS cv_f1, stddev_pop(f1) AS cv_std FROM folds_ GROUP BY name),
{auc_sql('both_', ['name'])},
res AS (SELECT full_.name, accuracy, precision, recall, f1, cv_f1, cv_std, auc FROM full_ JOIN cv USING (name) JOIN au USING (name))
"""

COMPARISON_SQL = COMPARISON_BASE_SQL + """
SELECT name, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(cv_f1, 6) AS cv_f1, round(cv_std, 6) AS cv_std, round(auc, 6) AS auc,
       name = (SELECT name FROM res ORDER BY f1 DESC, name LIMIT 1) AS is_best
FROM res
"""


def _comparison(spark, sf_dir):
    """Unrounded metrics of the lexicon scorer and the majority baseline."""
    b = binary_scored(spark, sf_dir)
    maj = b.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(1).select(
        F.col("y").alias("mp"))
    lex = b.withColumn("name", F.lit("Lexicon"))
    base = (b.crossJoin(F.broadcast(maj)).withColumn("p", F.col("mp")).withColumn("score", F.lit(1.0))
            .drop("mp").withColumn("name", F.lit("Majority")))
    both = lex.unionByName(base)
    full = metrics.summary(both, "y", "p", by=["name"])
    per_fold = metrics.summary(both, "y", "p", by=["name", "fold"])
    cv = per_fold.groupBy("name").agg(F.avg("f1").alias("cv_f1"), F.stddev_pop("f1").alias("cv_std"))
    a = metrics.auc(both, "y", "score", by=["name"])
    return full.join(cv, "name").join(a, "name")


@plan("model_comparison", sql=COMPARISON_SQL, ids=("X8", "U4", "W7", "A14", "M5", "D4"))
def model_comparison(spark, sf_dir):
    res = _comparison(spark, sf_dir)
    best = res.orderBy(F.desc("f1"), "name").limit(1).select(F.col("name").alias("__best"))
    out = res.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("name") == F.col("__best")).drop("__best")
    return _round_all(out, ["accuracy", "precision", "recall", "f1", "cv_f1", "cv_std", "auc"])


@plan("model_report_text", sql=COMPARISON_BASE_SQL + f"""
SELECT name, {Q.fixed('accuracy')} AS accuracy, {Q.fixed('precision')} AS precision,
       {Q.fixed('recall')} AS recall, {Q.fixed('f1')} AS f1,
       {Q.fixed('cv_f1')} || ' \u00b1 ' || {Q.fixed('cv_std')} AS cv_f1, {Q.fixed('auc')} AS auc
FROM res
""", ids=("T27", "X8"))
def model_report_text(spark, sf_dir):
    """The comparison as printed: every metric with 4 decimals, CV F1 as ``mean ± std``."""
    r = _comparison(spark, sf_dir)
    return r.select("name", *[TX.fixed(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                    F.concat(TX.fixed("cv_f1"), F.lit(" \u00b1 "), TX.fixed("cv_std")).alias("cv_f1"),
                    TX.fixed("auc").alias("auc"))


# --- P3: the same model applied as an external scorer on Arrow batches ------------------

EXTERNAL_SQL = f"""
WITH {CENTROID_SQL}
SELECT vec_id, y, p AS predicted, round(confidence, 4) AS confidence FROM mc
"""


def _external(scored):
    return scored.select("vec_id", F.col("label").alias("y"), "predicted", F.round("confidence", 4).alias("confidence"))


@plan("external_scores", sql=EXTERNAL_SQL, ids=("P3", "M7"))
def external_scores(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    return _external(external.score_centroids(e, "vec_id", "embedding", stored(centroids.fit_rows(e, "embedding", "label"), "centroids")))


@plan("external_scores_blocks", sql=EXTERNAL_SQL, ids=("P3", "M7"))
def external_scores_blocks(spark, sf_dir):
    """The same scores by the way that larger models take: three classes a block."""
    e = Tables(spark, sf_dir).embeddings
    classes = stored(centroids.fit_rows(e, "embedding", "label"), "centroids")
    dims = classes.agg(F.max(F.size("c"))).first()[0] or 1
    return _external(external.score_in_blocks(e, "vec_id", "embedding", classes, block_values=3 * dims))
