"""Trained-model queries.

Model fits are checked by invariants (rows kept, metrics in range, reload
gives the same predictions); the data steps around them (union + dedup,
known-class filter) have SQL twins.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions import text as TX
from parlance.operators import models, splits, turns
from parlance.operators.encode import fit_codes, sentiment_codes
from parlance.operators.logs import previous_value
from parlance.operators.ordered import first_by
from parlance.plans import sqlfrag as Q
from parlance.plans.corpus_plans import SENTIMENT_CORPUS_SQL, sentiment_corpus
from parlance.plans.feature_plans import VOCAB_CTE
from parlance.plans.log_plans import LOG_SQL, written_log
from parlance.plans.registry import Tables, plan
from parlance.session import scratch_path
from parlance.sources import logtables, modelstore
from parlance.sources.landing import stored
from parlance.sources.tables import spread

_CODE = " ".join(f"WHEN {{c}} = {Q.q(k)} THEN {v}" for k, v in K.SENTIMENT_CODES.items())


def _code_sql(c: str) -> str:
    return "CASE " + _CODE.format(c=c) + " END"


def cleaned_corpus(spark, sf_dir):
    """The corpus' (doc_id, clean_text, sentiment, sentiment_encoded), stored, without empty
    texts. A filter on the cleaned text that is written into the plan of the corpus is
    moved to the scan, where it cleans every document, with a label or not, and the
    corpus' texts a second time."""
    sc = sentiment_corpus(spark, sf_dir).select("doc_id", "clean_text", "sentiment", "sentiment_encoded")
    return stored(sc, "clean-corpus").where(F.col("clean_text") != "")


def split_corpus(spark, sf_dir):
    sc = splits.hash_split(cleaned_corpus(spark, sf_dir), "doc_id")
    sc = splits.folds(sc, "doc_id", K.CV_FOLDS)
    return sc.withColumn("label", F.col("sentiment_encoded").cast("double"))


def _features(spark, sf_dir):
    sc = spread(split_corpus(spark, sf_dir).select("doc_id", "clean_text", "label", "fold", "split"))
    train, test = sc.where(F.col("split") == "train"), sc.where(F.col("split") == "test")
    tr, te, _, n_terms = models.featurize(train, test, "doc_id", "clean_text")
    tr, te = tr.select("doc_id", "label", "fold", "features"), te.select("doc_id", "label", "features")
    return models.sized(tr, tr.count()), models.sized(te, te.count()), n_terms


@plan("lr_sentiment", ids=("M1", "M6", "X1", "X2", "X6", "V6", "V9"))
def lr_sentiment(spark, sf_dir):
    tr, te, _ = _features(spark, sf_dir)
    n = tr.count()
    m = models.logistic(n).fit(tr)
    return models.evaluate(m, te, name="Logistic Regression")


@plan("dt_sentiment", ids=("M2", "M6"))
def dt_sentiment(spark, sf_dir):
    tr, te, _ = _features(spark, sf_dir)
    m = models.fitted(models.tree(), tr, tr.count())
    return models.evaluate(m, te, name="Decision Tree")


@plan("cv_f1", ids=("M5", "D4", "A14"))
def cv_f1(spark, sf_dir):
    tr, _, _ = _features(spark, sf_dir)
    cvm = models.cross_validate(models.logistic(models.fold_rows(tr.count(), K.CV_FOLDS)), tr)
    std = cvm.stdMetrics[0] if cvm.stdMetrics else None
    return spark.createDataFrame([("Logistic Regression", float(cvm.avgMetrics[0]), float(std or 0.0))],
                                 "name string, cv_f1 double, cv_std double")


@plan("grid_lr", ids=("M3",))
def grid_lr(spark, sf_dir):
    """Folds are fitted with the regularisation of their own row number, the
    winner again on all training rows with theirs."""
    tr, te, _ = _features(spark, sf_dir)
    n = tr.count()
    tr3 = splits.folds(tr.drop("fold"), "doc_id", K.GRID_FOLDS)
    inside = models.fold_rows(n, K.GRID_FOLDS)
    lr = models.logistic(inside)
    cvm = models.cross_validate(lr, tr3, models.lr_grid(lr, inside), K.GRID_FOLDS)
    rows = [(float(c), float(score)) for c, score in zip(K.LR_GRID_C, cvm.avgMetrics)]
    best_c = max(rows, key=lambda r: r[1])[0]
    best = models.evaluate(models.logistic(n, best_c).fit(tr), te, name="Logistic Regression (tuned)")
    return spark.createDataFrame(rows, "C double, cv_f1 double").crossJoin(best.select(F.col("f1").alias("test_f1_of_best")))


@plan("grid_dt", ids=("M4",))
def grid_dt(spark, sf_dir):
    tr, te, _ = _features(spark, sf_dir)
    tr3 = splits.folds(tr.drop("fold"), "doc_id", K.GRID_FOLDS)
    dt = models.tree()
    points = models.dt_grid(dt)
    cvm = models.cross_validate(dt, tr3, points, K.GRID_FOLDS)
    rows = [(int(pm[dt.maxDepth]), int(pm[dt.minInstancesPerNode]), float(score)) for pm, score in zip(points, cvm.avgMetrics)]
    best = models.evaluate(cvm.bestModel, te, name="Decision Tree (tuned)")
    grid = spark.createDataFrame(rows, "max_depth int, min_leaf int, cv_f1 double")
    return grid.crossJoin(best.select(F.col("f1").alias("test_f1_of_best")))


MODEL_ROWS_CTE = f"""{VOCAB_CTE},
mr AS (SELECT split, doc_id FROM sp WHERE clean_text <> '')"""


@plan("lr_checks", sql=f"""
WITH {MODEL_ROWS_CTE}
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
       (SELECT count(*) FROM vocab) AS n_terms, true AS metrics_in_range, true AS accuracy_recomputed,
       true AS probabilities_sum_to_one FROM mr
""", ids=("M1", "M6", "X1"))
def lr_checks(spark, sf_dir):
    """What must hold for any fit: rows, terms, metrics in range and equal to those
    recomputed from the predictions, probabilities that sum to one."""
    tr, te, n_terms = _features(spark, sf_dir)
    n = tr.count()
    m = models.logistic(n).fit(tr)
    metrics_row = models.evaluate(m, te)
    ranged = [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1", "auc")]
    ok = ranged[0]
    for r in ranged[1:]:
        ok = ok & r
    pred = m.transform(te).select("label", "prediction", vector_to_array("probability").alias("p"))
    seen = pred.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc"),
                    F.bool_and(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums"))
    return metrics_row.crossJoin(seen).select(
        F.lit(n).cast("long").alias("n_train"), "n_test", F.lit(n_terms).cast("long").alias("n_terms"),
        ok.alias("metrics_in_range"), (F.abs(F.col("accuracy") - F.col("acc")) < 1e-9).alias("accuracy_recomputed"),
        F.col("sums").alias("probabilities_sum_to_one"))


@plan("tree_checks", sql=f"""
WITH {MODEL_ROWS_CTE}
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
       true AS metrics_in_range, true AS accuracy_recomputed, true AS within_depth, true AS leaves_large_enough FROM mr
""", ids=("M2", "M6", "X1"))
def tree_checks(spark, sf_dir):
    """What must hold for any fitted tree: rows, metrics in range and equal to those
    recomputed, its depth, and the training rows of each leaf."""
    tr, te, _ = _features(spark, sf_dir)
    m = models.fitted(models.tree(), tr, tr.count())
    row = models.evaluate(m, te)
    ok = F.lit(True)
    for c in ("accuracy", "precision", "recall", "f1", "auc"):
        ok = ok & F.col(c).between(0, 1)
    seen = m.transform(te).agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc"))
    leaves = m.setLeafCol("leaf").transform(tr).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    leaves = leaves.agg(F.min("n").alias("least"), F.sum("n").alias("n_train"))
    return row.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(leaves)).select(
        "n_train", "n_test", ok.alias("metrics_in_range"), (F.abs(F.col("accuracy") - F.col("acc")) < 1e-9).alias("accuracy_recomputed"),
        F.lit(m.depth <= K.DT_MAX_DEPTH).alias("within_depth"), (F.col("least") >= K.DT_MIN_LEAF).alias("leaves_large_enough"))


@plan("cv_checks", sql=f"""
WITH {MODEL_ROWS_CTE}
SELECT fold, count(*) AS n_held, true AS in_range, true AS mean_is_reported
FROM (SELECT {Q.bucket('doc_id', K.CV_FOLDS, K.SEED)}::INTEGER AS fold FROM mr WHERE split = 'train') GROUP BY fold
""", ids=("M5", "D4", "A14", "X2"))
def cv_checks(spark, sf_dir):
    """Each fold fitted and measured by this library's own metrics: the mean of the
    folds' weighted F1 is the one that cross-validation reports."""
    tr, _, _ = _features(spark, sf_dir)
    est = models.logistic(models.fold_rows(tr.count(), K.CV_FOLDS))
    reported = models.cross_validate(est, tr).avgMetrics[0]
    rows = []
    for k in range(K.CV_FOLDS):
        held = tr.where(F.col("fold") == k)
        r = models.evaluate(est.fit(tr.where(F.col("fold") != k)), held, binary=False).first()
        rows.append((k, held.count(), float(r.f1)))
    mean = sum(r[2] for r in rows) / len(rows)
    return spark.createDataFrame([(k, n, 0 <= f1 <= 1, bool(abs(mean - reported) < 1e-6)) for k, n, f1 in rows],
                                 "fold int, n_held long, in_range boolean, mean_is_reported boolean")


@plan("grid_checks", sql=f"""
WITH {MODEL_ROWS_CTE},
pts AS (SELECT 'lr' AS model, unnest({K.LR_GRID_C})::DOUBLE AS a, 0::INTEGER AS b
        UNION ALL SELECT 'dt', d::DOUBLE, l::INTEGER FROM (SELECT unnest({K.DT_GRID_DEPTH}) AS d), (SELECT unnest({K.DT_GRID_LEAF}) AS l))
SELECT model, a, b, (SELECT count(*) FROM mr WHERE split = 'train') AS n_train, true AS in_range, true AS best_is_highest, true AS best_recomputed FROM pts
""", ids=("M3", "M4", "D4", "X2"))
def grid_checks(spark, sf_dir):
    """What must hold for any grid: every point has a mean F1 in range, the model kept
    is of the highest one, and that mean equals the one of folds fitted and measured
    one by one by this library's own metrics."""
    tr, _, _ = _features(spark, sf_dir)
    n = tr.count()
    tr3 = stored(splits.folds(tr.drop("fold"), "doc_id", K.GRID_FOLDS), "grid-rows")
    inside = models.fold_rows(n, K.GRID_FOLDS)
    lr, dt = models.logistic(inside), models.tree()
    rows = []
    for name, est, grid in (("lr", lr, models.lr_grid(lr, inside)), ("dt", dt, models.dt_grid(dt))):
        cvm = models.cross_validate(est, tr3, grid, K.GRID_FOLDS)
        best = max(range(len(grid)), key=lambda i: cvm.avgMetrics[i])
        chosen = est.copy(grid[best])
        own = models.side_by_side(spark, [lambda k=k: models.evaluate(models.fitted(chosen, tr3.where(F.col("fold") != k), inside), tr3.where(F.col("fold") == k), binary=False).first().f1
                                          for k in range(K.GRID_FOLDS)], 2)
        recomputed = abs(sum(own) / len(own) - cvm.avgMetrics[best]) < 1e-6
        kept = all(cvm.bestModel.getOrDefault(p.name) == v for p, v in grid[best].items())
        points = zip(K.LR_GRID_C, [0] * len(grid)) if name == "lr" else [(pm[dt.maxDepth], pm[dt.minInstancesPerNode]) for pm in grid]
        rows += [(name, float(a), int(b), n, bool(0 <= f1 <= 1), kept, bool(recomputed)) for (a, b), f1 in zip(points, cvm.avgMetrics)]
    return spark.createDataFrame(rows, "model string, a double, b int, n_train long, in_range boolean, best_is_highest boolean, best_recomputed boolean")


@plan("intent_lr", ids=("M8", "E1", "D2", "X3"))
def intent_lr(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "text")
    dim = fit_codes(d, "lang", "code")
    d = d.join(dim, "lang").withColumn("label", F.col("code").cast("double"))
    # Cleaned as it is stored: the ranges of the split read the rows twice.
    d = splits.stratified_split(d, "doc_id", "lang").withColumn("clean_text", TX.clean_text("text")).drop("text")
    d = stored(d, "intent-split")
    train, test = d.where(F.col("split") == "train"), d.where(F.col("split") == "test")
    tr, te, _, _ = models.featurize(train, test, "doc_id", "clean_text")
    n = tr.count()
    m = models.logistic(n).setFamily("multinomial").fit(models.sized(tr, n))
    return models.evaluate(m, te, name="Intent LR", binary=False)


@plan("model_reload", sql=f"""
WITH {MODEL_ROWS_CTE}
SELECT count(*) AS rows, count(*) AS equal FROM mr WHERE split = 'test'
""", ids=("S12", "M6"))
def model_reload(spark, sf_dir):
    tr, te, _ = _features(spark, sf_dir)
    m = models.logistic(tr.count()).fit(tr)
    path = scratch_path(spark, "model-lr")
    m.write().overwrite().save(path)
    back = LogisticRegressionModel.load(path)
    a = m.transform(te).select("doc_id", F.col("prediction").alias("p1"))
    b = back.transform(te).select("doc_id", F.col("prediction").alias("p2"))
    j = a.join(b, "doc_id")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p1") == F.col("p2")).alias("equal"))


# --- M7, M8 on turns: trained pipelines from the model store ---------------------------

def train_turn_models(spark, sf_dir):
    """Sentiment and intent classifiers of messages, fitted on the training parts of
    the sentiment corpus and of the documents' languages."""
    sc = split_corpus(spark, sf_dir).where(F.col("split") == "train")
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", TX.clean_text("text").alias("clean_text"))
    d = splits.hash_split(d, "doc_id").where(F.col("split") == "train")
    return {"sentiment": models.fit_text_classifier(sc, "doc_id", "clean_text", "sentiment"),
            "intent": models.fit_text_classifier(d, "doc_id", "clean_text", "lang")}


def published_turn_models(spark, sf_dir):
    """(root, version) of a store with freshly trained turn models."""
    root = scratch_path(spark, "model-store")
    return root, modelstore.publish(spark, root, train_turn_models(spark, sf_dir))


def turn_pairs_of(spark, sf_dir):
    return turns.pair_turns(Tables(spark, sf_dir).conversations)


@plan("turn_scoring_model", ids=("M7", "M8", "S12", "T13", "T15", "T16", "T17", "T21"))
def turn_scoring_model(spark, sf_dir):
    """Every user turn scored by the published models, loaded from the shared folder."""
    root, _ = published_turn_models(spark, sf_dir)
    version, m = modelstore.load(spark, root, ("sentiment", "intent"))
    scored = turns.score_turns_by_models(turn_pairs_of(spark, sf_dir), m["sentiment"], m["intent"])
    return scored.withColumn("model_version", F.lit(version))


@plan("turn_model_checks", sql=f"""
SELECT conv_id, turn, true AS known_sentiment, true AS known_intent, true AS in_range, true AS same_as_fitted, true AS rules_hold
FROM conversations WHERE role = 'user'
""", ids=("M7", "M8", "S12", "V6"))
def turn_model_checks(spark, sf_dir):
    """What must hold for any fit, per user turn: known classes, confidences in
    range, the loaded pipelines' raw classes and probabilities equal to the fitted
    ones', and sentiment and escalation equal to the rules applied to them."""
    root = scratch_path(spark, "model-store")
    fitted = train_turn_models(spark, sf_dir)
    modelstore.publish(spark, root, fitted)
    _, back = modelstore.load(spark, root, ("sentiment", "intent"))
    pairs = turn_pairs_of(spark, sf_dir)
    scored = turns.score_turns_by_models(pairs, back["sentiment"], back["intent"])
    d = scored.withColumn("clean", TX.clean_text("user_message"))
    for tag, m in (("a", fitted), ("b", back)):
        d = models.classify(m["sentiment"], d, "clean", f"s_{tag}", f"sp_{tag}")
        d = models.classify(m["intent"], d, "clean", f"i_{tag}", f"ip_{tag}")
    same = ((F.col("s_a") == F.col("s_b")) & (F.col("i_a") == F.col("i_b")) & (F.abs(F.col("sp_a") - F.col("sp_b")) < 1e-12)
            & (F.abs(F.col("ip_a") - F.col("ip_b")) < 1e-12))
    over = L.keyword_override("s_a", "sp_a", tokens=TX.keyword_tokens("clean"))
    d = d.withColumn("over", over)
    rules = ((F.col("sentiment") == F.col("over.sentiment")) & (F.col("sentiment_confidence") == L.calibrate("over.confidence"))
             & (F.col("intent") == F.col("i_a")) & (F.abs(F.col("intent_confidence") - F.col("ip_a")) < 1e-4)
             & (F.col("escalate") == L.escalate("user_message", "sentiment", "sentiment_confidence")))
    sentiments = back["sentiment"].stages[-1].getLabels()
    intents = back["intent"].stages[-1].getLabels()
    return d.select("conv_id", "turn", F.col("sentiment").isin(*{*sentiments, "positive", "negative"}).alias("known_sentiment"),
                    F.col("intent").isin(*intents).alias("known_intent"),
                    (F.col("sentiment_confidence").between(0, 1) & F.col("intent_confidence").between(0, 1)).alias("in_range"),
                    same.alias("same_as_fitted"), rules.alias("rules_hold"))


# --- U1, U2, J3, M10: the retrain data step -------------------------------------------

UNION_SQL = f"""
WITH sc AS ({SENTIMENT_CORPUS_SQL}),
c AS (SELECT clean_text, {_code_sql('sentiment')} AS sentiment_encoded, 0 AS src, {Q.padded('doc_id')} AS ord FROM sc
      WHERE {Q.bucket('doc_id', splits.BUCKETS, K.SEED)} < 8000 AND clean_text <> ''),
lg AS (SELECT {Q.clean('user_message')} AS clean_text, {_code_sql('sentiment')} AS sentiment_encoded, 1 AS src, id AS ord
       FROM ({LOG_SQL}) WHERE user_message IS NOT NULL AND sentiment IS NOT NULL),
u AS (SELECT * FROM c UNION ALL SELECT * FROM lg WHERE clean_text <> '' AND sentiment_encoded IS NOT NULL)
SELECT clean_text, arg_min(sentiment_encoded, (src, ord)) AS sentiment_encoded,
       CASE WHEN min(src) = 0 THEN 'corpus' ELSE 'log' END AS origin
FROM u GROUP BY clean_text
"""


def combined_train(spark, sf_dir, keys: bool = False, corpus=None):
    """Corpus and log rows, the first row of each text kept; ``keys`` adds the
    kept row's own key as ``doc_id``; ``corpus``: the split corpus, if it is at hand."""
    corpus = splits.hash_split(cleaned_corpus(spark, sf_dir), "doc_id") if corpus is None else corpus
    corpus, _ = sentiment_codes(corpus.where(F.col("split") == "train"), "sentiment")
    corpus = corpus.select("clean_text", "sentiment_encoded", F.lit(0).alias("src"),
                           F.lpad(F.col("doc_id").cast("string"), K.ID_DIGITS, "0").alias("ord"))
    log = written_log(spark, sf_dir).dropna(subset=["user_message", "sentiment"])
    log = log.withColumn("clean_text", TX.clean_text("user_message"))
    log, _ = sentiment_codes(log, "sentiment")  # ``code_quarantine`` reports the others
    log = log.where(F.col("clean_text") != "").select("clean_text", "sentiment_encoded", F.lit(1).alias("src"),
                                                      F.col("id").alias("ord"))
    u = corpus.unionByName(log, allowMissingColumns=True).withColumn("__o", F.struct("src", "ord"))
    first = first_by(u, ["clean_text"], "__o", ["sentiment_encoded"])
    key = [F.concat_ws(":", F.col("__o.src").cast("string"), "__o.ord").alias("doc_id")] if keys else []
    return first.select(*key, "clean_text", "sentiment_encoded",
                        F.when(F.col("__o.src") == 0, "corpus").otherwise("log").alias("origin"))


@plan("union_dedup_train", sql=UNION_SQL, ids=("U1", "U2", "J3", "F2", "F3", "F15"))
def union_dedup_train(spark, sf_dir):
    return combined_train(spark, sf_dir)


@plan("code_quarantine", sql=f"""
WITH sc AS ({SENTIMENT_CORPUS_SQL}),
r AS (SELECT 'corpus' AS origin, sentiment FROM sc WHERE {Q.bucket('doc_id', splits.BUCKETS, K.SEED)} < 8000 AND clean_text <> ''
      UNION ALL SELECT 'log', sentiment FROM ({LOG_SQL}) WHERE user_message IS NOT NULL AND sentiment IS NOT NULL)
SELECT origin, sentiment, {_code_sql('sentiment')} AS sentiment_encoded, {_code_sql('sentiment')} IS NULL AS quarantined, count(*) AS n_rows
FROM r GROUP BY ALL
""", ids=("J3", "A4"))
def code_quarantine(spark, sf_dir):
    """Rows of the retrain union by class name and code; names without a code are
    quarantined there, and counted here."""
    sc = splits.hash_split(cleaned_corpus(spark, sf_dir), "doc_id").where(F.col("split") == "train")
    log = written_log(spark, sf_dir).dropna(subset=["user_message", "sentiment"])
    return code_report(sc.select(F.lit("corpus").alias("origin"), "sentiment").unionByName(log.select(F.lit("log").alias("origin"), "sentiment")))


def code_report(rows):
    """(origin, sentiment, code, quarantined, n_rows) of rows with origin and sentiment."""
    n = rows.groupBy("origin", "sentiment").agg(F.count(F.lit(1)).alias("n_rows"))
    known, unknown = sentiment_codes(n, "sentiment")
    return known.withColumn("quarantined", F.lit(False)).unionByName(unknown.withColumn("quarantined", F.lit(True)))


INTENT_SAMPLES_SQL = f"""
WITH dim AS (SELECT lang AS intent, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS label
             FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT l.id, l.intent, dim.label FROM ({LOG_SQL}) l JOIN dim ON l.intent = dim.intent
WHERE l.user_message IS NOT NULL AND l.intent IS NOT NULL
"""


@plan("intent_samples", sql=INTENT_SAMPLES_SQL, ids=("M10", "J2", "F3"))
def intent_samples(spark, sf_dir):
    dim = fit_codes(Tables(spark, sf_dir).documents, "lang", "label").withColumnRenamed("lang", "intent")
    log = written_log(spark, sf_dir).dropna(subset=["user_message", "intent"])
    return log.join(dim, "intent").select("id", "intent", "label")


def retrain_runs(spark, sf_dir):
    """Metrics history of two runs: fitted on the corpus alone (run 0) and on corpus +
    log (run 1), both measured on the unchanged test split."""
    sc = splits.hash_split(cleaned_corpus(spark, sf_dir), "doc_id")
    comb = combined_train(spark, sf_dir, keys=True, corpus=sc).withColumn("label", F.col("sentiment_encoded").cast("double"))
    test, _ = sentiment_codes(sc.where(F.col("split") == "test"), "sentiment")
    test = test.select("doc_id", "clean_text", F.col("sentiment_encoded").cast("double").alias("label"))
    comb, test = stored(comb, "retrain-rows"), stored(test, "retrain-test")
    path = scratch_path(spark, "model_metrics")
    for run, rows in enumerate((comb.where(F.col("origin") == "corpus"), comb)):
        tr, te, _, _ = models.featurize(rows, test, "doc_id", "clean_text")
        n_train = tr.count()
        n_test = te.count()
        small, held = models.sized(tr, n_train), models.sized(te, n_test)
        for k, (name, est) in enumerate((("Logistic Regression", models.logistic(n_train)), ("Decision Tree", models.tree()))):
            r = models.evaluate(models.fitted(est, small, n_train), held, name=name, binary=False)
            logtables.append(r.select(F.lit(f"{run}:{name}").alias("id"), F.col("name").alias("model_name"),
                                      "accuracy", F.col("f1").alias("f1_score"), "precision", "recall",
                                      F.current_timestamp().alias("timestamp"))
                             .withColumns({"run": F.lit(run), "n_train": F.lit(n_train).cast("long"), "n_test": F.lit(n_test).cast("long")}),
                             path, batch_id=run * 2 + k)
    return previous_value(spark.read.parquet(path), "model_name", ["run", "model_name"], "accuracy", out="previous_accuracy")


@plan("retrain_cycle", ids=("M9", "S6", "W3", "W4"))
def retrain_cycle(spark, sf_dir):
    """The two runs' metrics with each model's previous accuracy."""
    return retrain_runs(spark, sf_dir).select("model_name", "run", "accuracy", "f1_score", "precision", "recall", "previous_accuracy")


@plan("retrain_checks", sql=f"""
WITH un AS ({UNION_SQL}),
te AS (SELECT * FROM ({SENTIMENT_CORPUS_SQL}) WHERE {Q.bucket('doc_id', splits.BUCKETS, K.SEED)} >= 8000 AND clean_text <> '' AND {_code_sql('sentiment')} IS NOT NULL)
SELECT m AS model_name, r::INTEGER AS run, (SELECT count(*) FROM un WHERE r = 1 OR origin = 'corpus') AS n_train,
       (SELECT count(*) FROM te) AS n_test, true AS in_range, true AS previous_holds
FROM (SELECT unnest(['Logistic Regression', 'Decision Tree']) AS m), (SELECT unnest([0, 1]) AS r)
""", ids=("M9", "S6", "W4", "U2"))
def retrain_checks(spark, sf_dir):
    """What must hold for any retrain cycle: run 0 learns from the corpus' rows, run 1
    from the union's, both are measured on the same rows with metrics in range, and
    the previous accuracy of run 1 is the accuracy of run 0."""
    hist = stored(retrain_runs(spark, sf_dir), "retrain-history")
    first = hist.where("run = 0").select("model_name", F.col("accuracy").alias("first"))
    ok = F.lit(True)
    for c in ("accuracy", "f1_score", "precision", "recall"):
        ok = ok & F.col(c).between(0, 1)
    expected = F.when(F.col("run") == 0, F.lit(None).cast("double")).otherwise(F.col("first"))
    return hist.join(first, "model_name").select("model_name", "run", "n_train", "n_test", ok.alias("in_range"),
                                                 F.col("previous_accuracy").eqNullSafe(expected).alias("previous_holds"))
