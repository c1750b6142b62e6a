"""Model invariants: rows kept, probabilities sum to one, reload is identical."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from parlance.operators import encode, external, features, models, splits, tfidf, trees, turns
from parlance.plans import feature_plans, model_plans
from parlance.sources import modelstore
from parlance.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_tree_and_reload(spark):
    sc = model_plans.split_corpus(spark, SMALL)
    train, test = sc.where(F.col("split") == "train"), sc.where(F.col("split") == "test")
    tr, te, _, n_terms = models.featurize(train, test, "doc_id", "clean_text")
    assert 0 < n_terms <= 5000
    assert tr.count() == train.count() and te.count() == test.count()
    m = models.tree().fit(tr)
    pred = m.transform(te)
    sums = pred.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0
    r = model_plans.model_reload(spark, SMALL).first()
    assert r.rows == r.equal > 0


def test_hash_split_is_complete_and_disjoint(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id")
    s = splits.hash_split(d, "doc_id")
    assert s.count() == d.count()
    frac = s.where(F.col("split") == "test").count() / d.count()
    assert 0.1 < frac < 0.3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_need_no_python_and_no_shuffle(spark):
    train = spark.createDataFrame([(1, "good good day sun"), (2, "bad day sun"), (3, "good bad"), (4, None), (5, "")], "id int, text string")
    model = features.fit_tfidf(train, "id", "text", (1, 2), min_df=1)
    out = features.with_features(model, train)
    plan = _plan(out)
    assert "Python" not in plan and "Exchange" not in plan
    rows = {r.id: r.features for r in out.collect()}
    assert rows[4].numNonzeros() == rows[5].numNonzeros() == 0 and rows[1].size == len(features.vocabulary_of(model))
    assert abs(rows[1].norm(2) - 1) < 1e-12
    # by hand: idf = ln((1 + 5) / (1 + df)) + 1, 1 + ln(tf)
    import math
    terms = features.vocabulary_of(model)
    raw = {"good": (1 + math.log(2)) * (math.log(6 / 3) + 1), "day": math.log(6 / 3) + 1, "sun": math.log(6 / 3) + 1,
           "good good": math.log(6 / 2) + 1, "good day": math.log(6 / 2) + 1, "day sun": math.log(6 / 3) + 1}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    got = {terms[i]: v for i, v in zip(rows[1].indices, rows[1].values)}
    assert got.keys() == raw.keys() and all(abs(got[t] - raw[t] / norm) < 1e-12 for t in raw)
    long = features.long_weights(model, train, "id")
    assert "SortMergeJoin" not in _plan(long)
    assert {(r.term, r.weight) for r in long.where("id = 1").collect()} == {(t, v) for t, v in got.items()}


def test_saved_features_are_the_fitted_ones(spark, tmp_path):
    train = spark.createDataFrame([(1, "a1 b1 c1"), (2, "b1 c1 c1"), (3, "é1 漢字")], "id int, text string")
    model = features.fit_tfidf(train, "id", "text", (1, 2), min_df=1)
    model.write().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    back = PipelineModel.load(str(tmp_path / "m"))
    assert features.vocabulary_of(back) == features.vocabulary_of(model)
    a, b = (features.with_features(m, train).collect() for m in (model, back))
    assert a == b


def test_sublinear_weights_stay_in_the_row(spark):
    assert "Window" not in _plan(feature_plans.tfidf_sublinear(spark, SMALL))


def _messages(spark, rows, path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(path)


def test_a_version_published_between_batches_changes_later_rows_only(spark, tmp_path):
    def fitted(flip):
        rows = [(i, ("sun shine day" if i % 2 else "rain storm night"), ("positive" if (i % 2) ^ flip else "negative"), ("de" if i % 2 else "en")) for i in range(40)]
        d = spark.createDataFrame(rows, "id int, clean_text string, sentiment string, lang string")
        return {"sentiment": models.fit_text_classifier(d, "id", "clean_text", "sentiment"),
                "intent": models.fit_text_classifier(d, "id", "clean_text", "lang")}

    root, src, out, ckpt = (str(tmp_path / x) for x in ("store", "src", "out", "ckpt"))
    schema = "conv_id long, turn long, role string, text string"

    def run():
        jobs.stream_scoring_model(spark.readStream.schema(schema).parquet(src), root, out, ckpt)

    assert modelstore.versions(spark, root) == []
    assert modelstore.publish(spark, root, fitted(0)) == 1
    _messages(spark, [(1, 0, "user", "sun shine"), (1, 1, "assistant", "yes"), (2, 0, "user", None)], src)
    run()
    assert modelstore.publish(spark, root, fitted(1)) == 2
    _messages(spark, [(3, 0, "user", "sun shine"), (4, 0, "user", "rain storm")], src)
    run()
    run()  # nothing waits: nothing changes
    got = {r.conv_id: (r.sentiment, r.intent, r.model_version) for r in spark.read.parquet(out).collect()}
    assert got[1] == ("positive", "de", 1) and got[3] == ("negative", "de", 2) and got[4] == ("positive", "en", 2)
    assert got[2][2] == 1 and set(got) == {1, 2, 3, 4}
    version, old = modelstore.load(spark, root, ("sentiment", "intent"), 1)
    again = turns.score_turns_by_models(spark.createDataFrame([(1, 0, "sun shine", None)], "conv_id long, turn long, user_message string, reply string"),
                                        old["sentiment"], old["intent"]).first()
    assert (version, again.sentiment) == (1, "positive")


def test_blocks_score_as_one_model_does(spark):
    rng = random.Random(2)
    classes = [(k, [rng.uniform(-1, 1) for _ in range(3)]) for k in range(23)] + [(40, None)]
    classes[23] = (40, classes[5][1])  # a tie: the lower class wins
    model = spark.createDataFrame(classes, "label int, c array<double>")
    rows = [(i, [rng.uniform(-2, 2) for _ in range(3)], "x") for i in range(60)] + [(60, classes[5][1], "x"), (61, None, "x"), (62, [1.0, None, 2.0], "x")]
    df = spark.createDataFrame(rows, "id long, v array<float>, label string")
    got = {r.id: r for r in external.score_in_blocks(df, "id", "v", model, block_values=9, block_rows=7).collect()}
    assert len(got) == 63 and got[60].predicted == 5 and got[61].predicted is got[62].confidence is None and got[0].label == "x"
    for i, v, _ in rows[:60]:
        v = np.float32(v).astype(float)
        s = {k: -float(((v - c) ** 2).sum()) for k, c in classes}
        best = max(s.values())
        assert got[i].predicted == min(k for k in s if s[k] == best)
        assert abs(got[i].confidence - 1 / sum(math.exp(x - best) for x in s.values())) < 1e-9
    none = external.score_in_blocks(df, "id", "v", model.limit(0)).collect()
    assert len(none) == 63 and all(r.predicted is None for r in none)


def test_large_models_go_by_blocks(spark, monkeypatch):
    model = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0])], "label int, c array<double>")
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [2.9, 3.0])], "id long, v array<float>")
    small = external.score_centroids(df, "id", "v", model).orderBy("id").collect()
    monkeypatch.setattr(external, "MAX_MODEL_VALUES", 3)
    large = external.score_centroids(df, "id", "v", model).orderBy("id").collect()
    assert [r.predicted for r in small] == [r.predicted for r in large] == [0, 1]
    assert all(abs(a.confidence - b.confidence) < 1e-12 for a, b in zip(small, large))


def test_codes_alike_by_one_task_and_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "b", "", "é"] * 3], "name string")
    want = {"": 0, "a": 1, "b": 2, "c": 3, "é": 4}
    assert {r.name: r.code for r in encode.fit_codes(df, "name").collect()} == want
    monkeypatch.setattr(encode.K, "DIMENSION_BROADCAST_ROWS", 2)
    assert {r.name: r.code for r in encode.fit_codes(df, "name").collect()} == want
    assert encode.fit_codes(df.limit(0), "name").count() == 0


def test_names_without_a_code_are_counted(spark):
    df = spark.createDataFrame([("log", "positive"), ("log", "angry"), ("log", "angry"), ("corpus", "neutral"), ("log", None)], "origin string, sentiment string")
    got = {(r.origin, r.sentiment): (r.sentiment_encoded, r.quarantined, r.n_rows) for r in model_plans.code_report(df).collect()}
    assert got == {("log", "positive"): (2, False, 1), ("log", "angry"): (None, True, 2), ("corpus", "neutral"): (1, False, 1), ("log", None): (None, True, 1)}


def _tree_rows(spark, n=240, seed=5):
    rng = random.Random(seed)
    rows = [(i, float(rng.random() < 0.35 + 0.3 * (i % 3 == 0)), i % 3, Vectors.dense([rng.random(), float(i % 3 == 0), round(rng.random(), 1)])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "fold", "features"])


def test_a_tree_cut_at_a_depth_is_the_shallower_tree(spark):
    rows = _tree_rows(spark)
    deep = models.tree(depth=9, leaf=1).fit(rows)
    cut = deep.copy({deep.leafCol: "leaf"}).transform(rows).select("id", "leaf").join(models.depth_predictions(spark, deep, [1, 3, 5, 9]), "leaf")
    assert deep.depth > 5
    for depth in (1, 3, 5, 9):
        own = models.tree(depth=depth, leaf=1).fit(rows).transform(rows).select("id", F.col("prediction").alias("own"))
        both = cut.where(F.col("depth") == depth).join(own, "id")
        assert both.count() == 240 and both.where("own <> prediction").count() == 0


def test_depths_of_a_grid_share_a_fit_and_score_alike(spark, monkeypatch):
    rows = _tree_rows(spark).cache()
    dt = models.tree()
    grid = ParamGridBuilder().addGrid(dt.maxDepth, [2, 4, 7]).addGrid(dt.minInstancesPerNode, [1, 4]).build()
    fits, fit = [], models.fitted
    monkeypatch.setattr(models, "fitted", lambda *a: fits.append(1) or fit(*a))
    got = models.cross_validate(dt, rows, grid, 3)
    assert len(fits) == 3 * 2 + 1  # 3 folds, 2 leaf sizes, the best one
    want = CrossValidator(estimator=dt, estimatorParamMaps=grid, numFolds=3, foldCol="fold", seed=1,
                          evaluator=MulticlassClassificationEvaluator(metricName="f1")).fit(rows)
    assert np.allclose(got.avgMetrics, want.avgMetrics, atol=1e-12) and np.allclose(got.stdMetrics, want.stdMetrics, atol=1e-12)
    assert got.bestModel.getMaxDepth() == want.bestModel.getMaxDepth() and got.bestModel.numNodes == want.bestModel.numNodes


def test_fits_side_by_side_have_their_own_job_properties(spark):
    """Threads that share one copy take each other's execution id away."""
    sc, gate = spark.sparkContext, threading.Barrier(4, timeout=60)

    def task(i):
        sc.setLocalProperty("parlance.test", str(i))
        gate.wait()
        return sc.getLocalProperty("parlance.test")

    assert models.side_by_side(spark, [lambda i=i: task(i) for i in range(4)], 4) == ["0", "1", "2", "3"]
    empty = _tree_rows(spark).where("fold <> 1")
    with pytest.raises(ValueError):
        models.cross_validate(models.tree(), empty, folds=3)


def test_tree_rows_are_dealt_over_the_cores(spark):
    rows = _tree_rows(spark).coalesce(1)
    assert models.dealt(rows, 240).rdd.getNumPartitions() == 1
    assert models.dealt(rows, 1_000_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_term_totals_are_the_summed_term_counts_of_any_split_into_tallies(spark, monkeypatch):
    """df and cf of a task's sorted numbers equal the (document, term) rows added up, also
    where a task starts anew, for null, empty, one-word and non-ASCII texts."""
    texts = [None, "", "a", "one", "one one", "one two one two", "zwei Zwei été ÉTÉ x", "two one", "one"] * 150
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    for tallied in (tfidf.TALLIED, 5):
        monkeypatch.setattr(tfidf, "TALLIED", tallied)
        for ngrams in ((1, 1), (1, 2), (2, 2)):
            counts = tfidf.term_counts(df, "id", "text", ngrams).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
            assert sorted(map(tuple, tfidf.term_totals(df, "text", ngrams).collect())) == sorted(map(tuple, counts.collect()))


def test_fitting_the_vocabulary_makes_no_row_per_document_and_term(spark):
    """The vocabulary's aggregate meets a task's distinct terms, not its documents' ones."""
    df = spark.range(4000).select(F.col("id"), F.lit("same words again").alias("text")).coalesce(1)
    plan = tfidf.term_totals(df, "text", (1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert {(r.term, r.df, r.cf) for r in tfidf.term_totals(df, "text", (1, 2)).collect()} == {
        (t, 4000, 4000) for t in ("same", "words", "again", "same words", "words again")}


def test_stored_vectors_are_those_of_the_stages(spark):
    """Vectors made in numpy equal the JVM stages' ones bit by bit, in rows and order, and
    the regex is asked for texts that are not ASCII alone."""
    texts = [None, "", "a", "one", "One one_2 a one", "it's one.two,ONE two", "zwei Zwei été ÉTÉ x", "two one", "İstanbul one two", "b one", "two", "x"]
    train = spark.createDataFrame([(i, t, f"k{i % 3}") for i, t in enumerate(texts * 60)], "id long, text string, kind string").repartition(3)
    for ngrams, sublinear in (((1, 2), True), ((1, 1), False), ((2, 2), True)):
        model = features.fit_tfidf(train, "id", "text", ngrams, min_df=1, sublinear=sublinear)
        stored = features.stored_features(model, train)
        assert stored.columns == ["id", "kind", "features"]
        want = {r.id: (r.kind, r.features) for r in features.with_features(model, train).collect()}
        assert {r.id: (r.kind, r.features) for r in stored.collect()} == want
    plan = _plan(tfidf.weighed(train, "text", ["one"], [1.0], (1, 1), True, "v"))
    assert "MapInArrow" in plan and "from_json" not in plan
    many = spark.createDataFrame([(k, " ".join(["one"] * k + ["two"])) for k in (3, 5, 4095, 4096, 5000)], "id long, text string")
    got, want = ({r.id: r.features for r in f(model, many).collect()} for f in (features.stored_features, features.with_features))
    assert got.keys() == want.keys() and all(abs(got[k].values - want[k].values).max() < 1e-15 for k in got)


def test_tokens_of_a_batch_are_the_vectorizer_tokens(spark):
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "".join(rng.choices("abzAZ09_ .,'\n-é漢", k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    batch = tfidf.tokenized(df, "text").toArrow().combine_chunks().to_batches()[0]
    want = df.select(F.coalesce(tfidf.vector_tokens("text"), F.array().cast("array<string>")).alias("t")).toArrow()["t"].to_pylist()
    for lo, n in ((0, 3000), (17, 256), (2999, 1)):
        order, lengths, words, word_of = tfidf.tokens_of(batch.slice(lo, n))
        flat, at, got = [words[i] for i in word_of], 0, [None] * n
        for row, size in zip(order, lengths):
            got[row], at = flat[at:at + size], at + size
        assert got == want[lo:lo + n]


def test_a_training_set_with_work_for_every_core_is_spread_over_them(spark):
    rows = spark.range(0, 100, 1, 64)
    cores = spark.sparkContext.defaultParallelism
    assert models.sized(rows, 4_000).rdd.getNumPartitions() == 1
    assert models.sized(rows, 40_000).rdd.getNumPartitions() == min(cores, 8)
    assert models.sized(rows, 10_000_000).rdd.getNumPartitions() == 64


def test_vocabulary_of_the_terms_told_is_that_of_all_terms(spark, monkeypatch):
    """Few terms told by many tallies, terms that are frequent in some of them alone, and
    equal counts at the end of the vocabulary; a text without frequent terms adds all up."""
    rng = random.Random(8)
    words = [f"w{i:03d}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words[:150] if i < 200 else words[::-1], weights[:150] if i < 200 else weights, k=rng.randint(0, 40))) for i in range(400)]
    flat = [f"u{i} v{i}" for i in range(400)]
    monkeypatch.setattr(tfidf, "SLICE", 10)
    monkeypatch.setattr(tfidf, "TALLIED", 600)
    asked = []
    for name in ("recounted", "term_totals"):
        monkeypatch.setattr(tfidf, name, lambda *a, f=getattr(tfidf, name), name=name: asked.append(name) or f(*a))
    for rows, path, told in ((texts, "recounted", 8), (texts, "term_totals", 1), (flat, "term_totals", 8)):
        monkeypatch.setattr(tfidf, "TOLD", told)
        df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").coalesce(2)
        n = tfidf.doc_count(df)
        for ngrams, min_df in (((1, 1), 1), ((1, 2), 2), ((2, 2), 1)):
            want = tfidf.fit_vocabulary(tfidf.term_counts(df, "id", "text", ngrams), n, min_df, 20)
            asked.clear()
            got = tfidf.vocabulary_of(tfidf.frequent_totals(df, "text", ngrams, min_df, 20), n, min_df, 20)
            assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
            if ngrams == (1, 2):
                assert asked == [path]


def _sparse_rows(spark, seed, n=500, features=30, classes=2):
    """Sparse and dense vectors with negative values, equal ones and zeros that are written down."""
    rng = random.Random(seed)

    def vector():
        if rng.random() < 0.2:
            return Vectors.dense([rng.choice([0.0, 0.0, -1.0, rng.random()]) for _ in range(features)])
        return Vectors.sparse(features, {i: (rng.random() - 0.3 if i % 3 else round(rng.random(), 1)) for i in sorted(rng.sample(range(features), rng.randint(0, 9)))})

    rows = [(i, float(rng.randrange(classes)), i % 3, vector()) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "label", "fold", "features"]).repartition(3)


def _saved_nodes(spark, model, path):
    model.write().overwrite().save(str(path))
    return [tuple(r) for r in spark.read.parquet(f"{path}/data").orderBy("id").collect()]


def test_trees_by_columns_are_sparks_node_for_node(spark, monkeypatch, tmp_path):
    """Trees of several depths and leaf sizes grown side by side, in one block of features
    and in several, equal Spark's own: splits, gains, counts, pruning."""
    for seed, block, chunk in ((0, trees.BLOCK, trees.CHUNK), (1, 2000, 300)):
        monkeypatch.setattr(trees, "BLOCK", block)
        monkeypatch.setattr(trees, "CHUNK", chunk)
        monkeypatch.setattr(trees, "DENSE", 0 if seed else 4)
        rows = _sparse_rows(spark, seed, classes=2 + seed).cache()
        asked = [models.tree(depth=d, leaf=leaf) for d, leaf in ((3, 1), (12, 2), (30, 1))]
        for est, got in zip(asked, trees.fit(asked, rows)):
            want = est.fit(rows)
            assert _saved_nodes(spark, got, tmp_path / "a") == _saved_nodes(spark, want, tmp_path / "b")
            assert (got.numFeatures, got.numClasses, got.depth, got.getMaxDepth()) == (want.numFeatures, want.numClasses, want.depth, want.getMaxDepth())
    alike = spark.createDataFrame([(float(i % 2), Vectors.sparse(3, {})) for i in range(6)], ["label", "features"])
    assert trees.fit([models.tree()], alike)[0].numNodes == 1
    fine = (0.0, Vectors.dense([1.0]))
    for odd in ((None, Vectors.dense([1.0])), (0.5, Vectors.dense([1.0])), (1.0, None)):
        with pytest.raises(ValueError):
            trees.fit([models.tree()], spark.createDataFrame([fine, odd], ["label", "features"]))
    with pytest.raises(ValueError):
        trees.fit([models.tree()], spark.createDataFrame([fine], ["label", "features"]).limit(0))


def test_a_larger_grid_is_grown_from_columns_and_scores_alike(spark, monkeypatch):
    """Above the rows that Spark's own tree is for, no fold is made dense, a fold's trees
    share its columns, and the scores are those of Spark's trees."""
    rows = _sparse_rows(spark, 4).cache()
    dt = models.tree()
    grid = ParamGridBuilder().addGrid(dt.maxDepth, [3, 8]).addGrid(dt.minInstancesPerNode, [1, 4]).build()
    want = models.cross_validate(dt, rows, grid, 3)
    monkeypatch.setattr(models.K, "ML_DENSE_TREE_ROWS", 100)
    made, make = [], trees.columns_of
    monkeypatch.setattr(trees, "columns_of", lambda *a: made.append(1) or make(*a))
    monkeypatch.setattr(models, "dealt", lambda *a: pytest.fail("a tree of many rows was made dense"))
    got = models.cross_validate(dt, rows, grid, 3)
    assert len(made) == 3 + 1  # the folds, all rows for the best one
    assert got.avgMetrics == want.avgMetrics and got.stdMetrics == want.stdMetrics
    assert got.bestModel.toDebugString.split("\n")[1:] == want.bestModel.toDebugString.split("\n")[1:]
