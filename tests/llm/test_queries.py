"""Contract queries against their SQL twins, and the pipeline stage by stage."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import jaccard_join, mixing, queries, suffix_dedup
from tests.llm.test_operators import _brute_join, _brute_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = ([[None if pd.isna(v) else v for v in row] for row in x[columns].itertuples(index=False)] for x in (got, want))
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    assert df.count() >= n


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, held = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before = held[name] = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert before.columns == columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    passed = {r.doc_id: r.text for r in held["toxicity"].collect()}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in passed for d in clean) >= 0.98 * len(clean)

    ids = sorted(passed)
    links = _brute_join([passed[d] for d in ids])
    kept = {r.doc_id: r.text for r in held["near_copies"].collect()}
    smallest = [min(_component(links, a)) for a in range(len(ids))]
    assert sorted(kept) == sorted({ids[s] for s in smallest})

    ids = sorted(kept)
    sizes = {r.doc_id: len(r.text.encode()) for r in held["repeats"].collect()}
    for d, (n, gone, _, _) in zip(ids, _brute_spans([kept[d] for d in ids])):
        assert n - gone - 3 * 10 <= sizes[d] <= n - gone

    plan = mixing.mix_documents(held["repeats"]).agg({"taken": "sum"}).first()[0]
    words = held["mix"].select(mixing.words("text").alias("n")).agg({"n": "sum"}).first()[0]
    assert words == plan

    pieces = held["pack"].toPandas()
    fill = pieces.groupby("sequence_id").length.sum().sort_index()
    assert (fill.iloc[:-1] == 2048).all() and fill.iloc[-1] <= 2048
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == held["pack"].columns and run.count() == len(pieces)


def _component(links, a):
    seen, todo = {a}, [a]
    while todo:
        for b in links[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def test_a_driver_elsewhere_needs_no_package_on_the_workers(tmp_path):
    """The package on the driver's path only: queries still run, also those that
    broadcast what they learned."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from parlance.session import local_session\n"
            "from parlance.llm import queries\n"
            "s = local_session(2, 2)\n"
            f"print(queries.QUERIES['op2_toxicity'](s, {SF!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("200"), out.stderr[-2000:]


def test_pipeline_stages_on_awkward_rows(spark):
    """Null, empty, blank and repeated texts, null ids and sources, clashing and dotted
    extra columns: each stage keeps the columns and its defined rows."""
    base = "word " + " ".join(f"w{i}" for i in range(120))
    rows = [(1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n", "en", "b", 2),
            (None, "no id at all", None, None, 5), (6, "é" * 400, "de", "b", 400), (1, base, "en", "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("a.b", "score", "key", "spans", "K1", "taken"):
        docs = docs.withColumn(c, F.lit("x"))
    names, before, counts = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stage(spark, before, SF)
        assert before.columns == names, name
        counts[name] = before.count()
    assert counts["toxicity"] == len(rows)  # nothing here is toxic
    assert counts["near_copies"] == counts["repeats"] == len(rows) - 2  # the copies of one text
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() > 0
