"""Corpus preparation, cleaning, encoding and split queries (flow A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import text as TX
from parlance.functions.labels import stable_bucket
from parlance.operators import corpus, encode, splits, turns
from parlance.plans import sqlfrag as Q
from parlance.plans.registry import Tables, plan
from parlance.plans.turn_plans import PAIRS_SQL, SCORED_SQL
from parlance.sources import landing
from parlance.sources.tables import shape_report, spread


def _h(key: str, modulus: int, seed=None) -> str:
    return Q.bucket(key, modulus, seed)


# --- T1-T5 ------------------------------------------------------------------

@plan("clean_text", sql=f"SELECT doc_id, {Q.clean('text')} AS clean_text FROM documents", ids=("T1",))
def clean_text(spark, sf_dir):
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    return d.select("doc_id", TX.clean_text("text").alias("clean_text"))


TEXT_FEATURES_SQL = f"""
WITH c AS (SELECT doc_id, {Q.clean('text')} AS ct FROM documents)
SELECT doc_id, length(ct)::INTEGER AS text_len, {Q.word_count('ct')} AS word_count,
       {Q.has_char('ct', '!')} AS has_exclaim, {Q.has_char('ct', '?')} AS has_question,
       round({Q.stopword_ratio('ct')}, 6) AS stopword_ratio
FROM c
"""


@plan("text_features", sql=TEXT_FEATURES_SQL, ids=("T2", "T3", "T4", "T5"))
def text_features(spark, sf_dir):
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    d = d.select("doc_id", TX.clean_text("text").alias("ct"))
    d = corpus.text_features(d, "ct")
    return d.select("doc_id", "text_len", "word_count", "has_exclaim", "has_question",
                    F.round(TX.stopword_ratio("ct"), 6).alias("stopword_ratio"))


SENTIMENT_CORPUS_SQL = f"""
WITH raw AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
dd AS (SELECT min(doc_id) AS doc_id, text, label FROM raw GROUP BY text, label),
nn AS (SELECT * FROM dd WHERE doc_id IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL),
mx AS (SELECT max(label) AS m FROM nn),
s AS (SELECT nn.*, {Q.clean('text')} AS clean_text,
             CASE WHEN mx.m >= 4 THEN (CASE WHEN label >= 4 THEN 'positive' WHEN label <= 2 THEN 'negative' ELSE 'neutral' END)
                  ELSE (CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END) END AS sentiment
      FROM nn, mx),
dim AS (SELECT sentiment, (row_number() OVER (ORDER BY sentiment) - 1)::INTEGER AS sentiment_encoded
        FROM (SELECT DISTINCT sentiment FROM s))
SELECT doc_id, label, clean_text, s.sentiment, sentiment_encoded, length(clean_text)::INTEGER AS text_len,
       {Q.word_count('clean_text')} AS word_count, {Q.has_char('clean_text', '!')} AS has_exclaim,
       {Q.has_char('clean_text', '?')} AS has_question, round({Q.stopword_ratio('clean_text')}, 6) AS stopword_ratio
FROM s JOIN dim ON s.sentiment = dim.sentiment
"""


def _raw_sentiment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (t.documents.join(t.labels, "doc_id")
            .select("doc_id", "text", F.col("quality").alias("label")))


@plan("sentiment_corpus", sql=SENTIMENT_CORPUS_SQL,
      ids=("S1", "F1", "F4", "F10", "F11", "T1", "T12", "E1", "T2", "T3", "T4", "T5"))
def sentiment_corpus(spark, sf_dir):
    df = corpus.sentiment_corpus(_raw_sentiment(spark, sf_dir), "doc_id")
    return df.select("doc_id", "label", "clean_text", "sentiment", "sentiment_encoded", "text_len",
                     "word_count", "has_exclaim", "has_question",
                     F.round("stopword_ratio", 6).alias("stopword_ratio"))


SUPPORT_CORPUS_SQL = f"""
WITH p AS ({PAIRS_SQL}),
raw AS (SELECT {Q.TURN_ID} AS id, user_message AS instruction, reply AS response FROM p),
dd AS (SELECT min(id) AS id, instruction, response FROM raw GROUP BY instruction, response),
nn AS (SELECT * FROM dd WHERE instruction IS NOT NULL AND response IS NOT NULL),
c AS (SELECT id, {Q.clean('instruction')} AS clean_instruction, {Q.clean('response')} AS clean_response FROM nn)
SELECT id, clean_instruction, clean_response, length(clean_instruction)::INTEGER AS instruction_len,
       length(clean_response)::INTEGER AS response_len, {Q.word_count('clean_instruction')} AS instruction_words,
       {Q.word_count('clean_response')} AS response_words, {Q.has_char('clean_instruction', '?')} AS has_question
FROM c
"""


def support_raw(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations)
    return p.select(turns.turn_id().alias("id"),
                    F.col("user_message").alias("instruction"), F.col("reply").alias("response"))


def support_prepared(spark, sf_dir):
    return corpus.support_corpus(support_raw(spark, sf_dir), "id")


@plan("support_corpus", sql=SUPPORT_CORPUS_SQL, ids=("F1", "F3", "F8", "T1", "T2", "T3", "T4"))
def support_corpus(spark, sf_dir):
    return support_prepared(spark, sf_dir).select(
        "id", "clean_instruction", "clean_response", "instruction_len", "response_len",
        "instruction_words", "response_words", "has_question")


# --- F1-F5, F12, A1-A4, A12 ---------------------------------------------------

@plan("dedup_exact", sql="""
SELECT min(doc_id) AS doc_id, lang, source, n_chars FROM documents GROUP BY text, lang, source, n_chars
""", ids=("F1",))
def dedup_exact(spark, sf_dir):
    # The digest stands for the text: it alone crosses the shuffle.
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("text"), "lang", "source", "n_chars")
    return corpus.dedup_rows(d, "doc_id").select("doc_id", "lang", "source", "n_chars")


@plan("dedup_keep_first", sql="""
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
FROM documents GROUP BY text
""", ids=("F2",))
def dedup_keep_first(spark, sf_dir):
    from parlance.operators.ordered import first_by
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sha2("text", 256).alias("text"), "lang", "source")
    return first_by(d, ["text"], "doc_id", ["lang", "source"]).select("doc_id", "lang", "source")


@plan("dropna_any", sql="""
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NOT NULL AND d.lang IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL
""", ids=("F3", "F4"))
def dropna_any(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return j.dropna(how="any").select("doc_id", "lang", "quality", "toxic")


LENGTH_REPORT_SQL = f"""
WITH p AS ({PAIRS_SQL})
SELECT count(*) AS original,
  count(*) FILTER (WHERE reply IS NOT NULL AND user_message IS NOT NULL AND length(reply) < {K.LENGTH_STRICT[0]} AND length(user_message) < {K.LENGTH_STRICT[1]}) AS kept_strict,
  count(*) FILTER (WHERE reply IS NOT NULL AND user_message IS NOT NULL AND length(reply) < {K.LENGTH_RELAXED[0]} AND length(user_message) < {K.LENGTH_RELAXED[1]}) AS kept_relaxed,
  count(*) - count(*) FILTER (WHERE reply IS NOT NULL AND user_message IS NOT NULL AND length(reply) < {K.LENGTH_STRICT[0]} AND length(user_message) < {K.LENGTH_STRICT[1]}) AS removed_strict,
  count(*) - count(*) FILTER (WHERE reply IS NOT NULL AND user_message IS NOT NULL AND length(reply) < {K.LENGTH_RELAXED[0]} AND length(user_message) < {K.LENGTH_RELAXED[1]}) AS removed_relaxed
FROM p
"""


@plan("length_filter_report", sql=LENGTH_REPORT_SQL, ids=("F5", "A1"))
def length_filter_report(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations)
    return corpus.length_filter_report(p, "user_message", "reply")


@plan("length_filter", sql=f"""
WITH p AS ({PAIRS_SQL})
SELECT conv_id, turn, length(user_message) AS instruction_len, length(reply) AS response_len FROM p
WHERE reply IS NOT NULL AND user_message IS NOT NULL
  AND length(reply) < {K.LENGTH_RELAXED[0]} AND length(user_message) < {K.LENGTH_RELAXED[1]}
""", ids=("F5", "F14"))
def length_filter(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations)
    kept = corpus.length_filter(p, "user_message", "reply", K.LENGTH_RELAXED)
    return kept.select("conv_id", "turn", F.length("user_message").cast("bigint").alias("instruction_len"),
                       F.length("reply").cast("bigint").alias("response_len"))


@plan("value_counts", sql="""
SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, source
""", ids=("A3",))
def value_counts(spark, sf_dir):
    return corpus.value_counts(Tables(spark, sf_dir).documents, "source")


@plan("value_counts_by_key", sql="""
SELECT lang, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY lang
""", ids=("A4",))
def value_counts_by_key(spark, sf_dir):
    return corpus.value_counts(Tables(spark, sf_dir).documents, "lang", by_key=True)


@plan("distinct_counts", sql="""
SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM documents
""", ids=("A1", "A2"))
def distinct_counts(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("n_lang"),
                 F.count_distinct("source").alias("n_source"))


@plan("label_stats", sql="""
SELECT max(quality) AS max_label, array_to_string(list_sort(list_distinct(list(quality))), ',') AS classes
FROM labels
""", ids=("A12",))
def label_stats(spark, sf_dir):
    lb = Tables(spark, sf_dir).labels
    return lb.agg(F.max("quality").alias("max_label"),
                  F.array_join(F.array_sort(F.collect_set("quality")).cast("array<string>"), ",").alias("classes"))


@plan("topk_class_filter", sql=f"""
WITH top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source
             ORDER BY count(*) DESC, source LIMIT {K.TOP_CLASSES})
SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM top)
""", ids=("F12", "J6", "W5"))
def topk_class_filter(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "source")
    return corpus.keep_top_classes(d, "source")


# --- E1-E3, J1-J3 -------------------------------------------------------------

@plan("label_encode", sql="""
SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS source_code
FROM documents WHERE source IS NOT NULL
""", ids=("E1",))
def label_encode(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "source")
    dim = encode.fit_codes(d, "source", "source_code")
    return encode.apply_codes(d, dim, "source", "source_code").select("doc_id", "source", "source_code")


@plan("code_lookup", sql="""
WITH dim AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS code
             FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT e.vec_id, e.label, coalesce(dim.lang, 'DEFAULT') AS intent
FROM embeddings e LEFT JOIN dim ON e.label = dim.code
""", ids=("J1", "S13"))
def code_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dim = encode.fit_codes(t.documents, "lang", "code")
    e = t.embeddings.select("vec_id", "label")
    return encode.lookup_names(e, dim, "label", "code", "lang", "intent").select("vec_id", "label", "intent")


NAME_TO_CODE_SQL = f"""
WITH s AS (SELECT doc_id, source, CASE WHEN {_h('doc_id', splits.BUCKETS, K.SEED)} < 8000 THEN 'train' ELSE 'test' END AS split
           FROM documents),
dim AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INTEGER AS source_code
        FROM (SELECT DISTINCT source FROM s WHERE split = 'train' AND source IS NOT NULL))
SELECT s.doc_id, s.source, dim.source_code FROM s JOIN dim ON s.source = dim.source WHERE s.split = 'test'
"""


@plan("name_to_code", sql=NAME_TO_CODE_SQL, ids=("J2", "E2", "D1"))
def name_to_code(spark, sf_dir):
    d = splits.hash_split(Tables(spark, sf_dir).documents.select("doc_id", "source"), "doc_id")
    dim = encode.fit_codes(d.where(F.col("split") == "train"), "source", "source_code")
    test = d.where(F.col("split") == "test")
    return encode.apply_codes(test, dim, "source", "source_code", unknown="drop").select(
        "doc_id", "source", "source_code")


_CODES = " ".join(f"WHEN sentiment = {Q.q(k)} THEN {v}" for k, v in K.SENTIMENT_CODES.items())


@plan("sentiment_code_map", sql=f"""
SELECT conv_id, turn, sentiment, CASE {_CODES} END AS sentiment_encoded FROM ({SCORED_SQL})
WHERE CASE {_CODES} END IS NOT NULL
""", ids=("J3",))
def sentiment_code_map(spark, sf_dir):
    from parlance.plans.turn_plans import scored_turns
    coded, _ = encode.sentiment_codes(scored_turns(spark, sf_dir), "sentiment")
    return coded.select("conv_id", "turn", "sentiment", "sentiment_encoded")


@plan("one_vs_rest", sql="""
WITH c AS (SELECT DISTINCT label AS class FROM embeddings)
SELECT e.vec_id, e.label, c.class, (e.label = c.class)::INTEGER AS indicator FROM embeddings e, c
""", ids=("E3",))
def one_vs_rest(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", "label")
    return encode.one_vs_rest(e, "label", "class", "indicator")


# --- D1-D4, W11 ---------------------------------------------------------------

@plan("hash_split", sql=f"""
SELECT doc_id, {_h('doc_id', splits.BUCKETS, K.SEED)} AS bucket,
       CASE WHEN {_h('doc_id', splits.BUCKETS, K.SEED)} < 8000 THEN 'train' ELSE 'test' END AS split
FROM documents
""", ids=("D1",))
def hash_split(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    return splits.hash_split(d, "doc_id").withColumn("bucket", stable_bucket("doc_id", splits.BUCKETS, K.SEED))


@plan("stratified_split", sql=f"""
WITH h AS (SELECT doc_id, lang, {_h('doc_id', 1 << 32, K.SEED)} AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn,
             count(*) OVER (PARTITION BY lang) AS n FROM h)
SELECT doc_id, lang, CASE WHEN rn <= ceil(n * {K.TEST_FRACTION}) THEN 'test' ELSE 'train' END AS split FROM r
""", ids=("D2",))
def stratified_split(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    return splits.stratified_split(d, "doc_id", "lang").select("doc_id", "lang", "split")


@plan("kfold", sql=f"""
SELECT doc_id, {_h('doc_id', K.CV_FOLDS, K.SEED)}::INTEGER AS fold,
       {_h('doc_id', K.GRID_FOLDS, K.SEED)}::INTEGER AS fold3 FROM documents
""", ids=("D4",))
def kfold(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    d = splits.folds(d, "doc_id", K.CV_FOLDS, out="fold")
    return splits.folds(d, "doc_id", K.GRID_FOLDS, out="fold3")


@plan("seeded_sample", sql=f"""
WITH p AS ({PAIRS_SQL})
SELECT conv_id, turn FROM p
ORDER BY {_h(Q.TURN_ID, 1 << 32, K.SEED)}, {Q.TURN_ID} LIMIT {K.SIMILARITY_SAMPLES}
""", ids=("D3",))
def seeded_sample(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations)
    p = p.withColumn("__key", turns.turn_id())
    return splits.seeded_sample(p, "__key", K.SIMILARITY_SAMPLES).select("conv_id", "turn")


@plan("positional_split", sql=f"""
WITH p AS ({PAIRS_SQL}),
r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS position, count(*) OVER () AS n FROM p)
SELECT conv_id, turn, position, CASE WHEN position <= floor(n * {K.POSITIONAL_TRAIN_FRACTION}) THEN 'train' ELSE 'val' END AS split
FROM r
""", ids=("W11",))
def positional_split(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations).select("conv_id", "turn")
    return splits.positional_split(p, ["conv_id", "turn"]).select("conv_id", "turn", "position", "split")


@plan("head_split", sql=f"""
WITH p AS ({PAIRS_SQL}),
r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS position, count(*) OVER () AS n FROM p)
SELECT conv_id, turn, CASE WHEN position <= floor(n * {K.POSITIONAL_TRAIN_FRACTION}) THEN 'train' ELSE 'val' END AS split
FROM r
""", ids=("W11",))
def head_split(spark, sf_dir):
    """The positional split from one cut key."""
    p = turns.pair_turns(Tables(spark, sf_dir).conversations).select("conv_id", "turn")
    return splits.head_split(p, ["conv_id", "turn"])


# --- S3, F9: landing and shape reports ------------------------------------------------

LANDED = ("conversations", "documents")


@plan("landed_corpora", sql=" UNION ALL ".join(
    f"SELECT '{name}' AS dataset, count(*)::BIGINT AS records FROM {name}" for name in LANDED),
    ids=("S3",))
def landed_corpora(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = None
    for name in LANDED:
        counted = landing.land(spark, getattr(t, name), name)
        out = counted if out is None else out.unionByName(counted)
    return out


SUPPORT_REQUIRED = ("clean_instruction", "clean_response")


def _shape_sql(dataset: str, source: str, required=()) -> str:
    req = Q.str_list(required) if required else "[]::VARCHAR[]"
    return f"""
SELECT '{dataset}' AS dataset, (SELECT count(*) FROM ({source}))::BIGINT AS n_rows,
       count(*)::INTEGER AS n_columns, string_agg(column_name, ',') AS columns,
       array_to_string(list_filter({req}, lambda r: NOT list_contains(list(column_name), r)), ',') AS missing,
       len(list_filter({req}, lambda r: NOT list_contains(list(column_name), r))) = 0 AS has_required
FROM (DESCRIBE SELECT * FROM ({source}))"""


@plan("corpus_shapes", sql=" UNION ALL ".join([
    _shape_sql("conversations", "SELECT * FROM conversations"),
    _shape_sql("documents", "SELECT * FROM documents"),
    _shape_sql("support_corpus", SUPPORT_CORPUS_SQL, SUPPORT_REQUIRED)]), ids=("F9",))
def corpus_shapes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return (shape_report(t.conversations, "conversations")
            .unionByName(shape_report(t.documents, "documents"))
            .unionByName(shape_report(support_corpus(spark, sf_dir), "support_corpus", SUPPORT_REQUIRED)))
