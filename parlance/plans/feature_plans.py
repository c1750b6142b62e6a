"""TF-IDF, pair similarity and nearest-instruction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import text as TX
from parlance.functions.labels import stable_bucket
from parlance.operators import features, retrieval, splits, tfidf, turns
from parlance.plans import sqlfrag as Q
from parlance.plans.corpus_plans import SENTIMENT_CORPUS_SQL, SUPPORT_CORPUS_SQL, sentiment_corpus, support_prepared
from parlance.plans.registry import Tables, plan
from parlance.session import scratch_path
from parlance.sources import indexstore
from parlance.sources.landing import stored
from parlance.sources.tables import spread
from parlance.plans.turn_plans import PAIRS_SQL

# Java (?U)\w as an RE2 class.
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"
TOKEN = WORD + "{2,}"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {Q.q(TOKEN)})"


def grams(x: str) -> str:
    t = toks(x)
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


# --- V1, V2: terms -------------------------------------------------------------

NGRAMS_SQL = f"""
WITH u AS (SELECT {Q.TURN_ID} AS id, {Q.clean('text')} AS c FROM conversations WHERE role = 'user'),
t AS (SELECT id, unnest({grams('c')}) AS term FROM u)
SELECT id, term, count(*) AS tf FROM t GROUP BY id, term
"""


@plan("ngrams", sql=NGRAMS_SQL, ids=("V1", "V2"))
def ngrams(spark, sf_dir):
    from parlance.functions.text import clean_text
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    c = spread(c.select(turns.turn_id().alias("id"), "text"))
    c = c.select("id", clean_text("text").alias("c"))
    return tfidf.term_counts(c, "id", "c", (1, 2))


# --- V3, V4, V6, V9: classifier features on the sentiment corpus ----------------

_SC = f"sc AS ({SENTIMENT_CORPUS_SQL})"
VOCAB_CTE = f"""
{_SC},
sp AS (SELECT *, CASE WHEN {Q.bucket('doc_id', splits.BUCKETS, K.SEED)} < 8000 THEN 'train' ELSE 'test' END AS split FROM sc),
tr AS (SELECT doc_id, clean_text FROM sp WHERE split = 'train'),
n AS (SELECT count(*)::DOUBLE AS n FROM tr),
tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams('clean_text')}) AS term FROM tr) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term HAVING count(*) >= {K.TFIDF_MIN_DF}),
top AS (SELECT * FROM st ORDER BY cf DESC, term LIMIT {K.TFIDF_MAX_TERMS}),
vocab AS (SELECT term, df, cf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_index,
                 ln((1 + n.n) / (1 + df)) + 1 AS idf FROM top, n)
"""

VOCAB_SQL = f"WITH {VOCAB_CTE} SELECT term, df, cf, term_index, round(idf, 6) AS idf FROM vocab"

SUBLINEAR_SQL = f"""
WITH {VOCAB_CTE},
te AS (SELECT doc_id, clean_text FROM sp),
tft AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams('clean_text')}) AS term FROM te) GROUP BY 1, 2),
w AS (SELECT id, tft.term, term_index, (1 + ln(tf)) * idf AS w FROM tft JOIN vocab ON tft.term = vocab.term)
SELECT id, term, term_index, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w
"""


def _train_corpus(spark, sf_dir):
    sc = splits.hash_split(sentiment_corpus(spark, sf_dir), "doc_id")
    return sc


@plan("vocabulary", sql=VOCAB_SQL, ids=("V3", "V6"))
def vocabulary(spark, sf_dir):
    sc = _train_corpus(spark, sf_dir)
    tr = sc.where(F.col("split") == "train")
    tf = tfidf.term_counts(tr, "doc_id", "clean_text", K.TFIDF_NGRAMS)
    v = tfidf.fit_vocabulary(tf, tfidf.doc_count(tr), K.TFIDF_MIN_DF, K.TFIDF_MAX_TERMS)
    return v.select("term", "df", "cf", "term_index", F.round("idf", 6).alias("idf"))


@plan("tfidf_sublinear", sql=SUBLINEAR_SQL, ids=("V4", "V6"))
def tfidf_sublinear(spark, sf_dir):
    sc = spread(stored(_train_corpus(spark, sf_dir).select("doc_id", "clean_text", "split"), "sentiment-split"))
    model = features.fit_tfidf(sc.where(F.col("split") == "train"), "doc_id", "clean_text")
    w = features.long_weights(model, sc, "doc_id")
    return w.select("id", "term", "term_index", F.round("weight", 6).alias("weight"))


@plan("matrix_shape", sql=f"""
WITH {VOCAB_CTE} SELECT (SELECT count(*) FROM tr) AS n_rows, (SELECT count(*) FROM vocab) AS n_terms
""", ids=("V9",))
def matrix_shape(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    tr = _train_corpus(spark, sf_dir).where(F.col("split") == "train")
    return tr.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(v.agg(F.count(F.lit(1)).alias("n_terms")))


# --- V5: plain TF-IDF on the support corpus -------------------------------------

PLAIN_SQL = f"""
WITH sc AS ({SUPPORT_CORPUS_SQL}),
n AS (SELECT count(*)::DOUBLE AS n FROM sc),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks('clean_instruction')}) AS term FROM sc) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT id, tf.term, tf * (ln((1 + n.n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term, n)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w
"""


@plan("tfidf", sql=PLAIN_SQL, ids=("V1", "V5"))
def tfidf_plain(spark, sf_dir):
    sc = support_prepared(spark, sf_dir)
    w, _ = tfidf.fit_transform(sc, "id", "clean_instruction")
    return w.select("id", "term", F.round("weight", 6).alias("weight"))


# --- V7, X9, A13: pair similarity -------------------------------------------------

def _pair_sql(where: str = "") -> str:
    return f"""
WITH p AS ({PAIRS_SQL}),
k AS (SELECT {Q.TURN_ID} AS id, user_message, reply FROM p WHERE reply IS NOT NULL {where}),
t AS (SELECT id, unnest({toks('user_message')}) AS term, 0 AS side FROM k
      UNION ALL SELECT id, unnest({toks('reply')}) AS term, 1 AS side FROM k),
c AS (SELECT id, term, count(*) FILTER (WHERE side = 0) AS ta, count(*) FILTER (WHERE side = 1) AS tb FROM t GROUP BY id, term),
w AS (SELECT id, ta * (CASE WHEN ta > 0 AND tb > 0 THEN 1.0 ELSE ln(1.5) + 1 END) AS wa,
             tb * (CASE WHEN ta > 0 AND tb > 0 THEN 1.0 ELSE ln(1.5) + 1 END) AS wb FROM c),
s AS (SELECT id, sum(wa * wb) AS dot, sum(wa * wa) AS na, sum(wb * wb) AS nb FROM w GROUP BY id),
r AS (SELECT k.id, CASE WHEN na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb)) ELSE 0.0 END AS similarity
      FROM k LEFT JOIN s ON k.id = s.id)
"""


def _pairs(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations).where(F.col("reply").isNotNull())
    return p.withColumn("id", turns.turn_id())


@plan("pair_cosine", sql=_pair_sql() + "SELECT id, round(coalesce(similarity, 0.0), 6) AS similarity FROM r",
      ids=("V7",))
def pair_cosine(spark, sf_dir):
    s = tfidf.pair_cosine(_pairs(spark, sf_dir), "id", "user_message", "reply")
    return s.select("id", F.round("similarity", 6).alias("similarity"))


SAMPLE_WHERE = (f"AND {Q.TURN_ID} IN (SELECT {Q.TURN_ID} FROM p WHERE reply IS NOT NULL "
                f"ORDER BY {Q.bucket(Q.TURN_ID, 1 << 32, K.SEED)}, {Q.TURN_ID} "
                f"LIMIT {K.SIMILARITY_SAMPLES})")


@plan("similarity_summary", sql=_pair_sql(SAMPLE_WHERE) + f"""
SELECT count(*) AS n_samples, round(avg(similarity), 6) AS mean_similarity,
       round(min(similarity), 6) AS min_similarity, round(max(similarity), 6) AS max_similarity,
       avg(similarity) >= {K.SIMILARITY_PASS} AS passed,
       count(*) FILTER (WHERE similarity >= {K.SIMILARITY_PASS}) AS n_above
FROM r
""", ids=("X9", "A13", "D3", "F13"))
def similarity_summary(spark, sf_dir):
    sample = splits.seeded_sample(_pairs(spark, sf_dir), "id", K.SIMILARITY_SAMPLES)
    s = tfidf.pair_cosine(sample, "id", "user_message", "reply")
    return s.agg(F.count(F.lit(1)).alias("n_samples"),
                 F.round(F.avg("similarity"), 6).alias("mean_similarity"),
                 F.round(F.min("similarity"), 6).alias("min_similarity"),
                 F.round(F.max("similarity"), 6).alias("max_similarity"),
                 (F.avg("similarity") >= K.SIMILARITY_PASS).alias("passed"),
                 F.count_if(F.col("similarity") >= K.SIMILARITY_PASS).alias("n_above"))


@plan("similarity_report", sql=_pair_sql(SAMPLE_WHERE) + f"""
, a AS (SELECT avg(similarity) AS m, min(similarity) AS lo, max(similarity) AS hi FROM r)
SELECT {Q.percent('m')} AS average_similarity, {Q.percent('lo')} AS min_similarity,
       {Q.percent('hi')} AS max_similarity, {Q.q(K.SIMILARITY_TARGET)} AS target,
       CASE WHEN m >= {K.SIMILARITY_PASS} THEN {Q.q(K.STATUS_PASSED)} ELSE {Q.q(K.STATUS_BELOW)} END AS status
FROM a
""", ids=("T27", "X9"))
def similarity_report(spark, sf_dir):
    """The similarity check as printed: percentages with 2 decimals, target and status."""
    sample = splits.seeded_sample(_pairs(spark, sf_dir), "id", K.SIMILARITY_SAMPLES)
    s = tfidf.pair_cosine(sample, "id", "user_message", "reply")
    a = s.agg(F.avg("similarity").alias("m"), F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    return a.select(TX.percent("m").alias("average_similarity"), TX.percent("lo").alias("min_similarity"),
                    TX.percent("hi").alias("max_similarity"), F.lit(K.SIMILARITY_TARGET).alias("target"),
                    F.when(F.col("m") >= K.SIMILARITY_PASS, F.lit(K.STATUS_PASSED))
                    .otherwise(F.lit(K.STATUS_BELOW)).alias("status"))


# --- J5 / V8: nearest corpus instruction ----------------------------------------

_FIRST = Q.strip_ws(f"string_split_regex({Q.strip_ws('corpus.clean_response')}, {Q.q(TX.SENTENCE_END)})[1]")


def nearest_sql(queries: str, corpus: str = "true") -> str:
    """Matches and grounded prompts of ``queries`` (item_id, text) among the corpus rows
    that hold the condition, all pairs with a common term compared."""
    return f"""
WITH benchmark AS ({queries}),
sc AS ({SUPPORT_CORPUS_SQL}),
corpus AS (SELECT id, clean_instruction, clean_response FROM sc WHERE clean_instruction <> '' AND clean_response <> '' AND {corpus}),
n AS (SELECT count(*)::DOUBLE AS n FROM corpus),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({toks('clean_instruction')}) AS term FROM corpus) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bn AS (SELECT p.id, sum(p.tf * p.tf * pow(ln((n.n + 2) / (1 + d.df)) + 1, 2)) AS bnorm
       FROM post p JOIN dfs d ON p.term = d.term, n GROUP BY p.id),
qt AS (SELECT item_id, term, count(*) AS tq FROM (SELECT item_id, unnest({toks('lower(text)')}) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT qt.item_id, qt.term, qt.tq, coalesce(d.df, 0) AS df,
              ln((n.n + 2) / (2 + coalesce(d.df, 0))) + 1 AS idf, ln((n.n + 2) / (1 + coalesce(d.df, 0))) + 1 AS b
       FROM qt LEFT JOIN dfs d ON qt.term = d.term, n),
qn AS (SELECT item_id, sqrt(sum(tq * tq * idf * idf)) AS qnorm FROM qw GROUP BY item_id),
m AS (SELECT qw.item_id, p.id, sum(qw.tq * p.tf * qw.idf * qw.idf) AS dot,
             sum(p.tf * p.tf * (qw.idf * qw.idf - qw.b * qw.b)) AS corr
      FROM qw JOIN post p ON qw.term = p.term WHERE qw.df > 0 GROUP BY qw.item_id, p.id),
s AS (SELECT m.item_id, m.id, round(dot / (qnorm * sqrt(bnorm + corr)), {retrieval.SIM_DIGITS}) AS sim
      FROM m JOIN qn ON m.item_id = qn.item_id JOIN bn ON m.id = bn.id),
best AS (SELECT item_id, id AS best_id, sim FROM
         (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, id) AS rn FROM s) WHERE rn = 1),
allq AS (SELECT b.item_id, b.text, CASE WHEN best.sim > 0 THEN best.best_id ELSE (SELECT min(id) FROM corpus) END AS best_id,
                coalesce(best.sim, 0.0) AS similarity
         FROM benchmark b LEFT JOIN best ON b.item_id = best.item_id),
j AS (SELECT allq.*, corpus.clean_response AS resp,
             {_FIRST} AS fs
      FROM allq LEFT JOIN corpus ON allq.best_id = corpus.id),
o AS (SELECT *, (similarity > {K.RETRIEVAL_MIN_SIM} AND resp IS NOT NULL AND length(resp) > {K.REPLY_MIN_LEN} AND fs <> '') AS ok FROM j)
SELECT item_id, best_id, round(similarity, 6) AS similarity, ok AS accepted,
       CASE WHEN ok THEN fs END AS context,
       CASE WHEN ok THEN 'Customer: ' || text || ' Context: ' || fs || ' Support:' ELSE 'Customer: ' || text || ' Support:' END AS prompt
FROM o
"""


NEAREST_SQL = nearest_sql("SELECT item_id, text FROM main.benchmark")


def retrieval_corpus(spark, sf_dir):
    sc = support_prepared(spark, sf_dir)
    return sc.where((F.col("clean_instruction") != "") & (F.col("clean_response") != ""))


@plan("nearest_instruction", sql=NEAREST_SQL, ids=("J5", "V8", "W10", "T9", "T19", "T21"))
def nearest_instruction(spark, sf_dir):
    corpus = retrieval_corpus(spark, sf_dir)
    q = Tables(spark, sf_dir).benchmark
    m = retrieval.nearest(q, "item_id", "text", corpus, "id", "clean_instruction")
    return retrieval.grounded_prompts(m, q, "item_id", "text", corpus, "id", "clean_response")


_TRAIN = f"{Q.bucket('id', splits.BUCKETS, K.SEED)} < 8000"


@plan("grounded_replies", sql=f"""
WITH r AS ({nearest_sql(f"SELECT {Q.TURN_ID} AS item_id, text FROM conversations WHERE role = 'user'", _TRAIN)})
SELECT item_id AS id, best_id, similarity, accepted, context, prompt,
       CASE WHEN length(context) > {K.REPLY_MIN_LEN} THEN context ELSE {Q.q(K.DEFAULT_REPLY)} END AS reply,
       CASE WHEN length(context) > {K.REPLY_MIN_LEN} THEN {Q.q(K.SOURCE_GROUNDED)} ELSE {Q.q(K.SOURCE_DEFAULT)} END AS reply_source
FROM r
""", ids=("V8", "J5", "T9", "T19", "T21", "W10"))
def grounded_replies(spark, sf_dir):
    """Every user turn answered from a stored index of the support corpus (its
    training part, appended in two halves): nearest instruction, the reply's first
    sentence as context, prompt and reply."""
    root = scratch_path(spark, "retrieval-index")
    corpus = stored(splits.hash_split(retrieval_corpus(spark, sf_dir), "id").where(F.col("split") == "train"), "index-corpus")
    for half in range(2):
        indexstore.append_documents(corpus.where(stable_bucket("id", 2) == half), root, "id", "clean_instruction", "clean_response")
    index = indexstore.open_index(spark, root)
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    q = stored(c.select(turns.turn_id().alias("id"), "text"), "index-queries")
    m = retrieval.nearest_in(q, "id", "text", index)
    g = retrieval.grounded_prompts(m, q, "id", "text", index.forward.withColumnRenamed("id", "doc"), "doc", "reply")
    reply, source = turns.choose_reply("context")
    return g.withColumns({"reply": reply, "reply_source": source})
