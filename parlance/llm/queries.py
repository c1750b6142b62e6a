"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from parlance.llm import (anchor_mining, cosine_dedup, edit_embedding, gated_lm, jaccard_join, lexical_search, mixing, packing,
                          sharding, suffix_dedup, token_files, toxicity, warc_archive)
from parlance.sources.tables import table


def op1_edit_embedding(spark, sf_dir):
    return edit_embedding.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_gated_lm(spark, sf_dir):
    return gated_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_cosine_dedup(spark, sf_dir):
    return cosine_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    return token_files.token_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.join_documents(table(spark, sf_dir, "documents"))


def op11_anchor_mining(spark, sf_dir):
    return anchor_mining.mine_vectors(table(spark, sf_dir, "embeddings"))


def op12_warc_archive(spark, sf_dir):
    return warc_archive.archive_pages(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark, sf_dir):
    return lexical_search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_edit_embedding, op2_toxicity, op3_gated_lm, op4_cosine_dedup, op5_suffix_dedup, op6_packing, op7_mixing, op8_token_files, op9_sharding, op10_jaccard_join, op11_anchor_mining, op12_warc_archive, op13_lexical_search)}

#: Hash-random order and prefix sums over whole sources; targets by the level
#: that the largest prefix of capped sources leaves.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM b),
j AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM j
"""

#: All pairs of distinct texts that share an n-gram, compared on their whole sets.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, any_value(ws) AS ws, min(doc_id) AS first, count(*) AS copies FROM w WHERE len(ws) > 0 GROUP BY t),
g AS (SELECT DISTINCT first AS c, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM c),
z AS (SELECT c, count(*) AS n FROM g GROUP BY c),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.c < b.c GROUP BY a.c, b.c),
l AS (SELECT a, b FROM p JOIN z x ON x.c = a JOIN z y ON y.c = b WHERE common * 5 >= 4 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT first AS c, first AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.c WHERE r.root < e.b),
m AS (SELECT c, min(root) AS root FROM r GROUP BY c),
k AS (SELECT e.a AS c, sum(c.copies) AS links FROM e JOIN c ON c.first = e.b GROUP BY e.a),
o AS (SELECT c.t, c.copies - 1 + coalesce(k.links, 0) AS n_links, m.root FROM c JOIN m ON m.c = c.first LEFT JOIN k ON k.c = c.first)
SELECT w.doc_id, coalesce(o.n_links, 0)::BIGINT AS n_links, coalesce(o.root, w.doc_id) AS component_id,
       w.doc_id = coalesce(o.root, w.doc_id) AS kept
FROM w LEFT JOIN o ON o.t = w.t AND len(w.ws) > 0
"""

#: All pairs of equal label, cosine in double precision, components by reachability.
OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS c, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.c WHERE r.root < l.b),
m AS (SELECT c, min(root) AS root FROM r GROUP BY c),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.root, e.vec_id) AS component_id,
       e.vec_id = coalesce(m.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.c = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""

#: All anchors against all rows, positives and negatives by rank.
OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same QUALIFY n <= 5),
q AS (SELECT p.anchor_id, p.n, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, n ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
       negative_id, positive_score, negative_score FROM q QUALIFY rank <= 3
"""

#: Digests of whole payloads; base 32 from the hexadecimal digits, 40 bits at a time.
OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, h, sha1(h) AS hex, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n,
             min(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN head END AS refers_to
FROM x
"""

#: Scores of all documents that share a term with an item.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(ts))::HUGEINT AS words FROM d WHERE len(ts) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*)::HUGEINT AS tf
      FROM (SELECT r, doc_id, len(ts)::HUGEINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS w FROM p, c GROUP BY t, n_docs),
s AS (SELECT q.item_id, q.text, p.r, any_value(p.doc_id) AS doc_id,
             sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // words))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY q.item_id, q.text, p.r)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""

ORACLE_SQL = {"op4_cosine_dedup": OP4_SQL, "op7_mixing": OP7_SQL, "op10_jaccard_join": OP10_SQL,
              "op11_anchor_mining": OP11_SQL, "op12_warc_archive": OP12_SQL, "op13_lexical_search": OP13_SQL}
