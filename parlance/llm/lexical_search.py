"""Ranked lexical search: accumulator-limited term-at-a-time over all documents.

The items (queries) are taken in blocks of bounded size; each block goes past all
documents. First every text is cut into terms and each document leaves its length
and the counts of those terms that items of the block hold; document count, total
length and document frequencies are aggregates of that. Then each task walks its
documents' postings in bounded portions: for an item, terms rarest first. While the
bounds of the terms still to come (each one's greatest contribution in the portion)
reach the k-th best partial score, a document met gets an accumulator; from the
first term where they cannot, no new ones are made and the survivors are updated
exactly. A task carries each item's k best from portion to portion and returns
them; the best of all tasks are ranked by a window that is cut before the shuffle
as well as after it. No postings are shuffled.

Defined results: a null text (or one without terms) is no document and an item of
that kind has no result; repeated document rows are documents of their own;
repeated item rows count once, items of one id with different texts each have a
list; equal scores come by ascending doc_id, null ids last; a very long text is
one row of one task, its postings one entry per distinct item term; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.support import lean, quoted, saved, small_batches

BEST = 50
#: Items of a block, and bytes of their texts: what one pass broadcasts.
ITEMS, ITEM_BYTES = 4096, 8 << 20
#: Postings that a task holds as a portion.
POSTINGS = 1 << 21
#: Bytes that belong to terms (digits, letters, everything beyond ASCII), A-Z in
#: lower case; the others part terms. Bytes of UTF-8, so code points beyond ASCII
#: stay whole.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """The distinct (item_id, text) rows that hold terms, in blocks of a bounded size
    (one item larger than that is a block by itself)."""
    rows = items.select(quoted("item_id").cast("long").alias("item_id"), quoted("text").cast("string").alias("text"))
    rows = saved(rows.where("text is not null").distinct(), "search-items")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [rows.where(of == b) for b in range(blocks)]


def postings(documents: DataFrame, numbers) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with terms: n counts all of them,
    the lists those that ``numbers`` (broadcast: number by term) holds."""
    def cut(batches):
        known = numbers.value
        for batch in batches:
            ids, ns, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = terms_of(text)
                if not found:
                    continue
                count = Counter(map(known.get, found))
                count.pop(None, None)
                ids.append(doc_id)
                ns.append(len(found))
                terms.append(list(count))
                counts.append(list(count.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    rows = documents.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").cast("binary").alias("text"))
    return rows.where("text is not null").mapInArrow(lean(cut), "doc_id long, n long, terms array<int>, counts array<bigint>")


class _Portion:
    """Postings of some documents by term, with contributions and their bounds."""

    def __init__(self, batches, weights, total, words):
        n = np.concatenate([b.column("n").to_numpy() for b in batches])
        self.ids = np.concatenate([b.column("doc_id").fill_null(0).to_numpy() for b in batches])
        self.unnamed = np.concatenate([b.column("doc_id").is_null().to_numpy(zero_copy_only=False) for b in batches])
        lengths = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in batches])
        term = np.concatenate([b.column("terms").flatten().to_numpy() for b in batches])
        tf = np.concatenate([b.column("counts").flatten().to_numpy() for b in batches])
        doc = np.repeat(np.arange(len(n)), lengths)
        m = 50 + np.array([50 * x * total // words for x in n.tolist()], np.int64)
        gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.bound = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.start))
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.gain, self.start[held])
        self.sums = np.zeros(len(n), np.int64)


def _kth(scores, k):
    """k-th best of the scores; 0 where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def accumulated(portion: _Portion, terms: np.ndarray, held: np.ndarray, k: int):
    """(documents, scores) that may be among the k best, exact. ``terms``: rarest
    first; ``held``: scores of the k best documents of earlier portions."""
    terms = terms[portion.start[terms + 1] > portion.start[terms]]
    left = np.cumsum(portion.bound[terms][::-1])[::-1]  # bounds from each term on
    least, creating, sums = _kth(held, k), True, portion.sums
    met, alive = np.zeros(0, np.int64), None
    for i, t in enumerate(terms):
        a, b = portion.start[t], portion.start[t + 1]
        doc, gain = portion.doc[a:b], portion.gain[a:b]
        if creating and left[i] < least:
            creating = False
            alive = np.zeros(len(sums), bool)
            alive[met] = True
        if creating:
            met = np.concatenate([met, doc[(sums[doc] == 0) & (gain > 0)]])
            sums[doc] += gain
            # A k-th best score can close the list only if it tops what is to come.
            if i + 1 < len(terms) and len(met) + len(held) >= k:
                now = sums[met]
                if len(met) and max(now.max(), least) > left[i + 1]:
                    least = max(least, _kth(np.concatenate([held, now]), k))
        else:
            on = alive[doc]
            sums[doc[on]] += gain[on]
    scores = sums[met]
    sums[met] = 0
    good = scores >= _kth(held, k)
    return met[good], scores[good]


def _search(queries, weights, total, words, k):
    """Task: the k best documents of each item among the task's postings.
    ``queries``, ``weights``: broadcast; term numbers by item, weight by term."""
    def work(batches):
        asked, w = queries.value, weights.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in asked]
        held, size = [], 0

        def close():
            portion = _Portion(held, w, total, words)
            for q, (_, terms) in enumerate(asked):
                ids, unnamed, scores = best[q]
                doc, found = accumulated(portion, terms, scores, k)
                if len(doc):
                    ids, unnamed = np.concatenate([ids, portion.ids[doc]]), np.concatenate([unnamed, portion.unnamed[doc]])
                    scores = np.concatenate([scores, found])
                    order = np.lexsort((ids, unnamed, -scores))[:k]
                    best[q] = ids[order], unnamed[order], scores[order]

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= POSTINGS:
                close()
                held, size = [], 0
        if held:
            close()
        for q, (item_id, _) in enumerate(asked):
            ids, unnamed, scores = best[q]
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(ids), pa.int32()), pa.array([item_id] * len(ids), pa.int64()),
                     pa.array(ids, mask=unnamed), pa.array(scores)], names=["q", "item_id", "doc_id", "score"])
    return lean(work)


def searched(documents: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark, sc = documents.sparkSession, documents.sparkSession.sparkContext
    out = None
    with small_batches(spark):
        for block in item_blocks(items):
            asked = [(r.item_id, sorted(set(terms_of(r.text.encode())))) for r in block.collect()]  # at most ITEMS rows
            vocabulary = sorted({t for _, ts in asked for t in ts})
            if not vocabulary:
                continue
            number = {t: i for i, t in enumerate(vocabulary)}
            table = saved(postings(documents, sc.broadcast(number)), "search-postings")
            total, words = table.agg(F.count(F.lit(1)), F.sum("n")).first()
            if not total:
                break
            df = np.zeros(len(vocabulary), np.int64)
            for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
                df[r["t"]] = r["count"]
            weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
            queries = []
            for item_id, ts in asked:
                mine = np.array([number[t] for t in ts if df[number[t]]], np.int64)
                queries.append((item_id, mine[np.argsort(df[mine], kind="stable")]))
            found = table.mapInArrow(_search(sc.broadcast(queries), sc.broadcast(weights), total, words, k),
                                     "q int, item_id long, doc_id long, score long")
            found = saved(found, "search-found")
            best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            ranked = ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def search_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Contract rows of the search query."""
    return searched(documents, items)
