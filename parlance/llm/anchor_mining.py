"""Hard negatives for anchors, by score bounds along spanning trees of anchors.

A row's score is its integer inner product with the anchor. Near anchors lie in
one minimum spanning tree (Prim, at most ``TREE`` anchors, of one label). A tree's
root is scored against every candidate; from a parent to its child a candidate's
score moves by at most the length of the edge times the candidate's norm, so the
parent's bounds give the child's, and only candidates whose bounds overlap the
child's window are scored again. The window of the first pass (positives) reaches
from the k-th best lower bound upwards, that of the second from the least to the
greatest score that a negative of one of the positives may have.

Candidates are dealt by hash into units of at most about ``UNIT`` rows, moved once
a pass; a task holds one unit and streams the anchors past it, tree by tree. A
unit returns its best few rows per anchor; the best of all units are taken by a
rank per anchor that is cut before the shuffle as well as after it. Work is one
bound per (anchor, candidate) at least; nothing is dropped, capped or sampled.

Defined results: a null id, a null label, a null vector and a vector with a null
or non-finite component take no part; vectors meet only vectors of their own
length (empty ones score 0); repeated rows are rows of their own as candidates,
an anchor's own id is never its candidate, and of an anchor's repeated rows the
one of the smallest (label, vector) is the anchor; equal scores come in order of
id; components are held inside 64 bits, and sums beyond them wrap; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.support import discard, lean, quoted, saved, small_batches

#: Anchors of a tree, candidates of a unit, and the fewest a unit is cut down to
#: so that every core has one.
TREE, UNIT, SMALL_UNIT = 256, 8192, 1024
#: Leading components whose signs put near anchors side by side.
SIGNS = 16
#: Whole numbers up to here are exact in double precision.
EXACT = 2.0 ** 53


def prepared(vectors: DataFrame, label=None, scale: int = 256) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; x = floor(scale * component).
    ``label``: a column expression, by default the column label."""
    values = quoted("embedding").cast("array<double>")
    rows = vectors.select(quoted("vec_id").cast("long").alias("vec_id"),
                          (quoted("label") if label is None else label).cast("long").alias("label"), values.alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(~F.coalesce(odd, F.lit(True)))
    return rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _spanning(batches):
    """Rows of anchors in order of (size, label, signs, vec_id) to trees: adds tree,
    step, parent (step of the parent, -1 for the root) and edge."""
    chunk, key, number = [], None, 0

    def grown(chunk, number):
        x = np.array([r[3] for r in chunk], np.float64).reshape(len(chunk), -1)
        n, near, edge = len(chunk), np.zeros(len(chunk), np.int64), None
        left = np.ones(n, bool)
        order, parents, edges = [0], {0: -1}, {0: 0.0}
        left[0] = False
        edge = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        while len(order) < n:
            k = int(np.where(left, edge, np.inf).argmin()) if np.isfinite(edge[left]).any() else int(np.flatnonzero(left)[0])
            order.append(k)
            left[k] = False
            parents[k], edges[k] = int(near[k]), float(edge[k])
            d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
            closer = left & (d < edge)
            near[closer], edge[closer] = k, d[closer]
        step = {k: i for i, k in enumerate(order)}
        return pa.RecordBatch.from_pydict({
            "part": pa.array([chunk[k][0] for k in order], pa.int32()), "tree": pa.array([number] * n, pa.int32()),
            "step": pa.array(range(n), pa.int32()),
            "parent": pa.array([step.get(parents[k], -1) for k in order], pa.int32()),
            "edge": pa.array([edges[k] for k in order], pa.float64()),
            "vec_id": pa.array([chunk[k][1] for k in order], pa.int64()),
            "label": pa.array([chunk[k][2] for k in order], pa.int64()),
            "x": pa.array([chunk[k][3] for k in order], pa.list_(pa.int64()))})

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "vec_id", "label", "x"))):
            of = (row[2], len(row[3]))
            if chunk and (of != key or len(chunk) == TREE):
                yield grown(chunk, number)
                chunk, number = [], number + 1
            key = of
            chunk.append(row)
    if chunk:
        yield grown(chunk, number)


def spanning_trees(anchors: DataFrame) -> DataFrame:
    """(part, tree, step, parent, edge, vec_id, label, x): the anchors in trees, each
    in an order in which parents come first."""
    trees = max(1, -(-anchors.count() // TREE))
    signs = F.transform(F.slice("x", 1, SIGNS), lambda v: v >= 0)
    order = [F.size("x"), F.col("label"), signs, F.col("vec_id")]
    rows = anchors.repartitionByRange(trees, *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "vec_id", "label", "x")
    return rows.mapInArrow(lean(_spanning), "part int, tree int, step int, parent int, edge double, vec_id long, label long, x array<bigint>")


def _scores(x, wide, a):
    """Inner products with ``a``; ``wide`` holds the same numbers as doubles, or
    None where doubles are not exact."""
    return x @ a if wide is None else (wide @ a.astype(np.float64))


class _Unit:
    """Candidates of one unit: ids, labels, and per vector length a matrix."""

    def __init__(self, batches):
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
        labels = np.concatenate([b.column("label").to_numpy() for b in batches])
        flat = np.concatenate([_matrix(b.column("x")) for b in batches])
        lengths = np.concatenate([np.diff(b.column("x").offsets.to_numpy()) for b in batches])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        self.parts = {}
        for n in np.unique(lengths):
            pick = np.flatnonzero(lengths == n)
            x = flat[starts[pick][:, None] + np.arange(n)] if n else np.zeros((len(pick), 0), np.int64)
            self.parts[int(n)] = (ids[pick], labels[pick], x)
        self.of = {}

    def candidates(self, length: int, label: int, same: bool):
        """(ids, x, x as doubles, norms, largest component) for anchors of a label."""
        if (length, label, same) not in self.of:
            self.of.clear()  # trees come label by label
            if length not in self.parts:
                return None
            ids, labels, x = self.parts[length]
            pick = (labels == label) == same
            ids, x = ids[pick], x[pick]
            wide = x.astype(np.float64)
            norms = np.sqrt((wide * wide).sum(axis=1)) * (1 + 1e-9)
            self.of[length, label, same] = ids, x, wide, norms, np.abs(wide).max(initial=0.0)
        return self.of[length, label, same]


class _Tree:
    """Bounds of the candidates at each anchor of one tree, in tree order."""

    def __init__(self, unit, length, label, same):
        self.found = unit.candidates(length, label, same)
        self.low, self.high = [], []

    def step(self, a, parent, edge, window):
        """Exact scores of the candidates that may lie in the window, as (ids,
        scores). ``window``: (low, high), or a count k for the k best, or None."""
        ids, x, wide, norms, top = self.found
        exact = len(a) * top * max(np.abs(a.astype(np.float64)).max(initial=0.0), 1.0) < EXACT
        if parent < 0 or not exact:
            scores = _scores(x, wide if exact else None, a)
            self.low.append(scores)
            self.high.append(scores)
            return ids, scores
        slack = edge * (1 + 1e-9) * norms + 1
        low, high = self.low[parent] - slack, self.high[parent] + slack
        if window is None:
            near = np.zeros(len(ids), bool)
        elif isinstance(window, int):
            near = high >= np.partition(low, len(low) - window)[len(low) - window] if len(low) > window else np.ones(len(ids), bool)
        else:
            near = (high >= window[0]) & (low <= window[1])
        rows = np.flatnonzero(near)
        if 2 * len(rows) > len(ids):
            scores = wide @ a.astype(np.float64)
            low = high = scores
            out = ids[rows], scores[rows]
        else:
            scores = wide[rows] @ a.astype(np.float64)
            low[rows], high[rows] = scores, scores
            out = ids[rows], scores
        self.low.append(low)
        self.high.append(high)
        return out


def _best(ids, scores, k):
    """Positions of the k rows of highest score, equal ones by smaller id."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows = np.flatnonzero(scores >= kth)
    else:
        rows = np.arange(len(ids))
    return rows[np.lexsort((ids[rows], -scores[rows]))][:k]


def _passing(look, same):
    """The task of one pass: units one after the other, each first its candidates
    (anchor null), then the anchors tree by tree. ``look(tree, row)`` yields result
    rows for one anchor."""
    def work(batches):
        held, now, unit, tree, of = [], None, None, None, None
        out = []
        for batch in batches:
            units, kinds = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if units[a] != now:
                    now, held, unit, of = units[a], [], None, None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(piece)
                    continue
                if not held and unit is None:
                    continue  # anchors for a unit without candidates
                if unit is None:
                    unit, held = _Unit(held), []
                for row in piece.to_pylist():
                    if (row["part"], row["tree"]) != of:
                        of = row["part"], row["tree"]
                        tree = _Tree(unit, len(row["x"]), row["label"], same)
                    if tree.found is None:
                        continue
                    row["x"] = np.array(row["x"], np.int64)
                    out.extend(look(tree, row))
                if len(out) >= 10_000:
                    yield from _rows(out)
                    out = []
        yield from _rows(out)
    return lean(work)


def _rows(out):
    if out:
        names = ["anchor_id", "n", "positive_id", "positive_score", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=names)


def _positives(k):
    def look(tree, row):
        ids, scores = tree.step(row["x"], row["parent"], row["edge"], k + 1)  # the anchor itself may be among them
        other = ids != row["vec_id"]
        ids, scores = ids[other], scores[other]
        for i in _best(ids, scores, k):
            yield row["vec_id"], None, None, None, int(ids[i]), int(scores[i])
    return look


def _negatives(k, least, most):
    def look(tree, row):
        windows = [(-(-least * p["score"] // 100), most * p["score"] // 100, p) for p in row["positives"] or []]
        windows = [w for w in windows if w[0] <= w[1]]
        whole = (min(w[0] for w in windows), max(w[1] for w in windows)) if windows else None
        ids, scores = tree.step(row["x"], row["parent"], row["edge"], whole)
        for low, high, p in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high) & (ids != row["vec_id"]))
            for i in inside[_best(ids[inside], scores[inside], k)]:
                yield row["vec_id"], p["n"], p["vec_id"], p["score"], int(ids[i]), int(scores[i])
    return look


_FOUND = "anchor_id long, n long, positive_id long, positive_score long, vec_id long, score long"
_POSITIVES = "array<struct<n:bigint,vec_id:bigint,score:bigint>>"


def _passed(candidates: DataFrame, anchors: DataFrame, units: int, look, same: bool) -> DataFrame:
    """One pass: the candidates' units, each with all anchors behind its rows."""
    none = {c: F.lit(None) for c in ("part", "tree", "step", "parent", "edge")}
    rows = candidates.select("unit", F.lit(0).alias("kind"), *[v.cast("double" if c == "edge" else "int").alias(c) for c, v in none.items()],
                             "vec_id", "label", "x", F.lit(None).cast(_POSITIVES).alias("positives"))
    dealt = anchors.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).select(
        "unit", F.lit(1).alias("kind"), *none, "vec_id", "label", "x", "positives")
    order = ["unit", "kind", "part", "tree", "step"]
    return rows.union(dealt).repartition(units, "unit").sortWithinPartitions(*order).mapInArrow(_passing(look, same), _FOUND)


def mined(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, x): for each of
    an anchor's first ``positives`` rows of its label, the first ``negatives`` rows of
    other labels whose score is ``least`` to ``most`` per cent of the positive's.
    ``is_anchor``: condition on vec_id. One row per (anchor, positive, negative)."""
    spark = rows.sparkSession
    with small_batches(spark):
        total, cores = rows.count(), spark.sparkContext.defaultParallelism
        units = max(1, -(-total // UNIT), min(cores, total // SMALL_UNIT))
        candidates = saved(rows.withColumn("unit", F.pmod(F.xxhash64("vec_id"), F.lit(units)).cast("int")), "mining-rows")
        anchors = candidates.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("of"))
        trees = saved(spanning_trees(anchors.select("vec_id", "of.label", "of.x")), "mining-trees")

        first = _passed(candidates, trees.withColumn("positives", F.lit(None).cast(_POSITIVES)), units, _positives(positives), True)
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
        first = first.select("anchor_id", "vec_id", "score").withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
        lists = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), "vec_id", "score"))).alias("positives"))
        wanted = saved(trees.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left"), "mining-positives")

        found = saved(_passed(candidates, wanted, units, _negatives(negatives, least, most), False), "mining-found")
        for table in (candidates, trees, wanted):
            discard(table)
    best = Window.partitionBy("anchor_id", "n").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def mine_vectors(vectors: DataFrame) -> DataFrame:
    """Contract rows of the hard-negative query."""
    label = F.when(quoted("vec_id") % 7 == 0, (quoted("label") + 1) % 10).otherwise(quoted("label"))
    return mined(prepared(vectors, label), F.col("vec_id") % 50 == 0)
