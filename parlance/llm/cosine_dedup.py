"""Near-duplicate vectors by random-hyperplane signs and exact cosine.

Vectors are compared only when their labels are equal. Several tables of sign
bits name buckets; number and width of the tables follow from the number of
vectors and the wanted recall at the threshold. Every pair of a bucket is
verified by cosine in double precision, in blocks; a pair found in several
tables counts in the first one only. Equal vectors of a label are one node.
Links go through distributed connected components.

Defined results: a null label, and a vector that is null, empty, of zero length
or with a null or non-finite component, links with nothing; vectors of different
dimension do not link; repeated rows (equal label and vector) link to each
other; a component is named by its smallest vec_id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.components import components
from parlance.llm.support import lean, quoted, saved

THRESHOLD, RECALL = 0.93, 0.9995
SEED = 930
#: Vectors that a bucket should hold when all directions are alike.
BUCKET = 16


def tables_for(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): enough bits for small buckets, enough tables for the recall
    of a pair exactly at the threshold."""
    bits = min(32, max(6, round(math.log2(max(vectors, 2) / BUCKET))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def _planes(dimension: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED + dimension).standard_normal((dimension, bits * tables))


def signatures(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(vec_id, class, label, vector, signs): unit checks, digest and sign bits.
    class is null for a vector that cannot link."""
    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            classes, signs, packed = [], [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("vector").to_pylist()):
                x = np.array([np.nan if y is None else y for y in v or [np.nan]], np.float64)
                if label is None or not np.isfinite(x).all() or not x.any():
                    for out in (classes, signs, packed):
                        out.append(None)
                    continue
                x = x + 0.0  # -0.0 and 0.0 are one value
                if len(x) not in planes:
                    planes[len(x)] = _planes(len(x), bits, tables)
                unit = x / np.abs(x).max()
                above = (unit @ planes[len(x)] > 0).reshape(tables, bits)
                number = above @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                packed.append(x.tobytes())
                signs.append(number.astype("<u4").tobytes())
                classes.append(hashlib.md5(f"{label}\0".encode() + packed[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(classes, pa.string()), batch.column("label"),
                 pa.array(packed, pa.binary()), pa.array(signs, pa.binary())],
                names=["vec_id", "class", "label", "vector", "signs"])

    rows = vectors.select(quoted("vec_id").cast("long").alias("vec_id"), quoted("label").cast("string").alias("label"),
                          quoted("embedding").cast("array<double>").alias("vector"))
    return rows.mapInArrow(lean(sign), "vec_id long, class string, label string, vector binary, signs binary")


def _verify(threshold: float):
    def verify(batches):
        for unit in blocks.runs(batches, ["label", "table", "bucket"]):
            classes = np.array(unit.column("class").to_pylist(), object)
            order = np.argsort(classes)
            lengths = [len(b) for b in unit.column("vector").to_pylist()]
            if len(order) < 2:
                continue
            own = unit.column("own").to_numpy()
            copies = unit.column("copies").to_numpy()
            table = unit.column("table")[0].as_py()
            i, j = unit.column("block_i")[0].as_py(), unit.column("block_j")[0].as_py()
            vectors, signs = unit.column("vector").to_pylist(), unit.column("signs").to_pylist()
            for length in sorted(set(lengths)):
                pick = np.array([k for k in order if lengths[k] == length])
                if len(pick) < 2:
                    continue
                x = np.frombuffer(b"".join(vectors[k] for k in pick), np.float64).reshape(len(pick), -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                close = (x @ x.T >= threshold) & blocks.to_compare(own[pick], i, j)
                a, b = np.nonzero(close)
                s = np.frombuffer(b"".join(signs[k] for k in pick), "<u4").reshape(len(pick), -1)
                first = np.empty(len(a), np.int64)
                for lo in range(0, len(a), 1 << 16):
                    first[lo:lo + (1 << 16)] = (s[a[lo:lo + (1 << 16)]] == s[b[lo:lo + (1 << 16)]]).argmax(axis=1)
                close[a[first != table], b[first != table]] = False
                close |= close.T
                linked = np.flatnonzero(close.any(axis=1))
                if len(linked):
                    head = blocks.heads(close)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(classes[pick[linked]]), pa.string()),
                         pa.array((close[linked].astype(np.int64) @ copies[pick]).astype(np.int64)),
                         pa.array(list(classes[pick[head[linked]]]), pa.string())], names=["node", "links", "head"])
    return verify


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    bits, tables = tables_for(vectors.count(), threshold, recall)
    signed = saved(signatures(vectors, bits, tables), "signatures")
    able = signed.where(F.col("class").isNotNull())
    named = saved(able.groupBy("class").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    # One row of each class: equal rows of its first vec_id are the same vector.
    single = able.groupBy("class", "label", "vector", "signs").agg(F.count(F.lit(1)).alias("copies"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)),
                          lambda t: F.struct(t.alias("table"), F.substring("signs", t * 4 + 1, F.lit(4)).alias("bucket")))
    spread = single.select("*", F.explode(numbers).alias("of")).select(
        "class", "label", "vector", "signs", "copies", "of.table", "of.bucket")
    shared = (single.select("class", "label", F.explode(numbers).alias("of")).select("label", "of.table", "of.bucket")
              .groupBy("label", "table", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    spread = spread.join(shared, ["label", "table", "bucket"])  # buckets of one vector stay behind
    group = ["label", "table", "bucket"]
    found = blocks.units(blocks.in_blocks(spread, group, "class"), group).mapInArrow(
        lean(_verify(threshold)), "node string, links long, head string")
    found = saved(found, "vector-links")
    comps = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    of_class = (named.join(blocks.summed(found).withColumnRenamed("node", "class"), "class", "left")
                .join(comps.withColumnRenamed("node", "class"), "class", "left")
                .withColumn("component", F.coalesce("component", "class")))
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(smallest, "component").select(
        "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = signed.select("vec_id", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def link_vectors(vectors: DataFrame) -> DataFrame:
    """Contract rows of the embedding query."""
    return linked(vectors)
