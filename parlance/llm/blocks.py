"""Pairwise work inside groups of any size, in bounded blocks.

A group's members are dealt into blocks by hash; each pair of blocks (and each
block with itself) is one unit of work, so no task holds a whole large group and
every pair of members meets exactly once. Work units return per-member sums and
star links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block.
BLOCK = 512


def in_blocks(rows: DataFrame, group: list[str], member: str, size: int = BLOCK) -> DataFrame:
    """Rows once per work unit: adds block_i <= block_j and own, the row's block."""
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > size)
    large = large.select(*group, F.ceil(F.col("members") / size).cast("int").alias("blocks"))
    dealt = rows.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (dealt.withColumn("block_i", F.least("own", "other")).withColumn("block_j", F.greatest("own", "other"))
            .drop("blocks", "other"))


def units(rows: DataFrame, group: list[str]) -> DataFrame:
    """Work units side by side: one shuffle, each unit's rows in a run."""
    keys = [*group, "block_i", "block_j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """The rows of each work unit, one after the other, from sorted batches."""
    keys, held, last = [*group, "block_i", "block_j"], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        here = list(zip(*columns))
        cuts = [i for i in range(1, len(here)) if here[i] != here[i - 1]]
        for a, b in zip([0, *cuts], [*cuts, len(here)]):
            if here[a] != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = here[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def to_compare(own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs (row, column) a unit compares: all distinct ones inside a
    block, those across for two blocks; upper half only."""
    if i == j:
        return np.triu(np.ones((len(own), len(own)), bool), 1)
    return (own == i)[:, None] & (own == j)[None, :]


def heads(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric link matrix."""
    head = np.arange(len(linked))
    while True:
        low = np.where(linked, head[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(head, low)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def summed(found: DataFrame) -> DataFrame:
    """(node, links) from the units' (node, links, head) rows."""
    return found.groupBy("node").agg(F.sum("links").alias("links"))
