"""Connected components of a link table, by rounds of joins and minima.

Large-star / small-star rounds: every round links each node's larger neighbours
to its smallest one, then its smaller neighbours, until nothing changes. Each
round is written to the shared folder, so lineage stays short; links shrink to
one per node. Minima are partial aggregates and the joins are splittable, so a
node with very many links does not sit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.support import saved


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """``both_ways``: large-star (all neighbours known to each node, larger ones
    are moved); else small-star on (larger, smaller) links."""
    if both_ways:
        links = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = links.join(low, "a")
    if both_ways:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            low.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; ``links`` has the columns
    a and b. A component is named by its smallest node. No link, no row."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(links, "links")
    mark = None
    while True:
        # (larger, smaller) links after a large-star and a small-star
        large = _star(now, True)
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now = saved(_star(large, False), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(new):
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        mark = tuple(new)
