"""Order-dependent operators that stay parallel when one group is huge.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task; a group
holding a third of the rows then runs on one core. ``grouped_scan`` computes
the same running count / sum / max / min exactly, in three steps:

1. range-partition on (group, order) so a hot group is split over many
   partitions, and scan each (partition, group) chunk locally;
2. total each chunk (one row per chunk) and carry the totals of earlier
   chunks of the same group forward (a window over chunks: at most one row
   per partition for any group);
3. join the carries (only chunks with an earlier chunk, so at most one per
   partition: a bounded broadcast) and combine.

The range-partitioned rows are checkpointed once, so both uses see the same
partition ids.

With no group columns it is a global running scan (e.g. a positional index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.session import checkpoint_root

_COMBINE = {
    "count": lambda local, carry: local + F.coalesce(carry, F.lit(0)),
    "sum": lambda local, carry: F.coalesce(local + carry, local, carry),
    "max": lambda local, carry: F.greatest(local, carry),
    "min": lambda local, carry: F.least(local, carry),
}
_CHUNK_AGG = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def grouped_scan(df: DataFrame, group_cols, order_cols, aggs: dict, n_partitions: int | None = None) -> DataFrame:
    """Add running aggregates per group in ``order_cols`` order.

    ``aggs`` maps output name -> (kind, column) with kind in count/sum/max/min;
    for ``count`` the column is ignored and the result is the 1-based row
    number (``order_cols`` should make the order unique within a group).
    """
    group_cols = list(group_cols)
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(g) for g in group_cols] + order_exprs
    n = _partitions(df, n_partitions)
    # Range bounds come from a sample seeded by the RDD id, so two evaluations
    # may cut differently: materialise the partition ids once (a reliable
    # checkpoint in the shared folder, which also survives executor loss).
    checkpoint_root(df.sparkSession)
    ranged = df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)

    chunk = ["__pid"] + group_cols
    w_local = Window.partitionBy(*chunk).orderBy(*order_exprs).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged
    for name, (kind, col) in aggs.items():
        value = F.lit(1) if kind == "count" else (F.col(col) if isinstance(col, str) else col)
        fn = F.count if kind == "count" else _CHUNK_AGG[kind]
        local = local.withColumn(f"__local_{name}", fn(value).over(w_local))

    def _total(kind, col):
        if kind == "count":
            return F.count(F.lit(1))
        return _CHUNK_AGG[kind](F.col(col) if isinstance(col, str) else col)

    totals = ranged.groupBy(*chunk).agg(
        *[_total(kind, col).alias(f"__tot_{name}") for name, (kind, col) in aggs.items()])
    if group_cols:
        w_prev = Window.partitionBy(*group_cols).orderBy("__pid")
    else:
        totals = totals.withColumn("__one", F.lit(0))
        w_prev = Window.partitionBy("__one").orderBy("__pid")
    w_prev = w_prev.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *chunk,
        F.count(F.lit(1)).over(w_prev).alias("__n_prev"),
        *[_CHUNK_AGG[kind](F.col(f"__tot_{name}")).over(w_prev).alias(f"__carry_{name}")
          for name, (kind, _) in aggs.items()],
    ).where(F.col("__n_prev") > 0).drop("__n_prev")
    # Only a chunk whose group started in an earlier partition has a carry:
    # at most one such chunk per partition, so this side is bounded by n.
    # A null group is a group too, so the keys are compared null-safe.
    carries = carries.select(*[F.col(c).alias(f"__of_{c}") for c in chunk],
                             *[f"__carry_{name}" for name in aggs])
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in chunk]
    out = local.join(F.broadcast(carries), on=same, how="left")
    for name, (kind, _) in aggs.items():
        out = out.withColumn(name, _COMBINE[kind](F.col(f"__local_{name}"), F.col(f"__carry_{name}")))
    drop = ["__pid"] + [f"__of_{c}" for c in chunk] + [c for name in aggs for c in (f"__local_{name}", f"__carry_{name}")]
    return out.drop(*drop)


def row_number_within(df: DataFrame, group_cols, order_cols, out: str = "rn",
                      n_partitions: int | None = None) -> DataFrame:
    """1-based position within each group (exact, skew-safe)."""
    return grouped_scan(df, group_cols, order_cols, {out: ("count", None)}, n_partitions)


def first_by(df: DataFrame, key_cols, order_col: str, keep_cols=None) -> DataFrame:
    """Keep the first row of each key in ``order_col`` order.

    An aggregate (min of a struct led by the order column) combines map-side,
    so a hot key never gathers in one task.
    """
    key_cols = list(key_cols)
    keep = [c for c in (keep_cols or df.columns) if c not in key_cols]
    if order_col not in keep:
        keep = [order_col] + keep
    else:
        keep = [order_col] + [c for c in keep if c != order_col]
    if keep == [order_col]:
        # nothing rides along: a plain min keeps a fixed-width buffer, so the
        # aggregate is hash-based instead of sorting the (possibly long) keys
        return df.groupBy(*key_cols).agg(F.min(order_col).alias(order_col)).select(*key_cols, order_col)
    packed = df.groupBy(*key_cols).agg(F.min(F.struct(*[F.col(c) for c in keep])).alias("__first"))
    return packed.select(*key_cols, *[F.col(f"__first.{c}").alias(c) for c in keep])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)
