"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every (record key, shard) pair gets a hash; the shard with the smallest
``-ln(u) / weight`` takes the record. A shard's chance is its share of the
weights, the choice depends on the key and the shards alone, and a shard that
is added takes records only into itself.

Defined results: a null key is a key of its own (all such rows meet in one
shard); repeated rows go to the same shard and get slots of their own; a null
text counts as empty; an empty table gives an empty result; other columns of
the input are kept by ``assign`` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.support import fresh, quoted, text_or_empty

#: Parts of a shard that are numbered each by itself, so no task orders a whole shard.
SLOT_PARTS = 1024


def _race(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    return F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (0-based) of a key; shards of weight 0 take nothing."""
    # Hash the text form, so that the width of an integer key does not matter.
    stable = F.coalesce(key.cast("string"), F.lit("\0null"))
    racers = [_race(stable, i, w) for i, w in enumerate(weights) if w > 0]
    if len(racers) < 2:
        return F.lit(next(i for i, w in enumerate(weights) if w > 0))
    return F.least(*racers)["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in a new last column named ``shard``
    (underscores are put before the name if the table already has it)."""
    name, = fresh(df, shard)
    return df.select("*", rendezvous(quoted(key), weights).alias(name))


def numbered(df: DataFrame, shard: str, spread: Sequence[str], order: Sequence[str],
             slot: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Gapless slots from 0 within each shard, without ordering a shard in one task.

    Rows are dealt into ``parts`` hashed parts of each shard; parts are counted
    (partial aggregate), the counts are summed up in part order (``parts`` rows
    a shard), and rows are numbered inside their part only.
    """
    part, before, count, number = fresh(df, "part", "before", "count", "number")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*map(quoted, spread)), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, part, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, part).orderBy(*map(quoted, order))
    return (dealt.withColumn(number, F.row_number().over(inside) - 1)
            .join(counts, [shard, part])
            .withColumn(slot, F.col(number) + F.col(before))
            .drop(part, before, number))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract rows of the sharding query: law ``key``, equal weights."""
    key, text = quoted("doc_id"), text_or_empty()
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, [1.0] * shards).alias("shard"),
        rendezvous(key, [1.0] * (shards + 1)).alias("grown_shard"))
    rows = numbered(rows, "shard", spread=["doc_id", "size"], order=["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard",
                       F.col("slot").cast("long").alias("slot"), "grown_shard")
