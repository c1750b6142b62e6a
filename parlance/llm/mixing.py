"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the key range is cut
into fixed ranges, token counts are summed per (source, range), and the prefix
sums of those totals tell which ranges lie wholly before the source's budget,
which wholly behind it and which single range holds the cut. Only the rows of
that range are ordered. Whole epochs come first; the document at the cut gives
only the words that are left, so every source meets its rounded budget exactly.

Defined results: a null source is a source of its own, the last one; a null
text has size 0 and is never taken; rows with equal keys are ordered by size
(equal rows are interchangeable); an empty table gives an empty result; other
columns are kept by ``mixed_documents`` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.support import quoted, saved

WEIGHTS = (5.0, 2.0, 1.0)
#: Size of the mix as a multiple of all sizes; most epochs of a source.
SHARE, EPOCHS = 1.5, 2.0
SEED = "mix-1"
#: Words, as the tables' contract defines them.
WORD = r"[^\x20\x09-\x0D]+"
#: Key ranges of a source; the key has 60 bits, its top bits name the range.
RANGE_BITS = 12
KEY_BITS = 60
#: A source table of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_SOURCES = 10_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(key: Column, seed: str) -> Column:
    """Hash-random 60-bit number of a record key."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def budgets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """Target of each source from (source, source_size).

    Shares are ``min(epochs * size, level * weight)`` with one level for all.
    With the sources ordered by cap per weight, the level that would hold if all
    earlier ones were capped rises up to the first uncapped source and falls
    behind it, so its maximum is the level.
    """
    everything = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    ratio = [F.col("cap") / F.col("weight"), F.asc_nulls_last("source")]
    before = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level)
    return s.select("source", "source_size",
                    F.least("cap", F.col("weight") * F.max("level").over(whole)).alias("target"))


def planned(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            epochs: float = EPOCHS) -> DataFrame:
    """Adds source_size, target and taken to rows with the columns ``source``,
    ``key`` (60-bit) and ``size``; their other columns stay.

    Only (source, range) sums and the rows of the one cut range of each source
    are shuffled, whatever else the rows carry."""
    by_range = rows.withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS).cast("int"))
    totals = saved(by_range.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-totals")
    sizes = totals.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = budgets(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole)
    targets = targets.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumn("end", F.sum("range_size").over(upto))
    # The one range of each source that holds its cut, and the sizes before it.
    cuts = (ends.alias("e").join(targets.alias("t"), F.expr("e.source <=> t.source"))
            .where("e.end >= t.rest and e.end - e.range_size < t.rest")
            .select(F.col("t.source").alias("source"), F.col("e.range").alias("cut"),
                    (F.col("e.end") - F.col("e.range_size")).alias("before")))
    # No range holds the cut when nothing is left after whole epochs.
    table = (targets.alias("t").join(cuts.alias("c"), F.expr("t.source <=> c.source"), "left")
             .select(F.col("t.source").alias("of"), "source_size", "target", "whole", "rest",
                     F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("before", F.lit(0)).alias("before")))
    if sizes.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = by_range.join(table, F.expr("source <=> of")).drop("of")
    inside = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("before")
    at_cut = joined.where("range = cut").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead)))
    away = joined.where("range <> cut").withColumn(
        "part", F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    return (away.unionByName(at_cut)
            .withColumn("taken", (F.col("whole") * F.col("size") + F.col("part")).cast("long"))
            .drop("range", "whole", "rest", "cut", "before", "part"))


def _rows(docs: DataFrame, seed: str) -> DataFrame:
    """Narrow mixing columns; the document itself travels in one struct, so its
    columns cannot clash with them."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"),
                       quoted("source").cast("string").alias("source"),
                       random_key(quoted("doc_id"), seed).alias("key"), words("text").alias("size"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Contract rows of the mixing query."""
    rows = _rows(docs, SEED).withColumn("doc_id", F.col("doc").getField("doc_id")).drop("doc")
    return planned(rows).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                    epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a document once per epoch that
    takes it. A document that gives only some words of an epoch (at most one
    per source) keeps its first words there, joined by single spaces."""
    plan = planned(_rows(docs, seed), weights, share, epochs).where("taken > 0")
    plan = plan.withColumn("epoch", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    text = F.col("doc").getField("text")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), left), " ")
    return plan.select(*[F.when(left < F.col("size"), short).otherwise(text).alias(c) if c == "text"
                         else F.col("doc").getField(c).alias(c) for c in docs.columns])
