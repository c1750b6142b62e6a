"""Label encoding and code lookups.

Class dimensions are numbered on their distinct values only. Joins against a
dimension are left to the planner: with AQE on, a dimension whose shuffle
output is below ``spark.sql.adaptive.autoBroadcastJoinThreshold`` is
broadcast at run time, a large one stays a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.operators.ordered import row_number_within
from parlance.sources.landing import stored


def fit_codes(df: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """Dimension (value, code): codes 0..k-1 in sorted order of distinct non-null values.

    The distinct values are written once; at most ``DIMENSION_BROADCAST_ROWS`` of them
    are numbered in one task, more by ranges."""
    values = stored(df.select(col).where(F.col(col).isNotNull()).distinct(), "dimension")
    if values.count() <= K.DIMENSION_BROADCAST_ROWS:
        return values.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("int").alias(code_col))
    numbered = row_number_within(values, [], [col], out="__rn")
    return numbered.select(col, (F.col("__rn") - 1).cast("int").alias(code_col))


def apply_codes(df: DataFrame, dim: DataFrame, col: str, code_col: str = "code",
                unknown: str = "drop", broadcast_max_rows: int = K.DIMENSION_BROADCAST_ROWS) -> DataFrame:
    """Attach codes of a fitted dimension.

    unknown="drop" keeps only known values (inner join); "null" keeps the row
    with a null code; "error" raises on the first unknown value.

    A fitted dimension's values are written, so its row count is cheap to take; at most ``broadcast_max_rows`` rows it is
    broadcast. Otherwise it stays a shuffle join, never a broadcast of
    unchecked size.
    """
    if dim.count() <= broadcast_max_rows:
        dim = F.broadcast(dim)
    if unknown == "drop":
        return df.join(dim, on=col, how="inner")
    out = df.join(dim, on=col, how="left")
    if unknown == "error":
        out = out.withColumn(code_col, F.when(F.col(code_col).isNull() & F.col(col).isNotNull(),
                                              F.raise_error(F.concat(F.lit("unseen label: "),
                                                                     F.col(col).cast("string"))))
                             .otherwise(F.col(code_col)))
    return out


def lookup_names(df: DataFrame, dim: DataFrame, code_col: str, dim_code: str, dim_value: str,
                 out: str, default: str = "DEFAULT") -> DataFrame:
    """Code -> name with a default for codes missing from the dimension."""
    d = dim.select(F.col(dim_code).alias("__code"), F.col(dim_value).alias("__name"))
    j = df.join(d, F.col(code_col) == F.col("__code"), "left")
    return j.withColumn(out, F.coalesce(F.col("__name"), F.lit(default))).drop("__code", "__name")


def sentiment_codes(df: DataFrame, col: str, out: str = "sentiment_encoded") -> tuple[DataFrame, DataFrame]:
    """Fixed map {negative: 0, neutral: 1, positive: 2}; returns (coded, quarantined)."""
    expr = None
    for name, code in K.SENTIMENT_CODES.items():
        expr = (F.when(F.col(col) == name, F.lit(code)) if expr is None
                else expr.when(F.col(col) == name, F.lit(code)))
    coded = df.withColumn(out, expr.otherwise(F.lit(None).cast("int")))
    return coded.where(F.col(out).isNotNull()), coded.where(F.col(out).isNull())


def one_vs_rest(df: DataFrame, label_col: str, out_class: str = "class",
                out_flag: str = "indicator") -> DataFrame:
    """Long-form one-vs-rest indicators: one row per (row, class).

    The sorted class list is a one-row aggregate, broadcast (one row) and
    exploded per row; nothing pairs rows with rows.
    """
    classes = df.agg(F.array_sort(F.collect_set(label_col)).alias("__classes"))
    j = df.crossJoin(F.broadcast(classes))
    return (j.select("*", F.explode("__classes").alias(out_class)).drop("__classes")
            .withColumn(out_flag, (F.col(label_col) == F.col(out_class)).cast("int")))
