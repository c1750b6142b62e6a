"""Landing a corpus as a table (S3).

The network download is out of scope: the corpus arrives as files Spark can
read. Landing writes it once to the shared folder as Parquet (or CSV with a
header) and reports the landed row count, read back from the written table so
that the count is of what was committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import scratch_path
from parlance.sources.logtables import read_csv, write_csv


def land(spark: SparkSession, df: DataFrame, dataset: str, path: str | None = None,
         fmt: str = "parquet") -> DataFrame:
    """Write ``df`` as table ``dataset`` and return (dataset, records) of the written table."""
    path = path or scratch_path(spark, f"landed-{dataset}")
    if fmt == "csv":
        write_csv(df, path)
        written = read_csv(spark, path, df.schema)
    else:
        df.write.mode("overwrite").parquet(path)
        written = spark.read.parquet(path)
    return written.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(dataset).alias("dataset"), "records")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: one
    evaluation serves every reader, and a lost executor costs only its own tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
