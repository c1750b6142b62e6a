"""Token ids as Parquet list columns that can be read in part.

Files hold documents in ascending doc_id order: ``doc_id``, ``n_tokens`` and the
list column ``ids``. The writer's row-group size bounds what a selective read
must fetch, ids are dictionary-encoded, ids above the dictionary's limit fall
back to delta coding (format 2 pages), and page indexes (minima and maxima of
doc_id per page) let a reader skip pages. Reading ``doc_id`` and ``n_tokens``
never touches the ids.

Defined results: a null or empty text is its end id alone; a null doc_id comes
first; equal doc_ids are ordered by their text; an empty table gives files
without rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import tokens
from parlance.llm.support import documents, lean, new_path, quoted, text_or_empty

#: Bytes of a row group, and rows of a page (the grain of the page index).
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
SCHEMA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None,
                 end_id: int | None = tokens.END_ID) -> None:
    """Tokenize whole texts and write them in ascending doc_id order.

    One shuffle of the texts by doc_id ranges; ``shard`` numbers the ranges and
    ``place`` the rows of a range, so the files alone give the global order."""
    tokenizer = tokenizer or tokens.default_path()

    def encode(batches):
        shard, place = TaskContext.get().partitionId(), 0
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                some = batch.slice(lo, 128)
                packed = enc.many(some.column("text").to_pylist(), end_id)
                counts = [len(x) // enc.dtype.itemsize for x in packed]
                flat = np.frombuffer(b"".join(packed), enc.dtype).astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([shard] * len(counts), pa.int32()),
                     pa.array(range(place, place + len(counts)), pa.int64()), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "shard", "place", "n_tokens", "ids"])
                place += len(counts)

    rows = documents(docs).select(quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    (ordered.mapInArrow(lean(encode), SCHEMA).write
     .option("compression", "zstd")
     .option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .option("parquet.enable.dictionary", "true")
     .option("parquet.writer.version", "PARQUET_2_0")
     .parquet(path))


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The files' rows; without ``ids`` only the metadata columns are read.
    A filter on doc_id reaches row-group statistics and page indexes."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if ids else df.drop("ids")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all earlier documents, to rows that have shard,
    place and n_tokens: shard totals first, then sums inside each shard."""
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("shard_tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(F.broadcast(bases), "shard")  # one row per file
            .withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside"))


def digest(batches):
    for batch in batches:
        column = batch.column("ids")
        flat = column.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = column.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("shard"), batch.column("place"),
             pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
            names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])


def token_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Contract rows of the token-file query: written, read back, digested.
    Starts come from a metadata read, digests from a read of the ids."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write_tokens(docs, path, tokenizer)
    rows = read_tokens(spark, path).select("doc_id", "shard", "place", "ids").mapInArrow(
        lean(digest), "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    starts = with_starts(read_tokens(spark, path, ids=False).drop("doc_id"))
    return (rows.join(starts.drop("n_tokens"), ["shard", "place"])
            .select("doc_id", "start", "n_tokens", "ids_crc32"))
