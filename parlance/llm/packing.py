"""Packing token ids into fixed sequences by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids, with the number of ids
before it in its partition, as a table in the shared folder. The partitions'
totals are summed up into global offsets (one row per partition). Pass 2 reads
the table and cuts each document where the fixed windows of the global id
stream end; a document over a boundary gives one piece to each window. No row
is shuffled, and only the last sequence of all is short.

Defined results: a null or empty text is its end id alone; repeated rows are
packed once each; texts of any length give as many pieces as they need; an
empty table gives no piece; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import tokens
from parlance.llm.support import documents, lean, quoted, saved, text_or_empty

SEQUENCE = 2048


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = tokens.END_ID) -> DataFrame:
    """(part, before, n, ids, doc_id): a document's packed ids and the number of
    ids before it in its partition, written once to the shared folder."""
    def encode(batches):
        part = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer)
        width, before = enc.dtype.itemsize, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = enc.many(some.column("text").to_pylist(), end_id)
                starts = []
                for x in ids:
                    starts.append(before)
                    before += len(x) // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                     pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     some.column("doc_id")], names=["part", "before", "n", "ids", "doc_id"])

    rows = documents(docs).select(quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return saved(rows.mapInArrow(lean(encode), "part int, before long, n long, ids binary, doc_id long"), "pack-ids")


def offsets(ids: DataFrame) -> DataFrame:
    """(part, base): ids in all earlier partitions. One row per partition."""
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))


def pack(ids: DataFrame, sequence: int = SEQUENCE, width: int = 2) -> DataFrame:
    """Pieces of (part, before, n, ids, doc_id) rows: doc_id, start, length,
    ids (packed), doc_tokens, sequence_id, offset."""
    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for doc, at, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(),
                                       batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                start = 0
                while start < n:
                    offset = (at + start) % sequence
                    length = min(n - start, sequence - offset)
                    for k, v in zip(out, (doc, start, length, ids[start * width:(start + length) * width],
                                          n, (at + start) // sequence, offset)):
                        out[k].append(v)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    # One row per partition: broadcast whatever the documents' number is.
    placed = ids.join(F.broadcast(offsets(ids)), "part").select(
        "doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("at"))
    return placed.mapInArrow(lean(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long")


def crc_of(column: str, width: int):
    """Unsigned crc32 of packed ids as little-endian unsigned 32-bit integers."""
    narrow = "<u2" if width == 2 else "<u4"

    def crc(packed: pd.Series) -> pd.Series:
        return packed.map(lambda b: zlib.crc32(np.frombuffer(b, narrow).astype("<u4").tobytes()))

    return F.pandas_udf(crc, "long")(F.col(column))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Contract rows of the packing query."""
    tokenizer = tokenizer or tokens.default_path()
    width = tokens.encoder(tokenizer).dtype.itemsize
    pieces = pack(tokenized(docs, tokenizer), sequence, width)
    return pieces.select("doc_id", "start", "length", crc_of("ids", width).alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
