"""Document fingerprints by randomised edit embedding.

One random walk, shared by all documents, reads a text: at step j it stands on
some character, and a random bit that depends on j and the character alone says
whether it moves on. Two texts that differ by a few edits soon walk in step
again, so the edit distance of the texts shows as the Hamming distance of the
characters met. A fingerprint samples steps and keeps one hashed bit of the
character met at each: the steps of a length class are hash-sampled, and the
steps of a longer class are a subset of those of a shorter one, so texts of
different length can be compared.

Near duplicates: bands of sampled bits name buckets, the documents of a bucket
are compared pair by pair in blocks, and verified links are joined to groups.

Defined results: a null text counts as empty; the fingerprint of an empty text
is like that of another empty text (1.0) and unlike any other (0.0); equal texts
have equal fingerprints; texts of any length are walked whole; a null doc_id
comes first, equal doc_ids are ordered by their text; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.components import components
from parlance.llm.support import documents, kept, lean, quoted, saved, text_or_empty

#: Sampled steps of a length class (as expected), also the steps of the shortest class.
SAMPLES = 1024
#: Random bits repeat after so many steps; characters fall into so many walk classes.
PERIOD, CLASSES = 4096, 256
SEED = 20240229
#: Characters walked side by side at most (bounds a task's memory, not a text).
SLICE_CHARS = 6_000_000
#: Recall of a pair at the threshold, and fingerprints that a bucket should hold
#: when all bits are alike.
RECALL, BUCKET = 0.999, 16
#: Length slices of the walk: slice m reaches to step SLICE ** m. Allowances for the
#: sampling of steps: of the lengths' ratio, and of the share of differing bits.
SLICE, RATIO_SLACK, SHARE_SLACK = 1.25, 0.05, 0.03


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _stay_table() -> np.ndarray:
    """Steps the walk stays on a character of class c from phase j on, flat at
    c * PERIOD + j: up to and with the next step whose random bit is 1."""
    mine = kept("walks")
    if "stay" not in mine:
        bits = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        bits[:, 0] = 1
        stay = np.empty((CLASSES, PERIOD), np.uint8)
        wait = np.ones(CLASSES, np.uint8)  # from phase PERIOD, which is phase 0 again
        for j in range(PERIOD - 1, -1, -1):
            wait = np.where(bits[:, j] == 1, 1, wait + 1).astype(np.uint8)
            stay[:, j] = wait
        mine["stay"] = stay.ravel()
    return mine["stay"]


def sampled_steps(octave: int) -> np.ndarray:
    """Sampled steps of a length class, ascending: steps below SAMPLES << octave
    whose hash is among the lowest 1 / 2**octave."""
    mine = kept("walks")
    if octave not in mine:
        steps = np.arange(SAMPLES << octave, dtype=np.int64)
        mine[octave] = steps[(_mix(steps + SEED) >> np.uint64(11)) < np.uint64((1 << 53) >> octave)]
    return mine[octave]


def octave_of(steps: int) -> int:
    octave = 0
    while SAMPLES << octave < steps:
        octave += 1
    return octave


def walks(codes: list[np.ndarray]) -> list[np.ndarray]:
    """First step on each character of each text, with the total as last value.
    All texts walk side by side; character i of all of them lies together."""
    stay = _stay_table()
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # texts longer than i
    at = np.concatenate(([0], np.cumsum(active)))
    row = np.empty(int(at[-1]), np.int32)
    for k, d in enumerate(order):
        c = codes[d]
        row[at[:len(c)] + k] = ((c * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) * PERIOD
    met = np.empty_like(row)
    step = np.zeros(len(codes), np.int32)
    work = np.empty(len(codes), np.int32)
    for a, lo in zip(active.tolist(), at.tolist()):
        s, w = step[:a], work[:a]
        met[lo:lo + a] = s
        np.bitwise_and(s, PERIOD - 1, out=w)
        w += row[lo:lo + a]
        s += stay.take(w)
    out: list = [None] * len(codes)
    for k, d in enumerate(order):
        out[d] = np.append(met[at[:lengths[d]] + k], step[k])
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: ``octave.steps.bits`` in hexadecimal."""
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    out = []
    for c, met in zip(codes, walks(codes)):
        total = int(met[-1])
        octave = octave_of(total)
        steps = sampled_steps(octave)
        steps = steps[:np.searchsorted(steps, total)]
        symbols = c[np.searchsorted(met[:-1], steps, side="right") - 1].astype(np.uint64)
        bits = (_mix(symbols * np.uint64(0x100000001B3) + steps.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        out.append(f"{octave:x}.{total:x}.{np.packbits(bits).tobytes().hex()}")
    return out


def _bits(fingerprint: str, octave: int) -> np.ndarray:
    """Bits at the sampled steps of ``octave`` (its own or a longer class)."""
    own, total, packed = fingerprint.split(".")
    own, total = int(own, 16), int(total, 16)
    steps = sampled_steps(own)
    steps = steps[:np.searchsorted(steps, total)]
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(packed), np.uint8))[:len(steps)]
    return bits if own == octave else bits[np.isin(steps, sampled_steps(octave), assume_unique=True)]


def likeness(a: str, b: str) -> float:
    """1 - 2 * Hamming share over the steps that either text has; 0 at least."""
    if a == b:
        return 1.0
    octave = max(int(a.split(".")[0], 16), int(b.split(".")[0], 16))
    x, y = _bits(a, octave), _bits(b, octave)
    both, either = min(len(x), len(y)), max(len(x), len(y))
    if not both:
        return 0.0
    differ = int(np.count_nonzero(x[:both] != y[:both]))
    return max(0.0, (both - 2 * differ) / either)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of the next text."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text), sorted, in one shuffle of the texts.

    Buckets are ranges of doc_id that begin at ids of the table. The rows of a
    range's first id are sent to the range before it too (those of the first
    range to the last), marked ``ahead``: so the document after a range's last
    one is at hand without a look into other tasks."""
    spark = documents(docs).sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(quoted("doc_id").cast("long"), F.lit(lowest)).alias("order"),
                       quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("order")
    first = ids.agg(F.min("order")).first()[0]
    if first is None:
        first = lowest
    cuts = ids.agg(F.percentile_approx("order", F.lit([i / parts for i in range(1, parts)]), F.lit(10 * parts))).first()[0] if parts > 1 else []
    starts = np.unique(np.array([first, *(cuts or [])], np.int64))

    def deal(batches):
        for batch in batches:
            order = batch.column("order").to_numpy()
            bucket = np.searchsorted(starts, order, side="right") - 1
            ahead = np.flatnonzero(starts[np.maximum(bucket, 0)] == order)
            pick = np.concatenate((np.arange(len(order)), ahead))
            where = np.concatenate((bucket, (bucket[ahead] - 1) % len(starts)))
            late = np.arange(len(pick)) >= len(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int64()), pa.array(late), batch.column("doc_id").take(pa.array(pick)),
                 batch.column("text").take(pa.array(pick))], names=["bucket", "ahead", "doc_id", "text"])

    dealt = rows.mapInArrow(lean(deal), "bucket long, ahead boolean, doc_id long, text string")
    return dealt.repartitionByRange(parts, "bucket").sortWithinPartitions(
        "bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def _triples(batches):
    """(doc_id, text, next text) of the rows of ``in_order``."""
    held = None  # bucket, doc_id, text of the last document
    for batch in batches:
        for bucket, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
            if held and held[0] == bucket:
                yield held[1], held[2], text
                held = None
            if not ahead:
                held = (bucket, doc_id, text)


FIELDS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _describe(batches):
    def rows(part):
        texts: dict[str, int] = {}
        ids = [[texts.setdefault(t, len(texts)) for t in (text, edited(text, after), after)] for _, text, after in part]
        prints = fingerprints(list(texts))
        words = list(texts)
        cols: list[list] = [[] for _ in range(7)]
        for (doc_id, text, _), (own, changed, after) in zip(part, ids):
            for col, v in zip(cols, (doc_id, len(text), hashlib.sha256(words[changed].encode()).hexdigest(), prints[own],
                                     prints[changed], likeness(prints[own], prints[changed]),
                                     likeness(prints[own], prints[after]))):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=[f.split()[0] for f in FIELDS.split(", ")])

    part, size = [], 0
    for triple in _triples(batches):
        part.append(triple)
        size += len(triple[1]) + 1
        if size >= SLICE_CHARS:
            yield rows(part)
            part, size = [], 0
    if part:
        yield rows(part)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Contract rows of the fingerprint query."""
    return in_order(docs).mapInArrow(lean(_describe), FIELDS)


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text."""
    def describe(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                prints = fingerprints(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(prints)], names=["key", "fingerprint"])

    rows = documents(docs).select(quoted(key).alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(lean(describe), f"key {rows.schema['key'].dataType.simpleString()}, fingerprint string")


def bands_for(prints: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, bands) of a slice: enough bits for small buckets, enough bands for the
    recall of a pair at the threshold wherever its edits lie. Such a pair differs
    in (1 - least) / 2 of its bits, and its slice leaves out the last bits up to a
    ``SLICE``-th part at most; at worst all that differ lie in the slice."""
    bits = min(32, max(6, round(math.log2(max(prints, 2) / BUCKET))))
    same = 1 - min((1 - least) / 2 * SLICE + SHARE_SLACK, 0.5)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same ** bits))


def slices(total: int, least: float) -> list[int]:
    """Slices that a walk of so many steps has bands in. They reach over steps that
    the walk has; the last slice of a walk is one of every walk that is longer by
    1 / least at most, so each pair at the threshold shares a slice that holds
    nearly all of the shorter walk."""
    out, m = [], 0
    while SLICE ** m <= total:
        if SLICE ** (m + 1) > total * max(least - RATIO_SLACK, 0.01):
            out.append(m)
        m += 1
    return out


def bands(fingerprint: str, bits: int, count: int, least: float) -> list[int]:
    """Band hashes in each slice of the fingerprint: ``count`` times ``bits`` bits
    drawn over the whole slice, of the length class of the slice's longest walk."""
    total = int(fingerprint.split(".")[1], 16)
    out = []
    for m in slices(total, least):
        octave = octave_of(math.ceil(SLICE ** (m + 1) / max(least - RATIO_SLACK, 0.01)))
        reach = max(1, int(np.searchsorted(sampled_steps(octave), SLICE ** m)))
        picks = np.random.default_rng(SEED + m).integers(0, reach, (count, bits))
        values = _bits(fingerprint, octave)[picks].astype(np.int64) @ (np.int64(1) << np.arange(bits))
        out += (_mix((values * 65536 + np.arange(count)) * 256 + m) >> np.uint64(1)).astype(np.int64).tolist()
    return out


def all_likeness(prints: list[str]) -> np.ndarray:
    """``likeness`` of every pair of different fingerprints."""
    own = np.array([int(p.split(".")[0], 16) for p in prints])
    out = np.zeros((len(prints), len(prints)))
    for octave in np.unique(own):
        pick = np.flatnonzero(own <= octave)
        bits = [_bits(prints[k], int(octave)) for k in pick]
        size = np.array([len(b) for b in bits])
        signs = np.zeros((len(pick), int(size.max(initial=0))), np.float32)
        for k, b in enumerate(bits):
            signs[k, :len(b)] = 1 - 2 * b.astype(np.float32)
        # places that only one has are 0: the product is those alike less those that differ
        found = np.maximum(signs @ signs.T, 0) / np.maximum(np.maximum.outer(size, size), 1)
        here = np.maximum.outer(own[pick], own[pick]) == octave
        at = np.ix_(pick, pick)
        out[at] = np.where(here, found, out[at])
    return out


def _verify(least: float):
    """(a, b): links of the fingerprints of each work unit to the smallest one that
    verified pairs of the unit lead to."""
    def verify(batches):
        for unit in blocks.runs(batches, ["band"]):
            prints, own = unit.column("fingerprint").to_pylist(), unit.column("own").to_numpy()
            order = sorted(range(len(prints)), key=prints.__getitem__)
            prints, own = [prints[k] for k in order], own[order]
            i, j = unit.column("block_i")[0].as_py(), unit.column("block_j")[0].as_py()
            close = blocks.to_compare(own, i, j)
            if not close.any():
                continue
            close &= all_likeness(prints) >= least
            close |= close.T
            head = blocks.heads(close)
            linked = np.flatnonzero(head != np.arange(len(head)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array([prints[k] for k in linked]), pa.array([prints[k] for k in head[linked]])],
                                                 names=["a", "b"])
    return verify


def near_groups(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(key, group) of (key, fingerprint) rows: the smallest key that verified
    links lead to. Equal fingerprints are one node, whatever their number; in a
    bucket every pair of fingerprints is verified, in blocks, so a bucket of any
    size is many units of work, and a unit returns star links."""
    @F.pandas_udf("array<bigint>")
    def banded(s: pd.Series) -> pd.Series:
        return s.map(lambda p: bands(p, bits, count, least))

    nodes = saved(prints.groupBy("fingerprint").agg(F.min("key").alias("node")), "fingerprint-nodes")
    bits, count = bands_for(nodes.count(), least)
    named = saved(nodes.select("fingerprint", banded("fingerprint").alias("bands")), "fingerprint-bands")
    rows = named.select("fingerprint", F.explode(F.array_distinct("bands")).alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    rows = rows.join(shared, "band")  # buckets of one fingerprint stay behind
    found = blocks.units(blocks.in_blocks(rows, ["band"], "fingerprint"), ["band"]).mapInArrow(
        lean(_verify(least)), "a string, b string")
    found = components(saved(found.distinct(), "fingerprint-links"))
    grouped = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), nodes["node"].alias("first"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("group"))
    return (prints.join(grouped.select("fingerprint", "component"), "fingerprint")
            .join(smallest, "component").select("key", "group"))
