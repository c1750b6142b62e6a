"""N-gram Jaccard self-join of documents by MinHash banding.

1. Every whole text gives its set of hashed word n-grams and, from it, MinHash
   band hashes; number and length of bands follow from the wanted recall at the
   threshold.
2. Band hashes are shuffled; each bucket links its members to its smallest one,
   and components of these links are the candidate groups. Equal texts are one
   node, whatever their number.
3. Candidate groups are compared in blocks on the full n-gram sets; a unit of
   work returns link counts and star links, never all pairs.

A word is ``[^\\x20\\x09-\\x0D]+``; a text of fewer than n words has one n-gram,
all its words; a text without words has none and links with nothing. Hashes of
n-grams have 64 bits.

Defined results: a null text counts as empty; repeated rows and equal texts are
copies of each other and link; ties cannot change a result (components are named
by their smallest doc_id); a null doc_id is larger than any other and never names
a component that holds a document with one; an empty table gives an empty
result; other columns are kept by ``deduplicated`` and never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.components import components
from parlance.llm.support import documents, kept, lean, quoted, saved, text_or_empty

N, THRESHOLD = 5, 0.8
#: Hashes of a band, and the recall wanted at the threshold itself.
BAND_ROWS, RECALL = 7, 0.9999
SEED = 7001
#: n-grams that one pass of a comparison looks at.
PASS_GRAMS = 1_000_000
#: Bytes of text hashed at once (a longer text goes alone).
SLICE_BYTES = 2 << 20


def band_count(rows: int = BAND_ROWS, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` hashes that find a pair at the threshold with
    probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, and a random number per byte."""
    mine = kept("hashes")
    have = mine.get("powers")
    if have is None or len(have[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        bytes_ = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        have = mine["powers"] = (*both, bytes_)
    return have


def ngram_hashes(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Hashes of all n-grams of each text, in order, with repeats."""
    data = b"\n".join(texts) + b"\n"
    b = np.frombuffer(data, np.uint8)
    power, inverse, byte = _powers(len(b) + 1)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(byte[b] * power[:len(b)], out=total[1:])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    gram = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        gram = gram * step + word[k:len(word) - n + 1 + k] if len(gram) else gram
    gram = mix(gram)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            out.append(gram[a:z - n + 1])
        elif z > a:
            whole = np.zeros(1, np.uint64)
            for w in word[a:z]:
                whole = whole * step + w
            out.append(mix(whole + np.uint64(z - a)))
        else:
            out.append(gram[:0])
    return out


def band_hashes(grams: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """(texts, bands) hashes; texts without n-grams get zeros."""
    rng = np.random.default_rng(SEED + 1)
    factors = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(grams), bands), np.uint64)
    filled = [i for i, g in enumerate(grams) if len(g)]
    if not filled:
        return out
    flat = (np.concatenate([grams[i] for i in filled]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(grams[i]) for i in filled[:-1]])
    acc = np.zeros(len(filled), np.uint64)
    for k, factor in enumerate(factors):
        least = np.minimum.reduceat(flat * factor, starts)
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(1)
        if k % rows == rows - 1:
            out[filled, k // rows] = mix(acc + np.uint64(k))
            acc = np.zeros(len(filled), np.uint64)
    return out


def slices(column: pa.Array):
    """(offset, texts as bytes) of an Arrow string column, some MB at a time."""
    values = column.cast(pa.large_binary())
    held, size, lo = [], 0, 0
    for i, v in enumerate(values):
        held.append(v.as_py() or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield lo, held
            held, size, lo = [], 0, i + 1
    if held:
        yield lo, held


def sketches(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, class, node, bands) of every row: class is the text's digest, node
    a 64-bit hash of it; a text without words has no bands."""
    def sketch(batches):
        for batch in batches:
            for lo, texts in slices(batch.column("text")):
                grams = ngram_hashes(texts, n)
                hashes = band_hashes(grams, rows, bands).view(np.int64)
                some = batch.slice(lo, len(texts))
                ends = np.cumsum([0] + [bands if len(g) else 0 for g in grams]).astype(np.int32)
                keep = np.array([len(g) > 0 for g in grams], bool)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("class"), some.column("node"),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[keep].ravel()))],
                    names=["doc_id", "class", "node", "bands"])

    text = text_or_empty()
    rows_ = documents(docs).select(quoted("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("class"),
                        F.xxhash64(text).alias("node"), text.alias("text"))
    return saved(rows_.mapInArrow(lean(sketch), "doc_id long, class string, node long, bands array<bigint>"), "sketches")


def candidate_groups(sketched: DataFrame) -> DataFrame:
    """(node, group) of the texts that share a band with another text."""
    banded = sketched.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    links = banded.join(buckets.where("head < last").select("band", "head"), "band").where("node <> head")
    found = components(links.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())
    return found.select("node", F.col("component").alias("group"))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, in passes over parts of the hashes so
    that memory does not grow with the texts."""
    common = np.zeros((len(sets), len(sets)), np.float32)
    passes = 1 + sum(map(len, sets)) // PASS_GRAMS
    width = max(1, (4 << 20) // len(sets))
    for k in range(passes):
        some = sets if passes == 1 else [s[s % np.uint64(passes) == k] for s in sets]
        which = np.repeat(np.arange(len(some)), [len(s) for s in some])
        _, column, counts = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        rank = np.cumsum(counts > 1) - 1
        which, column = which[shared], rank[column[shared]]
        order = np.argsort(column, kind="stable")
        which, column = which[order], column[order]
        for lo in range(0, int((counts > 1).sum()), width):
            a, z = np.searchsorted(column, (lo, lo + width))
            part = np.zeros((len(sets), width), np.float32)
            part[which[a:z], column[a:z] - lo] = 1
            common += part @ part.T
    return common.astype(np.int64)


def _verify(n: int, threshold: float):
    def verify(batches):
        for unit in blocks.runs(batches, ["group"]):
            classes = unit.column("class").to_pylist()
            seen: dict[str, int] = {}
            for k, c in enumerate(classes):  # equal rows of a class are one
                seen.setdefault(c, k)
            pick = sorted(seen.values(), key=classes.__getitem__)
            classes = [classes[k] for k in pick]
            if len(pick) < 2:
                continue
            texts = unit.column("text").cast(pa.large_binary()).to_pylist()
            own = unit.column("own").to_numpy()[pick]
            copies = unit.column("copies").to_numpy()[pick].astype(np.int64)
            sets = [np.unique(ngram_hashes([texts[k]], n)[0]) for k in pick]
            sizes = np.array([len(s) for s in sets], np.int64)
            common = _common(sets)
            either = sizes[:, None] + sizes[None, :] - common
            close = (common >= threshold * either - 1e-9) & (either > 0)
            i, j = unit.column("block_i")[0].as_py(), unit.column("block_j")[0].as_py()
            close &= blocks.to_compare(own, i, j)
            close |= close.T
            linked = np.flatnonzero(close.any(axis=1))
            if len(linked):
                head = blocks.heads(close)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([classes[k] for k in linked]), pa.array((close[linked] @ copies).astype(np.int64)),
                     pa.array([classes[head[k]] for k in linked])], names=["node", "links", "head"])
    return verify


def joined(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL,
           band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, class, has_words, n_links, component_id) of every row: links are
    other rows whose n-gram sets reach the threshold, copies included."""
    sketched = sketches(docs, n, band_rows, band_count(band_rows, threshold, recall))
    worded = sketched.where(F.size("bands") > 0)
    classes = saved(worded.groupBy("class", "node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    groups = candidate_groups(worded)
    members = classes.join(groups, "node").select("group", "class", "first", "copies")
    text = text_or_empty()
    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    # One row of each class: that of its smallest doc_id (repeats of it are sorted out later).
    texts = members.join(rows, (rows["digest"] == members["class"]) & rows["doc_id"].eqNullSafe(members["first"])).select(
        "group", "class", "copies", "text")
    work = blocks.units(blocks.in_blocks(texts, ["group"], "class"), ["group"])
    found = saved(work.mapInArrow(lean(_verify(n, threshold)), "node string, links long, head string"), "verified")
    named = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    of_class = (classes.select("class", "first", "copies")
                .join(blocks.summed(found).withColumnRenamed("node", "class"), "class", "left")
                .join(named.withColumnRenamed("node", "class"), "class", "left")
                .withColumn("component", F.coalesce("component", "class")))
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = of_class.join(smallest, "component").select(
        "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "component")
    out = sketched.select("doc_id", "class", (F.size("bands") > 0).alias("has_words")).join(of_class, "class", "left")
    return out.select("doc_id", "class", "has_words", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.when(F.col("has_words"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_links, component_id, kept."""
    return joined(docs).select("doc_id", "n_links", "component_id",
                               F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component (that of its smallest doc_id); rows
    without words all stay."""
    found = joined(docs, **options)
    head = found.where("has_words").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")).alias("head"))
    head = head.select(F.col("head.doc_id").alias("head_id"), F.col("head.class").alias("head_class"))
    text = text_or_empty()
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), quoted("doc_id").cast("long").alias("id"),
                       F.md5(text.cast("binary")).alias("digest"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("wordless"))
    chosen = rows.join(head, (F.col("digest") == F.col("head_class")) & F.col("id").eqNullSafe(F.col("head_id")), "left")
    chosen = chosen.where(F.col("head_class").isNotNull() | F.col("wordless"))
    # Equal rows of the chosen document are interchangeable: the first one stays.
    same = Window.partitionBy("digest", "id").orderBy(F.lit(0))
    kept = chosen.withColumn("number", F.row_number().over(same)).where((F.col("number") == 1) | F.col("wordless"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
