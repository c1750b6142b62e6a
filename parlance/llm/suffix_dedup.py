"""Removal of repeated byte strings by bucket-pointer refinement.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts at
another place too, in any document. Suffixes are kept in buckets of equal
q-grams, and buckets are refined by the bucket identifiers found at later
offsets, until a bucket's members agree on ``LENGTH`` bytes.

Only suffixes that start at anchors are shuffled: the places where the hash of
the next ``GRAM`` bytes is the smallest of ``SPAN`` places in a row. Any string
of LENGTH = GRAM + SPAN - 1 bytes holds an anchor, and equal strings hold it at
the same place, so no repeat is missed.

1. Every anchor gives its initial bucket (hash of its q-gram) and an identifier
   of all bytes that a string through it can touch (its reach). A reach that
   occurs twice is removed as a whole; a bucket of one member is done.
2. Buckets that hold different reaches are refined, one copy of each reach, in
   rounds. Equal strings hold the anchor at the same offset, so a bucket stands for
   a range of offsets at first: all of them. A bucket whose members agree on every
   byte that the range touches is done. Else the range is halved: members are
   sorted on the identifier that the round before gave them and on the bytes that
   the strings of the half share, which gives the identifiers of the next round,
   until the range is one offset, a string of LENGTH bytes. Members left alone go.
   Bytes are compared before a string counts as repeated.
   A bucket of more than ``LARGE`` reaches is refined by the whole cluster
   instead: its strings are counted by two hashes with partial sums.
3. The removed intervals of each text are joined to the documents.

Equal texts are one text to these steps; a text of LENGTH bytes or more that
occurs twice is removed whole.

Defined results: a null text counts as empty; matches never cross documents;
texts shorter than LENGTH bytes stay; a very long text is read whole (its anchors
are rows of their own, its marks and intervals lie in one row each); repeated rows are copies of each other;
an empty table gives an empty result; other columns are kept by ``cleaned`` and
never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.jaccard_join import _powers, mix
from parlance.llm.support import discard, documents, fresh, lean, quoted, saved, text_or_empty

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
#: Strings whose bytes are compared in one go.
COMPARED = 1 << 16
#: Reaches of a bucket that one task refines, and reaches refined in one go.
LARGE, AT_ONCE = 16384, 16384


def _prefix(b: np.ndarray) -> np.ndarray:
    power, _, byte = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(byte[b] * power[:len(b)], out=total[1:])
    return total


def _hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes between places; equal bytes give equal hashes."""
    inverse = _powers(len(total))[1]
    return mix((total[end] - total[begin]) * inverse[begin])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, q-gram hashes, reach hashes) of a text of LENGTH bytes or more."""
    b = np.frombuffer(data, np.uint8)
    total, n = _prefix(b), len(b)
    grams = mix((total[GRAM:] - total[:-GRAM]) * _powers(n + 1)[1][:n - GRAM + 1])
    least = _sliding(grams, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    # A place is an anchor if it holds the minimum of some span around it.
    at = np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), SPAN, np.maximum) == grams)
    lo, hi = np.maximum(at - SPAN + 1, 0), np.minimum(at + LENGTH, n)
    reach = _hashes(total, lo, hi) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - at).astype(np.uint64)
    return at, grams[at], mix(reach)


def _emit_anchors(batches):
    seen: set = set()  # copies in this partition give their anchors once
    for batch in batches:
        out: list[list] = [[], [], [], []]
        held = 0
        for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").cast(pa.large_binary())):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            text = text.as_py()
            if len(text) < LENGTH:
                continue
            at, grams, reach = anchors(text)
            for col, x in zip(out, (grams.view(np.int64), reach.view(np.int64), np.full(len(at), k1, np.int64), (k2 << 32) + at.astype(np.int64))):
                col.append(x)
            held += len(at)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["g", "c", "k1", "place"])
                out, held = [[], [], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["g", "c", "k1", "place"])


def _emit_reaches(batches):
    """(g, k1, k2, lo, anchor, bytes) of the marked anchors of each text: lo is the
    reach's place in the text, anchor the anchor's place in the reach."""
    seen: set = set()
    for batch in batches:
        rows = []
        for k1, k2, text, marks in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "marks"))):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            data = text.encode()
            for m in marks:
                at = m["code"] >> 3
                lo = max(at - SPAN + 1, 0)
                rows.append((m["g"], k1, k2, lo, at - lo, data[lo:at + LENGTH]))
        for a in range(0, len(rows), 10_000):
            cols = list(zip(*rows[a:a + 10_000]))
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "k1", "k2", "lo", "anchor", "reach"])


def _by_bytes(data: np.ndarray, begin: np.ndarray, width: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``group`` numbers, with members whose ``width`` bytes differ told apart. Members
    of a group have one width."""
    order = np.argsort(group, kind="stable")
    follows = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    after, before = order[follows], order[follows - 1]
    differ = np.zeros(len(after), bool)
    for w in np.unique(width[after]):
        strings = np.lib.stride_tricks.sliding_window_view(data, int(w))
        pairs = np.flatnonzero(width[after] == w)
        for a in range(0, len(pairs), COMPARED):
            here = pairs[a:a + COMPARED]
            differ[here] = (strings[begin[after[here]]] != strings[begin[before[here]]]).any(axis=1)
    if differ.any():  # different bytes met in a hash
        group, names = group.copy(), {}
        for k in np.flatnonzero(np.isin(group, group[after[differ]])):
            content = (int(group[k]), data[begin[k]:begin[k] + width[k]].tobytes())
            group[k] = -1 - names.setdefault(content, len(names))
        _, group = np.unique(group, return_inverse=True)
    return group


def refined(bucket: np.ndarray, place: np.ndarray, anchor: np.ndarray,
            reaches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) in its reach of the bytes covered by a string of LENGTH
    bytes through the anchor that another row of the bucket has too. ``place``
    names a row's anchor in its text (rows with equal ones count once), ``anchor``
    is the anchor's place in the reach."""
    lengths = np.array([len(r) for r in reaches], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    data = np.frombuffer(b"".join(reaches), np.uint8)
    total = _prefix(data)
    at = base + anchor
    # Bytes before the anchor at which a row has a string.
    least, most = np.maximum(at + LENGTH - base - lengths, 0), np.minimum(anchor, SPAN - 1)
    _, row = np.unique(place, return_index=True)
    pointer, low, high = bucket[row].astype(np.int64), np.zeros(len(row), np.int64), np.full(len(row), SPAN - 1)
    done = np.zeros(len(row), bool)
    found: list[tuple] = []
    while len(row):
        # Members that agree on all bytes of the range; one of them stays to be met by the others.
        full = np.flatnonzero((least[row] <= low) & (high <= most[row]))
        begin, width = at[row[full]] - high[full], LENGTH + high[full] - low[full]
        key = _hashes(total, begin, begin + width) + mix(pointer[full].astype(np.uint64))
        _, group = np.unique(key, return_inverse=True)
        group = _by_bytes(data, begin, width, group)
        _, first, group, times = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        again = times[group] > 1
        new = full[again & ~done[full]]
        found.append((row[new], anchor[row[new]] - high[new], anchor[row[new]] - low[new] + LENGTH))
        stays = np.ones(len(row), bool)
        stays[full[again]] = False
        stays[full[first]] = True
        done[full[again]] = True
        stays &= high > low
        row, pointer, low, high, done = row[stays], pointer[stays], low[stays], high[stays], done[stays]
        # Halves of the ranges, refined by the bytes that all strings of a half share.
        middle = (low + high) // 2
        row, done = np.tile(row, 2), np.tile(done, 2)
        pointer = np.concatenate((2 * pointer, 2 * pointer + 1))
        low, high = np.concatenate((low, middle + 1)), np.concatenate((middle, high))
        alive = (least[row] <= high) & (low <= most[row])
        row, pointer, low, high, done = row[alive], pointer[alive], low[alive], high[alive], done[alive]
        key = _hashes(total, at[row] - low, at[row] - high + LENGTH) + mix(pointer.astype(np.uint64))
        _, pointer, times = np.unique(key, return_inverse=True, return_counts=True)
        alive = (times > 1)[pointer] & (np.bincount(pointer, ~done, len(times)) > 0)[pointer]
        row, pointer, low, high, done = row[alive], pointer[alive], low[alive], high[alive], done[alive]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _refine(batches):
    """(k1, k2, a, b): removed intervals of the texts, from rows sorted by g."""
    def work(rows):
        _, bucket = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        names: dict = {}
        owner = np.array([names.setdefault((r[1], r[2]), len(names)) for r in rows], np.int64)
        lo, anchor = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
        row, begin, end = refined(bucket, (owner << 32) + lo + anchor, anchor, [r[5] for r in rows])
        if not len(row):
            return None
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (begin[1:] > end[:-1]))))
        who = row[cut]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][1] for k in who], pa.int64()), pa.array([rows[k][2] for k in who], pa.int64()),
             pa.array(lo[who] + begin[cut], pa.int64()), pa.array(lo[who] + end[np.append(cut[1:], len(row)) - 1], pa.int64())],
            names=["k1", "k2", "a", "b"])

    rows: list = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("g", "k1", "k2", "lo", "anchor", "reach"))):
            if len(rows) >= AT_ONCE and rows[-1][0] != r[0]:
                if (found := work(rows)) is not None:
                    yield found
                rows = []
            rows.append(r)
    if rows and (found := work(rows)) is not None:
        yield found


def _strings(batches):
    """(w1, w2, k1, k2, start) of every string of LENGTH bytes in large buckets' reaches."""
    for batch in batches:
        for k1, k2, lo, reach in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "reach"))):
            n = len(reach) - LENGTH + 1
            begin = np.arange(n)
            b = np.frombuffer(reach, np.uint8)
            w1 = _hashes(_prefix(b), begin, begin + LENGTH)
            w2 = _hashes(_prefix(b ^ np.uint8(0x5A)), begin, begin + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(begin + lo)],
                names=["w1", "w2", "k1", "k2", "start"])


def _by_cluster(reaches: DataFrame) -> DataFrame:
    """What ``_refine`` does, for buckets of any size."""
    rows = reaches.mapInArrow(lean(_strings), "w1 long, w2 long, k1 long, k2 long, start long")
    rows = rows.withColumn("code", F.xxhash64("k1", "k2", "start"))
    twice = rows.groupBy("w1", "w2").agg(F.min("code").alias("one"), F.max("code").alias("other")).where("one <> other")
    return rows.join(twice.select("w1", "w2"), ["w1", "w2"]).select(
        "k1", "k2", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))


def _merged(found: DataFrame) -> DataFrame:
    """(k1, k2, spans): maximal intervals of each text, in order, from (k1, k2, a, b)."""
    order = Window.partitionBy("k1", "k2").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("apart", F.when(F.col("a") <= reached, 0).otherwise(1))
    islands = apart.withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("k1", "k2", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def keyed(text):
    """The two hashes that name a text (64 and 31 bits)."""
    return F.xxhash64(text).alias("k1"), F.shiftright(F.crc32(text.cast("binary")), 1).alias("k2")


def removed_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, spans) of the texts that lose bytes: maximal removed intervals of
    the UTF-8 bytes, in order; [-1, -1) first where the whole text goes."""
    t = text_or_empty(text)
    texts = documents(docs).select(*keyed(t), t.alias("text"))
    emitted = texts.mapInArrow(lean(_emit_anchors), "g long, c long, k1 long, place long")
    # One place of a reach is sent for all of them: a text may hold a reach at many.
    here = F.xxhash64("k1", "place")
    reaches = emitted.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("holder"))
    live = reaches.groupBy("g").agg(F.sum("n").alias("members"), F.count(F.lit(1)).alias("reaches")).where("members > 1")
    # Left out: buckets of one member.
    live = saved(reaches.join(live.select("g", "reaches"), "g"), "live-buckets", release=True)
    any_large = bool(live.where(F.col("reaches") > LARGE).limit(1).count())
    sent = (F.col("reaches") > 1) & (here == F.col("holder"))
    code = (F.shiftleft(F.col("place").bitwiseAND((1 << 32) - 1), 3) + F.when(F.col("n") > 1, 1).otherwise(0)
            + F.when(sent, 2).otherwise(0) + F.when(F.col("reaches") > LARGE, 4).otherwise(0))
    marks = (emitted.join(live, ["g", "c"])
             .select("k1", F.shiftrightunsigned("place", 32).alias("k2"), F.struct(code.alias("code"), "g").alias("mark"))
             .groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks")))  # copies give the same
    marks = saved(marks, "marks", release=True)
    discard(live)

    def reaches_of(flags: int) -> DataFrame:
        """Reaches of the marks with just these of the flags 2 (sent) and 4 (large bucket)."""
        asked = marks.select("k1", "k2", F.filter("marks", lambda m: m["code"].bitwiseAND(6) == flags).alias("marks"))
        return texts.join(asked.where(F.size("marks") > 0), ["k1", "k2"]).mapInArrow(
            lean(_emit_reaches), "g long, k1 long, k2 long, lo long, anchor long, reach binary")

    spans = reaches_of(2).repartition("g").sortWithinPartitions("g").mapInArrow(lean(_refine), "k1 long, k2 long, a long, b long")
    tables = [saved(spans, "refined", release=True)]
    if any_large:  # after the others, so that their shuffle files are gone
        tables.append(saved(_by_cluster(reaches_of(6)), "refined-large", release=True))
    # Intervals of reaches that occur twice, clipped at the text's end later.
    at = F.shiftright(F.col("m.code"), 3)
    whole = (marks.select("k1", "k2", F.explode(F.filter("marks", lambda m: m["code"].bitwiseAND(1) > 0)).alias("m"))
             .select("k1", "k2", F.greatest(at - SPAN + 1, F.lit(0)).alias("a"), (at + LENGTH).alias("b")))
    copies = (docs.select(*keyed(t), F.octet_length(t).alias("size")).where(F.col("size") >= LENGTH)
              .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
              .select("k1", "k2", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
    found = whole.unionByName(copies)
    for table in tables:
        found = found.unionByName(table)
    out = saved(_merged(found), "spans", release=True)
    for table in (marks, *tables):
        discard(table)
    return out


def cut(data: bytes, spans) -> tuple[list[tuple[int, int]], bytes]:
    """Removed intervals inside a text, and its remaining bytes."""
    spans = [(s["a"], s["b"]) for s in spans or []]
    if spans and spans[0][0] < 0:
        return [(0, len(data))], b""
    spans = [(a, min(b, len(data))) for a, b in spans]
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return spans, b"".join(kept) + data[at:]


def _with_spans(docs: DataFrame, text: str = "text"):
    """Documents (in one struct) with the removed intervals of their texts."""
    t = text_or_empty(text)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("doc"), *keyed(t))
    return rows.join(removed_spans(docs, text), ["k1", "k2"], "left")


def digest_documents(docs: DataFrame) -> DataFrame:
    """Contract rows of the suffix query."""
    def digest(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data = text.encode()
                gone, kept = cut(data, spans)
                for col, v in zip(out, (doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    narrow = docs.select(quoted("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = _with_spans(narrow).select("doc.doc_id", "doc.text", "spans")
    return rows.mapInArrow(lean(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the repeated strings in ``text``. Bytes of a character of
    which a part is removed go with it; a text without repeats is unchanged."""
    @F.udf("string")
    def keep(value, spans):
        return cut((value or "").encode(), spans)[1].decode("utf-8", "ignore")

    name, = fresh(docs, "spans")
    rows = _with_spans(docs, text).withColumnRenamed("spans", name)
    value = F.col("doc").getField(text)
    new = F.when(F.col(name).isNull(), value).otherwise(keep(value.cast("string"), F.col(name)))
    return rows.select(*[new.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns])
