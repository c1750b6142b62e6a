"""Hard negatives, archives and ranked search on awkward rows, against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import anchor_mining, lexical_search, warc_archive

CLASHES = ("score", "n", "unit", "kind", "key", "chunk", "rank", "term", "a.b", "VEC")


def _extra(df):
    """Extra columns with names that the operators use inside, and a dotted one."""
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


# --- hard negatives ---------------------------------------------------------

def _vectors(seed, n, dimension=6, centres=5, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dimension))
    rows = []
    for i in range(n):
        c = int(rng.integers(centres))
        rows.append((i, [float(x) for x in middle[c] + spread * rng.standard_normal(dimension)], int(c % 3)))
    return rows


def _floors(v):
    return [math.floor(256 * x) for x in v]


def _brute_mined(rows, every=50, positives=5, negatives=3):
    live = [(i, l, _floors(v)) for i, v, l in rows
            if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, l, x in live:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (l, x)), (l, x))
    out = []
    for a, (label, x) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, l) for i, l, y in live if i != a and len(y) == len(x))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            good = [(-t, q) for t, q, l in scored if l != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, q, -s, t) for k, (t, q) in enumerate(good[:negatives])]
    return sorted(out)


def _mined(df, every=50):
    found = anchor_mining.mined(anchor_mining.prepared(df), F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def _as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]


@pytest.mark.parametrize("units", [1, 3])
def test_mining_equals_brute_force(spark, monkeypatch, units):
    rows = _vectors(3, 400)
    rows += [(None, rows[0][1], 0), (1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1002, [float("nan")] * 6, 0),
             (1003, [float("inf")] * 6, 0), (1050, rows[7][1], None), (1100, [], 1), (1101, [], 2), (1150, [0.5, -0.5], 0),
             (1151, [0.5, -0.4], 1), (1152, [0.4, -0.5], 0), (1200, [0.0] * 6, 2), (-50, rows[3][1], 1)]
    rows += [rows[0], rows[0], rows[11], rows[11], (100, rows[5][1], 2)]  # repeated rows; a second vector of one id
    rows += [(2000 + i, rows[20][1], rows[20][2]) for i in range(60)]  # a common vector: ties
    rows = _as_float(rows)
    monkeypatch.setattr(anchor_mining, "TREE", 4)
    if units > 1:
        monkeypatch.setattr(anchor_mining, "SMALL_UNIT", len(rows) // units)
    got = _mined(_extra(spark.createDataFrame(rows, VECTORS).repartition(3)))
    want = _brute_mined(rows)
    assert got == want and len(want) > 50


def test_mining_of_large_components_is_exact(spark):
    rng = random.Random(1)
    rows = [(i * 10, [float(rng.randint(-2 ** 20, 2 ** 20)) for _ in range(4)], i % 2) for i in range(60)]  # sums beyond 2^53: not exact in doubles
    assert _mined(spark.createDataFrame(rows, VECTORS)) == _brute_mined(_as_float(rows))


def test_mining_rescores_only_what_may_matter():
    """On near anchors most candidates are never scored again."""
    rng = np.random.default_rng(0)
    x = rng.integers(-200, 200, (2000, 16))
    unit = object.__new__(anchor_mining._Unit)
    wide = x.astype(float)
    found = np.arange(2000), x, wide, np.sqrt((wide ** 2).sum(axis=1)), 200.0
    unit.candidates = lambda *_: found
    tree = anchor_mining._Tree(unit, 16, 0, True)
    a = rng.integers(-200, 200, 16)
    tree.step(a, -1, 0.0, 6)
    b = a + rng.integers(-2, 3, 16)
    ids, scores = tree.step(b, 0, float(np.sqrt(((a - b) ** 2).sum())), 6)
    exact = x @ b
    assert len(ids) < 200
    best = np.argsort(-exact)[:6]
    assert set(best) <= set(ids) and (scores == exact[ids]).all()
    assert (tree.low[1] <= exact).all() and (exact <= tree.high[1]).all()


def test_mining_of_an_empty_table(spark):
    assert _mined(spark.createDataFrame([], VECTORS)) == []


# --- archives ---------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def _pages():
    big = "é" * 1500
    return [(5, "http://a/5", "<p>one</p>"), (3, "http://a/3", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "http://a/1", None), (2, "http://a/2", ""),
            (7, "http://a/ \r\nX-Page-ID: 99", "two\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", big), (10, "u", big + "x"), (11, "w", big),
            (12, "v", "a" * 1024), (13, "v", "b" * 2048), (None, "n", "<p>one</p>"), (None, "n", "only"), (20, "r", "same row"), (20, "r", "same row"),
            (20, "r", "other text"), (21, "ü", "𝔘" * 700)]


def _brute_archive(rows, least=0):
    out, heads = [], {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page, _, html in ordered:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) >= least and data in heads:
            out.append((page, len(data), digest, "revisit", heads[data]))
        else:
            heads[data] = page
            out.append((page, len(data), digest, "response", None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_archive_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc_archive, "CHUNK", 1024)
    monkeypatch.setattr(warc_archive, "ARCHIVE", 2000)
    monkeypatch.setattr(warc_archive, "SMALL_ARCHIVE", 4000)
    rows = _pages()
    manifest = warc_archive.write_archives(_extra(spark.createDataFrame(rows, PAGES).repartition(3)), least)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    read = warc_archive.read_archives(manifest).collect()
    last = [r for r in read if r["last"]]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in last), key=repr)
    assert got == _brute_archive(rows, least)
    # The chunk rows hold the payloads: in order, whole but for the last.
    held = {}
    for r in sorted(read, key=lambda r: (r.record_id, r.chunk)):
        if r.record_type == "response":
            assert r["last"] or len(r.payload) == 1024
            held.setdefault((r.page_id, r.record_id), []).append(r)
    texts = sorted(b"".join(r.payload for r in rs).decode() for rs in held.values())
    if least == 0:
        assert texts == sorted({html or "" for _, _, html in rows})
    for rs in held.values():
        size = 0
        sha = hashlib.sha1()
        for k, r in enumerate(rs):
            size += len(r.payload)
            sha.update(r.payload)
            assert (r.chunk, r.payload_bytes, r.payload_digest) == (k, size, base64.b32encode(sha.digest()).decode())
    # Each record is a gzip member of its own, and what revisits refer to is there.
    ids = {r.record_id for r in last}
    assert len(ids) == len(rows)
    assert {r.refers_to_record for r in last if r.record_type == "revisit"} <= ids
    path = manifest.first().path
    data = gzip.decompress(open(path, "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_archive_of_common_and_long_payloads(spark):
    n = 3 * warc_archive.CHUNK + 17
    rows = [(i, f"u{i}", "common") for i in range(300)] + [(1000, "long", "x" * n), (1001, "long too", "x" * n), (1002, "even", "y" * (2 * warc_archive.CHUNK))]
    got = warc_archive.archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _brute_archive(rows)


def test_archive_of_an_empty_table(spark):
    assert warc_archive.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_a_damaged_payload_is_an_error(spark):
    manifest = warc_archive.write_archives(spark.createDataFrame([(1, "u", "abcdefgh")], PAGES))
    path = manifest.first().path
    text = gzip.decompress(open(path, "rb").read()).replace(b"abcdefgh", b"abcdefgX")
    with open(path, "wb") as f:
        f.write(gzip.compress(text))
    with pytest.raises(Exception, match="digest"):
        warc_archive.read_archives(manifest).collect()


# --- ranked search ----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _terms(text):
    return TERM.findall((text or "").translate(UPPER))


def _brute_search(docs, items, k=50):
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def _searched(docs, items, **kw):
    got = lexical_search.searched(docs, items, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def _corpus(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "naïve", "漢字", "x86", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(None, "w1 w2 w3"), (400, None), (401, ""), (402, " .,;\n"), (403, "W1,w1;w1_w1"), (404, "w3 " * 20000), (3, docs[3][1]), (3, docs[3][1]), (9, "w50 w51")]
    docs += [(500 + i, "w7 w9 rare") for i in range(80)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(100, None), (101, "..."), (102, "unknown words"), (103, "rare w1"), (103, "rare w1"), (103, "É é"), (None, "w2"), (104, "w0 " * 50), (105, "漢字 STRASSE straße A1 a1")]
    return docs, items


@pytest.mark.parametrize("portion", [None, 200])
@pytest.mark.parametrize("k", [50, 3])
def test_search_equals_brute_force(spark, monkeypatch, portion, k):
    docs, items = _corpus()
    if portion:  # many portions, several blocks of items
        monkeypatch.setattr(lexical_search, "ITEMS", 10)
        search = lexical_search._search

        def small(*args):
            work = search(*args)

            def cut(batches):
                yield from work(b.slice(i, 10) for b in batches for i in range(0, b.num_rows, 10))
            return cut
        monkeypatch.setattr(lexical_search, "_search", small)
        monkeypatch.setattr(lexical_search, "POSTINGS", portion)
    d = _extra(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    q = _extra(spark.createDataFrame(items, "item_id long, text string"))
    assert _searched(d, q, k=k) == _brute_search(docs, items, k)


def test_search_stops_making_accumulators():
    """A word that most documents hold makes no accumulators once k documents lead."""
    n = 1000
    portion = object.__new__(lexical_search._Portion)
    rare, common = np.arange(0, 100, dtype=np.int64), np.arange(n, dtype=np.int64)
    portion.doc, portion.gain = np.concatenate([rare, common]), np.concatenate([np.full(100, 900), np.full(n, 10)]).astype(np.int64)
    portion.start, portion.bound, portion.sums = np.array([0, 100, 1100]), np.array([900, 10]), np.zeros(n, np.int64)
    docs, scores = lexical_search.accumulated(portion, np.array([0, 1]), np.zeros(0, np.int64), 50)
    assert sorted(docs) == list(range(100)) and (scores == 910).all() and not portion.sums.any()


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert _searched(d, q) == []
    assert _searched(spark.createDataFrame([(1, "a")], d.schema), spark.createDataFrame([], q.schema)) == []
    assert _searched(spark.createDataFrame([(1, None)], d.schema), q) == []
