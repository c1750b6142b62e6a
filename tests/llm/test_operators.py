"""Edge cases and brute-force checks of the training-data operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import (components, cosine_dedup, edit_embedding, gated_lm, jaccard_join, mixing, packing, sharding,
                          suffix_dedup, token_files, tokens, toxicity)

FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       *[T.StructField(c, T.StringType()) for c in ("key", "class", "node", "size", "spans", "score", "doc", "shard", "K1")]])


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = _words(rng, 80)
    near = base.split()
    near[40] = "changed"
    shared = _words(rng, 70)
    long = _words(rng, 20_000)
    texts = [base, base, " ".join(near), None, "", " \n\t", "one two", "one two", "a" * 700, shared + " x1 " + _words(rng, 30),
             _words(rng, 30) + " " + shared, long, "é" * 300, "idiot clown", "Ünïcode ﬁ 𝔘 ‍ text", _words(rng, 60)]
    out = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(None, "no id", None, None, None), (None, None, None, None, None), out[0], out[0], (6, "same id, other text", "en", "s0", 20)]
    return [r + ("x",) * 9 for r in out]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FIELDS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, None, None), (None, 1, 1), (39, 0, 1), (45, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def _key(r):
    return tuple((x is not None, x) for x in r)


def test_empty_tables(spark, empty, labels):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (edit_embedding.fingerprint_documents(empty), toxicity.score_documents(empty, labels), gated_lm.score_documents(empty),
               cosine_dedup.link_vectors(vectors), suffix_dedup.digest_documents(empty), packing.pack_documents(empty),
               mixing.mix_documents(empty), token_files.token_documents(empty), sharding.shard_documents(empty),
               jaccard_join.join_documents(empty), jaccard_join.deduplicated(empty), suffix_dedup.cleaned(empty), mixing.mixed_documents(empty)):
        assert df.count() == 0


# -- fingerprints -------------------------------------------------------------

def test_fingerprints(docs, rows):
    got = edit_embedding.fingerprint_documents(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = sorted((r[0] is not None, r[0] or 0, len(t), hashlib.sha256(edit_embedding.edited(t, n).encode()).hexdigest())
                  for r, t, n in zip(order, texts, texts[1:] + texts[:1]))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want
    prints = dict(zip(texts, edit_embedding.fingerprints(texts)))
    assert {r.fingerprint for r in got} == set(prints.values())
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = next(r for r in got if r.n_chars > 50_000)
    assert long.near_edited > 0.65 and long.near_next < 0.3
    assert all(r.near_edited == edit_embedding.likeness(r.fingerprint, r.edited_fingerprint) for r in got)


def test_walks_one_by_one():
    stay = edit_embedding._stay_table().reshape(edit_embedding.CLASSES, edit_embedding.PERIOD)
    texts = ["", "a", "hello world", "é" * 40, _words(random.Random(1), 3000)]
    codes = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    for c, met in zip(codes, edit_embedding.walks(codes)):
        step, want = 0, []
        for x in c.tolist():
            want.append(step)
            step += int(stay[((x * 2654435761) & 0xFFFFFFFF) >> 24, step % edit_embedding.PERIOD])
        assert met.tolist() == want + [step]


def test_fingerprint_groups(spark):
    rng = random.Random(3)
    base = _words(rng, 600)
    near = base[:2000] + "zz" + base[2000:]
    rows = [(1, base), (2, base), (3, near), (4, _words(rng, 600)), (5, ""), (6, None)]
    prints = edit_embedding.with_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.key: r.group for r in edit_embedding.near_groups(prints, 0.5).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


# -- toxicity -----------------------------------------------------------------

def _brute_groups(likeness, least):
    """Smallest number that links of all pairs lead to, by number."""
    group = list(range(len(likeness)))
    pairs = [(a, b) for a, b in np.argwhere(likeness >= least).tolist() if a < b]
    while any(group[a] != group[b] for a, b in pairs):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_groups_in_a_family_of_templates(spark, monkeypatch):
    monkeypatch.setattr(edit_embedding.blocks.in_blocks, "__defaults__", (128,))
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(rng.choices(letters, k=900))

    def changed(text, share):
        return "".join(rng.choice(letters) if rng.random() < share else c for c in text)

    texts = []
    for _ in range(1000):
        own = changed(base, 0.06)
        texts += [own, changed(own, 0.003)]
    prints = list(enumerate(edit_embedding.fingerprints(texts)))
    both = edit_embedding.all_likeness([p for _, p in prints])
    assert all(abs(both[a, b] - edit_embedding.likeness(x, y)) < 1e-6 for a, x in prints[:20] for b, y in prints[:100] if a != b)
    want = _brute_groups(both, 0.8)
    assert len(set(want)) > 500
    got = edit_embedding.near_groups(spark.createDataFrame(prints, "key long, fingerprint string"), 0.8)
    assert {r.key: r.group for r in got.collect()} == dict(enumerate(want))


def test_bands_find_pairs_wherever_their_edits_lie():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    least, pairs, missed = 0.8, 0, 0
    for k in range(200):
        text = rng.choices(letters, k=rng.choice((300, 500, 670, 1000, 1340)))
        size = int(len(text) * rng.uniform(0.12, 0.2))
        lo = (0, (len(text) - size) // 2, len(text) - size)[k % 3]
        near = text[:lo] + rng.choices(letters, k=size) + text[lo + size:]
        a, b = edit_embedding.fingerprints(["".join(text), "".join(near)])
        if not least <= edit_embedding.likeness(a, b) < 0.9:
            continue
        pairs += 1
        for prints in (1000, 100_000_000):
            bits, count = edit_embedding.bands_for(prints, least)
            missed += not set(edit_embedding.bands(a, bits, count, least)) & set(edit_embedding.bands(b, bits, count, least))
    assert pairs > 60 and missed <= 1
    # texts of different length, and texts with a common opening
    long = rng.choices(letters, k=1500)
    a, b, c = edit_embedding.fingerprints(["".join(x) for x in (long, long[:1290], long[:375] + rng.choices(letters, k=1125))])
    bits, count = edit_embedding.bands_for(1_000_000_000, least)
    x, y, z = (set(edit_embedding.bands(p, bits, count, least)) for p in (a, b, c))
    assert edit_embedding.likeness(a, b) >= least and x & y
    assert len(x & z) < 20 < len(x) / 20


def test_folding_of_signs_and_forms():
    for t in ("\u201cidiot\u201d", "idiot\u2026", "i\u0301diot", "\u00eddiot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d",
              "\U0001d408\U0001d403\U0001d408\U0001d40e\U0001d413", "\u2014idiot\u2014", "ｉｄｉｏｔ", "IDIOT\uff01", "id\u00adi\u200bot", "\u24d8diot", "idi\u043et"):
        assert toxicity.fold(t) == " idiot ", t
    assert toxicity.fold("\ud55c\uad6d\uc5b4 \u0939\u093f\u0928\u094d\u0926\u0940") == " \ud55c\uad6d\uc5b4 \u0939\u093f\u0928\u094d\u0926\u0940 "  # other scripts keep their marks
    assert toxicity.fold("don\u2019t") == toxicity.fold("don't") and toxicity.fold("") == toxicity.fold("\u2026") == "  "


def test_matches_equal_plain_search():
    rng = random.Random(3)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(60)]
    for _ in range(40):
        weights = {rng.choice((f" {w} ", f" {w}")): rng.random() for w in rng.sample(words, 12)}
        phrases = [" ".join(rng.sample(words, 2)) for _ in range(25)]
        lexicon = toxicity.Lexicon(weights, phrases, 1.0, 0.0)
        automaton = lexicon.automaton()
        for _ in range(20):
            text = toxicity.fold(" ".join(rng.choices(words, k=rng.randint(0, 40))))
            best = {}
            for p, w in weights.items():  # a word begins behind a space; its heaviest entry counts
                for at in range(len(text)):
                    if text.startswith(p, at):
                        best[at] = max(best.get(at, 0.0), w)
            for p in phrases:
                for at in range(len(text)):
                    if text.startswith(f" {p} ", at):
                        best = {x: w for x, w in best.items() if not at <= x < at + len(p) + 1}
            assert abs(lexicon.matched(automaton, text) - sum(best.values())) < 1e-12


def test_folding_and_exceptions():
    assert toxicity.fold("Іdiot ID10T, m0r0n! $tupid") == " idiot idiot moron stupid "
    lexicon = toxicity.Lexicon({" clown ": 2.0, " idio": 3.0}, ["clown fish"], 1.0, -1.0)
    a = lexicon.automaton()
    match = lambda t: lexicon.matched(a, toxicity.fold(t))
    assert match("a clown fish") == 0 and match("a clown") == 2 and match("idiotic CL0WN") == 5 and match("clownish") == 0
    assert lexicon.feature(a, "clown") > lexicon.feature(a, "clown " + "word " * 50)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.98
    assert got[(got.toxic == 0)].predicted.mean() < 0.005


def test_toxicity_edges(docs, rows, labels):
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = {r.doc_id: r.held_out for r in got}
    assert all(held[d] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d in held)


# -- language model -----------------------------------------------------------

def test_language_model(docs, rows):
    got = gated_lm.score_documents(docs).collect()
    trains = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts: dict = {}
    for r in trains:
        for w in gated_lm.tokens(r[1] or ""):
            counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(_key((r[0], len(t := gated_lm.tokens(r[1] or "")), sum(counts.get(w, 0) > 0 for w in t), total,
                        round(sum(np.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in t), 5))) for r in rows)
    assert sorted(_key((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))) for r in got) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    same = {round(r.score, 6) for r in got if r.doc_id in (0, 3)}
    assert len(same) == 1  # equal texts


def _small_model():
    known = sorted(({b"w%d" % i: 500 - i for i in range(300)} | {gated_lm.END: 400}).items())
    v = gated_lm.Vocabulary(known, 10_000, 500, {"tokens": 40, "distinct": 30, "once": 20, "twice": 5})
    return v, gated_lm.new_network(v)


def test_probabilities_sum_to_one():
    v, net = _small_model()
    symbols = np.arange(v.inputs() - 1, dtype=np.int32)
    single = gated_lm.log_likelihood(net, v, [np.array([s], np.int32) for s in symbols])
    assert abs(np.exp(single).sum() - 1) < 1e-4
    after = gated_lm.log_likelihood(net, v, [np.array([3, s], np.int32) for s in symbols]) - single[3]
    assert abs(np.exp(after).sum() - 1) < 1e-4
    mass = 10 ** v.unseen + v.tail_scale * (v.tail["tokens"] - v.discount * v.tail["distinct"])
    assert abs(mass - 1) < 1e-9


def test_state_is_carried_and_training_learns():
    v, net = _small_model()
    rng = np.random.default_rng(0)
    long = rng.integers(0, v.head, 500).astype(np.int32)
    alone = gated_lm.log_likelihood(net, v, [long])[0]
    among = gated_lm.log_likelihood(net, v, [long[:7], long, long[50:90], long[:0]])
    assert abs(alone - among[1]) < 1e-2 and among[3] == 0
    pattern = [np.tile(np.array([5, 17, 42, 99], np.int32), 60) for _ in range(40)]
    before = gated_lm.log_likelihood(net, v, pattern[:1])[0]
    memory = {k: np.full(x.shape, 0.1, np.float32) for k, x in net.items()}
    for _ in range(5):
        gated_lm.train(net, v, pattern, memory)
    assert gated_lm.log_likelihood(net, v, pattern[:1])[0] > before / 3


def test_every_training_document_fits_the_network(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7 != 2, "shared text" if i % 3 == 0 else f"own text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, trains boolean, text string").repartition(4)
    dealt = [[r.text for r in gated_lm.round_of(docs, k).collect()] for k in range(gated_lm.ROUNDS)]
    assert sorted(t for part in dealt for t in part) == sorted(r[2] for r in rows if r[1])
    assert all("shared text" in part for part in dealt)
    # each model's weight is the tokens it was trained on
    trained = []
    monkeypatch.setattr(gated_lm, "saved", lambda df, name, real=gated_lm.saved: trained.append(real(df, name)) or trained[-1])
    monkeypatch.setattr(gated_lm, "discard", lambda table: None)
    monkeypatch.setattr(gated_lm, "FAN_IN", 1 << 20)
    v = gated_lm.vocabulary(gated_lm.token_counts(docs))
    gated_lm.fitted(docs, v)
    first = [t for t in trained[1:] if "weight" in t.columns]
    models = first[::2] if len(first) == 2 * gated_lm.ROUNDS else first
    assert sum(r.weight for t in models for r in t.collect()) == v.total


def test_network_vocabulary_grows_with_the_corpus():
    heads = []
    for distinct in (1000, 20_000, 120_000):
        known = [(b"w%d" % i, 1 + 2_000_000 // (i + 1)) for i in range(distinct)] + [(gated_lm.END, 5000)]
        total = sum(c for _, c in known)
        v = gated_lm.Vocabulary(known, total, len(known), {"tokens": 0, "distinct": 0, "once": 0, "twice": 0})
        assert v.counts[:v.head].sum() >= gated_lm.COVER * total
        assert abs(v.neural - v.head ** 0.5) <= 1 and v.neural * v.per_class >= v.head
        net = gated_lm.new_network(v)
        symbols = [np.array([s], np.int32) for s in range(v.inputs() - 1)]
        assert abs(np.exp(gated_lm.log_likelihood(net, v, symbols)).sum() - 1) < 1e-3
        heads.append(v.head)
    assert heads[0] == 1001 and heads[1] > gated_lm.LEAST_HEAD and heads[2] > 2 * heads[1]


# -- embeddings ---------------------------------------------------------------

def test_cosine_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cosine_dedup.blocks, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(150):
        x = centres[i % 6] + rng.standard_normal(12) * (0.12 if i % 3 else 1.0)
        rows.append((i, x.astype(np.float32).tolist(), int(i % 2)))
    rows += [(200, rows[3][1], rows[3][2]), (201, rows[3][1], 1 - rows[3][2]), (202, None, 1), (203, [], 1), (204, [0.0] * 12, 1),
             (205, [1.0] * 11 + [None], 1), (206, [1.0] * 11 + [float("nan")], 1), (207, rows[3][1], None), (None, rows[3][1], rows[3][2]),
             (208, [1.0] * 5, 1), (209, [2.0] * 5, 1), rows[4]]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, label int, class string").repartition(4)
    got = sorted(_key(tuple(r)) for r in cosine_dedup.link_vectors(df).collect())
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    n, links = len(rows), [set() for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93 - 1e-12:
                    links[a].add(b)
    want = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        c = min(ids) if ids else None
        want.append(_key((rows[a][0], len(links[a]), c, rows[a][0] == c)))
    assert got == sorted(want)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(9, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


# -- repeated strings ---------------------------------------------------------

def _brute_spans(texts):
    data = [(t or "").encode() for t in texts]
    seen: dict = {}
    for b in data:
        for k in range(len(b) - 199):
            seen[b[k:k + 200]] = seen.get(b[k:k + 200], 0) + 1
    out = []
    for b in data:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                mask[k:k + 200] = True
        spans = int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~mask[:-1]].tobytes()
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 1])
def test_suffixes(docs, rows, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    got = sorted(_key(tuple(r)) for r in suffix_dedup.digest_documents(docs).collect())
    assert got == sorted(_key((r[0], *b)) for r, b in zip(rows, _brute_spans([r[1] for r in rows])))


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 1])
def test_suffixes_of_overlapping_repeats(spark, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((60, 120, 199, 200, 201, 340)))) for _ in range(12)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("stuvwxyz") for _ in range(rng.randint(1, 300)))
                     for _ in range(rng.randint(0, 8))) for _ in range(60)] + ["ab" * 400, "abc" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in suffix_dedup.digest_documents(df).collect())
    assert got == [(i, *b) for i, b in enumerate(_brute_spans(texts))]


def test_refined_buckets_equal_brute_force():
    rng = random.Random(5)
    for alphabet, size in ((b"ab", 900), (b"abcd", 2000), (b"a", 700), (bytes(range(97, 123)), 2500)):
        base = bytes(rng.choices(alphabet, k=size))
        pieces = [base[i:i + rng.randint(100, 500)] for i in rng.sample(range(size - 100), 12)]
        texts = [b"".join(rng.choice(pieces) + bytes(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4)) for _ in range(8)]
        rows = []  # (gram, place, anchor, reach), some rows twice as copies in other partitions give them
        for i, t in enumerate(texts):
            for x in suffix_dedup.anchors(t)[0] if len(t) >= 200 else ():
                lo = max(int(x) - suffix_dedup.SPAN + 1, 0)
                rows.append((t[x:x + suffix_dedup.GRAM], (i << 32) + int(x), int(x) - lo, t[lo:int(x) + 200]))
        rows += rows[::7]
        _, bucket = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
        row, begin, end = suffix_dedup.refined(bucket, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows])
        masks = [np.zeros(len(t) + 1, bool) for t in texts]
        for k, a, b in zip(row, begin, end):
            i, lo = rows[k][1] >> 32, (rows[k][1] & 0xFFFFFFFF) - rows[k][2]
            masks[i][lo + a:lo + b] = True
        want = _brute_spans([t.decode() for t in texts])
        assert [int(m.sum()) for m in masks] == [w[1] for w in want]


def test_bytes_split_what_a_hash_merged():
    data = np.frombuffer(bytes(random.Random(6).choices(b"abc", k=250)) * 3, np.uint8)
    wide = np.full(6, 200)
    got = suffix_dedup._by_bytes(data, np.array([0, 250, 1, 500, 251, 3]), wide, np.ones(6, np.int64))
    assert got[0] == got[1] == got[3] != got[2] == got[4] and got[5] not in (got[0], got[2])
    same = suffix_dedup._by_bytes(data, np.array([0, 250, 7]), wide[:3], np.array([1, 1, 2]))
    assert (same == [1, 1, 2]).all()


def test_a_text_of_very_many_anchors(spark):
    rng = random.Random(7)
    body = rng.randbytes(3_500_000).hex()  # 7 MB, about 100,000 anchors
    passage = rng.randbytes(150).hex()
    texts = [body[:3_000_000] + passage + body[3_000_000:], "Z" * 150 + passage + "Y" * 150, body[100:5_000_000] + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.digest_documents(df).collect()}
    assert got[1] == (300, 1) and got[0] == (5_000_000 - 100 + 300, 1) and got[2] == (4_999_900, 1)


def test_one_place_of_a_reach_is_sent(spark, monkeypatch):
    saved, sent = suffix_dedup.saved, []

    def watched(df, name, **how):
        table = saved(df, name, **how)
        if name == "marks":
            sent.append(table.select(F.explode("marks").alias("m")).where("(m.code & 2) > 0").groupBy("m.g").count().agg(F.max("count")).first()[0])
        return table

    monkeypatch.setattr(suffix_dedup, "saved", watched)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + "-" * 20_000 + "".join(rng.choices("abcdefgh ", k=300)), "xy" * 150, "z" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup.digest_documents(df).collect())
    assert got == [(i, *b) for i, b in enumerate(_brute_spans(texts))]
    assert sent[0] < 1000  # a run's edges give some hundred reaches


def test_cleaned_keeps_columns(docs, rows):
    got = suffix_dedup.cleaned(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[9] is None and by[18] == "one two" and by[24] == "" and by[0] == ""


# -- packing and token files --------------------------------------------------

def _ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_encoder_is_the_tokenizer(rows):
    extra = ["a.'b' x'. ..' can't! «a», —.x a_.b '_. é. .é x.— ...", "((foo)) <a>b</a> __init__ 3.14 x² Ⅷ ẞ Å", "<|endoftext|>", "!<|endoftext|>!",
             "\x1cfoo\x1dbar'll  I'VE ΑΣ ΣΑΣ", " \x85 x\xa0y", "İstanbul é É."]
    texts = [r[1] or "" for r in rows] + extra
    enc = tokens.WordEncoder(tokens.default_path())
    for t, packed in zip(texts, enc.many(texts)):
        assert np.frombuffer(packed, enc.dtype).tolist() == _ids(t)


def test_packing(docs, rows):
    got = packing.pack_documents(docs, sequence=256).collect()
    stream = {}
    for r in got:
        assert r.sequence_id not in stream or r.offset not in stream[r.sequence_id]
        stream.setdefault(r.sequence_id, {})[r.offset] = r
    assert sorted(stream) == list(range(len(stream)))
    for s, pieces in stream.items():
        at = 0
        for o in sorted(pieces):
            assert o == at
            at += pieces[o].length
        assert at == 256 or s == len(stream) - 1
    want = {}
    for r in rows:
        want.setdefault((r[0], len(_ids(r[1]))), []).append(_ids(r[1]))
    total = 0
    for r in got:
        total += r.length
        candidates = want[(r.doc_id, r.doc_tokens)]
        assert any(zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in candidates)
    assert total == sum(len(_ids(r[1])) for r in rows)


def test_token_files(spark, docs, rows, tmp_path):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in order:
        ids = _ids(r[1])
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_files.token_documents(docs).orderBy("start").collect()] == want
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path)
    some = token_files.read_tokens(spark, path).where("doc_id = 42").collect()
    assert [list(r.ids) for r in some] == [_ids(rows[14][1])]
    import glob

    import pyarrow.parquet as pq

    file = next(f for f in (pq.ParquetFile(p) for p in glob.glob(path + "/*.parquet")) if f.metadata.num_rows)
    columns = [file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)]
    assert any("DICTIONARY" in str(c.encodings) for c in columns) and all(c.has_offset_index for c in columns)


# -- mixing and sharding ------------------------------------------------------

def test_mixing(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix_documents(docs).collect()
    assert sorted(_key((r.doc_id, r.size)) for r in got) == sorted(_key((r[0], size(r[1]))) for r in rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1) * 2))
    total, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = total / sum(weight[s] for s in free)
        over = {s for s in free if 2 * sizes[s] < level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
        free -= over
    by_size = {v: k for k, v in sizes.items()}
    taken: dict = {}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())


def test_sharding(docs, rows, spark):
    got = sharding.shard_documents(docs).collect()
    assert sorted(_key((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(
        _key((r[0], len(t := (r[1] or "").encode()) + 1, zlib.crc32(t))) for r in rows)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert len({x.shard for x in got if x.doc_id == r.doc_id}) == 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    many = spark.range(40_000).select(F.col("id").alias("k"), F.lit("x").alias("shard"))
    w = sharding.assign(many, "k", [1.0, 3.0, 0.0, 2.0])
    assert w.columns == ["k", "shard", "_shard"]
    share = {r["_shard"]: r["count"] / 40_000 for r in w.groupBy("_shard").count().collect()}
    assert set(share) == {0, 1, 3} and all(abs(share[i] - p) < 0.02 for i, p in ((0, 1 / 6), (1, 1 / 2), (3, 1 / 3)))
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# -- Jaccard join -------------------------------------------------------------

def _brute_join(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return [{b for b, y in enumerate(sets) if a != b and x and y and 5 * len(x & y) >= 4 * len(x | y)} for a, x in enumerate(sets)]


def test_jaccard_join(docs, rows):
    links = _brute_join([r[1] for r in rows])
    want = []
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        c = min(ids) if ids else None
        want.append(_key((r[0], len(links[a]), c, r[0] == c)))
    got = jaccard_join.join_documents(docs)
    assert sorted(_key(tuple(r)) for r in got.collect()) == sorted(want)
    kept = jaccard_join.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = sorted((r.text or "") for r in kept.collect())
    groups = {(min(k for k in _reach(links, a))) for a in range(len(rows)) if links[a] or rows[a][1] and rows[a][1].split()}
    blank = [r for r in rows if not (r[1] or "").split()]
    assert len(texts) == len(groups) + len(blank)


def _reach(links, a):
    seen, todo = {a}, [a]
    while todo:
        for b in links[todo.pop()] - seen:
            seen.add(b)
            todo.append(b)
    return seen


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = _words(rng, 60).split()
    texts = []
    for i in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"v{i}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard_join.blocks.in_blocks, "__defaults__", (16,))
    links = _brute_join(texts)
    got = jaccard_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: len(x) for i, x in enumerate(links)}


def test_band_count_reaches_its_recall():
    b = jaccard_join.band_count()
    assert 1 - (1 - 0.8 ** 7) ** b >= 0.9999


def test_a_large_vocabulary_is_learned_once():
    enc = tokens.WordEncoder(tokens.default_path())
    learned = []

    def learn(pieces):
        learned.extend(pieces)
        enc.new.update(dict.fromkeys(pieces, b"\2\0"))

    enc._learn = learn
    texts = [" ".join(f"w{i}" for i in range(lo, lo + 500)) for lo in range(0, 450_000, 500)]
    for _ in range(2):
        assert all(len(ids) == 2 * 501 for ids in enc.many(texts))
    assert len(learned) == 450_000
