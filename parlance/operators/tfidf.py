"""Long-form TF-IDF (V1-V7, V9).

Documents become ``(id, term, tf)`` rows: tokens are exploded inside the scan
stage and counted with a partial (map-side) aggregate, so only distinct
(doc, term) pairs cross the shuffle. Document frequencies are a second
partial aggregate; a hot term is combined map-side like any other. Where only the
totals by term are wanted (``term_totals``), a task sorts its terms as numbers in numpy
and sends its distinct terms alone, and where the most frequent ones are
(``frequent_totals``, the classifiers' vocabulary) those that may be among them; the
training sets' vectors (``weighed``) are made of such numbers too.

Weights follow the smooth IDF of the common vectorizer:
``idf = ln((1 + n) / (1 + df)) + 1``, tf raw or sublinear ``1 + ln(tf)``,
rows L2-normalised. The vocabulary is at most ``max_terms`` rows (a top-k),
so it is broadcast; without a cap it is joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.functions import constants as K
from parlance.functions.text import vector_tokens, with_bigrams
from parlance.operators.ordered import row_number_within
from parlance.sources.landing import stored


def _with_ngrams(df: DataFrame, text_col: str, ngrams=(1, 1), out: str = "__all") -> DataFrame:
    """Adds the token array (unigrams and / or bigrams) as ``out``.

    The tokens are their own projection: the n-gram expression reads them
    several times, and a non-trivial expression read more than once is not
    inlined by the optimizer, so the tokenizing regex runs once per row.
    """
    d = df.withColumn("__tok", vector_tokens(text_col))
    toks = F.col("__tok")
    if ngrams[1] >= 2:
        toks = with_bigrams("__tok")
        if ngrams[0] >= 2:
            toks = F.slice(toks, F.size("__tok") + 1, 1 << 30)
    return d.withColumn(out, toks).drop("__tok")


def counted(df: DataFrame, id_col: str, text_col: str, ngrams=(1, 1)) -> DataFrame:
    """(id, terms, counts) of every document; each row of ``df`` is one document.

    A document's tokens all sit in one row, so they are counted in the row:
    sorted, then each run of equal tokens becomes a term and its run length. A
    document without tokens has the one term null. Lambda bodies read only lambda
    variables.
    """
    d = _with_ngrams(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__txt")), "__txt", ngrams)
    d = d.select("id", F.sort_array("__all").alias("__s"))
    n = F.size("__s")
    nxt = F.concat(F.slice("__s", 2, F.greatest(n - 1, F.lit(1))), F.array(F.lit(None).cast("string")))
    # true where a run of equal tokens ends
    d = d.select("id", "__s", F.zip_with("__s", nxt, lambda a, b: b.isNull() | (a != b)).alias("__end"))
    d = d.select("id",
                 F.filter(F.zip_with("__s", "__end", lambda t, e: F.when(e, t)), lambda x: x.isNotNull())
                 .alias("__t"),
                 F.filter(F.zip_with("__end", F.sequence(F.lit(1), F.greatest(F.size("__end"), F.lit(1))),
                                     lambda e, i: F.when(e, i)), lambda x: x.isNotNull()).alias("__e"))
    prev = F.concat(F.array(F.lit(0)), F.slice("__e", 1, F.greatest(F.size("__e") - 1, F.lit(1))))
    return d.select("id", F.col("__t").alias("terms"), F.zip_with("__e", prev, lambda e, p: e - p).alias("counts"))


def term_counts(df: DataFrame, id_col: str, text_col: str, ngrams=(1, 1)) -> DataFrame:
    """(id, term, tf) of every document: the (document, term) pairs leave the scan
    stage already counted and never cross a shuffle."""
    d = counted(df, id_col, text_col, ngrams)
    d = d.select("id", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("tf"))).alias("__p"))
    # a document without tokens yields one (null, 1) entry: dropped here
    return d.select("id", "__p.term", F.col("__p.tf").cast("long").alias("tf")).where(F.col("term").isNotNull())


#: Tokens that are sorted together; documents and distinct words told apart meanwhile
#: (16 bits of a key number the document, 24 each word). Documents are added by slices.
TALLIED, TALLIED_DOCS, TALLIED_WORDS, SLICE = 4_000_000, 1 << 16, 1 << 24, 256


class _Tally:
    """df and cf of the terms of some documents: a term is a key of its words' numbers, a
    (term, document) occurrence one 64-bit number, and all are sorted at once."""

    def __init__(self, ngrams):
        self.ngrams = ngrams
        self.number: dict[str, int] = {}
        self.keys: list[np.ndarray] = []
        self.docs = self.tokens = 0

    def full(self, docs: int, words: int) -> bool:
        return self.tokens > TALLIED or self.docs + docs > TALLIED_DOCS or len(self.number) + words >= TALLIED_WORDS

    def add(self, lengths: np.ndarray, words: list[str], word_of: np.ndarray) -> None:
        """Documents of ``lengths`` tokens; token i is ``words[word_of[i]]``."""
        number = self.number  # from 1: 0 stands for no second word
        of = np.array([number.setdefault(w, len(number) + 1) for w in words], np.uint64)[word_of]
        doc = np.repeat(np.arange(self.docs, self.docs + len(lengths), dtype=np.uint64), lengths)
        if len(number) >= TALLIED_WORDS:
            raise ValueError(f"{SLICE} documents hold more than {TALLIED_WORDS} different words")
        if self.ngrams[0] < 2:
            self.keys.append((of << np.uint64(40)) | doc)
        if self.ngrams[1] >= 2:
            pair = (of[:-1] << np.uint64(40)) | (of[1:] << np.uint64(16)) | doc[1:]
            self.keys.append(pair[doc[:-1] == doc[1:]])
        self.docs += len(lengths)
        self.tokens += len(of)

    def rows(self, most: int | None = None) -> pa.RecordBatch:
        """(term, df, cf); with ``most``, of the so many most frequent terms, and then
        ``rest``: what a term left out occurs at most."""
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64)
        keys.sort()
        new = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
        at = np.flatnonzero(new)  # first of each (term, document)
        term = keys[at] >> np.uint64(16)
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][:len(term)])
        df = np.diff(np.r_[begins, len(term)])
        cf = np.diff(np.r_[at[begins], len(keys)])
        rest = 0
        if most is not None and len(cf) > most:
            by_cf = np.argpartition(-cf, most)
            rest = int(cf[by_cf[most]])
            df, cf, begins = (x[by_cf[:most]] for x in (df, cf, begins))
        words = pa.array(["", *self.number], pa.string())
        a, b = (term[begins] >> np.uint64(24)).astype(np.int64), (term[begins] & np.uint64((1 << 24) - 1)).astype(np.int64)
        names = words.take(pa.array(a))
        pairs = pc.binary_join_element_wise(names, words.take(pa.array(b)), " ")
        out = [pc.if_else(pa.array(b > 0), pairs, names), pa.array(df, pa.int64()), pa.array(cf, pa.int64())]
        if most is not None:
            # a row without a term says that this tally is there, whatever it kept
            out = [pa.concat_arrays([x, y]) for x, y in zip(out, (pa.nulls(1, pa.string()), pa.array([0]), pa.array([0])))]
            out.append(pa.array(np.full(len(cf) + 1, rest), pa.int64()))
        return pa.RecordBatch.from_arrays(out, names=["term", "df", "cf", "rest"][:len(out)])


def tokenized(df: DataFrame, text_col: str, *kept) -> DataFrame:
    """``kept`` columns, the text where it is ASCII (``ascii``), else its tokens
    (``tokens``): what ``tokens_of`` reads. The regex runs on the other texts alone."""
    c = F.col(f"`{text_col}`")
    plain = F.octet_length(c) == F.length(c)
    return df.select(*kept, F.when(plain, c).alias("ascii"), F.when(~plain, vector_tokens(c)).alias("tokens"))


#: Lower-cased word characters of ASCII by byte, 0 for all other bytes.
_WORD_BYTES = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _WORD_BYTES[_c] = _WORD_BYTES[ord(chr(_c).upper())] = _c


def _ascii_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``vector_tokens`` of ASCII texts: number of tokens of each, all tokens. The bytes
    of a batch are classed at once; runs of word characters end where a text does."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if at[0] == at[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    folded = _WORD_BYTES[np.frombuffer(data, np.uint8)[at[0]:at[-1]]]
    at = at - at[0]
    word = folded != 0
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = at[(at > 0) & (at < at[-1])]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size -= first
    word[first[size < 2]] = False
    first, size = first[size >= 2], size[size >= 2]
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(folded[word]))
    return np.diff(np.searchsorted(first, at)), found


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(order, lengths, words, word_of) of ``tokenized`` rows: row ``order[k]`` has
    ``lengths[k]`` tokens; token i of all is ``words[word_of[i]]``. A null has none."""
    lengths, found = _ascii_tokens(pc.fill_null(batch.column("ascii"), ""))
    order = np.arange(len(lengths))
    listed = batch.column("tokens")
    if listed.null_count < len(listed):
        # ASCII and null texts first, then the texts whose tokens are listed
        is_listed = listed.is_valid().to_numpy(zero_copy_only=False)
        order = np.concatenate((order[~is_listed], order[is_listed]))
        others = pc.list_value_length(listed).drop_null().to_numpy(zero_copy_only=False)
        lengths = np.concatenate((lengths[~is_listed], others))
        found = pa.concat_arrays([found, listed.flatten()])
    coded = found.dictionary_encode()
    return order, lengths.astype(np.int64), coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _tallied(df: DataFrame, text_col: str, ngrams, schema: str, most: int | None = None) -> DataFrame:
    def tally(batches):
        held = _Tally(ngrams)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                _, lengths, words, word_of = tokens_of(batch.slice(lo, SLICE))
                if held.full(len(lengths), len(words)):
                    yield held.rows(most)
                    held = _Tally(ngrams)
                held.add(lengths, words, word_of)
        yield held.rows(most)

    return tokenized(df, text_col).mapInArrow(tally, schema)


def term_totals(df: DataFrame, text_col: str, ngrams=(1, 1)) -> DataFrame:
    """(term, df, cf) over all documents: ``term_counts`` added up by term. A task sorts
    its documents' terms as numbers, so that only its distinct terms become rows."""
    rows = _tallied(df, text_col, ngrams, "term string, df long, cf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


#: Terms that a tally tells of, and terms counted again, per term wanted.
TOLD, RECOUNTED = 8, 20


def frequent_totals(df: DataFrame, text_col: str, ngrams, min_df: int, max_terms: int) -> DataFrame:
    """``term_totals`` of terms that hold the ``max_terms`` most frequent ones of at least
    ``min_df`` documents. A tally tells its most frequent terms and how often one that it
    leaves out occurs at most; the terms whose total may then reach the last one
    wanted are counted again. Where that bound leaves too many, all terms are added up."""
    told = stored(_tallied(df, text_col, ngrams, "term string, df long, cf long, rest long", TOLD * max_terms), "told-terms")
    unseen = told.where("term is null").agg(F.sum("rest")).first()[0] or 0
    sums = told.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.sum("rest").alias("met"))
    if not unseen:
        return sums.drop("met")
    wanted = sums.where(F.col("df") >= min_df).orderBy(F.desc("cf")).limit(max_terms).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = wanted[1] if wanted[0] == max_terms else 0
    if unseen < least:
        likely = sums.where(F.col("cf") + unseen - F.col("met") >= least).select("term").limit(RECOUNTED * max_terms + 1)
        terms = [r.term for r in likely.collect()]
        if len(terms) <= RECOUNTED * max_terms:
            return recounted(df, text_col, terms, ngrams)
    return term_totals(df, text_col, ngrams)


def recounted(df: DataFrame, text_col: str, terms: list[str], ngrams) -> DataFrame:
    """``term_totals`` of the given terms alone, one row per task and term met."""
    def count(batches):
        finder, totals = Finder(terms, ngrams), np.zeros((2, len(terms)), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                _, *tokens = tokens_of(batch.slice(lo, SLICE))
                _, term, tf = finder.counts(*tokens)
                totals += np.bincount(term, minlength=len(terms)), np.bincount(term, tf, len(terms)).astype(np.int64)
        met = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(met)), *(pa.array(x[met]) for x in totals)], names=["term", "df", "cf"])

    rows = tokenized(df, text_col).mapInArrow(count, "term string, df long, cf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class Finder:
    """Counts of given terms (by their place in the list) in batches of tokens."""

    def __init__(self, terms, ngrams):
        self.size = len(terms)
        single = [(t, k) for k, t in enumerate(terms) if " " not in t and ngrams[0] < 2]
        double = [(t.split(" "), k) for k, t in enumerate(terms) if " " in t and ngrams[1] >= 2]
        self.number: dict[str, int] = {}
        for w in (*(t for t, _ in single), *(w for pair, _ in double for w in pair)):
            self.number.setdefault(w, len(self.number))
        self.term = np.full(len(self.number) + 1, -1, np.int64)  # the last place: unknown words
        self.term[[self.number[t] for t, _ in single]] = [k for _, k in single]
        pairs = sorted((self._pair(*(self.number[w] for w in pair)), k) for pair, k in double)
        self.pairs, self.pair_term = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

    def _pair(self, a, b):
        return a * (len(self.number) + 1) + b

    def counts(self, lengths: np.ndarray, words: list[str], word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, tf), sorted by document and term."""
        unknown, size = len(self.number), max(self.size, 1)
        of = np.array([self.number.get(w, unknown) for w in words], np.int64)[word_of]
        doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        term = self.term[of]
        keys = [(doc * size + term)[term >= 0]]
        if len(self.pairs):
            both = np.flatnonzero((doc[:-1] == doc[1:]) & (of[:-1] < unknown) & (of[1:] < unknown))
            pair = self._pair(of[both], of[both + 1])
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hit = self.pairs[place] == pair
            keys.append(doc[both[hit]] * size + self.pair_term[place[hit]])
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return *np.divmod(key, size), tf


def _vectors(finder: Finder, idf: np.ndarray, damped: np.ndarray | None, tokens) -> pa.Array:
    """One sparse vector (type, size, indices, values) per document, as ``TermVector``,
    the idf product and the normalizer give them; ``damped``: 1 + ln(tf) by tf."""
    n = len(tokens[0])
    doc, term, tf = finder.counts(*tokens)
    if damped is None:
        values = tf.astype(np.float64)
    else:
        values = damped[np.minimum(tf, len(damped) - 1)]
        over = tf >= len(damped)
        values[over] = 1.0 + np.log(tf[over])
    values *= idf[term]
    norm = np.sqrt(np.bincount(doc, values * values, n))[doc]
    values /= np.where(norm == 0, 1.0, norm)
    offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, finder.size, np.int32)),
         pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(values))],
        names=["type", "size", "indices", "values"])


#: Counts whose 1 + ln(tf) comes from Spark, whose logarithm may differ in the last bit.
DAMPED = 4096


def weighed(df: DataFrame, text_col: str, vocabulary, idf, ngrams, sublinear: bool, out: str) -> DataFrame:
    """``df`` without its text, with each text's sparse vector as the struct ``out``."""
    kept = [c for c in df.columns if c != text_col]
    damped = None
    if sublinear:
        rows = df.sparkSession.range(1, DAMPED, 1, 1).select("id", (1.0 + F.log("id")).alias("x")).collect()
        damped = np.array([0.0, *(r.x for r in sorted(rows))])

    def work(batches):
        finder, scale = Finder(vocabulary, ngrams), np.asarray(idf, np.float64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                order, *tokens = tokens_of(some)
                vectors = _vectors(finder, scale, damped, tokens).take(pa.array(np.argsort(order)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), vectors], names=[*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, VectorUDT.sqlType())])
    return tokenized(df, text_col, *(F.col(f"`{c}`") for c in kept)).mapInArrow(work, schema)


def doc_count(df: DataFrame) -> DataFrame:
    """One-row frame with the number of documents ``n``."""
    return df.agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit_vocabulary(tf: DataFrame, n_docs: DataFrame, min_df: int = 1,
                   max_terms: int | None = None) -> DataFrame:
    """(term, df, cf, term_index, idf): terms in >= min_df documents, the
    ``max_terms`` most frequent by corpus count (ties by term), indexed in
    alphabetical order."""
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return vocabulary_of(stats, n_docs, min_df, max_terms)


def vocabulary_of(stats: DataFrame, n_docs: DataFrame, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """``fit_vocabulary`` of (term, df, cf) rows."""
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    if max_terms:
        kept = stats.orderBy(F.desc("cf"), F.col("term")).limit(max_terms)
        # bounded by max_terms rows: numbering on one task is fine here
        indexed = kept.withColumn("term_index",
                                  (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
    else:
        indexed = row_number_within(stats, [], ["term"], out="__rn").withColumn(
            "term_index", (F.col("__rn") - 1).cast("int")).drop("__rn")
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    return indexed.crossJoin(F.broadcast(n_docs)).withColumn("idf", idf).drop("n")


def _vocab_side(vocab: DataFrame, bounded: bool) -> DataFrame:
    v = vocab.select("term", "term_index", "idf")
    return F.broadcast(v) if bounded else v


def transform(tf: DataFrame, vocab: DataFrame, sublinear: bool = False, bounded: bool = True,
              normalize: bool = True) -> DataFrame:
    """(id, term, term_index, weight) for terms of the vocabulary (others ignored)."""
    j = tf.join(_vocab_side(vocab, bounded), on="term", how="inner")
    tfw = (1.0 + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    j = j.withColumn("weight", tfw * F.col("idf"))
    if normalize:
        # a document's terms are one document's worth of rows
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
        j = j.withColumn("weight", F.col("weight") / norm)
    return j.select("id", "term", "term_index", "weight")


def fit_transform(df: DataFrame, id_col: str, text_col: str, ngrams=(1, 1), min_df: int = 1,
                  max_terms: int | None = None, sublinear: bool = False):
    """Fit on ``df`` and weight it; returns (weights, vocabulary)."""
    tf = term_counts(df, id_col, text_col, ngrams)
    vocab = fit_vocabulary(tf, doc_count(df), min_df, max_terms)
    return transform(tf, vocab, sublinear, bounded=max_terms is not None), vocab


def pair_cosine(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """Cosine of two texts per row, IDF fitted on just those two texts.

    With n = 2: a term in both texts has idf 1, a term in one has ln(1.5) + 1.
    Both texts are in the row, so nothing is shuffled: their tokens, marked by
    side, are sorted together and folded run by run.
    """
    def marked(c, side):
        return F.transform(vector_tokens(c), lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    def state(t, a, b, dot, na, nb):
        return F.struct(t.alias("t"), a.alias("a"), b.alias("b"), dot.alias("dot"), na.alias("na"), nb.alias("nb"))

    def closed(s):
        """(dot, na, nb) with the run of the current term added."""
        idf = F.when((s["a"] > 0) & (s["b"] > 0), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1.0)
        wa, wb = s["a"] * idf, s["b"] * idf
        return s["dot"] + wa * wb, s["na"] + wa * wa, s["nb"] + wb * wb

    def step(s, x):
        a, b = F.when(x["side"] == 0, 1).otherwise(0), F.when(x["side"] == 1, 1).otherwise(0)
        return F.when(s["t"] == x["t"], state(s["t"], s["a"] + a, s["b"] + b, s["dot"], s["na"], s["nb"])).otherwise(
            state(x["t"], a, b, *closed(s)))

    def finish(s):
        dot, na, nb = closed(s)
        return F.when((na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))

    none = F.array().cast("array<struct<t:string,side:int>>")
    d = df.select(F.col(id_col), F.sort_array(F.concat(F.coalesce(marked(left, 0), none), F.coalesce(marked(right, 1), none))).alias("__all"))
    zero = F.lit(0.0)
    start = state(F.lit(None).cast("string"), F.lit(0), F.lit(0), zero, zero, zero)
    return d.select(id_col, F.aggregate("__all", start, step, finish).alias("similarity"))
