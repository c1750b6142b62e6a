"""Toxicity by a weighted lexicon, matched with Aho-Corasick automata.

Texts are folded first: lower case, look-alike letters of other scripts and
compatibility forms (full-width, mathematical) to plain ones, accents dropped,
digits and signs that stand for letters back to the letters, other punctuation
and symbols to spaces. A lexicon entry is a whole word or a word beginning, with a
weight learned from labelled rows (smoothed log odds of its document counts).
Exception phrases, given or learned (a word pair that holds an entry's word and
is found in clean documents), are entries too: a match inside one does not
count. The weights matched in a text, over the logarithm of its length in
words, go through a fitted logistic curve.

Learning: at most ``TRAIN_ROWS`` labelled rows, drawn by hashed ids, are read
(their whole texts). Everything else - the scoring - covers all
rows and whole texts.

Defined results: a null or empty text has no match and gets the curve's value
at zero; repeated rows get equal scores; with no labelled rows (or of one class
only) the lexicon is empty and the score is the smoothed share of toxic rows; a
null label or id is no training row; an empty table gives an empty result; a very
long text is matched whole in its row; extra columns travel along, and the score
column gets another name where the table has one of its name.

The lexicon, its candidates and the learned exception phrases are bounded
(``LEXICON``, ``CANDIDATES``); a warning says so when a bound bites.
"""

from __future__ import annotations

import math
import re
import unicodedata
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.support import documents, fresh, give_back, kept, lean, quoted, saved, text_or_empty

#: Bound of the labelled sample; entries of the lexicon (and exception phrases) at
#: most, and the patterns weighed for them.
TRAIN_ROWS, LEXICON = 40_000, 20_000
CANDIDATES = 20 * LEXICON
#: Distinct patterns that a task adds up before it passes them on.
TALLIED = 100_000
#: Word beginnings of these lengths may be entries.
BEGINNINGS = range(4, 9)
#: Toxic documents an entry must be seen in, and the least share of toxic ones
#: among the documents that hold it.
LEAST_DOCS, LEAST_PRECISION = 4, 0.75
#: Clean documents in which a word pair must be seen to excuse its word.
EXCEPTION_DOCS = 3

#: Letters that look like another, and signs written for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


class _Folds(dict):
    """Characters to what they fold to, worked out when first met."""

    def __missing__(self, code: int) -> str:
        kind, form = unicodedata.category(chr(code)), unicodedata.normalize("NFKD", chr(code))
        if kind == "Cf" or 0x0300 <= code < 0x0370:  # soft hyphens, joiners; accents
            out = ""
        elif kind[0] in "PSZ" and not (len(form) == 1 and form.isalpha()):  # not a letter in a circle
            out = " "
        else:
            plain = [c for c in form.lower() if not 0x0300 <= ord(c) < 0x0370]
            out = unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c) or SIGNS.get(c, c) for c in plain))
        self[code] = out
        return out


FOLDS = _Folds({ord(k): v for k, v in (LOOK_ALIKES | SIGNS).items()}
               | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SIGNS}
               | {ord(c): c for c in "abcdefghijklmnopqrstuvwxyz269"})
#: A sign that no letter follows is punctuation, not a letter.
ENDS_WORD = re.compile(r"[!@$]+(?!\w)")


def fold(text: str) -> str:
    """Folded words, one space between, before and after them."""
    return " " + " ".join(ENDS_WORD.sub(" ", text.lower()).translate(FOLDS).split()) + " "


def patterns_of(words: set[str]) -> set[str]:
    """Candidate entries of a text's words: ' word ' and ' beginning'."""
    out = {f" {w} " for w in words}
    for n in BEGINNINGS:
        out.update(" " + w[:n] for w in words if len(w) > n)
    return out


def _labelled(docs: DataFrame, labels: DataFrame, train, rows: int) -> DataFrame:
    """(text, toxic) of the bounded training sample, whole texts."""
    some = (labels.where(quoted("toxic").isNotNull() & quoted("doc_id").isNotNull())
            .select(quoted("doc_id").alias("doc_id"), quoted("toxic").cast("int").alias("toxic")).where(train(F.col("doc_id"))))
    there = some.count()
    if there > rows:  # the share that stays below the bound, by hash: no sort, no single task
        draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
        some = some.where(draw < 0.97 * rows / there)
    # At most ``rows`` narrow rows.
    sample = documents(docs).select(quoted("doc_id").alias("doc_id"), text_or_empty().alias("text")).join(
        F.broadcast(some), "doc_id").select("text", "toxic")
    return saved(sample, "toxicity-sample")  # several passes read it


def _counts(sample: DataFrame, make) -> DataFrame:
    """(pattern, toxic, clean): documents that hold each pattern, pre-added before the shuffle."""
    def rows(tally):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()),
             pa.array([v[1] for v in tally.values()], pa.int64())], names=["pattern", "toxic", "clean"])

    def count(batches):
        kept("toxicity")
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for p in make(fold(text)):
                    tally.setdefault(p, [0, 0])[0 if toxic else 1] += 1
                if len(tally) > TALLIED:
                    yield rows(tally)
                    tally = {}
        yield rows(tally)

    return sample.mapInArrow(lean(count), "pattern string, toxic long, clean long").groupBy("pattern").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _word_patterns(folded: str) -> set[str]:
    return patterns_of(set(folded.split()))


class Lexicon:
    """Weights of entries, exception phrases and the curve; small and sent whole."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], slope: float, base: float):
        self.weights, self.exceptions, self.slope, self.base = weights, exceptions, slope, base

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            phrase = " " + p.strip() + " "
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a

    def matched(self, automaton, folded: str) -> float:
        """Weights in a folded text; a word counts once, with its heaviest entry."""
        if not len(automaton):
            return 0.0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (n, weight) in automaton.iter(folded):
            begin = end - n + 1
            if weight is None:
                excused.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        for a, b in excused:
            for begin in [x for x in best if a <= x < b]:
                del best[begin]
        return sum(best.values())

    def feature(self, automaton, text: str) -> float:
        folded = fold(text)
        return self.matched(automaton, folded) / math.log2(4 + folded.count(" "))

    def score(self, feature: float) -> float:
        z = self.base + self.slope * feature
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature: Newton steps with a small ridge."""
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.array([math.log(share / (1 - share)), 0.0])
    if y.min(initial=1) == y.max(initial=0) or not len(y):
        return w[0], 0.0
    design = np.column_stack((np.ones_like(x), x))
    ridge = np.diag([1e-6, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _told(got: int, bound: int, what: str) -> None:
    if got >= bound:
        warnings.warn(f"toxicity: {what} reached their bound of {bound}", stacklevel=3)


def learn(docs: DataFrame, labels: DataFrame, train, rows: int = TRAIN_ROWS,
          exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exceptions and curve from labelled rows that ``train(doc_id)`` admits."""
    sample = _labelled(docs, labels, train, rows)
    toxic = sample.where("toxic = 1")
    seen = _counts(toxic, _word_patterns).where(F.col("toxic") >= LEAST_DOCS)
    # Of the bounded sample's patterns, the most common ones are weighed.
    candidates = {r[0] for r in seen.orderBy(F.desc("toxic"), "pattern").limit(CANDIDATES).select("pattern").collect()}
    _told(len(candidates), CANDIDATES, "candidate patterns")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(candidates)

    def of_candidates(folded: str) -> set[str]:
        return patterns_of(set(folded.split())) & shared.value

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    counted = _counts(sample, of_candidates)
    weighed = counted.withColumn("weight", F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0)))
    good = weighed.where((F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))) & (F.col("weight") > 0))
    weights = {r["pattern"]: r["weight"] for r in
               good.orderBy(F.desc("weight"), F.desc("toxic"), "pattern").limit(LEXICON).collect()} if n0 and n1 else {}

    starts = spark.sparkContext.broadcast(weights)

    def pairs(folded: str) -> set[str]:
        words = folded.split()
        hit = [f" {w} " in starts.value or any(" " + w[:n] in starts.value for n in BEGINNINGS) for w in words]
        return {f"{a} {b}" for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}

    excused = _counts(sample, pairs).where((F.col("clean") >= EXCEPTION_DOCS) & (F.col("clean") > 4 * F.col("toxic")))
    found = [r[0] for r in excused.orderBy(F.desc("clean"), "pattern").limit(LEXICON).select("pattern").collect()] if weights else []
    _told(len(weights), LEXICON, "lexicon entries")
    _told(len(found), LEXICON, "exception phrases")
    lexicon = Lexicon(weights, sorted({fold(e).strip() for e in exceptions} | set(found)), 0.0, 0.0)

    shared.destroy()
    starts.destroy()

    def features(batches):
        automaton = lexicon.automaton()
        kept("toxicity")
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lexicon.feature(automaton, t) for t in batch.column("text").to_pylist()], pa.float64()),
                 batch.column("toxic")], names=["feature", "toxic"])

    # At most ``rows`` pairs of numbers.
    xy = sample.mapInArrow(lean(features), "feature double, toxic int").toPandas()
    lexicon.base, lexicon.slope = _fit_curve(xy["feature"].to_numpy(float), (xy["toxic"] == 1).to_numpy(float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new last column (underscores
    are put before its name if the table already has it)."""
    name, = fresh(docs, score)
    # Plain data: a broadcast names classes, and workers may not have this package.
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.slope, lexicon.base))

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept("toxicity")
        lexicon = Lexicon(*shared.value)
        automaton = lexicon.automaton()
        for batch in texts:
            yield batch.map(lambda t: lexicon.score(lexicon.feature(automaton, t))).astype("float64")
        give_back()

    return documents(docs).withColumn(name, F.pandas_udf(of, "double")(text_or_empty(text)))


def fold_of(key, parts: int):
    """crc32 of a record id's text, modulo ``parts`` (null id: null)."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows of the toxicity query."""
    lexicon = learn(docs, labels, train=lambda key: fold_of(key, 5) != 0)
    rows = docs.select(quoted("doc_id").alias("doc_id"), F.coalesce(fold_of(quoted("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                       quoted("text").alias("text"))
    return scored(rows, lexicon).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
