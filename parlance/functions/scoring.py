"""Fixed-weight scorers.

The reference scores turns with trained models. For exact, SQL-checkable
queries the same downstream rules (override, calibration, escalation, metrics)
are fed by scorers whose weights are fixed here (our own parameters, not the
reference's). Trained Spark ML models (``parlance.operators.models``) plug in
at the same place and are checked by invariants instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions.text import has_char, keyword_tokens, stopword_ratio

# Lexicon logistic scorer: z = b + a*(pos - neg) + e*exclaim + q*question + s*(stop_ratio - m)
LEXICON_WEIGHTS = {"bias": 0.0, "lexicon": 1.5, "exclaim": 0.4, "question": -0.3,
                   "stop": 4.0, "stop_mid": 0.2}

# Marker words of the four document languages; intent classes are sorted codes.
LANG_MARKERS = {
    "de": ["der", "die", "und", "das", "ist"],
    "en": ["the", "and", "of", "to", "is"],
    "es": ["el", "los", "las", "que", "y"],
    "fr": ["le", "la", "les", "des", "et"],
}
LANG_SCALE = 8.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lexicon_positive_probability(cleaned, tokens=None, ws=None) -> Column:
    """P(positive) of cleaned text under the fixed lexicon logistic scorer;
    ``tokens`` and ``ws`` name columns that hold its keyword tokens and words."""
    w = LEXICON_WEIGHTS
    toks = keyword_tokens(cleaned) if tokens is None else _col(tokens)
    pos = F.size(F.array_intersect(toks, F.array(*[F.lit(x) for x in K.POSITIVE_WORDS])))
    neg = F.size(F.array_intersect(toks, F.array(*[F.lit(x) for x in K.NEGATIVE_WORDS])))
    z = (F.lit(w["bias"]) + w["lexicon"] * (pos - neg) + w["exclaim"] * has_char(cleaned, "!")
         + w["question"] * has_char(cleaned, "?")
         + w["stop"] * (stopword_ratio(cleaned, ws=ws) - w["stop_mid"]))
    return 1.0 / (1.0 + F.exp(-z))


def binary_prediction(p_positive) -> tuple[Column, Column]:
    """(class code, confidence) of a two-class probability; ties go to class 0."""
    p = _col(p_positive)
    code = F.when(p > 0.5, F.lit(1)).otherwise(F.lit(0))
    conf = F.greatest(p, 1.0 - p)
    return code, conf


def _member_of(items):
    return lambda x: x.isin(items)


def lang_logits(ws) -> dict[str, Column]:
    """Marker-word rate of each language over the words ``ws``, in class order."""
    ws = _col(ws)
    n = F.size(ws) + 1
    return {k: LANG_SCALE * F.size(F.filter(ws, _member_of(LANG_MARKERS[k]))) / n for k in sorted(LANG_MARKERS)}


def softmax_choice(logits: dict[str, Column], peak) -> tuple[Column, Column]:
    """(class, confidence) of a softmax over logits whose largest is ``peak``;
    the first of equal classes wins."""
    best = None
    for k, lg in reversed(logits.items()):
        best = F.when(lg == peak, F.lit(k)) if best is None else F.when(lg == peak, F.lit(k)).otherwise(best)
    total = None
    for lg in logits.values():
        total = F.exp(lg - peak) if total is None else total + F.exp(lg - peak)
    return best, F.round(1.0 / total, 4)
