"""Text column functions (Column -> Column), all JVM-side built-ins (P1: the
reference's per-row lambdas become column expressions, never Python UDFs).

Regex patterns are written so that Java regex (Spark) gives the same result as
the Python ``re`` module the reference uses: Python's ``\\s`` is Unicode-wide
and includes U+001C..U+001F, so the whitespace class is spelled out
(``PY_WHITESPACE``) instead of relying on ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.constants import (CHAT_SYSTEM_SHORT, ENGLISH_STOPWORDS, EOS_TOKEN, ESCALATION_TRIGGERS,
                                          METRIC_DIGITS, PERCENT_DIGITS, PY_WHITESPACE)

WS = PY_WHITESPACE
URL_PATTERN = f"http[^{WS}]+|www[^{WS}]+"
NON_KEPT_CHARS = f"[^a-zA-Z0-9{WS}?.!,']"
WS_RUN = f"[{WS}]+"
# URL removal and character filtering in one left-to-right pass. A removed
# character can never start a URL (h and w are kept), so the matches are those
# of the two passes run in turn. Every match is a possessive run of kept text
# (an h or w that does not start a URL included) followed by a URL, a run of
# removed characters or the end, and the run is put back: the scan never fails
# at a position and retries at the next, which a bare negated class does on
# every kept character.
_KEPT = f"a-zA-Z0-9{WS}?.!,'"
CLEAN_PASS = (f"((?:[a-gi-vx-zA-Z0-9{WS}?.!,']++|h(?!ttp[^{WS}])|w(?!ww[^{WS}]))*+)"
              f"(?:http[^{WS}]+|www[^{WS}]+|[^{_KEPT}]+|\\z)")
# Texts without a URL take the runs of kept characters, then the words, out of the
# text: such a search runs through what it keeps and makes no pattern step per
# character. The class is a union whose ASCII part is asked first.
MAY_HOLD_URL = ("http", "www")
KEPT_RUN = f"[[a-z0-9?.!,'\\x09-\\x0D\\x1C-\\x20][{WS}]]+"
CLEAN_WORD = "[a-z0-9?.!,']+"
# Word tokens of the keyword override: \b[a-z']+\b on cleaned text.
KEYWORD_TOKEN = r"\b[a-z']+\b"
# Vectorizer tokens: two or more word characters, Unicode-aware.
# A greedy run from the first word character on begins and ends at a word boundary.
VECTOR_TOKEN = r"(?U)\w\w+"
SENTENCE_END = f"[.!?][{WS}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """lower -> drop URLs -> keep [a-zA-Z0-9 whitespace ?.!,'] -> collapse whitespace -> strip."""
    c = F.lower(_col(c))
    may_hold_url = F.contains(c, F.lit(MAY_HOLD_URL[0])) | F.contains(c, F.lit(MAY_HOLD_URL[1]))
    without_urls = F.trim(F.regexp_replace(F.regexp_replace(c, CLEAN_PASS, "$1"), WS_RUN, " "))
    return F.when(may_hold_url, without_urls).otherwise(_runs(_runs(c, KEPT_RUN, ""), CLEAN_WORD, " "))


def _runs(c, pattern: str, sep: str) -> Column:
    """The matches of ``pattern`` in ``c``, joined by ``sep``."""
    return F.array_join(F.regexp_extract_all(c, F.lit(pattern), 0), sep)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def char_len(c) -> Column:
    return F.length(_col(c))


def words(c) -> Column:
    """``text.split()`` on cleaned text (single spaces, stripped); empty -> []."""
    c = _col(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_count(c) -> Column:
    c = _col(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ")))


def has_char(c, ch: str) -> Column:
    return F.instr(_col(c), ch).__gt__(0).cast("int")


def stopword_ratio(c, stopwords=None, ws=None) -> Column:
    """stop words / (words + 1); the list is a parameter (an ``IN`` set).
    ``ws``: the words of ``c`` where a column already holds them."""
    stop = list(dict.fromkeys(stopwords or ENGLISH_STOPWORDS))
    ws = words(c) if ws is None else _col(ws)
    hits = F.size(F.filter(ws, lambda x: x.isin(stop)))
    return hits / (F.size(ws) + 1)


def keyword_tokens(cleaned) -> Column:
    """Distinct ``\\b[a-z']+\\b`` tokens of cleaned text."""
    return F.array_distinct(F.regexp_extract_all(_col(cleaned), F.lit(KEYWORD_TOKEN), 0))


def has_any(tokens: Column, word_list) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in word_list]))


def escalation_trigger(c, triggers=None, word_boundary: bool = False) -> Column:
    """Any phrase as a substring of the lower-cased text (or as a whole word)."""
    phrases = triggers or ESCALATION_TRIGGERS
    alternation = "|".join(_regex_quote(p.lower()) for p in phrases)
    pattern = f"\\b(?:{alternation})\\b" if word_boundary else alternation
    return F.coalesce(F.lower(_col(c)).rlike(pattern), F.lit(False))


def first_sentence(c) -> Column:
    """First piece of ``re.split(r'[.!?]\\s+', text.strip())``, stripped."""
    return strip_ws(F.split(strip_ws(_col(c)), SENTENCE_END).getItem(0))


def text_after(c, marker: str) -> Column:
    """Text after the last occurrence of ``marker`` (whole text if absent)."""
    return F.element_at(F.split(_col(c), _regex_quote(marker)), -1)


def category_of(intent) -> Column:
    """Upper-cased text before the first underscore."""
    return F.upper(F.split_part(_col(intent), F.lit("_"), F.lit(1)))


def preview(c, n: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def vector_tokens(c) -> Column:
    """Vectorizer tokens: lower-cased runs of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(VECTOR_TOKEN), 0)


def with_bigrams(tokens) -> Column:
    """Unigrams followed by adjacent pairs joined with one space."""
    t = _col(tokens)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))),
                       F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)


def prompt(question, context=None) -> Column:
    """``Customer: {q} Support:``; with context the question is ``{q} Context: {s}``."""
    q = _col(question)
    if context is not None:
        q = F.concat(q, F.lit(" Context: "), _col(context))
    return F.concat(F.lit("Customer: "), q, F.lit(" Support:"))


def chat_text(instruction, response, system: str = CHAT_SYSTEM_SHORT) -> Column:
    """Three-part chat template: system, user and assistant blocks, each closed by ``</s>``."""
    return F.concat(F.lit(f"<|system|>\n{system}\n</s>\n<|user|>\n"), _col(instruction),
                    F.lit("\n</s>\n<|assistant|>\n"), _col(response), F.lit("\n</s>"))


def dialogue_text(instruction, response, eos: str = EOS_TOKEN) -> Column:
    """``Customer: {instruction} Support: {response}{eos}``."""
    return F.concat(F.lit("Customer: "), _col(instruction), F.lit(" Support: "), _col(response), F.lit(eos))


def fixed(c, digits: int = METRIC_DIGITS) -> Column:
    """Number as text with ``digits`` decimals (Python ``f"{x:.4f}"``).

    The value is rounded to an integer count of units first, with the same
    double arithmetic in every engine; formatting that short value cannot
    round differently in Java and C.
    """
    scale = 10 ** digits
    c = _col(c)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.floor(c * scale + 0.5) / scale))


def percent(c, digits: int = PERCENT_DIGITS) -> Column:
    """Fraction as a percentage with ``digits`` decimals (Python ``f"{x:.2%}"``)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.concat(fixed(c * 100, digits), F.lit("%")))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)
