"""DuckDB twins of the column functions, used by the oracle SQL catalogue.

Each function takes a SQL expression and returns a SQL expression that
computes what the same-named Spark function computes.
"""

from __future__ import annotations

from parlance.functions import constants as K
from parlance.functions import scoring as S
from parlance.functions.text import KEYWORD_TOKEN, NON_KEPT_CHARS, URL_PATTERN, WS_RUN, WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def padded(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {K.ID_DIGITS}, '0')"


#: Key of a turn, see ``turns.turn_id``.
TURN_ID = f"({padded('conv_id')} || ':' || {padded('turn')})"


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), {q(URL_PATTERN)}, '', 'g'), "
            f"{q(NON_KEPT_CHARS)}, '', 'g'), {q(WS_RUN)}, ' ', 'g'))")


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split({x}, ' ') END)"


def word_count(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)::INTEGER"


def has_char(x: str, ch: str) -> str:
    return f"(strpos({x}, {q(ch)}) > 0)::INTEGER"


def stopword_ratio(x: str, stopwords=None) -> str:
    stop = str_list(dict.fromkeys(stopwords or K.ENGLISH_STOPWORDS))
    w = words(x)
    return f"(len(list_filter({w}, lambda t: list_contains({stop}, t))) / (len({w}) + 1))"


def keyword_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {q(KEYWORD_TOKEN)}))"


def n_overlap(tokens: str, items) -> str:
    return f"len(list_intersect({tokens}, {str_list(items)}))"


def has_any(tokens: str, items) -> str:
    return f"list_has_any({tokens}, {str_list(items)})"


def escalation_trigger(x: str, word_boundary: bool = False) -> str:
    alt = "|".join(p.lower() for p in K.ESCALATION_TRIGGERS)
    pat = f"\\b(?:{alt})\\b" if word_boundary else alt
    return f"coalesce(regexp_matches(lower({x}), {q(pat)}), false)"


def lexicon_p(clean_x: str) -> str:
    w = S.LEXICON_WEIGHTS
    toks = keyword_tokens(clean_x)
    z = (f"({w['bias']} + {w['lexicon']} * ({n_overlap(toks, K.POSITIVE_WORDS)} - "
         f"{n_overlap(toks, K.NEGATIVE_WORDS)}) + {w['exclaim']} * {has_char(clean_x, '!')} "
         f"+ {w['question']} * {has_char(clean_x, '?')} + {w['stop']} * ({stopword_ratio(clean_x)} - {w['stop_mid']}))")
    return f"(1.0 / (1.0 + exp(-{z})))"


def lang_logits(clean_x: str) -> list[str]:
    w = words(clean_x)
    out = []
    for k in sorted(S.LANG_MARKERS):
        markers = str_list(S.LANG_MARKERS[k])
        out.append(f"({S.LANG_SCALE} * len(list_filter({w}, lambda t: list_contains({markers}, t))) / (len({w}) + 1))")
    return out


def bucket(key_sql: str, modulus: int, seed: int | None = None) -> str:
    k = f"CAST({key_sql} AS VARCHAR)"
    if seed is not None:
        k = f"({q(f'{seed}:')} || {k})"
    return f"(('0x' || substr(md5({k}), 1, 8))::BIGINT % {modulus})"


def calibrate(c: str) -> str:
    return f"round(least({c} * {K.CALIBRATION_FACTOR}, {K.CALIBRATION_CAP}), {K.CALIBRATION_DIGITS})"


def preview(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def chat_text(instr: str, resp: str, system: str = K.CHAT_SYSTEM_SHORT) -> str:
    return (f"({q(f'<|system|>' + chr(10) + system + chr(10) + '</s>' + chr(10) + '<|user|>' + chr(10))} || {instr} || "
            f"{q(chr(10) + '</s>' + chr(10) + '<|assistant|>' + chr(10))} || {resp} || {q(chr(10) + '</s>')})")


def dialogue_text(instr: str, resp: str, eos: str = K.EOS_TOKEN) -> str:
    return f"('Customer: ' || {instr} || ' Support: ' || {resp} || {q(eos)})"


def fixed(x: str, digits: int = K.METRIC_DIGITS) -> str:
    scale = 10 ** digits
    return f"printf('%.{digits}f', floor(({x}) * {scale} + 0.5) / {scale})"


def percent(x: str, digits: int = K.PERCENT_DIGITS) -> str:
    return f"({fixed(f'({x}) * 100', digits)} || '%')"
