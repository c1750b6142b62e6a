"""Turn scoring queries over ``conversations`` (flow C as a batch job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import constants as K
from parlance.functions import labels as L
from parlance.functions import scoring as S
from parlance.functions import text as TX
from parlance.operators import turns
from parlance.plans import sqlfrag as Q
from parlance.plans.registry import Tables, plan

# --- shared SQL ------------------------------------------------------------

PAIRS_SQL = """
SELECT u.conv_id, u.turn, u.text AS user_message, a.text AS reply
FROM conversations u
LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""

_LOGITS = Q.lang_logits("c")
_LANGS = sorted(S.LANG_MARKERS)


def _intent_sql() -> str:
    mx = "greatest(" + ", ".join(f"l{i}" for i in range(len(_LANGS))) + ")"
    pick = "CASE " + " ".join(f"WHEN l{i} = {mx} THEN {Q.q(k)}" for i, k in enumerate(_LANGS)) + " END"
    total = " + ".join(f"exp(l{i} - {mx})" for i in range(len(_LANGS)))
    return pick, f"round(1.0 / ({total}), 4)"


_PICK, _ICONF = _intent_sql()

SCORED_SQL = f"""
WITH pairs AS ({PAIRS_SQL}),
cl AS (SELECT *, {Q.clean('user_message')} AS c FROM pairs),
pr AS (SELECT *, {Q.lexicon_p('c')} AS p, {Q.keyword_tokens('c')} AS toks,
              {', '.join(f'{lg} AS l{i}' for i, lg in enumerate(_LOGITS))}
       FROM cl),
base AS (SELECT *, CASE WHEN p > 0.5 THEN 'positive' ELSE 'negative' END AS s0,
                greatest(p, 1.0 - p) AS c0 FROM pr),
ov AS (SELECT *,
         CASE WHEN c0 < {K.OVERRIDE_BELOW} AND {Q.has_any('toks', K.POSITIVE_WORDS)} THEN 'positive'
              WHEN c0 < {K.OVERRIDE_BELOW} AND {Q.has_any('toks', K.NEGATIVE_WORDS)} THEN 'negative'
              ELSE s0 END AS sentiment,
         CASE WHEN c0 < {K.OVERRIDE_BELOW} AND {Q.has_any('toks', K.POSITIVE_WORDS)} THEN {K.OVERRIDE_POSITIVE_CONF}
              WHEN c0 < {K.OVERRIDE_BELOW} AND {Q.has_any('toks', K.NEGATIVE_WORDS)} THEN {K.OVERRIDE_NEGATIVE_CONF}
              ELSE c0 END AS oc
       FROM base),
sc AS (SELECT *, {Q.calibrate('oc')} AS sentiment_confidence,
              {_PICK} AS intent, {_ICONF} AS intent_confidence FROM ov),
es AS (SELECT *, ({Q.escalation_trigger('user_message')}
                  OR (sentiment = 'negative' AND sentiment_confidence > {K.ESCALATION_CONFIDENCE})) AS escalate,
              (reply IS NOT NULL AND length(reply) > {K.REPLY_MIN_LEN}) AS ok_g
       FROM sc)
SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS session_id, user_message, reply,
       sentiment, sentiment_confidence, intent, intent_confidence, escalate,
       CASE WHEN escalate THEN {Q.q(K.ESCALATION_REPLY)} ||
              CAST({K.ESCALATION_ID_LOW} + {Q.bucket("CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)",
                                                      K.ESCALATION_ID_HIGH - K.ESCALATION_ID_LOW)} AS VARCHAR)
            WHEN ok_g THEN reply ELSE {Q.q(K.DEFAULT_REPLY)} END AS response,
       {Q.q(K.MODEL_USED_PREFIX)} || CASE WHEN escalate THEN {Q.q(K.SOURCE_ESCALATION)}
            WHEN ok_g THEN {Q.q(K.SOURCE_GROUNDED)} ELSE {Q.q(K.SOURCE_DEFAULT)} END AS model_used,
       upper(split_part(intent, '_', 1)) AS category
FROM es
"""


def scored_turns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return turns.score_turns(turns.pair_turns(t.conversations))


@plan("turn_scoring", sql=SCORED_SQL, ids=("J4", "T1", "T7", "T8", "T13", "T14", "T15", "T16",
                                          "T17", "T18", "T21", "T26", "T11", "M7", "M8"))
def turn_scoring(spark, sf_dir):
    return scored_turns(spark, sf_dir)


@plan("turn_pairs", sql=PAIRS_SQL, ids=("J4",))
def turn_pairs(spark, sf_dir):
    return turns.pair_turns(Tables(spark, sf_dir).conversations)


ESCALATION_SQL = f"""
SELECT conv_id, turn,
       {Q.escalation_trigger('text')} AS trigger_substring,
       {Q.escalation_trigger('text', word_boundary=True)} AS trigger_word
FROM conversations WHERE role = 'user'
"""


@plan("escalation_flags", sql=ESCALATION_SQL, ids=("T7", "T6"))
def escalation_flags(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    return c.select("conv_id", "turn",
                    TX.escalation_trigger("text").alias("trigger_substring"),
                    TX.escalation_trigger("text", word_boundary=True).alias("trigger_word"))


OVERRIDE_SQL = f"""
WITH cl AS (SELECT conv_id, turn, {Q.clean('text')} AS c FROM conversations WHERE role = 'user'),
tk AS (SELECT *, {Q.keyword_tokens('c')} AS toks, {Q.lexicon_p('c')} AS p FROM cl)
SELECT conv_id, turn, len(toks) AS n_tokens,
       {Q.has_any('toks', K.POSITIVE_WORDS)} AS has_positive,
       {Q.has_any('toks', K.NEGATIVE_WORDS)} AS has_negative,
       round(p, 6) AS p_positive
FROM tk
"""


@plan("keyword_override", sql=OVERRIDE_SQL, ids=("T8", "U3", "T15"))
def keyword_override(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.where(F.col("role") == "user")
    c = c.select("conv_id", "turn", TX.clean_text("text").alias("c"))
    toks = TX.keyword_tokens("c")
    return c.select("conv_id", "turn", F.size(toks).alias("n_tokens"),
                    TX.has_any(toks, K.POSITIVE_WORDS).alias("has_positive"),
                    TX.has_any(toks, K.NEGATIVE_WORDS).alias("has_negative"),
                    F.round(S.lexicon_positive_probability("c"), 6).alias("p_positive"))


CALIBRATED_SQL = f"""
SELECT conv_id, turn, sentiment, sentiment_confidence, escalate,
       sentiment_confidence > {K.ESCALATION_CONFIDENCE} AS above_threshold
FROM ({SCORED_SQL}) s
"""


@plan("sentiment_calibrated", sql=CALIBRATED_SQL, ids=("T13", "T14", "T16", "T17"))
def sentiment_calibrated(spark, sf_dir):
    s = scored_turns(spark, sf_dir)
    return s.select("conv_id", "turn", "sentiment", "sentiment_confidence", "escalate",
                    (F.col("sentiment_confidence") > K.ESCALATION_CONFIDENCE).alias("above_threshold"))


REPLY_SQL = f"""
WITH p AS ({PAIRS_SQL})
SELECT conv_id, turn,
       {Q.strip_ws(f"string_split_regex({Q.strip_ws('reply')}, {Q.q(TX.SENTENCE_END)})[1]")} AS first_sentence,
       'Customer: ' || user_message || ' Support:' AS prompt_plain,
       'Customer: ' || user_message || ' Context: ' ||
         {Q.strip_ws(f"string_split_regex({Q.strip_ws('reply')}, {Q.q(TX.SENTENCE_END)})[1]")} || ' Support:' AS prompt_grounded,
       string_split(reply, 'Support:')[-1] AS after_marker
FROM p WHERE reply IS NOT NULL
"""


@plan("reply_prompts", sql=REPLY_SQL, ids=("T9", "T10", "T19", "T24"))
def reply_prompts(spark, sf_dir):
    p = turns.pair_turns(Tables(spark, sf_dir).conversations).where(F.col("reply").isNotNull())
    fs = TX.first_sentence("reply")
    return p.select("conv_id", "turn", fs.alias("first_sentence"),
                    TX.prompt("user_message").alias("prompt_plain"),
                    TX.prompt("user_message", fs).alias("prompt_grounded"),
                    TX.text_after("reply", "Support:").alias("after_marker"))


# --- T20: training text ------------------------------------------------------------

@plan("training_text", sql=f"""
SELECT conv_id, turn,
       {Q.chat_text('user_message', 'reply', K.CHAT_SYSTEM_FULL)} AS chat_text_full,
       {Q.chat_text('user_message', 'reply', K.CHAT_SYSTEM_SHORT)} AS chat_text,
       {Q.dialogue_text('user_message', 'reply')} AS dialogue_text
FROM ({PAIRS_SQL}) WHERE user_message IS NOT NULL AND reply IS NOT NULL
""", ids=("T20",))
def training_text(spark, sf_dir):
    """Every (user turn, reply) pair as fine-tuning text, in the two chat-template
    variants and the ``Customer: … Support: …`` dialogue form."""
    p = turns.pair_turns(Tables(spark, sf_dir).conversations).where(
        F.col("user_message").isNotNull() & F.col("reply").isNotNull())
    return p.select("conv_id", "turn",
                    TX.chat_text("user_message", "reply", K.CHAT_SYSTEM_FULL).alias("chat_text_full"),
                    TX.chat_text("user_message", "reply", K.CHAT_SYSTEM_SHORT).alias("chat_text"),
                    TX.dialogue_text("user_message", "reply").alias("dialogue_text"))
