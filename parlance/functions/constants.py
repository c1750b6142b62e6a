"""Fixed values the operators need.

Values that must equal the reference application's for equal results are
listed together here, in their natural order, as plain text.
"""

# --- fixed values (must equal the reference application's) -----------------

# Escalation phrases, matched as substrings of the lower-cased message.
ESCALATION_TRIGGERS = [
    "angry", "furious", "terrible", "awful", "disgusting", "horrible",
    "unacceptable", "fraud", "scam", "lawsuit", "legal", "worst",
    "hate", "ridiculous", "useless", "incompetent", "never again",
]

# Keyword override of a low-confidence sentiment prediction.
POSITIVE_WORDS = ["thank", "happy", "great", "love", "excellent", "amazing", "good", "wonderful"]
NEGATIVE_WORDS = ["angry", "furious", "terrible", "awful", "hate", "worst", "horrible", "disgusting"]
OVERRIDE_BELOW = 0.6
OVERRIDE_POSITIVE_CONF = 0.85
OVERRIDE_NEGATIVE_CONF = 0.90

# Confidence calibration and escalation threshold.
CALIBRATION_FACTOR = 1.15
CALIBRATION_CAP = 0.99
CALIBRATION_DIGITS = 4
INTENT_DIGITS = 4
ESCALATION_CONFIDENCE = 0.85

# Retrieval: nearest corpus instruction.
RETRIEVAL_MIN_SIM = 0.05
REPLY_MIN_LEN = 10

# Reply sources and texts.
SOURCE_GROUNDED = "GPT-2 + Dataset Context"
SOURCE_GENERATED = "GPT-2 Fine-tuned"
SOURCE_DEFAULT = "Default"
SOURCE_ESCALATION = "Escalation System"
MODEL_USED_PREFIX = "Intent: DistilBERT | Response: "
DEFAULT_REPLY = "I am here to help! Could you provide more details?"
ESCALATION_REPLY = (
    "I sincerely apologize for the frustration. "
    "I'm escalating your case to a senior support agent "
    "who will contact you within 1 hour. "
    "Reference ID: ESC-"
)
ESCALATION_ID_LOW = 10000
ESCALATION_ID_HIGH = 99999  # exclusive

# Sentiment codes of the conversation log (retrain step).
SENTIMENT_CODES = {"negative": 0, "neutral": 1, "positive": 2}

# TF-IDF for the classifiers.
TFIDF_MAX_TERMS = 5000
TFIDF_MIN_DF = 2
TFIDF_NGRAMS = (1, 2)

# Splits and samples.
SEED = 42
TEST_FRACTION = 0.2
POSITIONAL_TRAIN_FRACTION = 0.9
SIMILARITY_SAMPLES = 10
SIMILARITY_PASS = 0.6

# Length-bounded corpus filters: (max response length, max instruction length).
LENGTH_STRICT = (300, 150)
LENGTH_RELAXED = (800, 300)

# Training-log loss limits.
LOSS_LIMIT = 10.0
LOSS_LIMIT_RELAXED = 15.0

# Dashboard.
DASHBOARD_ROWS = 20
PREVIEW_CHARS = 50
TOP_CLASSES = 10

# Model settings.
LR_C = 1.0
LR_MAX_ITER = 1000
LR_TOL = 1e-4  # the reference's solver default stopping tolerance
DT_MAX_DEPTH = 20
DT_MIN_LEAF = 2
CV_FOLDS = 5
GRID_FOLDS = 3
LR_GRID_C = [0.01, 0.1, 1, 10]
DT_GRID_DEPTH = [10, 20, 30]
DT_GRID_LEAF = [1, 2, 4]

# Training-text templates: system prompts of the two chat-template variants,
# the dialogue form's end-of-text token, and the similarity report's labels.
CHAT_SYSTEM_FULL = "You are a helpful customer support assistant for an e-commerce platform."
CHAT_SYSTEM_SHORT = "You are a helpful e-commerce customer support assistant."
EOS_TOKEN = "<|endoftext|>"
SIMILARITY_TARGET = "60-70%"
STATUS_PASSED = "\u2705 PASSED"
STATUS_BELOW = "\u26a0\ufe0f Below target"

# Report digits: metrics with 4 decimals, percentages with 2.
METRIC_DIGITS = 4
PERCENT_DIGITS = 2

# --- public values (not from the reference) --------------------------------

# Training rows per partition for iterative Spark ML fits.
ML_ROWS_PER_PARTITION = 50_000
# Rows that are worth a task of their own while cores are idle.
ML_LEAST_ROWS_PER_TASK = 5_000
# A tree's pass reads all terms of a row, present or not: a row costs some 25 times as much.
ML_TREE_ROWS_PER_PARTITION = 2_000
# Up to so many rows Spark's own tree, with fewer jobs a level, is the faster one.
ML_DENSE_TREE_ROWS = 2_000

# Largest counted class dimension joined by broadcast.
DIMENSION_BROADCAST_ROWS = 100_000


# Python's str.isspace() set, as a regex character-class body usable by both
# Java regex (Spark) and RE2 (DuckDB). Java's \s lacks U+001C..U+001F.
PY_WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Spark's English stop-word list (StopWordsRemover default); a parameter of
# stopword_ratio, as the reference's own list is downloaded at run time.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he "
    "him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can "
    "will just don should now i'll you'll he'll she'll we'll they'll i'd you'd "
    "he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't "
    "doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot "
    "could here's how's let's ought that's there's what's when's where's who's "
    "why's would"
).split()

# Keys of turns and training rows: numbers padded to the digits a 64-bit one can
# have, training rows led by their source (dataset rows sort before user rows).
ID_DIGITS = 20
DATASET_ID_PREFIX = "dataset:"
USER_ID_PREFIX = "user:"
# Fits of a cross-validation that run side by side.
CV_PARALLELISM = 8
# A class counts as well recognised from this F1 on.
GOOD_F1 = 0.7
# What a request without a session or a user name gets; the answer to a request
# for results that were not stored.
DEFAULT_SESSION = "default"
DEFAULT_USER = "Customer"
MISSING_RESULTS = "Results not found"

# Message intake.
INTAKE_DELAY = "1 day"  # how late a message may come
REPLY_WITHIN = "1 hour"
DASHBOARD_WINDOW = "1 day"
SKETCH_BITS = 12
FEED_START = 1_704_067_200  # 2024-01-01, first minute of the derived message feed
FEED_MINUTES = 14 * 24 * 60
CLOSING_SESSION = "~closing"
COMPACTED_BYTES = 128 << 20
