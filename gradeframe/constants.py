"""Fixed values.

Everything in this module must equal the original pipeline's values for
results to line up (column names and order, required columns, the Bloom
level names, the labelled-line keys of the judge and labeller formats, the
quota markers, limits and truncation lengths). They are stated plainly, in
their natural order, and used by name elsewhere.
"""

# ---------------------------------------------------------------- fixed values
BLOOM_LEVELS = {
    1: "Remember",
    2: "Understand",
    3: "Apply",
    4: "Analyze",
    5: "Evaluate",
    6: "Create",
}

REQUIRED_QUESTION_COLUMNS = [
    "question_id", "domain", "difficulty", "bloom_level",
    "bloom_name", "question_text", "ground_truth_answer",
]
OPTIONAL_QUESTION_COLUMNS = ["context", "choices_json", "question_type"]
REQUIRED_RESPONSE_COLUMNS = ["response_id", "question_id", "model_name", "response_text"]

RESPONSE_COLUMNS = [
    "response_id", "question_id", "model_name", "response_text",
    "response_time_sec", "token_count", "error", "error_message", "timestamp",
]

SCORE_COLUMNS = [
    "score_id", "response_id", "question_id", "model_name",
    "dataset_name", "dataset_subset", "domain", "difficulty",
    "bloom_level", "bloom_name", "bloom_confidence",
    "question_type", "question_text", "ground_truth_answer",
    "context", "choices_json", "response_text", "response_time_sec",
    "token_count", "error", "error_message", "timestamp",
    "model_version", "temperature",
    "correctness", "completeness", "clarity", "cognitive_alignment",
    "overall_score", "justification",
    "bleu", "rouge1", "rouge2", "rougeL",
    "keyword_precision", "keyword_recall", "keyword_f1",
    "human_validated", "human_score", "human_agreement",
    "bloom_justification", "validation_agreement",
]

# Labelled-line keys the judge answers with (compared exactly).
JUDGE_SCORE_KEYS = ["CORRECTNESS", "COMPLETENESS", "CLARITY", "COGNITIVE_ALIGNMENT"]
JUDGE_OVERALL_KEY = "OVERALL_SCORE"
JUDGE_JUSTIFICATION_KEY = "JUSTIFICATION"
# Labelled-line keys the labeller answers with (compared after trim + upper-case).
LABEL_KEYS = ["LEVEL", "NAME", "CONFIDENCE", "JUSTIFICATION"]

# An error message containing any of these (lower-cased) disables the model.
QUOTA_MARKERS = ["rate_limit", "quota", "429", "credit"]

MCQ_TYPE = "mcq"
KEYWORD_LIMIT = 20          # first N distinct keywords
KEYWORD_MIN_CHARS = 3       # keywords are longer than 2 characters
ID_DIGITS = 6               # resp_000001, score_000001
RESPONSE_ID_PREFIX = "resp_"
SCORE_ID_PREFIX = "score_"
CALL_ERROR_CHARS = 200      # model-call error text kept
JUDGE_ERROR_CHARS = 100     # judge error text kept
LABEL_ERROR_CHARS = 80      # labeller error text kept
RESPONSE_FLUSH_ROWS = 50
SCORE_FLUSH_ROWS = 100
RETRY_ATTEMPTS = 3
RETRY_DELAY_SEC = 5
SKIP_LEXICAL_FOR_MCQ = True
# --------------------------------------------------------- end of fixed values

JUDGE_SUBSCORE_COLUMNS = ["correctness", "completeness", "clarity", "cognitive_alignment"]
LEXICAL_COLUMNS = ["bleu", "rouge1", "rouge2", "rougeL",
                   "keyword_precision", "keyword_recall", "keyword_f1"]
