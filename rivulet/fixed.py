"""Fixed values the engine must share with the original application.

FIXED VALUES — these must stay equal to the original application's for
results to match.  They are listed here plainly, together, in natural order.
"""

# --- fixed values: limits -------------------------------------------------
MAX_SUMMARY_SENTENCES = 20
MAX_SUMMARY_CHARACTERS = 2000
QUEUE_MESSAGE_LIMIT_BYTES = 64 * 1024
TEXT_PREVIEW_CHARS = 100

# --- fixed values: defaults ----------------------------------------------
FEED_PARTITION_KEY = "feed"
ENTRY_PARTITION_KEY = "entry"
DEFAULT_TITLE = "Untitled"
DEFAULT_SUMMARY = "No Summary Available"
DEFAULT_CONTENT = "No Content Available"
DEFAULT_AUTHOR = "Unknown Author"
DEFAULT_PUBLISHED_TEXT = "1970-01-01T00:00:00Z"
DEFAULT_SENTIMENT = "Neutral"
ERROR_SENTIMENT = "Error"
MISSING_CONTENT_SENTINEL = "\ue000"  # U+E000, private use

# --- fixed values: enumerations ------------------------------------------
SENTIMENT_LABELS = ["Positive", "Negative", "Neutral", "Mixed"]
ENGAGEMENT_CATEGORIES = ["Liked", "Comment", "Shared"]
DRAFT_STATUSES = ["Draft", "Edited", "Approved", "Posted"]
TRUE_WORDS = ["true", "t", "yes", "1"]
FALSE_WORDS = ["false", "f", "no", "0"]
ENVELOPE_ENQUEUED = "enqueued"
ENVELOPE_RETRIEVED = "retrieved"

# --- fixed values: patterns ----------------------------------------------
KEY_PATTERN = r"^[a-zA-Z0-9_-]+$"
FEED_KEY_PATTERN = r"^[a-f0-9]{16}$"
LANGUAGE_PATTERN = r"^[a-z]{2}(?:-[a-zA-Z]{2})?$"

# --- fixed values: engagement weights (likes, shares, comments) ------------
ENGAGEMENT_WEIGHTS = (0.4, 0.4, 0.2)

# --- fixed values: readability formula constants -------------------------
READABILITY_BASE = 206.835
READABILITY_WORDS_PER_SENTENCE = 1.015
READABILITY_CHARS_PER_WORD = 84.6

# --- fixed values: prompts ------------------------------------------------
SUMMARY_SYSTEM_PROMPT = "Improve this short summary for clarity and engagement, keeping it concise."
SENTIMENT_SYSTEM_PROMPT = (
    "Analyze the sentiment of this text. Categorized it as one of "
    "Positive, Negative, Neutral, or Mixed and return a score between -1 and 1. "
    "Output should be in the format: { \"sentiment\": \"Positive\", \"score\": 0.8 }."
)
ENGAGEMENT_SYSTEM_PROMPT = "You are an assistant that summarizes text and provides engagement scores."
ENGAGEMENT_USER_TEMPLATE = (
    "Summarize the following text and provide a numerical engagement score (1-10) "
    "based on how interesting it might be:\n\n{content_text}\n\n"
    "Respond in JSON format with keys: summary, score."
)
SUMMARY_MAX_TOKENS = 50
SENTIMENT_MAX_TOKENS = 20

# --- fixed values: the 15 list columns, in list order ----------------------
LIST_COLUMNS = [
    "Title", "URL", "Summary", "Entry_ID", "Published_Date", "Full_Content",
    "Categories", "Author", "Keywords", "Sentiment", "Readability_Score",
    "Engagement_Score", "Processed", "Engagement_Type", "Response_Received",
]

# --- fixed values: the 13 frame columns, in frame order --------------------
FRAME_COLUMNS = [
    "Title", "URL", "Summary", "Entry_ID", "Published_Date", "Full_Content",
    "Categories", "Author", "Embeddings", "Sentiment", "Sentiment_Score",
    "Readability_FK", "Readability_DC",
]

# --- fixed values: enrichment ranges -------------------------------------
GRADE_LEVEL_RANGE = (0.0, 15.0)
DIFFICULTY_RANGE = (4.9, 11.0)
ENGAGEMENT_SCORE_RANGE = (0.0, 10.0)
REPLY_SCORE_RANGE = (1.0, 10.0)

# --- fixed values: list schema rules (display name, type, nullable, allowed, range)
LIST_SCHEMA = {"fields": [
    {"display_name": "Title", "type": "Single Line of Text", "nullable": False},
    {"display_name": "URL", "type": "Hyperlink", "nullable": False},
    {"display_name": "Summary", "type": "Multiple Lines of Text", "nullable": True},
    {"display_name": "Entry_ID", "type": "Single Line of Text", "nullable": False},
    {"display_name": "Published_Date", "type": "Date and Time", "nullable": False},
    {"display_name": "Full_Content", "type": "Multiple Lines of Text", "nullable": True},
    {"display_name": "Categories", "type": "Choice (Multi-select)", "nullable": True},
    {"display_name": "Author", "type": "Single Line of Text", "nullable": True},
    {"display_name": "Keywords", "type": "Single Line of Text", "nullable": True},
    {"display_name": "Sentiment", "type": "Choice (Single-select)", "nullable": False,
     "allowed_values": ["Positive", "Neutral", "Negative", "Mixed"]},
    {"display_name": "Readability_Score", "type": "Number", "nullable": False, "range": [0.0, 100.0]},
    {"display_name": "Engagement_Score", "type": "Number", "nullable": False, "range": [0, 1000]},
    {"display_name": "Processed", "type": "Yes/No (Boolean)", "nullable": False},
    {"display_name": "Engagement_Type", "type": "Choice (Multi-select)", "nullable": True,
     "allowed_values": ["Shared", "Liked", "Commented"]},
    {"display_name": "Response_Received", "type": "Yes/No (Boolean)", "nullable": False},
]}
