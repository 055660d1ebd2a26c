"""Fixed values that must equal the original system's for identical results.

Everything here is stated plainly, in natural order; the code that uses these
values lives elsewhere.
"""

# --- Fixed values: capture admission and extraction limits ---------------------------
MIN_CAPTURE_LENGTH = 5000          # header length below this -> "TooSmall"
MIN_CONVERTED_BYTES = 100          # converted output must be longer than this
MAX_RECORD_BYTES = 10_000_000      # larger records -> "TooLong"
MAX_PAGES = 100                    # optional limit: pages analysed
SECTION_PAGES = 2                  # optional limit: pages at the end that hold the references

# --- Fixed values: title scoring and acceptance ----------------------------------------
TITLE_TOP_ANCHOR = 100             # vertical anchor of the title score
TITLE_CENTER_ANCHOR = 400          # horizontal anchor of the title score
TITLE_CANDIDATES = 5               # candidates tried, best score first
TITLE_MIN_LEN_EXCLUSIVE = 10       # accepted when 10 < length < 150
TITLE_MAX_LEN_EXCLUSIVE = 150
SHORT_TITLE_LEN = 5                # "ShortTitle" counter when length < 5

# --- Fixed values: year extraction ------------------------------------------------------
YEAR_LOW_EXCLUSIVE = 1990          # years accepted when 1990 < y < 2013
YEAR_HIGH_EXCLUSIVE = 2013

# --- Fixed values: inversion, test set, evaluation, learning, search -----------------
INVERT_VALUES_PER_KEY = 1000
TEST_SET_MIN_INCOMING = 20
TEST_SET_MAX_INCOMING = 100
EVAL_FOCUS_DOCS = 50
EVAL_LIST_LENGTH = 1000
EVAL_N_FROM = 10                   # recall sweep N = 10 .. 99 (end excluded)
EVAL_N_UNTIL = 100
NB_NEGATIVES_PER_DOC = 50
NB_LABELS = ("good-cite", "bad-cite")
SEARCH_CANDIDATES = 100            # hits fetched per shard
SEARCH_KEEP = 5                    # results kept per shard
SHARDS = 100                       # reducers of the indexing job
HISTOGRAM_LOG_BASE = 1.1

# --- Fixed values: citation parser keyword tables -------------------------------------
# (the original writes the first three conference words with a backslash before the full stop, so that no token equals
# them; here they are the words that were meant)
KEY_WORDS = ("and", "or", "the", "if", "our")
CONFERENCE_WORDS = ("proc.", "inc.", "pp.", "proceedings", "conference", "acm", "ieee", "usenix")

# --- Fixed values: English stop words of the standard analyzer -------------------------
ENGLISH_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into",
    "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then",
    "there", "these", "they", "this", "to", "was", "will", "with",
)
