"""Fixed values.

Values that must equal the reference's behaviour for identical results, stated
together and in plain text.  Everything else in the package (templates, report
advice lines, block sizes, algorithms) is our own design.
"""

# ---------------------------------------------------------------- fixed values
# Text cleanup: Arabic diacritics U+0617..U+061A and U+064B..U+0652 are removed
# from indexed body text; "strip" removes what Python's str.isspace() matches.
DIACRITICS_RE = r"[\x{0617}-\x{061A}\x{064B}-\x{0652}]+"
PY_SPACE_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}"
                  r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Answering: the refusal sentence the answer prompt asks for.
REFUSAL_SENTENCE = "أنا آسف، ليس لدي المعلومات لذلك. يرجى استشارة عالم مؤهل."

# Harvested pages: question/answer markers (tried in this order) and the text
# stored when a lecture page has no content block.
ANSWER_MARKER = "الجواب"
ANSWER_MARKER_ALT = "أما بعد"
CONTENT_NOT_FOUND = "Lecture content not found."

# Nested lectures: root of the walk path, path separator, metadata defaults.
ROOT_PATH = "ROOT"
PATH_SEPARATOR = " > "
LECTURE_FIELDS = ["lecture_title", "lecture_url", "content", "path", "title"]
SECTION_TITLE = "\nTitle: "
SECTION_URL = "\nURL: "
NO_TITLE = "NoTitle"
NO_URL = "NoURL"

# Numbered source list defaults.
SOURCE_NO_URL = "No URL"
SOURCE_NO_PATH = "NoPath"

# Q&A synthesis: fence characters stripped from completions, minimum answer
# length, near-duplicate ratio (strictly greater), caps, token budget, types.
FENCE_CHARS = "`json"
MIN_ANSWER_LENGTH = 40
NEAR_DUP_RATIO = 0.85
MAX_PER_LIST = 2
MAX_PER_CATEGORY = 20
MAX_TOTAL = 100
TOKEN_BUDGET = 1_000_000
QUESTION_TYPES = ["General"]

# Index build: chunk size and overlap (characters), embedding batch size.
CHUNK_SIZE = 8096
CHUNK_OVERLAP = 200
EMBED_BATCH = 100

# Evaluation report: headings and labels of a dataset's text block.
REPORT_TITLE = "=== Evaluation for %s ==="
REPORT_COUNTS = ("Total samples", "Correct", "Incorrect", "Unknown")
REPORT_ACCURACY = "Accuracy"
REPORT_CORRECT = "Some correct examples:"
REPORT_INCORRECT = "Some incorrect examples:"
REPORT_RULE = "-------------------"
REPORT_EXAMPLE = "Q: %s\nReference: %s\nModel: %s\n"

# Retrieval, evaluation report, harvest.
NEIGHBOURS = 6
EXAMPLES_PER_LABEL = 3
LINKS_PER_CATEGORY = 5
# -----------------------------------------------------------------------------
