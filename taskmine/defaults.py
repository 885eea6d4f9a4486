"""Thresholds, word lists, patterns and text formats of the jobs.

Everything in this module is a fixed value: results only agree with existing
data sets when these are exactly as written. Thresholds, lists and patterns are
defaults of keyword arguments. Numbers that cut something off (MAX_*, *_PER_*,
and the sets of them in *_LIMITS) are not: nothing is cut unless a job passes them.
"""

# --- fixed values: repository screening ---------------------------------
MIN_STARS = 5000
RANK_START = 100
RANK_END = 200
EXCLUDED_TOPICS = [
    "tutorial", "beginner", "example", "course", "boilerplate", "book", "awesome",
    "books", "education", "learning", "demo", "starter", "guide",
]
BOT_USERS = [
    "github-actions[bot]", "dependabot[bot]", "renovate[bot]", "greenkeeper[bot]",
]

# --- fixed values: releases ---------------------------------------------
MIN_RELEASES = 5
MIN_RELEASE_BODY_LENGTH = 50
MIN_RELEASE_DATE = "2024-06-01"
RELEASES_PER_REPO = 30
RELEASES_PER_API_PAGE = 30
PRE_RELEASE = r"(alpha|beta|rc|a\d+|b\d+)"
VERSION_NUMBER = r"\d+(?:\s*[.\-_]\s*\d+){0,3}"
VERSION_SEPARATOR = r"\s*[.\-_]\s*"

# --- fixed values: what counts as a test file ---------------------------
TEST_DIRECTORIES = ["test", "tests", "testing", "spec", "specs"]
TEST_FILE_PATTERNS = [r"test_.*\.py$", r".*_test\.py$", r".*_spec\.py$", r"conftest\.py$"]
PATCH_TEST_PATTERNS = [
    r"test.*\.py$", r".*test\.py$", r".*_test\.py$", r".*/test[s]?/.*\.py$",
    r".*/testing/.*\.py$",
]
README_NAMES = ["readme.md", "readme.rst", "readme.txt", "readme"]
WORKFLOW_DIR = ".github/workflows"
TEST_RUN_DIRECTORIES = ["tests", "test", "Tests", "TESTS", "unit_tests", "TEST"]
TEST_RUN_IGNORED = [".venv", "build"]
TEST_RUN_FALLBACK = "tests"
DEFAULT_PYTHON_VERSION = "3.9"

# --- fixed values: prompts and summaries --------------------------------
MAX_README_LENGTH = 2000
README_SUFFIX = "...(truncated)"
MAX_FILES_IN_SUMMARY = 50
MAX_PATCH_LENGTH = 1000
MAX_PATCH_PREVIEW = 600
SUMMARY_LIMITS = {"max_files": MAX_FILES_IN_SUMMARY, "max_patch": MAX_PATCH_LENGTH, "max_preview": MAX_PATCH_PREVIEW}
NO_FILES_TEXT = "No files were modified in this PR."
PR_URL = "https://github.com/{repo}/pull/{number}"

# --- fixed values: test logs --------------------------------------------
SUMMARY_MARKER = "short test summary info"
STATUSES = ["PASSED", "FAILED", "SKIPPED", "ERROR", "UNKNOWN"]
RESULT_LINE = r"(?dU)^(PASSED|FAILED|SKIPPED|ERROR)\s+(.+?)(?:\s-\s.*)?$"
RESULT_START = r"(?U)^(PASSED|FAILED|SKIPPED|ERROR)\s"
ANSI_COLOUR = r"\x1b\[[0-9;]*m"
TOKENS_MARKER = "Execution Summary"
TOKENS_LINE = "│ Total Tokens"
TOKENS_VALUE = r"│ Total Tokens\s*│\s*(\d+)"

# --- fixed values: test runs and selection ------------------------------
MAX_SPECS_PER_REPO = 100
MAX_COMMAND_CHARS = 100_000
TESTS_PER_BATCH = 250
BATCH_LIMITS = {"max_chars": MAX_COMMAND_CHARS, "batch_size": TESTS_PER_BATCH}
TEST_COMMAND = (
    "python3 -m pytest -q -rA --tb=no -p no:pretty --timeout=5 "
    "--continue-on-collection-errors --timeout-method=signal"
)
TEST_COMMAND_PARALLEL = (
    "pip install pytest-xdist && python3 -m pytest -q -rA --tb=no -p no:pretty "
    "--timeout=5 --continue-on-collection-errors --timeout-method=thread -n auto"
)

# --- fixed values: white space that Python's str.strip() removes ---------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
