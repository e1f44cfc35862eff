"""Parameters of the registered queries over the driver fixture (FIXTURES.md)."""

import datetime as dt

# The fixture's reported campaigns, CTAs, patterns and thresholds.
EXPECTED = [
    ("typo", "crm_click_3101", "Talk to an agent", dt.date(2024, 1, 31), 835),
    ("unregistered", "crm_galaxy26", "Buy now", dt.date(2024, 1, 20), 838),
    ("healthy", "crm_click_2001", "Learn more", dt.date(2024, 1, 20), 840),
]
CTAS = [("Buy now", "exact"), ("Talk to an agent", "exact")]
CTAS_MIXED = [("Buy now", "exact"), (r"(?i)^talk\s+to", "regex"), (r"(?i)\bthe\s+of", "regex"), ("(?i)now$", "regex")]
KEYWORDS = [
    ("buy_now", r"(?i)buy\s+now"),
    ("agent", r"(?i)talk\s+to\s+an\s+agent"),
    ("the_of", r"(?i)\bthe\s+of"),
]
CONVERSATION_PATTERN = r"(?i)\bthe\s+of"
CONVERSATION_FLAG = "the_of_found"
LOG_PATTERN = r"(?i)buy\s+now"
LOG_FLAG = "buy_now_found"
SIMILAR_LIST = ["crm_error_0101", "crm_error_2312", "crm_error_at"]
REQUIRED_FIELDS = {"k": "int"}
AS_OF = dt.date(2024, 1, 21)
PERIOD = (dt.date(2024, 1, 5), dt.date(2024, 1, 18))
LATE_CUT, LATE_AFTER = dt.datetime(2024, 1, 16), "1 hour"
ORPHAN_THRESHOLD = 5
ERROR_RATE_THRESHOLD = 2
MAX_EDIT_DISTANCE = 4
TOP_SIMILAR = 3
LOGS_SAMPLE_ROWS = 100
TOP_SESSIONS = 5
JOIN_KEYS = ["message_id", "session_id"]

# Generic operators over the untouched driver tables.
DOCUMENT_KEYWORDS = [
    ("license", r"(?i)licen[cs]e"),
    ("the_of", r"(?i)the\s+of"),
    ("four_digits", r"[0-9]{4}"),
]

# A long keyword list by rule: a word that begins with three syllables before
# one that begins with a fourth (10 x 10 x 10 x 5 patterns).
SYLLABLES = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd"]
HEADS = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]
TAILS = SYLLABLES[::2]
MANY_KEYWORDS = [(f"{a}_{b}", rf"(?i)\b{a}\w*\s+{b}") for a in HEADS for b in TAILS]

# A long CTA list by rule; most lines of the logs hold its common beginning.
MANY_CTAS = [f'"k": {i}' for i in range(20_000)]

# A long list of expected names by rule, all with a beginning in common.
MANY_NAMES = [f"crm_{kind}_{i:04d}" for kind in ("click", "error") for i in range(10_000)]
MANY_EDITS = 2
