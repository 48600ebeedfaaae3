"""Patterns, word lists and formats that results depend on."""

from __future__ import annotations

#: A word boundary over ASCII letters, digits and underscore, spelt out: Java's own boundary takes
#: accented letters for word characters. Two-sided, as some patterns can end in a mark.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Entity patterns (with \b for a word boundary).
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\+\d{1,3}[\s-]?\d{4,14}\b|\(\d{3}\)\s?\d{3}[-.\s]\d{4}\b|\b\d{3}[-.]\d{3}[-.]\d{4}\b"
MONEY = r"\$\d{1,3}(?:,\d{3})+(?:\.\d{2})?\b|\$\d+\.\d{2}\b"
CAPITALIZED = r"\b[A-Z][a-zA-Z'&-]*(?:\s+[A-Z][a-zA-Z'&-]*){0,3}\b"
ACRONYM = r"^[A-Z]{2,}$"
ENTITY_PATTERNS = {"EMAIL": EMAIL, "SSN": SSN, "PHONE": PHONE, "MONEY": MONEY}

# Words that a capitalized phrase loses at its start.
STOPWORDS = (
    "I", "The", "A", "An", "This", "That", "These", "Those", "My", "Our", "Your", "His", "Her", "Its", "Their",
    "Please", "Hi", "Hello", "Hey", "Dear", "Thanks", "Thank", "Regards", "Sincerely", "Best",
    "Yes", "No", "Ok", "Okay", "So", "But", "And", "Or", "If", "When", "While", "Because", "However", "Therefore",
    "Also", "Just", "Now", "Today", "Tomorrow", "Yesterday",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
# Last words of organizations, and organizations of one word.
ORG_SUFFIXES = ("Inc", "LLC", "Corp", "Corporation", "Ltd", "Co", "Company", "Group", "Technologies", "Labs", "Systems", "Partners", "Holdings", "Ventures")
KNOWN_ORGS = (
    "Stripe", "Google", "Microsoft", "Apple", "Amazon", "Meta", "OpenAI", "Anthropic", "Salesforce",
    "Netflix", "Airbnb", "Uber", "Lyft", "Shopify", "Square", "PayPal", "Visa", "Mastercard", "Oracle",
    "IBM", "Intel", "Nvidia", "Adobe", "Slack", "Zoom", "Dropbox", "Twilio", "Snowflake", "Palantir",
)
# Person tokens.
GREEK = (
    "Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta", "Iota", "Kappa", "Lambda", "Mu",
    "Nu", "Xi", "Omicron", "Pi", "Rho", "Sigma", "Tau", "Upsilon", "Phi", "Chi", "Psi", "Omega",
)

# Audit categories, label and time formats, bounds.
CATEGORIES = ("identifier", "comment", "string", "secret")
REPO_LABEL = r"^repo_[a-f0-9]{16}$"
SESSION_LABEL = r"^session_[a-f0-9]{16}$"
VALUE_HASH = r"^[a-f0-9]{64}$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?Z$"
MAX_COUNT = 100_000_000
MAX_HASHES = 100_000

# Names and patterns of suspicion rules (case doesn't matter).
SUSPICION_RULES = (
    ("artificial-or-synthetic", r"\b(?:artificial|synthetic|generated|auto[- ]generated)\b"),
    ("obfuscation-or-anonymization", r"\b(?:obfuscat(?:ed|ion)|anonymi[sz](?:ed|ation)|placeholder)\b"),
    ("inconsistent-domain", r"\b(?:domain mismatch|inconsistent(?:ly)?|mixed vocabulary|does not belong)\b"),
    ("strange-or-weird-naming", r"\b(?:strange|weird|odd|unusual|generic)\s+(?:names?|naming|identifiers?)\b"),
    ("missing-or-redacted-comments", r"\b(?:missing|stripped|redacted|removed)\s+(?:comments?|context)\b"),
)

# Prefixes of compact names by kind.
KIND_PREFIX = {"function": "func", "variable": "var", "class": "class", "type": "type", "property": "prop", "string": "str", "literal": "lit"}

# Phrases that stand for comments, by style and length of the original.
PHRASES = {
    ("compact", "short"): ("internal only", "see below", "helper logic", "not user-facing", "todo: revisit"),
    ("compact", "medium"): ("see implementation below", "internal logic, not user-facing", "handles edge cases internally", "utility function, see usage", "kept for backwards compatibility"),
    ("compact", "long"): (
        "additional internal implementation details are handled here", "see the internal implementation for further context",
        "this section contains logic not relevant to the current task", "refactor candidate, revisit when touching this area next",
        "internal helper retained for legacy callers, do not remove",
    ),
    ("stealth", "short"): ("normalizes input", "keeps this local", "handles this case", "sets the value", "shared path"),
    ("stealth", "medium"): ("keeps this path consistent", "normalizes the value before use", "shared behavior for this branch", "keeps related setup together", "handles the surrounding state"),
    ("stealth", "long"): (
        "the remaining details are handled in this section", "this path keeps the surrounding behavior consistent",
        "additional setup is kept close to the call site", "related processing stays contained in this section", "the surrounding flow is kept together here",
    ),
}
SHORT_MOST, MEDIUM_MOST = 20, 45
FINGERPRINT_BASE, FINGERPRINT_MODULUS = 31, 1_000_003

# Strings that are redacted, tokens that aren't, paths.
MIN_STRING = 15
MACHINE_TOKEN = r"^[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)+$"
PATH_FILE = r"(?<![A-Za-z0-9_$])((?:/|\.\.?/|[A-Za-z0-9_-]+/)(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?![A-Za-z0-9_$])"
PATH_DIR = r"(?<![A-Za-z0-9_$])((?:/|\.\.?/|[A-Za-z0-9_-]+/)(?:[A-Za-z0-9_.-]+/)+)(?![A-Za-z0-9_$])"
LINE_PREFIX = r"^\s*\d+\t"
TOOL_FIELDS = {"Edit": ("old_string", "new_string"), "Write": ("content",)}
LABEL_MOST = 60


def java(pattern: str) -> str:
    """A pattern for Spark: word boundaries over ASCII."""
    return pattern.replace(r"\b", BOUNDARY)


def sql_text(value: str) -> str:
    """A SQL literal that keeps backslashes."""
    return "r'" + value.replace("'", "\\'") + "'" if "'" not in value else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
