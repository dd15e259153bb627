"""Word lists, markers and text patterns.

Every value in this module is a fixed value that must stay as it is for
results to agree with the behaviour we reproduce. The patterns use Unicode
classes when they run on Spark (see ``functions.text.java``).
"""

from __future__ import annotations

# --- fixed values: table layout ------------------------------------------------
REQUIRED_COLUMNS = ["email_id", "subject", "body"]
OPTIONAL_COLUMNS = ["category", "sentiment", "tone", "sender", "recipient", "created_at"]

# --- fixed values: line patterns -----------------------------------------------
GREETING_LINE = r"^\s*(hi|hello|hey|dear|greetings|good\s+(morning|afternoon|evening))\b[^\n]*"

CLOSING_LINES = [
    r"\b(best|kind|warm|sincere)\s+(regards|wishes)\b[^\n]*",
    r"\b(regards|cheers|thanks|thank\s+you|thanks\s+a\s+lot|sincerely|respectfully)\b[^\n]*",
    r"\b(yours\s+truly|yours\s+faithfully|talk\s+soon)\b[^\n]*",
]

SIGNATURE_LINES = [
    r"^--\s*$",
    r"^\s*sent\s+from\s+my\s+\w+",
    r"^\s*get\s+outlook\s+for\s+\w+",
    r"^\s*confidentiality\s+notice",
    r"^\s*this\s+email\s+(and\s+any\s+attachments\s+)?is\s+confidential",
    r"^\s*disclaimer\s*:",
]

QUOTE_LINES = [
    r"^\s*on\s+\w+,\s+\w+\s+\d+,\s+\d{4}.*?wrote:\s*$",
    r"^\s*from:\s+.*$",
    r"^\s*sent:\s+.*$",
    r"^\s*to:\s+.*$",
    r"^\s*subject:\s+.*$",
    r"^\s*-+\s*original\s+message\s*-+",
    r"^\s*>.*$",
]

TRACKING_PATTERNS = [
    r"https?://(?:[^\s]+?(?:track|click|utm_|mailtrack|sendgrid|mailchimp)[^\s]*)",
    r"\[image:[^\]]+\]",
    r"unsubscribe\s+here.*$",
]

# --- fixed values: placeholder slots a mail could expose -------------------------
PLACEHOLDER_SLOTS = {
    "recipient_name": [r"\b(dear|hi|hello|hey)\s+([A-Z][a-z]+)\b"],
    "sender_name": [r"\b(regards|sincerely|thanks),?\s+\n?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"],
    "company_name": [r"\b(at|from|of)\s+([A-Z][A-Za-z&\.\s]{2,30}(?:Inc|LLC|Ltd|Corp|Co\.))\b"],
    "date": [
        r"\b(?:on\s+)?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
        r"\b(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})\b",
        r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    ],
    "deadline": [r"\bby\s+(end\s+of\s+\w+|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+\s+\d{1,2})\b"],
}

# --- fixed values: action words --------------------------------------------------
ACTION_WORDS = [
    "review", "approve", "confirm", "schedule", "reschedule", "send", "share", "submit",
    "complete", "update", "follow up", "respond", "reply", "join", "attend", "sign", "pay",
    "invoice", "deliver", "ship", "ship out", "investigate", "resolve", "escalate", "verify",
    "check",
]

# --- fixed values: intent rules, first hit wins ----------------------------------
INTENT_RULES = [
    ("complaint", ["complain", "unacceptable", "frustrated", "unhappy", "issue with"]),
    ("apology", ["apologi", "sorry for", "regret"]),
    ("confirmation", ["confirm", "confirmation", "received", "acknowledge"]),
    ("follow_up", ["follow up", "following up", "checking in", "any update"]),
    ("request", ["could you", "would you", "please", "request", "kindly"]),
    ("scheduling", ["meeting", "calendar", "schedule", "reschedule", "availability"]),
    ("invoice", ["invoice", "payment", "billing", "amount due"]),
    ("introduction", ["introduce", "introduction", "nice to meet"]),
    ("announcement", ["announcement", "we are excited", "pleased to announce"]),
    ("thank_you", ["thank you", "thanks for", "appreciate"]),
]
DEFAULT_INTENT = "general"

# --- fixed values: formality markers, formal before casual -----------------------
FORMAL_STYLE = [
    "dear", "sincerely", "kind regards", "respectfully", "to whom it may concern",
    "yours faithfully",
]
CASUAL_STYLE = ["hey ", "yo ", "thx", "cheers", "lol", "btw", "asap"]

# --- fixed values: sentiment and tone markers ------------------------------------
POSITIVE_WORDS = [
    "thanks", "thank you", "appreciate", "grateful", "great", "excellent", "wonderful", "love",
    "excited", "happy", "pleased", "amazing", "perfect", "fantastic", "looking forward",
]
NEGATIVE_WORDS = [
    "unhappy", "frustrated", "disappointed", "angry", "upset", "bad", "terrible", "awful",
    "unacceptable", "issue", "problem", "delay", "broken", "complaint", "sorry", "apolog",
    "mistake", "fail",
]
# the order of the tones is the tie order
TONE_MARKERS = {
    "urgent": [
        "urgent", "asap", "immediately", "critical", "today", "deadline", "time-sensitive",
    ],
    "apologetic": ["apolog", "sorry for", "regret"],
    "complaint": ["complaint", "complain", "unacceptable", "frustrat", "issue with"],
    "follow_up": ["follow up", "following up", "circling back", "checking in", "any update"],
    "confirmation": ["confirm", "confirmation", "acknowledge", "received"],
    "request": ["could you", "would you", "please", "kindly", "request"],
    "persuasive": ["recommend", "suggest", "consider", "believe", "convince", "imagine"],
    "formal": ["dear", "sincerely", "regards", "respectfully", "to whom it may concern"],
    "casual": ["hey", "yo ", "thx", "cheers", "lol", "btw"],
}
DEFAULT_TONE = "neutral"

# --- fixed values: placeholder rules, applied in this order ----------------------
# name, pattern, ignore case, replacement
PLACEHOLDER_RULES = [
    ("date_numeric", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", False, "{date}"),
    (
        "date_month",
        r"\b(?:on\s+)?(?:january|february|march|april|may|june|july|august|september"
        r"|october|november|december)\s+\d{1,2}(?:,?\s*\d{2,4})?\b",
        True,
        "{date}",
    ),
    (
        "weekday",
        r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
        True,
        "{date}",
    ),
    (
        "deadline",
        r"\bby\s+(?:end\s+of\s+\w+|EOD|EOW|next\s+\w+|tomorrow|\w+day)\b",
        True,
        "by {deadline}",
    ),
    ("amount", r"\$\d+(?:[,.]\d+)*", False, "{amount}"),
    ("invoice", r"\bINV-\d{3,}\b", False, "{invoice_no}"),
    ("link", r"https?://\S+", False, "{link}"),
    ("email", r"\b[\w\.-]+@[\w\.-]+\.\w+\b", False, "{email}"),
    ("phone", r"\b\+?\d[\d\-\s]{7,}\d\b", False, "{phone}"),
    (
        "company",
        r"\b[A-Z][A-Za-z&\.\s]{2,30}(?:Inc|LLC|Ltd|Corp|Co\.|Corporation|Company)\b",
        False,
        "{company_name}",
    ),
]
TEMPLATE_GREETING = (
    r"^[ \t]*(?:hi|hello|hey|dear|greetings)[ \t,]+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)[!,]?[ \t]*"
)
TEMPLATE_CLOSING = (
    r"\b(best regards|kind regards|warm regards|sincerely|regards|thanks|thank you|cheers),?"
    r"\s*\n+\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)"
)
GREETING_TEXT = "Hi {recipient_name},"
CLOSING_TEXT = "Best regards,\n{sender_name}"
SENDER_TEXT = "{sender_name}"
SUBJECT_FALLBACK = "Regarding {topic}"
ALWAYS_LISTED = ["recipient_name", "sender_name"]
PLACEHOLDER_NAME = r"\{([a-zA-Z_]+)\}"
TOKEN = r"[A-Za-z']+"

# --- fixed values: run parameters -------------------------------------------------
NOISE = -1
MISSING_LABEL = "__missing__"
DUPLICATE_SIMILARITY = 0.92
MAX_TEMPLATES = 50
DBSCAN_EPS = 0.35
DBSCAN_MIN_SAMPLES = 5
RANDOM_STATE = 42
MIN_CLUSTERS, MAX_CLUSTERS = 4, 20
PAIR_RANGE_ROWS = 4096
PAIR_SEED = 13
EMBED_DIM = 64
