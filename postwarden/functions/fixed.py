"""Fixed values.

Word lists, domain sets, patterns, weights' texts and category names that
results depend on.  They are data: changing an entry changes scores.
"""

# --- characters -------------------------------------------------------------

# Unicode white space, as a regex class body valid in Java and RE2.
WHITE = (
    r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Decimal digits plus the superscript, subscript and enclosed digits.
DIGIT = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
)
WORD = r"\p{L}\p{N}_"
ASCII_PUNCT = r"!-/:-@\[-`{-~"

# --- labels -----------------------------------------------------------------

LABELS = ["ham", "spam", "phishing"]
LABEL_CODES = {
    "ham": 0, "0": 0,
    "spam": 1, "1": 1,
    "phishing": 2, "phish": 2, "phisher": 2, "2": 2,
}

# --- keyword lists ----------------------------------------------------------

TRAIN_SPAM_KEYWORDS = [
    "offer", "discount", "sale", "promo", "deal", "limited time", "buy now", "order now",
    "free trial", "special offer", "save", "% off", "coupon", "unsubscribe", "dear friend",
    "act now", "final notice", "congratulations", "winner", "click here", "apply now",
    "best price",
]
SERVE_SPAM_KEYWORDS = [
    "free", "winner", "claim", "prize", "urgent", "limited", "offer", "click here",
    "act now", "congratulations", "cash", "bonus", "reward", "exclusive",
    "verify", "suspended", "expire", "bitcoin", "crypto", "investment",
    "guaranteed", "risk-free", "no cost", "dear friend", "lottery",
    "million", "inheritance", "transfer", "confidential", "business proposal",
    "click below", "act immediately", "limited time", "expires", "verify account",
    "confirm identity", "update payment", "suspended account", "unusual activity",
]
PHISHING_PHRASES = [
    "verify your account", "confirm your identity", "suspended account",
    "unusual activity", "click here immediately", "act now", "expire",
    "update payment", "confirm payment", "verify payment", "bank account",
    "social security", "ssn", "tax refund", "irs", "paypal", "amazon",
]
URGENCY_TERMS = ["urgent", "immediately", "expire", "act now"]
COMPACT_WORDS = {
    "urgent": ["urgent", "immediately", "verify", "update", "alert", "attention"],
    "prize": ["winner", "lottery", "reward", "prize", "gift card"],
    "threat": ["suspend", "deactivate", "violation", "terminate"],
    "money": ["bitcoin", "payment", "invoice", "bank", "fund"],
}
EXTENDED_WORDS = {
    "urgent": [
        "urgent", "immediate", "action required", "verify", "confirm", "suspended", "locked",
        "expires", "expiring", "limited time", "act now", "click here", "click below",
        "update now",
    ],
    "prize": [
        "winner", "won", "prize", "reward", "cash", "million", "lottery", "selected", "chosen",
        "congratulations", "claim", "free", "bonus",
    ],
    "threat": [
        "suspended", "closed", "locked", "terminated", "cancelled", "final notice",
        "last chance", "deadline", "legal action",
    ],
    "money": [
        "$", "usd", "dollars", "payment", "refund", "transfer", "bank", "account",
        "credit card", "wire", "paypal", "bitcoin",
    ],
}
SEMANTIC_KEYWORDS = [
    "urgent", "final notice", "congratulations", "claim", "exclusive", "winner", "selected",
    "verify", "verify now", "click", "bank details", "free", "limited time", "hurry", "reward",
]
TRAIN_MONEY_SYMBOLS = ["$", "£", "€", "₹", "¥"]
SERVE_MONEY_SYMBOLS = ["$", "₹", "€", "£", "¥", "₩"]

# --- senders and domains ----------------------------------------------------

TRAIN_FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]
FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
SERVE_FREE_NAMES = ["gmail", "yahoo", "hotmail"]
TRAIN_SENDER_TOKENS = ["noreply", "secure", "account", "support", "admin", "info"]
COMPACT_SENDER_TOKENS = ["noreply-", "secure", "account", "support"]
SERVE_SENDER_TOKENS = [
    "alert@", "secure@", "noreply@", "no-reply@", "verify@", "confirm@",
    "notification@", "security@", "support@", "service@", "admin@",
    "winner@", "prize@", "reward@", "urgent@",
]
IMPERSONATED = ["bank", "paypal", "amazon", "verify", "security"]
DOMAIN_RISK_TLDS = [".xyz", ".top", ".ru", ".cn", ".tk", ".ml", ".ga", ".cf", ".gq"]

# --- URLs -------------------------------------------------------------------

SHORTENERS = [
    "bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "adf.ly", "bitly.com",
    "is.gd", "rb.gy",
]
SERVE_SHORTENERS = ["bit.ly", "tinyurl"]
LINK_SHORTENERS = ["bit.ly", "tinyurl", "t.co", "goo.gl"]
TRAIN_URL_TLDS = [
    ".xyz", ".top", ".click", ".work", ".online", ".club", ".country", ".site", ".win", ".loan",
]
SERVE_URL_TLDS = [".xyz", ".top", ".ru", ".cn"]
LINK_URL_TLDS = [".xyz", ".top", ".ru", ".cn", ".tk", ".ml"]
COMPACT_URL_TLDS = [
    ".zip", ".xyz", ".top", ".click", ".work", ".country", ".club", ".support", ".online",
]
THREAT_TLDS = [
    "zip", "review", "top", "tk", "pw", "cn", "gq", "ru", "click", "xyz", "info", "biz", "men",
    "work",
]
EXECUTABLE_EXTENSIONS = [".exe", ".scr", ".zip", ".bat", ".js", ".vbs", ".msi", ".cmd"]
THREAT_TOKENS = [
    "verify", "login", "confirm", "update", "account", "secure", "claim", "reset", "download",
]

URL_TRAIN = r"(?i)https?://[^" + WHITE + r"'\"<>)+,]*"
URL_SERVE = r"https?://[^" + WHITE + r"]+"
URL_THREAT = r"(?i)(?:https?://[^" + WHITE + r"<>\"]+|www\.[^" + WHITE + r"<>\"]+)"
URL_STRICT = r"(?i)https?://[^" + WHITE + r"<>\"{}|\\^`\[\]]+"
IP_URL_TRAIN = r"https?://\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}"
IP_URL_SERVE = r"https?://\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+"
IPV4_HOST = (
    r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\z"
)

# --- HTML, headers, personal data ------------------------------------------

TAG = r"<[^>]+>"
TRAIN_TAG = r"<[a-zA-Z0-9]+[" + WHITE + r">]"
TRAIN_BASE64 = r"data:[a-zA-Z0-9/+-.]+;base64,"
ADDRESS = r"[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PII_ADDRESS = r"[" + WORD + r".-]+@[" + WORD + r".-]+"
LARGE_AMOUNT = (
    r"[$₹€£][" + WHITE + r"]*\p{Nd}{1,3}(?:,\p{Nd}{3})+|\p{Nd}{6,}"
)
DISCOUNT = r"(?i)\p{Nd}+%[" + WHITE + r"]*(?:off|discount|free)"
PERCENT_OFF = r"(?i)\p{Nd}+%[" + WHITE + r"]*off"

# --- vectors ----------------------------------------------------------------

BODY_MAX_FEATURES = 5000
SUBJECT_MAX_FEATURES = 1000
TOKEN = r"[" + WORD + r"]{2,}"

# Default English stop words; another list can be passed wherever one is used.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very can will just should now"
).split()

# --- metric names -----------------------------------------------------------

REPUTATION_COLUMNS = [
    "sender_email_count", "sender_ham_count", "sender_spam_count", "sender_phish_count",
    "sender_spam_ratio", "sender_is_known",
]
MODEL_NAME = "spark_ml_v1"
