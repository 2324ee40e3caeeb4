"""Word lists, patterns, tables and thresholds that define the results.

Everything here is data. Operators take each of them as a parameter and use these as defaults.
"""

# --- fixed values: label set, in report order -------------------------------------------------
INTENTS = [
    "keyboard_autocorrect_bug",
    "system_performance_freeze",
    "battery_drain_power",
    "audio_music_playback",
    "connectivity_network",
    "camera_photos_media",
    "account_icloud_login",
    "billing_app_store",
    "other",
]
OTHER_INTENT = "other"
PRONE_INTENTS = ["account_icloud_login", "billing_app_store"]

# --- fixed values: routing tiers, severities, scoring criteria -----------------------------------
TIER_AUTO = "AUTO_SEND"
TIER_REVIEW = "DRAFT_FOR_REVIEW"
TIER_ESCALATE = "ESCALATE"
TIERS = [TIER_AUTO, TIER_REVIEW, TIER_ESCALATE]
CRITERIA = ["correctness", "groundedness", "completeness", "brand_voice", "tone"]
SYSTEMS = ["TrivialBaseline", "SimpleBaseline", "FullAgent"]

# --- fixed values: thresholds ------------------------------------------------------------------
TOP_K = 3
MIN_SIMILARITY = 0.15
MAX_INDEX_TERMS = 25000
MIN_DOC_FREQ = 2
ARBITRATION_CONFIDENCE = 0.50
ESCALATION_CONFIDENCE = 0.40
AUTO_SEND_SIMILARITY = 0.40
AUTO_SEND_RISK = 0.45
RISK_FLOOR_MINUTES = 35.0
RISK_CEILING_MINUTES = 105.0
FALLBACK_MEDIAN_MINUTES = 72.98
SEVERITY_RISK = {"routine": 0.10, "frustrated": 0.60, "severe": 1.00}
UNKNOWN_SEVERITY_RISK = 0.30
URGENCY_BONUS = 0.15

# --- fixed values: median response minutes used when no labelled threads exist --------------------
INTENT_MEDIAN_MINUTES = {
    "battery_drain_power": 101.7,
    "billing_app_store": 100.0,
    "keyboard_autocorrect_bug": 82.33,
    "account_icloud_login": 75.43,
    "system_performance_freeze": 64.48,
    "audio_music_playback": 62.53,
    "other": 41.79,
    "connectivity_network": 41.58,
    "camera_photos_media": 38.15,
}

# --- fixed values: word lists ------------------------------------------------------------------
FRUSTRATION_WORDS = [
    "still", "again", "not working", "useless", "terrible", "worst",
    "refund", "scam", "lawsuit", "sue", "lawyer", "worse",
]
FRUSTRATION_WORDS_INDEX = FRUSTRATION_WORDS + ["hate", "broken", "broke"]
PRAISE_WORDS = ["thanks", "great", "love", "amazing", "good job", "perfect"]
GROUP_ESCALATION_WORDS = [
    "lawsuit", "sue", "lawyer", "attorney", "hacked", "fraud", "safety", "danger", "fda", "police",
]
URGENCY_WORDS = [
    "urgent", "urgently", "immediately", "asap", "right now",
    "critical", "emergency", "hurry", "today", "cannot wait",
]

# --- fixed values: topic words used to count how many topics a text touches ------------------------
TOPIC_WORDS = {
    "keyboard_autocorrect_bug": ["autocorrect", "keyboard", "typing", "letter i", "i glitch", "predictive text", "spacebar"],
    "system_performance_freeze": ["freeze", "freezing", "frozen", "crashes", "crashing", "lag", "slow", "unresponsive", "restart", "reboot"],
    "battery_drain_power": ["battery", "drain", "draining", "charge", "charging", "overheating", "dies"],
    "audio_music_playback": ["music", "apple music", "playlist", "headphone", "earpods", "airpods", "song"],
    "connectivity_network": ["wifi", "wi-fi", "bluetooth", "pair", "pairing", "airdrop", "cellular", "lte", "service"],
    "camera_photos_media": ["camera", "photos", "flashlight", "shutter", "black screen", "blurry"],
    "account_icloud_login": ["apple id", "icloud", "password", "2fa", "verification code", "locked out", "login"],
    "billing_app_store": ["app store", "charged", "subscription", "refund", "receipt", "purchase", "billing"],
}

# --- fixed values: personal-data patterns, applied in this order -----------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
LONG_DIGITS_PATTERN = r"\b(?:\d[ -]*?){10,19}\b"
DEVICE_PATTERN = r"\b(?:IMEI|Serial|SN|Serial Number)[\s:]*([A-Za-z0-9]{8,18})\b"
EMAIL_TAG = "[EMAIL_REDACTED]"
PHONE_TAG = "[PHONE_REDACTED]"
LONG_DIGITS_TAG = "[ACCOUNT_NUM_REDACTED]"
DEVICE_TAG = "[DEVICE_ID_REDACTED]"
PII_TYPES = ["email", "phone_number", "card_or_account_number", "device_identifier"]

# --- fixed values: escalation rules in priority order; (code, patterns) ----------------------------
ESCALATION_RULES = [
    ("rule:legal_threat", [
        r"\b(?:lawsuit|lawyer|attorney|legal action|legal complaint|legal notice|sue|suing|take you to court|consumer court|complaint to regulator|file a complaint with|chargeback|fraud)\b",
        r"\b(?:contact(?:ed|ing)? (?:my|a) lawyer|involve (?:my|a) lawyer|legal counsel)\b",
    ]),
    ("rule:safety", [
        r"\b(?:kill myself|suicide|self harm|hurt myself|end my life|want to die|commit suicide)\b",
        r"\b(?:swelling|swollen battery|exploded|exploding|explode|burning|burned|burnt|smoke|smoking|spark|sparking|shock|shocked|fire|melted|melting|hazardous|overheating)\b",
    ]),
    ("rule:security", [
        r"\b(?:(?:account|apple id|iphone|device) (?:has been |was )?hacked|someone hacked|account (?:is )?compromised|compromised (?:account|id))\b",
        r"\b(?:unauthorized (?:login|device|access|charge)|someone (?:logged into|accessed) my account|password (?:was )?stolen|stolen account|ransomware|extortion)\b",
    ]),
    ("rule:media", [
        r"\b(?:i(?:\'m| am)? (?:a )?(?:journalist|reporter)|writing an article|for the (?:press|newspaper|magazine|news)|press inquiry|media inquiry|news outlet)\b",
        r"\b(?:report(?:er)? from|interview for|publishing a story)\b",
    ]),
    ("rule:abuse", [
        r"\b(?:fuck you|fuck off|piece of shit|go to hell|bastards|assholes|die in a fire|bitch)\b",
        r"\b(?:kill you|murder you|threaten you)\b",
    ]),
    ("rule:pii_needed", [
        r"\b(?:send (?:me )?(?:your|my) full card number|give me my account number|here is my phone number|send my personal details)\b",
        r"\b(?:full credit card number|full debit card number|send your password|verify credit card number|full ssn|social security number|my full ssn)\b",
    ]),
]

# --- fixed values: reply texts ------------------------------------
FALLBACK_REPLY = "I want to make sure you get the right help — let me connect you with our team."
ESCALATED_REPLY = "[ESCALATED TO HUMAN SPECIALIST: %s] We want to ensure you get dedicated support on this urgent matter. Our senior team has been notified and will assist you directly."
ESCALATED_BY_RULE_REPLY = "[ESCALATED VIA RULE: %s]"

# --- fixed values: columns a labelled evaluation file must have -------------------------------------
REQUIRED_EVALUATION_COLUMNS = ["golden_id", "customer_text", "intent", "escalate", "escalate_reason"]

# --- fixed values: phrases that show a trait of a reply (any of them, lower case) ---------------------
REPLY_TRAITS = {
    "has_settings": ["settings", "reset", "update"],
    "has_dm": ["dm", "direct message"],
    "has_url": ["https://", ".com", "t.co"],
    "asks_question": ["?", "what version", "which device", "front and rear"],
    "has_specific_path": [
        "settings >", "iforgot.apple.com", "reportaproblem.apple.com", "text replacement", "network settings", "icloud music library", "front and rear",
    ],
}
ESCALATED_MARK = "[escalated"

# --- fixed values: names of failure modes by rank, and of causes of disagreement ----------------------
FAILURE_MODES = {
    1: "Biggest Intent Confusion Pair",
    2: "Escalation False Negative (Missed Escalation)",
    3: "Lowest Reply Quality / Groundedness & Hallucination Failure",
    4: "Retrieval Found Irrelevant Context & LLM Improvised",
    5: "Naive Verbatim Nearest-Neighbor Retrieval Failure (Baseline Risk)",
}
CAUSE_POLITE = "politeness-over-diagnostic"
CAUSE_INCOMPLETE = "incomplete-but-plausible"
CAUSE_HALLUCINATION = "missed-hallucination"
CAUSE_STRICT = "overly-strict-groundedness"
CAUSE_BRAND = "brand-voice-judgment"
CAUSE_TONE = "tone-preference"
CAUSE_BOUNDARY = "scoring-boundary"
