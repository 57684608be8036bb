"""Fixed values.

Everything here is a literal that results must agree on: word lists, lookup tables, message
texts, patterns and thresholds. No logic lives in this module.
"""

from __future__ import annotations

# Risk classes and their order.
RISK_LABELS = ["LOW", "MEDIUM", "HIGH"]

# The 12 features of the risk model, in vector order.
RISK_FEATURES = [
    "product_type",
    "age_months",
    "usage_hours_per_day",
    "error_count",
    "failure_count",
    "maintenance_count",
    "behaviour_score",
    "care_score",
    "responsiveness_score",
    "region_code",
    "climate_band",
    "power_quality_band",
]

# The 10 features of the EV battery model, in vector order.
EV_FEATURES = [
    "product_type",
    "age_months",
    "daily_km",
    "fast_charge_sessions",
    "deep_discharge_events",
    "max_temp_seen",
    "behaviour_score",
    "care_score",
    "responsiveness_score",
    "region_climate_band",
]

# Feature values assumed when an EV has sent no telemetry.
EV_DEFAULTS = {
    "product_type": 3,
    "age_months": 12,
    "daily_km": 40,
    "fast_charge_sessions": 4,
    "deep_discharge_events": 1,
    "max_temp_seen": 32,
    "region_climate_band": 1,
}

# Vocabularies of the one-hot features.
CLIMATES = ["hot", "humid", "dry", "cold", "coastal"]
REGIONS = ["na", "eu", "apac", "latam", "mea"]
COMPONENTS = ["motor", "drum", "bearing", "pump", "seal"]

# Numeric features of the second risk model, in vector order.
V2_NUMERIC = [
    "usage_hours",
    "errors",
    "failures",
    "maintenance",
    "months_used",
    "days_to_expiry",
    "is_out_of_coverage",
    "behaviour_score",
    "care_score",
    "response_speed_score",
    "nudges_shown",
    "nudges_acted",
    "nudges_ignored",
    "avg_rating",
    "review_sentiment",
    "failure_keyword_count",
    "search_count",
    "unresolved_search_count",
    "oem_risk_factor",
    "brand_reliability_score",
]

# Product catalogue (id, category, title, regions or None for all, minimum band, priority, tags).
PRODUCT_CATALOG = [
    ("sp_ultra", "smartphone", "Ultra smartphone upgrade", ["APAC", "EU", "NA"], "HIGH", 1, ["upgrade", "premium"]),
    ("sp_case_bundle", "smartphone", "Rugged case + protector", ["APAC", "EU", "NA"], "LOW", 2, ["accessory", "protection"]),
    ("sp_extended", "smartphone", "Phone extended warranty", ["APAC", "EU", "NA"], "MEDIUM", 3, ["warranty"]),
    ("lt_protect", "laptop", "Accidental damage protection", ["APAC", "EU", "NA"], "MEDIUM", 2, ["warranty"]),
    ("lt_backup", "laptop", "Cloud backup bundle", None, "HIGH", 3, ["backup"]),
    ("lt_cooling", "laptop", "Cooling pad + cleaner", None, "LOW", 4, ["care"]),
    ("ap_surge", "appliance", "Surge protector + stabilizer", None, "LOW", 2, ["protection"]),
    ("ap_service", "appliance", "Preventive service visit", ["APAC"], "MEDIUM", 3, ["care"]),
    ("ev_warranty", "ev", "EV battery cover", None, "MEDIUM", 2, ["ev"]),
    ("ev_charger", "ev", "Smart home charger", ["EU", "NA"], "LOW", 4, ["ev"]),
    ("gn_backup", "general", "Data backup & sync", None, "HIGH", 4, ["backup"]),
    ("gn_inspect", "general", "Annual inspection coupon", None, "MEDIUM", 5, ["maintenance"]),
    ("gn_cleaning", "general", "Cleaning kit", None, "LOW", 6, ["care"]),
]

# Recommendation rules used while none is stored
# (id, segment, condition as JSON, title, message, priority).
DEFAULT_RULES = [
    (
        1,
        "AIR_QUALITY",
        '{"min_aqi_band": 2}',
        "Air quality is high",
        "Use an air purifier at home. If you commute by car, consider a small cabin purifier.",
        1,
    ),
    (
        2,
        "CARE_ROUTINE",
        '{"min_risk_label": "MEDIUM", "max_behaviour_score": 0.6, "max_care_score": 0.6}',
        "Give your device a quick health boost",
        "Clean filters, descale, and book a preventive service to avoid surprises.",
        2,
    ),
]

# Behaviour question bank (id, text, answer type, options), in asking order.
QUESTION_BANK = [
    ("q1_usage_location", "Where is the product used most?", "choice", ["Home", "Office", "Outdoor", "Mixed"]),
    ("q2_daily_usage", "Average daily usage?", "choice", ["Low", "Medium", "High"]),
    ("q3_voltage", "Do you notice voltage fluctuations?", "choice", ["Yes", "No", "Not sure"]),
    ("q4_install", "Installed by authorized technician?", "choice", ["Yes", "No", "Not sure"]),
    ("q5_environment", "Environment?", "choice", ["Humid", "Dusty", "Normal"]),
    ("q6_overheat", "Ever overheated or shut down unexpectedly?", "choice", ["Yes", "No"]),
]

# Parts recommended per reported symptom.
SYMPTOM_PARTS = {
    "no_cooling": ["capacitor", "blower_motor"],
    "noise": ["suspension_kit", "drum_stabiliser"],
    "power_failure": ["power_board"],
}

# Nudge titles and messages per experiment variant (B, and A for all others).
NUDGE_COPY = {
    "A": {
        "snapshot_title": "Warranty Snapshot",
        "snapshot_msg": "Coverage and exclusions ready in one place for quick claims.",
        "care_title": "Preventive Care",
        "care_msg": "Complete quick maintenance steps to keep failure risk down.",
        "expiry_title": "Expiry Reminder",
    },
    "B": {
        "snapshot_title": "Coverage Quick View",
        "snapshot_msg": "Key terms, exclusions, and expiry at a glance.",
        "care_title": "Do It Now",
        "care_msg": "One-minute steps cut failure risk—do them now.",
        "expiry_title": "Use It Before You Lose It",
    },
}

# Reason and suggested actions per nudge kind.
NUDGE_REASONS = {
    "snapshot": "Provide plain-language dashboard",
    "care": "Risk score indicates elevated probability; preventive care can reduce it.",
    "expiry": "Near-expiry coverage window",
    "all_good": "Low risk and no expiry pressure",
}
NUDGE_ACTIONS = {
    "snapshot": ["Review coverage and exclusions now.", "Upload invoice if missing."],
    "care": [
        "Acknowledge or complete pending maintenance tasks.",
        "Capture photos or logs if you notice anomalies.",
    ],
    "expiry": ["Save invoice and serial details.", "Run self-checks and log outputs for any claim."],
}

# Standard texts of a canonical warranty.
WARRANTY_TERMS = [
    "Base parts and labour coverage within stated period.",
    "Firmware support updates included where applicable.",
]
WARRANTY_EXCLUSIONS = [
    "Physical or liquid damage.",
    "Unauthorised repair or tampering.",
    "Improper installation or maintenance outside guidance.",
]
WARRANTY_CLAIM_STEPS = [
    "Keep invoice or receipt ready.",
    "Share serial/model information with support.",
    "Provide error evidence (photos or logs) for faster triage.",
]

# Extraction patterns for artifact text (matched on lower-cased text).
ARTIFACT_PATTERNS = {
    "brand": r"brand[:\s]+([a-z0-9 \-]{2,40})",
    "model": r"model[:\s]+([a-z0-9\-]{2,50})",
    "serial": r"(serial|s\/n|sn)[:\s-]*([a-z0-9\-]{6,})",
    "months": r"(\d{1,2})\s*(month|months|mo)\b",
    "date": r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
}

# Extraction patterns for manufacturer page text (case-insensitive).
OEM_TEXT_PATTERNS = {
    "brand": r"brand[:\s]+([A-Za-z0-9 \-]{2,40})",
    "model": r"model[:\s]+([A-Za-z0-9 \-]{2,40})",
    "months": r"(\d{1,2})\s*(month|months|mo)",
    "years": r"(\d)\s*year",
    "exclusion": r"exclusion[:\s-]+([A-Za-z0-9 ,\-]{2,80})",
}

# Extended part warranty patterns per brand hint, in order.
OEM_PART_PATTERNS = [
    ("samsung", r"(compressor|panel)\s*warranty\s*:?(\d+)\s*(year|years)"),
    ("samsung", r"(digital\s*inverter)\s*:?(\d+)\s*(year|years)"),
    ("lg", r"(motor|compressor)\s*:?(\d+)\s*(year|years)"),
    ("lg", r"(smart\s*inverter)\s*:?(\d+)\s*(year|years)"),
    ("bosch", r"(motor|drum)\s*:?(\d+)\s*(year|years)"),
    ("whirlpool", r"(compressor)\s*:?(\d+)\s*(year|years)"),
]

# Page blocks per brand hint, first match in this order wins ('.' class, '#' id).
OEM_BLOCK_SELECTORS = {
    "samsung": {
        "coverage": [".warranty-coverage", "#coverage", ".coverage-details"],
        "terms": [".terms", "#terms", ".conditions"],
    },
    "lg": {
        "coverage": [".warranty-details", "#warranty", ".coverage"],
        "terms": [".terms", "#terms", ".fine-print"],
    },
    "bosch": {
        "coverage": [".warranty", ".service-info", "#coverage"],
        "terms": [".conditions", ".terms"],
    },
    "whirlpool": {
        "coverage": [".warranty", "#warranty", ".coverage"],
        "terms": [".terms", ".conditions"],
    },
}

# EV battery suggestions (rule-based score, model score).
EV_SUGGESTIONS = [
    "Avoid fast charging unless you need a quick top-up.",
    "Try not to let the battery drop below 10%.",
    "Parking in shade helps battery health.",
]
EV_MODEL_REASONS = [
    "High daily kilometres.",
    "Frequent fast charging.",
    "Battery often drops below 10%.",
    "Hot conditions may stress the battery.",
    "Care habits could be improved.",
]
EV_MODEL_HEALTHY = "Driving pattern looks healthy."
EV_MODEL_SUGGESTIONS = [
    "Avoid fast charging unless needed.",
    "Keep charge between 20% and 80% for daily use.",
    "Park in shade to reduce heat.",
]

# Whitespace as a Unicode-aware splitter sees it (for character classes).
UNICODE_SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Limits.
AUDIT_MAX_LEN = 2000
AUDIT_PREVIEW_LEN = 128
QUESTION_COOLDOWN_DAYS = 7
DEDUPE_DAYS = 7
CLUSTER_MIN_HIGH = 10
