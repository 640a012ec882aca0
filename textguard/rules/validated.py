"""Personal-data categories whose matches are validated after the pattern hits."""

from textguard.rules.model import Rule, g

# Categories and patterns.
RULES = (
    Rule("ssn", "", r"\b(?:\d{3}[-.\s]?\d{2}[-.\s]?\d{4}|\d{9})\b"),
    Rule("credit_card", "", r"\b(?:4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5}|6(?:011|5[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4})\b"),
    Rule("email", "", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    Rule("phone", "", r"\b\+?1?[-.\s]?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b"),
    Rule("passport", "", r"\b[A-Z0-9]{9}\b"),
    Rule("driver_license", "", r"(?i)\b(?:dl|dl#|driverlic|driverlicno|driverlicense|driverlicensenum|licenseno):?\s*[A-Z0-9]{5,20}\b"),
    Rule("health_info", "", r"(?i)\b(?:mrn|patient|health|medical|hipaa)\b[^\d]*\d{5,12}"),
    Rule("date_of_birth", "", r"(?i)\b(?:DOB|Date of Birth|Birth Date|Birthday|Born):?\s*(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"),
    Rule("bank_account", "", r"(?i)\b(?:account|acct|acct#|savings|checking|accountnum|acctno):?\s*\d{8,17}\b"),
    Rule("ip_address", "", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    Rule("name", "", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"),
)

# Category -> (severity 1-5, frameworks, redaction prefix). The
# address category has no pattern of its own.
METADATA = {
    "ssn": (5, ("SOC2", "HIPAA", "PCI-DSS"), "XXX-XX-"),
    "credit_card": (5, ("PCI-DSS",), "XXXX-XXXX-XXXX-"),
    "email": (3, ("GDPR", "SOC2"), "***@***"),
    "phone": (3, ("GDPR", "SOC2"), "***-***-"),
    "health_info": (5, ("HIPAA",), "[REDACTED-HEALTH]"),
    "passport": (4, ("SOC2", "GDPR"), "****"),
    "driver_license": (3, ("SOC2",), "****"),
    "bank_account": (5, ("SOC2", "PCI-DSS"), "****"),
    "ip_address": (2, ("GDPR",), "X.X.X.X"),
    "date_of_birth": (3, ("GDPR", "SOC2"), "**/**/****"),
    "name": (2, ("GDPR",), "[REDACTED]"),
    "address": (3, ("GDPR",), "[REDACTED-ADDRESS]"),
}

# What a user-supplied pattern is reported as.
CUSTOM_CATEGORY, CUSTOM_SEVERITY, CUSTOM_REDACTED = "email", 3, "****"

GATES = {
    "ssn": g(digits=r"[0-9]{3} ?[0-9]{2} ?[0-9]{4}"),
    "credit_card": g(digits=r"[0-9]{4} ?[0-9]{4,6} ?[0-9]{4}"),
    "email": g("@"),
    "phone": g(digits=r"[0-9]{3} [0-9]{3} [0-9]{4}"),
    "passport": g(),
    "driver_license": g(("dl", "driverlic", "licenseno")),
    "health_info": g(("mrn", "patient", "health", "medical", "hipaa"), digits=r"[0-9]{5}"),
    "date_of_birth": g(("dob", "birth", "born"), digits=r"[0-9] [0-9]{1,2} [0-9]"),
    "bank_account": g(("account", "acct", "savings", "checking"), digits=r"[0-9]{8}"),
    "ip_address": g(digits=r"[0-9] [0-9]{1,3} [0-9]{1,3} [0-9]"),
    "name": g(("mr.", "mrs.", "ms.", "dr.", "prof.")),
}
