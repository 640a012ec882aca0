"""US extended and general personal-data pack."""

from textguard.rules.model import Rule, g

# Rule names, severities and patterns.
RULES = (
    Rule("pii_credit_card_loose", "high", r"\b\d{12,19}\b", "bare long number"),
    Rule("pii_email_intl", "medium", r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.[\p{L}]{2,24}", "mail address, any script"),
    Rule("pii_phone_intl_loose", "medium", r"\+?\d[\d\s\-()]{6,12}\d", "phone, loose"),
    Rule("pii_phone_intl_strict", "medium", r"\+?\d{1,3}[\s\-.()]{1,2}\(?\d{2,4}\)?[\s\-.()]{0,2}\d{3,4}[\s\-.()]{0,2}\d{3,4}", "phone with separators"),
    Rule("pii_passport_generic", "critical", r"(?i)\b(?:passport|id|license|certificate)\s*[:\#]?\s*[A-Z0-9]{6,9}\b", "labelled document number"),
    Rule("pii_id_generic_alphanumeric", "high", r"(?i)\b(?:id|code|number|ref|license|passport|certificate|serial|account)\s*[:\#]?\s*[A-Z0-9]{4,15}\b", "labelled identifier"),
    Rule("pii_ssn_fr", "critical", r"\b[12]\d{2}\.\d{2}\.\d{2}\.\d{3}\.\d{2}\b|\b\d{3}\.\d{4}\.\d{4}\.\d{2}\b", "French social number"),
    Rule("pii_ssn_ru", "critical", r"\b\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2,3}\b", "Russian insurance number"),
    Rule("pii_tax_id_ch", "high", r"\bCHE-\d{3}\.\d{3}\.\d{3}\b", "Swiss company number"),
    Rule("pii_letter_only_id", "high", r"\b[A-Z]{8,12}\b", "upper-case word of 8-12 letters"),
    Rule("pii_id_multisegment", "high", r"\b[A-Z][A-Z0-9]{1,7}[-.][A-Z0-9]{1,8}(?:[-.][A-Z0-9]{1,8}){1,3}\b", "segmented code"),
    Rule("pii_street_intl", "medium", r"(?i)\b(?:Bulevardul|Bd\.|Intrarea|Strada|Str\.|Aleea|Piața|Calea)\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+Nr\.?\s+\d+\b", "Romanian street address"),
    Rule("pii_ip_address_v6", "low", r"(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}", "IPv6"),
)

GATES = {
    "pii_credit_card_loose": g(digits=r"[0-9]{12}"),
    "pii_email_intl": g("@"),
    "pii_phone_intl_loose": g(digits=r"[0-9] ?[0-9]"),
    "pii_phone_intl_strict": g(digits=r"[0-9] [0-9]{2,4} ?[0-9]{3,4} ?[0-9]{3}"),
    "pii_passport_generic": g(("passport", "id", "license", "certificate")),
    "pii_id_generic_alphanumeric": g(("id", "code", "number", "ref", "license", "passport", "certificate", "serial", "account")),
    "pii_ssn_fr": g(digits=r"[0-9]{3} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{2}|[0-9]{3} [0-9]{4} [0-9]{4} [0-9]{2}"),
    "pii_ssn_ru": g(digits=r"[0-9]{3} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}"),
    "pii_tax_id_ch": g("che-", digits=r"[0-9]{3} [0-9]{3} [0-9]{3}"),
    "pii_letter_only_id": g(),
    "pii_id_multisegment": g(),
    "pii_street_intl": g(("bulevardul", "bd.", "intrarea", "strada", "str.", "aleea", "piața", "calea"), "nr", digits=r"[0-9]"),
    "pii_ip_address_v6": g(":"),
}
