"""US core personal-data pack."""

from textguard.rules.model import Rule, g

# Rule names, severities and patterns.
RULES = (
    Rule("pii_ssn", "critical", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "Social Security number"),
    Rule("pii_email", "medium", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}", "mail address"),
    Rule("pii_phone", "medium", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "ten-digit phone"),
    Rule("pii_credit_card", "high", r"\b(?:\d{4}[ -]?){3}\d{1,7}\b|\b\d{13,19}\b", "card number"),
    Rule("pii_dob", "high", r"\b(?:(?:0?[1-9]|1[0-2])[/.\-](?:0?[1-9]|[12]\d|3[01])[/.\-](?:19|20)\d{2}|(?:19|20)\d{2}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01]))\b", "full date"),
    Rule("pii_address", "medium", r"(?i)\b\d{1,6}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Place|Pl)\b\.?(?:\s+(?:Apt|Suite|Ste|#)\s*\d+)?", "street address"),
    Rule("pii_driver_license", "high", r"(?i)\b(?:DL|D\.L\.|Driver(?:'s)?\s+License|License)\s*[:\#]?\s*(?:No\.?|Number)?\s*[:\#]?\s*[A-Z0-9]{5,15}\b", "labelled driving licence"),
    Rule("pii_passport", "critical", r"(?i)\b(?:US|United\s+States\s+)?Passport\s*(?:#|No\.?)?\s*[A-Z]\d{8}\b", "labelled US passport"),
    Rule("pii_tax_id", "high", r"\b\d{2}-\d{7}\b", "employer number"),
    Rule("pii_bank_account", "high", r"(?i)\b(?:Routing|Account|ABA)\s*(?:#|No\.?|Number)?\s*\d{4,17}\b", "labelled bank number"),
    Rule("pii_ip_address", "low", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "IPv4"),
    Rule("pii_mrn", "high", r"(?i)\b(?:MRN|Medical\s+Record\s+(?:Number|No\.?|#)|Patient\s+(?:ID|Number|No\.?|#))\b\s*[:=#]?\s*[A-Z0-9][A-Z0-9\-]{4,10}[A-Z0-9]\b", "labelled medical record"),
    Rule("pii_icd10_code", "medium", r"\b[A-TV-Z][0-9][0-9AB]\.[0-9A-TV-Z]{1,4}\b", "diagnosis code"),
    Rule("pii_npi", "medium", r"(?i)\b(?:NPI|National\s+Provider\s+(?:ID|Identifier|Number))\s*[:=#]?\s*[0-9]{10}\b", "provider identifier"),
    Rule("pii_ssn_last4", "high", r"(?i)\b(?:SSN|Social\s+Security)\s+(?:last|final)\s+(?:4|four)\s*(?:[:=#]|is|was|are|of|equals)?\s*[0-9]{4}\b", "last four of an SSN"),
)

GATES = {
    "pii_ssn": g(digits=r"[0-9]{3} [0-9]{2} [0-9]{4}"),
    "pii_email": g("@"),
    "pii_phone": g(digits=r"[0-9]{3} ?[0-9]{3} ?[0-9]{4}"),
    "pii_credit_card": g(digits=r"[0-9]{13}|[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]"),
    "pii_dob": g(digits=r"[0-9] [0-9]{1,2} (?:19|20)[0-9]{2}|(?:19|20)[0-9]{2} [0-9]{1,2} [0-9]"),
    "pii_address": g(digits=r"[0-9]"),
    "pii_driver_license": g(("dl", "d.l.", "license")),
    "pii_passport": g("passport", digits=r"[0-9]{8}"),
    "pii_tax_id": g("-", digits=r"[0-9]{2} [0-9]{7}"),
    "pii_bank_account": g(("routing", "account", "aba"), digits=r"[0-9]{4}"),
    "pii_ip_address": g(digits=r"[0-9] [0-9]{1,3} [0-9]{1,3} [0-9]"),
    "pii_mrn": g(("mrn", "medical", "patient")),
    "pii_icd10_code": g(".", digits=r"[0-9]"),
    "pii_npi": g(("npi", "national"), digits=r"[0-9]{10}"),
    "pii_ssn_last4": g(("ssn", "social"), digits=r"[0-9]{4}"),
}
