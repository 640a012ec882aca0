"""National identifiers, passports and permits."""

from textguard.rules.model import Rule, g

# Rule names, severities and patterns.
RULES = (
    Rule("pii_cpf_br", "critical", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "Brazilian taxpayer number"),
    Rule("pii_aadhaar_in", "critical", r"\d{4}[-\s]\d{4}[-\s]\d{4}", "Indian resident number"),
    Rule("pii_nhs_uk", "high", r"(?i)\b(?:NHS|NHS\s+Number|National\s+Health\s+Service)\s*[:\#]?\s*(?:No\.?|Number)?\s*[:\#]?\s*\d{3}-\d{3}-\d{4}\b", "UK health number"),
    Rule("pii_tfn_au", "high", r"\b\d{3}\s\d{3}\s\d{3}\b", "Australian tax number"),
    Rule("pii_sin_ca", "high", r"\b[1-7]\d{2}\s\d{3}\s\d{3}\b", "Canadian insurance number"),
    Rule("pii_iban", "critical", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "bank account, IBAN"),
    Rule("pii_bip39_seed", "critical", r"\b(?:[a-z]{3,8}\s+){11}[a-z]{3,8}\b|\b(?:[a-z]{3,8}\s+){23}[a-z]{3,8}\b", "twelve short words in a row"),
    Rule("pii_passport_uk", "critical", r"(?i)(?:UK|United\s+Kingdom)?\s*Passport\s*(?:#|No\.?)?\s*(\d{9})\b", "UK passport"),
    Rule("pii_passport_eu", "critical", r"(?i)(?:European\s+Union|EU)\s*Passport\s*(?:#|No\.?)?\s*([A-Z]{1,2}\d{6,8})\b", "EU passport"),
    Rule("pii_passport_ca", "critical", r"(?i)(?:Canadian|Canada)\s*Passport\s*(?:#|No\.?)?\s*([A-Z]\d{8})\b", "Canadian passport"),
    Rule("pii_passport_au", "critical", r"(?i)(?:Australian|Australia)\s*Passport\s*(?:#|No\.?)?\s*(\d{9})\b", "Australian passport"),
    Rule("pii_passport_de", "critical", r"(?i)(?:German|Germany)\s*Passport\s*(?:#|No\.?)?\s*(?:([A-Z]\d{8})|(D\d{8}))\b", "German passport"),
    Rule("pii_passport_fr", "critical", r"(?i)(?:French|France)\s*Passport\s*(?:#|No\.?)?\s*(\d{9})\b", "French passport"),
    Rule("pii_nid_de", "critical", r"(?i)(?:German\s+Nationalseid|Personalausweis|PA)\s*[:\#]?\s*(\d{11})\b", "German identity number"),
    Rule("pii_nid_fr", "critical", r"(?i)(?:French\s+National\s+ID|Carte\s+Nationale|Carte\s+Nationale\s+Identite|CN)\s*[:\#]?\s*([A-Z]{1,5}\d{10})\b", "French identity number"),
    Rule("pii_nid_es", "critical", r"(?i)(?:Spanish\s+National\s+ID|DNI)\s*[:\#]?\s*(\d{8}[A-Z])\b", "Spanish identity number"),
    Rule("pii_nid_it", "critical", r"(?i)(?:Italian\s+National\s+ID|Codice\s+Fiscale|CF)\s*[:\#]?\s*([A-Z0-9]{16})\b", "Italian fiscal code"),
    Rule("pii_nid_jp", "critical", r"(?i)(?:Japanese\s+National\s+ID|My\s+Number|MyNumber)\s*[:\#]?\s*(\d{3}-\d{3}-\d{5,6})\b", "Japanese resident number"),
    Rule("pii_residence_us", "critical", r"(?i)(?:I-551|Green\s+Card|Resident\s+Permit)\s*([A-Z]?\d{9,11})\b", "US residence card"),
    Rule("pii_residence_ca", "critical", r"(?i)(?:Permanent\s+Resident|PR\s+Card|Canadians?\s+Permanent\s+Resident)\s*([A-Z]?\d{9,11})\b", "Canadian residence card"),
    Rule("pii_residence_uk", "critical", r"(?i)(?:Biometric\s+Residence\s+Permit|BRP)\s*([A-Z]?\d{9,11})\b", "UK residence permit"),
    Rule("pii_visa", "critical", r"(?i)(?:Visa|visa)\s+(?:number|entry|entry\s+type)?\s*[:=]?\s*([A-Z0-9]{8,17})\b", "visa number"),
    Rule("pii_driver_license_international", "high", r"(?i)(?:(?:Driver's\s+License|State\s+ID|Permis\s+conduire|Führerschein|Patente|Licencia|Permiso|Brevetto)\s*[:\#]?\s*[A-Z]?\d{5,15}|(?:Korti\s+ajamiso|Dokument\s+tożsamości)\s*[:\#]?\s*\d{5,15})\b", "driving licence, other countries"),
    Rule("pii_ipv6", "low", r"(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}", "IPv6"),
)

GATES = {
    "pii_cpf_br": g(digits=r"[0-9]{3} [0-9]{3} [0-9]{3} [0-9]{2}"),
    "pii_aadhaar_in": g(digits=r"[0-9]{4} [0-9]{4} [0-9]{4}"),
    "pii_nhs_uk": g(("nhs", "national"), digits=r"[0-9]{3} [0-9]{3} [0-9]{4}"),
    "pii_tfn_au": g(digits=r"[0-9]{3} [0-9]{3} [0-9]{3}"),
    "pii_sin_ca": g(digits=r"[1-7][0-9]{2} [0-9]{3} [0-9]{3}"),
    "pii_iban": g(digits=r"[0-9]{2}"),
    "pii_bip39_seed": g(),
    "pii_passport_uk": g("passport", digits=r"[0-9]{9}"),
    "pii_passport_eu": g("passport", digits=r"[0-9]{6}"),
    "pii_passport_ca": g("passport", digits=r"[0-9]{8}"),
    "pii_passport_au": g("passport", digits=r"[0-9]{9}"),
    "pii_passport_de": g("passport", digits=r"[0-9]{8}"),
    "pii_passport_fr": g("passport", digits=r"[0-9]{9}"),
    "pii_nid_de": g(("nationalseid", "personalausweis", "pa"), digits=r"[0-9]{11}"),
    "pii_nid_fr": g(("french", "carte", "cn"), digits=r"[0-9]{10}"),
    "pii_nid_es": g(("spanish", "dni"), digits=r"[0-9]{8}"),
    "pii_nid_it": g(("italian", "codice", "cf")),
    "pii_nid_jp": g(("japanese", "my"), digits=r"[0-9]{3} [0-9]{3} [0-9]{5}"),
    "pii_residence_us": g(("i-551", "green", "resident"), digits=r"[0-9]{9}"),
    "pii_residence_ca": g(("resident", "pr"), digits=r"[0-9]{9}"),
    "pii_residence_uk": g(("biometric", "brp"), digits=r"[0-9]{9}"),
    "pii_visa": g("visa"),
    "pii_driver_license_international": g(("driver", "state", "permis", "führerschein", "patente", "licencia", "brevetto", "korti", "dokument"), digits=r"[0-9]{5}"),
    "pii_ipv6": g(":"),
}
