"""RE2 patterns rewritten for ``java.util.regex``.

The catalogue is written in RE2 syntax. Spark's regex functions use the JVM
engine, which differs in a few points this module levels out: ``\\b`` and ``\\s``
there know more characters, ``.`` and ``$`` treat line ends differently, and
case-insensitive matching folds other letters. The result matches the same
spans; patterns in ``JVM`` are hand-written equivalents that stay linear or need
no deep stack on long inputs.
"""

from __future__ import annotations

SPACE = r"\t\n\f\r "
# There, ``\w`` is ASCII; only ``\b`` is not.
BEFORE = r"(?<!\w)"
AFTER = r"(?!\w)"
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# The only non-ASCII characters that fold to ASCII letters: long s, Kelvin sign.
FOLDS = {"s": "ſ", "k": "\u212a"}


def _folded_letter(ch: str) -> str:
    if ch.lower() in FOLDS:
        return f"[{ch}{FOLDS[ch.lower()]}]"
    if ord(ch) > 127 and ch.lower() != ch.upper() and len(ch.lower()) == len(ch.upper()) == 1:
        return f"[{ch.lower()}{ch.upper()}]"
    return ch


def _class(body: str, fold: bool = False) -> str:
    """Body of a bracket class, JVM form.

    Ranges are spelled out: the JVM looks single characters up in one table, but
    tests ranges one after the other.
    """
    out, i, letters = [], 0, set()
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            pair = body[i : i + 2]
            if pair in (r"\p", r"\P") and body[i + 2 : i + 3] == "{":
                pair = body[i : body.index("}", i) + 1]
            out.append({r"\s": SPACE, r"\S": r"\S\x0B"}.get(pair, pair))
            i += len(pair)
            continue
        high = body[i + 2] if body[i + 1 : i + 2] == "-" and i + 2 < len(body) and body[i + 2] != "\\" else ch
        if high != ch and (ch + high).isascii() and ch.isalnum() and high.isalnum() and len(body) > 3:
            out.extend(map(chr, range(ord(ch), ord(high) + 1)))
            i += 2
        elif high != ch:
            out.append(body[i : i + 3])
            i += 2
        else:
            out.append("\\" + ch if ch in "[&" else ch)
        letters.update(f for f in FOLDS if ch.isalpha() and high.isalpha() and ch.lower() <= f <= high.lower())
        i += 1
    if fold:
        out.extend(FOLDS[letter] for letter in sorted(letters))
    return "".join(out)


def to_java(regex: str) -> str:
    """The JVM pattern with the same matches as ``regex`` in RE2."""
    fold = regex.startswith("(?i)")
    out, i = [], 0
    while i < len(regex):
        ch = regex[i]
        if ch == "\\":
            pair = regex[i : i + 2]
            if pair in (r"\x", r"\p", r"\P") and regex[i + 2 : i + 3] == "{":
                end = regex.index("}", i)
                out.append(regex[i : end + 1])
                i = end + 1
                continue
            out.append({r"\b": BOUNDARY, r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]"}.get(pair, pair))
            i += 2
            continue
        if ch == "[":
            start = i + 1
            negated = regex[start] == "^"
            start += negated
            end = start + 1 if regex[start] == "]" else start
            while regex[end] != "]":
                end += 2 if regex[end] == "\\" else 1
            out.append("[" + "^" * negated + _class(regex[start:end], fold) + "]")
            i = end + 1
            continue
        if regex.startswith("(?", i) and not regex.startswith("(?:", i):
            end = min(x for x in (regex.find(")", i), regex.find(":", i)) if x > 0)
            out.append(regex[i : end + 1])
            i = end + 1
            continue
        if ch == ".":
            out.append(r"[^\n]")
        elif ch == "$":
            out.append(r"\z")
        elif ch == "{":
            end = regex.find("}", i)
            out.append(regex[i : end + 1] if end > 0 else r"\{")
            i = end if end > 0 else i
        else:
            out.append(_folded_letter(ch) if fold else ch)
        i += 1
    return "".join(out)


_S = f"[{SPACE}]"
_LETTERS = _class("a-zA-Z", fold=True)
_A = f"[{_LETTERS}]"
_AS = f"[{_LETTERS}{SPACE}]"
# Words of two or more letters with blanks between, one character per turn, so
# that the engine loops instead of recursing once per word.
_WORDS = f"{_A}{{2}}(?:(?!(?<={_S}{_A}){_S}){_AS})*(?<={_A}{_A})"
_LOCAL = _class(r"A-Za-z0-9._%+\-")
_LOCAL_ANY = r"\p{L}\p{N}._%+\-"
_DOMAIN = _class(r"A-Za-z0-9.\-")
_UPPER = _class("A-Z0-9")
_BASE64 = _class("A-Za-z0-9+/")

JVM = {
    "pii_email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_DOMAIN}]+\.[A-Za-z]{{2,24}}",
    "pii_email_intl": rf"(?:(?<![{_LOCAL_ANY}])|\G)[{_LOCAL_ANY}]++@[\p{{L}}\p{{N}}.\-]+\.[\p{{L}}]{{2,24}}",
    "email": rf"{BOUNDARY}[{_LOCAL}]++@[{_DOMAIN}]+\.[a-zA-Z]{{2,}}{AFTER}",
    "pii_address": (
        rf"(?i){BEFORE}[0-9]{{1,6}}+{_S}++{_WORDS}{_S}+"
        rf"(?:[sſ]treet|[sſ]t|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Place|Pl){AFTER}"
        rf"\.?(?:{_S}+(?:Apt|[sſ]uite|[sſ]te|#){_S}*[0-9]+)?"
    ),
    "pii_street_intl": (
        rf"(?i){BOUNDARY}(?:Bulevardul|Bd\.|Intrarea|[sſ]trada|[sſ]tr\.|Aleea|Pia[țȚ]a|Calea){_S}+{_WORDS}"
        rf"{_S}+Nr\.?{_S}+[0-9]+{AFTER}"
    ),
    "pii_bip39_seed": f"{BEFORE}(?:[a-z]{{3,8}}+{_S}++){{11}}[a-z]{{3,8}}+{AFTER}",
    "pii_letter_only_id": f"{BEFORE}[A-Z]{{8,12}}+{AFTER}",
    "pii_id_multisegment": f"{BEFORE}[A-Z][{_UPPER}]{{1,7}}[-.][{_UPPER}]{{1,8}}(?:[-.][{_UPPER}]{{1,8}}){{1,3}}{AFTER}",
    "pii_iban": f"{BEFORE}[A-Z]{{2}}[0-9]{{2}}[{_UPPER}]{{11,30}}+{AFTER}",
    "pii_icd10_code": rf"{BEFORE}[A-TV-Z][0-9][0-9AB]\.[0-9A-TV-Z]{{1,4}}+{AFTER}",
    "lgpd_reference": (
        rf"(?i){BOUNDARY}(?:LGPD|Lei{_S}+Geral{_S}+de{_S}+Protec[çÇa]ção{_S}+de{_S}+Dado[sſ]"
        rf"|Art\.{_S}*[0-9]+(?:[{SPACE},º°]++(?:VIII|VII|VI|V|IV|IX|III|II|I|X){AFTER})*+"
        rf"|dado[sſ]{_S}+pe[sſ][sſ]oai[sſ]|controlador|operador|ANPD){BOUNDARY}"
    ).replace("ção", "[çÇ][ãÃ]o"),
    "passport": f"{BEFORE}[{_UPPER}]{{9}}{AFTER}",
    "health_info": rf"(?i){BOUNDARY}(?:mrn|patient|health|medical|hipaa){BOUNDARY}[^0-9]*+[0-9]{{5,12}}",
    "base64_encoding": f"(?<![{_BASE64}])[{_BASE64}]{{20,}}+={{0,2}}",
    "repetitive_padding": r"(?i)([a-z])\1{4,}|[0-9]{5,}",
}


# First characters of rules that open with a word boundary and run on most
# texts: one cheap class test spares the boundary test at every other position.
FIRST = {
    "pii_driver_license": "dl",
    "pii_passport_generic": "pilc",
    "pii_id_generic_alphanumeric": "icnrlpsſa",
    "pii_letter_only_id": "A-Z",
    "pii_id_multisegment": "A-Z",
    "passport": "A-Z0-9",
    "lgpd_reference": "ladco",
    "popia_reference": "psſi",
    "ccpa_reference": "crsſd",
    "toxicity_self_harm": "sſk\u212ahec",
    "toxicity_sexual": "poenhsſrmicu",
    "name": "MDP",
    "driver_license": "dl",
    "word_splitting": "ibosſp",
    "camelcase_attack_word": "ibosſpahereld",
}


def java_of(name: str, regex: str) -> str:
    """JVM pattern of a catalogue rule."""
    java = JVM.get(name) or to_java(regex)
    if name not in FIRST:
        return java
    flag = "(?i)" if java.startswith("(?i)") else ""
    return f"{flag}(?=[{FIRST[name]}]){java[len(flag):]}"
