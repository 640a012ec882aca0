"""Word lists and patterns of the toxicity, evasion, threat and claim jobs."""

from textguard.rules.model import Rule, either, g

# Toxicity category, explanation and pattern.
TOXICITY = (
    ("violence", "violent content", r"(?i)\b(kill|murder|assassinate|strangle|poison|shoot|stab|slit|dismember|butcher|slay)\b"),
    ("weapons", "weapons content", r"(?i)\b(bomb|explosive|grenade|machine\s*gun|ak-47|ar-15|ricin|anthrax)\b"),
    ("illegal", "illegal activity", r"(?i)\b(crack\s*cocaine|heroin|meth|manufacture\s*drug|illegal\s*weapon)\b"),
    ("self_harm", "self-harm content", r"(?i)\b(suicide|self-harm|cut\s*myself|kill\s*myself|end\s*my\s*life)\b"),
    ("harassment", "harassment", r"(?i)\b(you\s+are\s+(stupid|dumb|ugly|worthless|inferior))\b"),
)
TOXICITY_GATES = {
    "violence": g(("kill", "murder", "assassinate", "strangle", "poison", "shoot", "stab", "slit", "dismember", "butcher", "slay")),
    "weapons": g(("bomb", "explosive", "grenade", "machine", "ak-47", "ar-15", "ricin", "anthrax")),
    "illegal": g(("cocaine", "heroin", "meth", "drug", "weapon")),
    "self_harm": g(("suicide", "self", "life")),
    "harassment": g(("stupid", "dumb", "ugly", "worthless", "inferior")),
}
TOXICITY_SEVERITY = 5
TOXICITY_PREFIX = "Harmful content detected: "

# Evasion technique, category, weight and pattern.
EVASION = (
    ("base64_encoding", "encoding", 0.7, r"[A-Za-z0-9+/]{20,}={0,2}"),
    ("url_encoding", "encoding", 0.6, r"%[0-9A-Fa-f]{2}"),
    ("unicode_escape", "encoding", 0.8, r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"),
    ("html_entity_encoding", "encoding", 0.6, r"&#x?[0-9A-Fa-f]+;|&\w+;"),
    ("zero_width_chars", "splitting", 0.9, r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{200e}\x{200f}]"),
    ("character_interleaving", "splitting", 0.7, r"(?i)(?:i[-_.]\s*g[-_.]\s*n[-_.]\s*o[-_.]\s*r[-_.]\s*e|b[-_.]\s*y[-_.]\s*p[-_.]\s*a[-_.]\s*s[-_.]\s*s|o[-_.]\s*v[-_.]\s*e[-_.]\s*r[-_.]\s*r[-_.]\s*i[-_.]\s*d[-_.]\s*e|i[-_.]\s*n[-_.]\s*j[-_.]\s*e[-_.]\s*c[-_.]\s*t|s[-_.]\s*y[-_.]\s*s[-_.]\s*t[-_.]\s*e[-_.]\s*m|p[-_.]\s*r[-_.]\s*o[-_.]\s*m[-_.]\s*p[-_.]\s*t)"),
    ("word_splitting", "splitting", 0.5, r"(?i)\b(?:ig\s*nore|by\s*p(?:as)?s|ov\s*err?\s*ide|in\s*ject|sy\s*stem|pr\s*ompt)\b"),
    ("leet_speak", "obfuscation", 0.8, r"(?i)(?:1gn0r3|by7p455|0v3rr1d3|5y573m|pr0mp7|h4ck|3xpl0it|d15abl3|d3l3t3|3xtr4ct|st34l|f0rg3|3sc4l4t3|p01s0n|c0rrupt|1nj3ct)"),
    ("camelcase_attack_word", "obfuscation", 0.4, r"(?i)\b(?:ignore|bypass|override|inject|system|prompt|admin|hack|exploit|reveal|extract|steal|disable|delete|remove|access|forge|escalate|poison|corrupt)\b"),
    ("repetitive_padding", "obfuscation", 0.3, r"[aA]{5,}|[bB]{5,}|[cC]{5,}|[dD]{5,}|[eE]{5,}|[fF]{5,}|[gG]{5,}|[hH]{5,}|[iI]{5,}|[jJ]{5,}|[kK]{5,}|[lL]{5,}|[mM]{5,}|[nN]{5,}|[oO]{5,}|[pP]{5,}|[qQ]{5,}|[rR]{5,}|[sS]{5,}|[tT]{5,}|[uU]{5,}|[vV]{5,}|[wW]{5,}|[xX]{5,}|[yY]{5,}|[zZ]{5,}|[0-9]{5,}"),
    ("markup_injection", "obfuscation", 0.9, r"<(?:script|img|svg|iframe|object)"),
    ("roleplay_framing", "semantic", 0.7, r"(?i)(?:pretend|act\s+as|role[\s.-]?play|you\s+are\s+now|imagine\s+you)"),
    ("instruction_override", "semantic", 0.9, r"(?i)(?:new\s+instruction|ignore[\s.-]?previous|disregard|forget\s+what|above\s+instructions)"),
    ("context_manipulation", "semantic", 0.8, r"(?i)(?:context[\s.-]?switch|system[\s.-]?message|developer[\s.-]?mode|jailbreak)"),
    ("output_constraint_bypass", "semantic", 0.6, r"(?i)(?:output[\s.-]?without|respond[\s.-]?without|don'?t[\s.-]?follow|bypass[\s.-]?safety|without[\s.-]?restrictions)"),
)
EVASION_GATES = {
    "base64_encoding": g(),
    "url_encoding": g("%"),
    "unicode_escape": g("\\"),
    "html_entity_encoding": g("&", ";"),
    "zero_width_chars": g(("​", "‌", "‍", "﻿", "‎", "‏")),
    "character_interleaving": g(("g-", "g_", "g.", "y-", "y_", "y.", "v-", "v_", "v.", "n-", "n_", "n.", "r-", "r_", "r.")),
    "word_splitting": either(
        g("nore", "ig"), g("by", ("ps", "pass")), g("ov", "ide"), g("ject", "in"), g("stem", "sy"), g("ompt", "pr")
    ),
    "leet_speak": g(("1gn0r3", "by7p455", "0v3rr1d3", "5y573m", "pr0mp7", "h4ck", "3xpl0it", "d15abl3", "d3l3t3", "3xtr4ct", "st34l", "f0rg3", "3sc4l4t3", "p01s0n", "c0rrupt", "1nj3ct")),
    "camelcase_attack_word": g(("ignore", "bypass", "override", "inject", "system", "prompt", "admin", "hack", "exploit", "reveal", "extract", "steal", "disable", "delete", "remove", "access", "forge", "escalate", "poison", "corrupt")),
    "repetitive_padding": g(),
    "markup_injection": g("<"),
    "roleplay_framing": g(("pretend", "act", "role", "you")),
    "instruction_override": g(("instruction", "previous", "disregard", "forget")),
    "context_manipulation": g(("switch", "message", "developer", "jailbreak")),
    "output_constraint_bypass": g(("without", "follow", "safety")),
}

# Words whose disguised forms raise the threat score.
ATTACK_WORDS = (
    "ignore", "bypass", "override", "inject", "admin",
    "system", "prompt", "hack", "exploit", "reveal", "extract", "steal",
    "disable", "delete", "remove", "access", "forge", "escalate", "poison", "corrupt",
)

# Confident wording and statistics, simple form.
CONFIDENT_PHRASES = ("definitely", "absolutely", "certainly", "guaranteed", "always", "never", "everyone", "no one")
STAT_CLAIM = r"\b\d+%?\s+(people|users|users?|percent|%)"
STAT_CLAIM_CONFIDENCE = 0.5

# Claim analysis, extended form.
OVERCONFIDENCE = r"(?i)\b(certainly|definitely|absolutely|always|never|guaranteed|100%|proven|incontrovertible|unquestionably)\b"
FACTUAL_CLAIM = r"(?i)\b(according to|studies show|research indicates|experts say|statistics show|evidence suggests)\b"
QUANTITY = r"\b\d+\.?\d*\s*(%|percent|percentage)\b"
ATTRIBUTION = r"(?i)\b(source:|according to|based on|from|research|study|data)\b"

EVASION_RULES = tuple(Rule(n, "", p, c) for n, c, _, p in EVASION)
TOXICITY_RULES = tuple(Rule(n, "", p, e) for n, e, p in TOXICITY)
