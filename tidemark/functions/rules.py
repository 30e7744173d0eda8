"""Fixed values of the prompt-safety rules: phrase groups and blocklist patterns."""

from __future__ import annotations

# --- fixed values: phrase groups, matched as substrings of the lower-cased text
PHRASE_RULES: dict[str, list[str]] = {
    "instruction_override": [
        "ignore previous instructions",
        "ignore all previous instructions",
        "disregard previous instructions",
        "forget your instructions",
        "system override",
        "developer mode",
        "override your rules",
        "ignore all prior",
    ],
    "roleplay": [
        "act as",
        "pretend to be",
        "roleplay as",
        "you are now",
        "unrestricted ai",
        "without rules",
        "evil assistant",
        "dan",
    ],
    "payload_request": [
        "write malware",
        "create ransomware",
        "sql injection",
        "ddos attack",
        "exploit code",
        "reverse shell",
        "shellcode",
        "keylogger",
        "payload",
        "phishing page",
    ],
    "social_engineering": [
        "phishing email",
        "scam message",
        "impersonate",
        "trick someone",
        "social engineer",
        "convince a user",
        "spoof email",
        "fraud message",
    ],
    "obfuscation": [
        "base64",
        "rot13",
        "leet",
        "hex encoded",
        "encoded payload",
        "character by character",
        "spaced letters",
        "obfuscate",
    ],
}

# --- fixed values: keys of a phrase-rule JSON file, by group
PHRASE_FILE_KEYS = {
    "instruction_override": "instruction_override_phrases",
    "roleplay": "roleplay_phrases",
    "payload_request": "payload_phrases",
    "social_engineering": "social_engineering_phrases",
    "obfuscation": "obfuscation_phrases",
}

# --- fixed values: blocklist patterns by family, matched on the lower-cased text
# (the upper-case pattern of the jailbreak family therefore never matches)
BLOCKLIST: dict[str, list[str]] = {
    "injection": [
        r"ignore\s+(all\s+)?previous\s+instructions",
        r"disregard\s+(all\s+)?(prior|previous|above)",
        r"forget\s+(all\s+)?(prior|previous|your)\s+instructions",
        r"new\s+instructions?\s*:",
        r"you\s+are\s+now\s+(an?\s+)?unrestricted",
        r"override\s+(safety|content|system)",
        r"do\s+not\s+follow\s+(your|the)\s+(rules|guidelines)",
    ],
    "jailbreak": [
        r"do\s+anything\s+now",
        r"\bDAN\b",
        r"act\s+as\s+(an?\s+)?(evil|unrestricted|unfiltered)",
        r"jailbreak",
        r"pretend\s+(you\s+)?(are|have)\s+no\s+(restrictions|filters|rules)",
        r"developer\s+mode",
        r"bypass\s+(safety|content|filter)",
        r"opposite\s+mode",
        r"no\s+ethical\s+(guidelines|restrictions)",
    ],
    "exfiltration": [
        r"(show|reveal|display|print|output|repeat)\s+(your\s+)?(system\s+)?prompt",
        r"system\s+(message|instructions|prompt)",
        r"(what|show)\s+(are\s+)?(your|the)\s+(initial\s+)?instructions",
        r"(api|secret)\s+key",
        r"(database|db)\s+connection",
        r"(export|extract|leak)\s+(all\s+)?(user\s+)?data",
        r"(proprietary|confidential|private)\s+(data|information)",
    ],
}

# --- fixed values: label names by id
LABEL_NAMES = {0: "Benign", 1: "Malicious"}

# --- fixed values: words read as booleans and the default benign label words
TRUE_WORDS = ("1", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "false", "f", "no", "n")
BENIGN_WORDS = ("0", "benign", "normal", "ham", "false")

# --- fixed values: substrings of a class label that hint at risk or safety
MALICIOUS_HINTS = ("malicious", "attack", "inject", "unsafe")
BENIGN_HINTS = ("benign", "safe", "normal")
BAD_TONE_HINTS = ("mal", "attack", "inject", "unsafe")

# --- fixed values: lower-case names under which a text column is recognised
LOADER_TEXT_NAMES = ("text", "prompt", "content")
EXPLORER_TEXT_NAMES = (
    "prompt",
    "text",
    "user_input",
    "instruction",
    "conversation",
    "conversation_a",
    "transcript",
    "question",
    "input",
    "content",
)
