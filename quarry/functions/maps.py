"""Lookup tables of the domain and the expressions that apply them.

All tables are small and fixed, so they become map literals in the plan: no join, no broadcast, no shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least to the worst, and their weights.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
SEVERITY_WEIGHT = {"info": 0.2, "low": 0.4, "medium": 0.6, "high": 0.8, "critical": 1.0}
#: The least confidence of each level, from the highest on; below the last it is very_low.
CONFIDENCE_LEVELS = [(0.9, "very_high"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]
#: Which tool's finding survives deduplication, and the confidence of a finding without one.
TOOL_PRIORITY = {"safety": 3, "semgrep": 2, "bandit": 1}
TOOL_CONFIDENCE = {"bandit": 0.8, "safety": 0.9, "semgrep": 0.85}
#: Each tool's severity words; any other word is medium. The empty tool is the default.
TOOL_SEVERITY = {
    "": {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "info": "info", "informational": "info"},
    "bandit": {"high": "high", "medium": "medium", "low": "low"},
    "semgrep": {"error": "high", "warning": "medium", "info": "low", "critical": "critical", "high": "high", "medium": "medium", "low": "low"},
    "safety": {"critical": "critical", "high": "high", "medium": "medium", "low": "low"},
}
#: Finding types of the first tool's test ids; any other id is other.
TEST_TYPES = {
    "command_injection": "B602 B603 B604 B605 B606 B607 B601",
    "sql_injection": "B608",
    "code_injection": "B201 B307 B313 B314 B315 B316 B317 B318 B319 B320 B322 B102 B110",
    "weak_cryptography": "B301 B303 B304 B305 B306 B308 B309 B312 B321 B501 B502 B503 B504 B505 B506",
    "unsafe_deserialization": "B302 B323",
    "path_traversal": "B310",
    "insecure_randomness": "B311",
    "hardcoded_secrets": "B105 B106 B107 B108",
    "security_misconfiguration": "B101 B701 B702 B703",
    "insecure_defaults": "B103",
    "broken_access_control": "B104",
    "denial_of_service": "B112",
    "xss": "B507",
}
#: Types by generic names; any other name is other.
GENERIC_TYPES = {"sql_injection": "sql_injection", "command_injection": "command_injection", "xss": "xss", "hardcoded_password": "hardcoded_secrets", "weak_crypto": "weak_cryptography"}
#: The first row with a word that the lower-cased rule id contains gives the type.
RULE_WORDS = [
    ("sql_injection", ["sql-injection", "sqli", "sql_injection"]),
    ("command_injection", ["command-injection", "cmd-injection", "shell-injection"]),
    ("xss", ["xss", "cross-site-scripting"]),
    ("path_traversal", ["path-traversal", "directory-traversal", "lfi"]),
    ("weak_cryptography", ["crypto", "weak-hash", "md5", "sha1", "weak-cipher"]),
    ("hardcoded_secrets", ["hardcoded", "secret", "password", "api-key"]),
    ("unsafe_deserialization", ["deserialization", "pickle", "yaml.load"]),
    ("broken_access_control", ["auth", "authz", "access-control"]),
]
#: An advisory's severity by the first row with a word it contains; none: high.
ADVISORY_WORDS = [
    ("critical", ["critical", "severe", "remote code execution", "rce"]),
    ("high", ["high", "arbitrary code", "injection"]),
    ("medium", ["medium", "moderate"]),
    ("low", ["low", "minor"]),
]
#: An explicit advisory severity counts one step up.
ADVISORY_SHIFT = {"critical": "critical", "high": "critical", "medium": "high", "low": "medium"}
#: Prefixes that tools put before descriptions, in the order in which they are taken off.
PREFIXES = ["bandit:", "safety:", "semgrep:", "[bandit]", "[safety]", "[semgrep]"]
#: Correlation strengths, SARIF levels, chunk type priorities.
STRENGTH_SCORE = {"very_strong": 0.95, "strong": 0.8, "moderate": 0.6, "weak": 0.45, "very_weak": 0.2}
SARIF_LEVEL = {"info": "note", "low": "note", "medium": "warning", "high": "error", "critical": "error"}


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    """The value of ``key`` in a fixed table."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_match(text: Column, rows: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    """The label of the first row with a word that ``text`` contains."""
    out = None
    for label, words in rows:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def severity_ordinal(severity: Column) -> Column:
    """0 (info) to 4 (critical); null for a word that is no severity."""
    return lookup({x: k for k, x in enumerate(SEVERITIES)}, severity)


def severity_weight(severity: Column) -> Column:
    return lookup(SEVERITY_WEIGHT, severity)


def confidence_level(confidence: Column) -> Column:
    out = None
    for least, level in CONFIDENCE_LEVELS:
        out = F.when(confidence >= least, level) if out is None else out.when(confidence >= least, level)
    return F.when(confidence.isNotNull(), out.otherwise("very_low"))


def tool_severity(tool: Column, word: Column) -> Column:
    """A tool's severity word as one of the five severities; what a tool doesn't know is medium."""
    out, word = None, F.lower(word)
    for name, table in TOOL_SEVERITY.items():
        if name:
            out = F.when(tool == name, lookup(table, word)) if out is None else out.when(tool == name, lookup(table, word))
    return F.coalesce(out.otherwise(lookup(TOOL_SEVERITY[""], word)), F.lit("medium"))


def test_type(test_id: Column) -> Column:
    return lookup({x: label for label, ids in TEST_TYPES.items() for x in ids.split()}, test_id, "other")


def rule_type(rule_id: Column, message: Column) -> Column:
    """Type by the words of a rule's id, else by those of its message."""
    message = F.lower(message)
    told = F.when(message.contains("sql"), "sql_injection")
    told = told.when(message.contains("command") | message.contains("shell") | message.contains("os"), "command_injection").otherwise("code_injection")
    return first_match(F.lower(rule_id), RULE_WORDS, F.when(message.contains("inject"), told).otherwise("other"))


def rule_confidence(rule_id: Column, told: Column) -> Column:
    """0.75, and 0.1 more for a rule id with a trusted word; a stated high, medium or low overrides both."""
    trusted = rule_id.contains("owasp") | rule_id.contains("cwe") | rule_id.contains("security")
    base = F.when(trusted, 0.85).otherwise(0.75)
    return F.least(F.lit(1.0), F.coalesce(lookup({"high": 0.9, "medium": 0.7, "low": 0.5}, F.lower(told)), base))


def test_confidence(word: Column) -> Column:
    return lookup({"high": 0.9, "medium": 0.7, "low": 0.5}, F.lower(word), 0.7)


def advisory_severity(severity: Column, advisory: Column) -> Column:
    return F.coalesce(lookup(ADVISORY_SHIFT, F.lower(severity)), first_match(F.lower(F.coalesce(advisory, F.lit(""))), ADVISORY_WORDS, F.lit("high")))


def clamped_confidence(tool: Column, confidence: Column) -> Column:
    """Confidence cut to 0..1; a missing one is the tool's own, 0.7 for tools without."""
    return F.coalesce(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), lookup(TOOL_CONFIDENCE, tool, 0.7))
