"""The screen: text that looks like a secret or like an instruction. It reports and masks; it removes nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Rules in order, with the flag that a match raises.
SECRET, INSTRUCTION = "possible-secret", "possible-instruction-text"
SECRET_RULES = {
    "private-key-block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    "api-key": _B + r"sk-[A-Za-z0-9_-]{20,}",
    "github-token": _B + r"(?:ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,})",
    "aws-access-key-id": _B + r"AKIA[0-9A-Z]{16}" + _E,
    "slack-token": _B + r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "json-web-token": _B + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
INSTRUCTION_RULES = {
    "ignore-previous-instructions": f"(?i){_B}ignore{_SPACE}+(?:all{_SPACE}+)?(?:of{_SPACE}+)?(?:(?:the|your){_SPACE}+)?(?:previous|prior|above|earlier){_SPACE}+instructions{_E}",
    "disregard-the-above": f"(?i){_B}disregard{_SPACE}+(?:all{_SPACE}+)?(?:of{_SPACE}+)?(?:(?:the|your){_SPACE}+)?(?:above|previous|prior){_E}",
}
MASK = "[hidden: looks like a key]"


# A text without any of these strings cannot match the rule, and looking for a string is cheap.
HINTS = {
    "private-key-block": ("-----BEGIN ",),
    "api-key": ("sk-",),
    "github-token": ("ghp_", "github_pat_"),
    "aws-access-key-id": ("AKIA",),
    "slack-token": ("xox",),
    "json-web-token": ("eyJ",),
    "ignore-previous-instructions": ("ignore",),
    "disregard-the-above": ("disregard",),
}


def _hinted(text: Column, rule: str) -> Column:
    seen = F.lower(text) if rule in INSTRUCTION_RULES else text
    hints = [F.contains(seen, F.lit(h)) for h in HINTS[rule]]
    return hints[0] if len(hints) == 1 else hints[0] | hints[1]


def matches(text: Column, rule: str) -> Column:
    return _hinted(text, rule) & text.rlike((SECRET_RULES | INSTRUCTION_RULES)[rule])


def rules(text: Column) -> Column:
    """Names of the rules that match, in order."""
    return F.array_compact(F.array(*[F.when(matches(text, n), F.lit(n)) for n in HINTS]))


def flags(text: Column) -> Column:
    """Flags that are raised, each once."""
    raised = []
    for flag, names in ((SECRET, SECRET_RULES), (INSTRUCTION, INSTRUCTION_RULES)):
        found = None
        for n in names:
            found = matches(text, n) if found is None else found | matches(text, n)
        raised.append(F.when(found, F.lit(flag)))
    return F.array_compact(F.array(*raised))


def mask_secrets(text: Column) -> Column:
    """Every secret replaced; the rules are applied one after another, each to texts with its hint alone."""

    def step(rule: str, pattern: str):
        return lambda t: F.when(_hinted(t, rule), F.regexp_replace(t, pattern, MASK)).otherwise(t)

    held = F.array(text)  # an array of one, so that each step names the text once
    for rule, pattern in SECRET_RULES.items():
        held = F.transform(held, step(rule, pattern))
    return F.element_at(held, 1)
