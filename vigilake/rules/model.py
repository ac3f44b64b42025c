"""Rule rows: the small dimension every pattern pack is made of."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Severities in rising order and the finding types.
SEVERITIES = ("low", "medium", "high", "critical")
FINDING_TYPES = ("vulnerability", "secret", "misconfig", "suspicious", "license", "other")

# What to do about a weakness class; used when a rule carries no advice of its own.
ADVICE_BY_CWE = {
    "CWE-77": "Pass arguments as a list and keep untrusted input out of command strings.",
    "CWE-78": "Remove commands built from untrusted input.",
    "CWE-79": "Encode output and avoid writing raw markup.",
    "CWE-89": "Bind query parameters instead of building statements from text.",
    "CWE-94": "Do not evaluate text that may come from outside.",
    "CWE-95": "Replace dynamic evaluation by explicit calls.",
    "CWE-200": "Check why the code reads private data and remove it if there is no need.",
    "CWE-250": "Run with the least privileges that work.",
    "CWE-494": "Verify a checksum or signature before running what was downloaded.",
    "CWE-502": "Read untrusted data with a format that cannot carry code.",
    "CWE-506": "Decode the literal and find out what it does.",
    "CWE-522": "Remove access to stored credentials.",
    "CWE-798": "Move the secret to a vault and rotate it.",
    "CWE-829": "Pin what is loaded to a fixed, trusted version.",
    "CWE-1104": "Pin the dependency and update it on a schedule.",
}
DEFAULT_ADVICE = "Review the place and confirm that the behaviour is intended."


@dataclass(frozen=True)
class Rule:
    """One detection rule. ``flags`` is any of ``i`` (ignore case), ``m``, ``s``."""

    rule_id: str
    title: str
    severity: str
    type: str
    pattern: str | None = None
    flags: str = ""
    cwe_id: str | None = None
    cvss_score: float | None = None
    confidence: float = 0.7
    scope: str = "line"
    group: str | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)
    remediation: str | None = None

    @property
    def severity_rank(self) -> int:
        return SEVERITIES.index(self.severity)

    @property
    def advice(self) -> str:
        return self.remediation or ADVICE_BY_CWE.get(self.cwe_id or "", DEFAULT_ADVICE)


@dataclass(frozen=True)
class Pack:
    """A named list of rules evaluated together by one analyzer."""

    name: str
    analyzer: str
    rules: tuple[Rule, ...]
    extensions: tuple[str, ...] = ()
    context_lines: int = 3
    column_base: int = 0

    def only(self, *rule_ids: str) -> "Pack":
        return replace(self, rules=tuple(r for r in self.rules if r.rule_id in rule_ids))

    def without_groups(self, *groups: str) -> "Pack":
        return replace(self, rules=tuple(r for r in self.rules if r.group not in groups))

    @property
    def matchable(self) -> tuple[Rule, ...]:
        return tuple(r for r in self.rules if r.pattern is not None)


def numbered(prefix: str, title: str, patterns, *, severity, type, confidence, flags="", scope="line", **extra):
    """Rules that share everything but the pattern, numbered from 1."""
    return tuple(
        Rule(f"{prefix}{i:02d}", title, severity, type, p, flags, confidence=confidence, scope=scope, **extra)
        for i, p in enumerate(patterns, 1)
    )
