"""Privacy policies: validation, path patterns and the rules they compile to."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.constants import PRIVACY_POLICY_VERSION, PRIVACY_SPEC_VERSION, UNSAFE_KEYS

ACTIONS = ("redact", "mask", "tokenize", "hmac", "remove", "deny")
WILDCARD = "[]"
_PIECES = re.compile(r"\[\]|[^.\[]+")
_SEGMENTS = re.compile(r"\[([^\]]*)\]|([^.\[]+)")

#: Error codes.
CODES = ("INVALID_POLICY", "POLICY_CONFLICT", "UNSAFE_POLICY_PATH", "UNHANDLED_PII_FIELD", "RAW_PII_REMAINS", "MISSING_TOKEN_SECRET", "MISSING_HMAC_SECRET", "DANGEROUS_KEY", "CIRCULAR_INPUT", "NON_PLAIN_OBJECT", "DENIED_FIELD_RAW")


class PrivacyError(ValueError):
    """Carries a code and field paths, never values."""

    def __init__(self, code: str, message: str, field_paths=()):
        super().__init__(f"{code}: {message}" + (f" ({', '.join(field_paths)})" if field_paths else ""))
        self.code, self.message, self.field_paths = code, message, list(field_paths)

    def __reduce__(self):
        return PrivacyError, (self.code, self.message, self.field_paths)


def parse_policy_path(path: str) -> tuple[str, ...]:
    """Segments of a policy path; [] is the only index allowed."""
    path = path.strip()
    if re.search(r"\[(?!\])", path):
        raise PrivacyError("INVALID_POLICY", "a policy path may only use [] as an index", [path])
    parts = tuple(_PIECES.findall(path))
    if not parts or UNSAFE_KEYS & set(parts):
        raise PrivacyError("UNSAFE_POLICY_PATH", "empty or forbidden policy path", [path])
    return parts


def path_segments(path: str) -> tuple[str, ...]:
    """Segments of a formatted path such as a.b[3].c."""
    return tuple(m[1] if m[1] is not None else m[2] for m in _SEGMENTS.finditer(path))


def format_path(parts) -> str:
    out = ""
    for i, p in enumerate(parts):
        out += f"[{p}]" if isinstance(p, int) else p if i == 0 else f".{p}"
    return out


def path_matches(path: str, pattern: tuple[str, ...]) -> bool:
    got = path_segments(path)
    return len(got) == len(pattern) and all((a.isascii() and a.isdigit()) if p == WILDCARD else a == p for a, p in zip(got, pattern))


@dataclass(frozen=True)
class Policy:
    """A validated policy. rules: (pattern, action) in order of precedence."""

    mode: str
    allow: tuple[str, ...]
    rules: tuple[tuple[tuple[str, ...], str], ...]
    allow_patterns: tuple[tuple[str, ...], ...]
    used: frozenset[str]

    def rule(self, path: str) -> str | None:
        return next((a for p, a in self.rules if path_matches(path, p)), None)

    def allows(self, path: str) -> bool:
        return any(path_matches(path, p) for p in self.allow_patterns)


def validate_policy(policy) -> Policy:
    if isinstance(policy, Policy):
        return policy
    known = {"version", "mode", "allow", *ACTIONS}
    if not isinstance(policy, dict) or policy.keys() - known or policy.get("version") != PRIVACY_POLICY_VERSION:
        raise PrivacyError("INVALID_POLICY", "policy has unknown fields or an unknown version")
    mode = policy.get("mode", "fail-closed")
    if mode not in ("fail-closed", "permissive"):
        raise PrivacyError("INVALID_POLICY", "unknown policy mode")
    for name in ("allow", *ACTIONS):
        paths = policy.get(name, [])
        if not isinstance(paths, (list, tuple)) or not all(isinstance(p, str) and p for p in paths):
            raise PrivacyError("INVALID_POLICY", f"{name} must be a list of paths")
    seen: set[str] = set()
    rules = []
    for action in ACTIONS:
        for path in map(str.strip, policy.get(action, [])):
            pattern = parse_policy_path(path)
            if path in seen:
                raise PrivacyError("POLICY_CONFLICT", "path appears twice among the actions", [path])
            seen.add(path)
            rules.append((pattern, action))
    allow = tuple(policy.get("allow", []))
    return Policy(mode, allow, tuple(rules), tuple(map(parse_policy_path, allow)), frozenset(a for a in ACTIONS if policy.get(a)))


def assert_supported_report(report: dict) -> None:
    if report.get("policy_version") == PRIVACY_POLICY_VERSION and report.get("pii_spec_version") != PRIVACY_SPEC_VERSION:
        raise PrivacyError("INVALID_POLICY", "unsupported privacy report version")
