"""Redaction, masks, tokens and HMACs of single values."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re

from ..functions.jsontext import number_text, string_text, utf16_key
from .detect import _RX

#: Fixed value: what a redacted value becomes.
REDACTED = "[REDACTED]"
#: What a transformed value starts with, by the name of what was done.
MARKS = {"tokenized": "tok_", "hmac": "hmac_"}


def redact(_value) -> str:
    return REDACTED


def mask_kind(field: str) -> str:
    k = field.lower()
    if "email" in k:
        return "email"
    if "phone" in k or "mobile" in k or k == "fax":
        return "phone"
    return "ssn" if "ssn" in k or "social" in k else "generic"


def _last_four(s: str) -> str:
    return re.sub("[^0-9]", "", s)[-4:].rjust(4, "0")


def mask_phone(s: str) -> str:
    return "***-***-" + _last_four(s)


def mask_ssn(s: str) -> str:
    return "***-**-" + _last_four(s)


def mask_email(s: str) -> str:
    at = s.find("@")
    return f"{s[0]}***@{s[at + 1:]}" if at > 0 else "****"


def mask_generic(_s: str) -> str:
    return "****"


def mask(s: str, kind: str) -> str:
    if kind == "email" and _RX["email"].search(s):
        return mask_email(s)
    if kind in ("phone", "ssn") and re.search("[0-9]", s):
        return mask_phone(s) if kind == "phone" else mask_ssn(s)
    return mask_generic(s)


def text_of(v) -> str:
    """Text that a mask sees for a value that is not a string."""
    if isinstance(v, str):
        return v
    if isinstance(v, dict):
        return "[object Object]"
    if isinstance(v, list):
        return ",".join("" if x is None else text_of(x) for x in v)
    return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else number_text(v)


def value_repr(v) -> str:
    """Typed, order-free text of a value, the input of tokens and HMACs."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "s:" + v
    if isinstance(v, bool):
        return "b:true" if v else "b:false"
    if isinstance(v, (int, float)):
        return "n:" + number_text(v)
    if isinstance(v, list):
        return "a:[" + ",".join(map(value_repr, v)) + "]"
    return "o:{" + ",".join(f"{string_text(k)}:{value_repr(v[k])}" for k in sorted(v, key=utf16_key)) + "}"


def field_label(path: str) -> str:
    parts = [p for p in re.sub(r"\[[^\]]+\]", ".", path).split(".") if p]
    return re.sub("[^a-zA-Z0-9_]", "_", parts[-1] if parts else "field")[:48] or "field"


def field_scoped_key(path: str) -> str:
    return path


def keyed_digest(path: str, value, secret: str) -> str:
    message = f"{field_scoped_key(path)}\0{value_repr(value)}".encode("utf-8", "replace")
    return _hmac.new(secret.encode(), message, hashlib.sha256).hexdigest()[:16]


def tokenize(path: str, value, secret: str) -> str:
    return f"{MARKS['tokenized']}{field_label(path)}_{keyed_digest(path, value, secret)}"


def hmac_field(path: str, value, secret: str) -> str:
    return f"{MARKS['hmac']}{field_label(path)}_{keyed_digest(path, value, secret)}"
