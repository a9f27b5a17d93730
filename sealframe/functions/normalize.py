"""Scalar normalization rules applied to every leaf of a document."""

from __future__ import annotations

import calendar
import math
import re
import unicodedata
from datetime import datetime, timedelta, timezone

from .jsontext import ordered
from .limits import assert_safe_key, validate_document

# The white space that ECMAScript's trim() removes.
JS_SPACE = "\t\n\x0b\x0c\r \xa0                　﻿"
#: The same as the inside of a regular expression's class, for Python and for Java.
SPACE = r"\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORDS = {"true": True, "yes": True, "false": False, "no": False}

_S = f"[{SPACE}]"
_SPACED = re.compile(rf"([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}){_S}+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?{_S}*(AM|PM)?", re.I)
_ISO = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?", re.I)
_DECIMAL = re.compile(r"[-+]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)")


_DIGIT = re.compile("[0-9]")


def boolean_word(s: str):
    return WORDS.get(s.strip(JS_SPACE).lower())


def _valid_day(y: int, m: int, d: int) -> bool:
    return y >= 100 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]


def timestamp_text(s: str):
    """ISO-8601 UTC text with milliseconds, or None. Times without an offset are UTC."""
    t = s.strip(JS_SPACE)
    if m := _SPACED.fullmatch(t):
        y, mo, d, h, mi = (int(m[i]) for i in range(1, 6))
        sec, half = int(m[6] or 0), (m[7] or "").upper()
        if _valid_day(y, mo, d) and mi <= 59 and sec <= 59:
            if half:
                h = h + 12 if half == "PM" and h < 12 else 0 if half == "AM" and h == 12 else h
            if h <= 23:
                return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{sec:02d}.000Z"
    m = _ISO.fullmatch(t)
    if not m:
        return None
    y, mo, d = (int(m[i]) for i in (1, 2, 3))
    h, mi, sec = (int(m[i] or 0) for i in (4, 5, 6))
    if not _valid_day(y, mo, d) or mi > 59 or sec > 59 or h > 23:
        return None
    ms = int(((m[7] or "") + "000")[:3])
    offset = timedelta()
    if m[8] and m[8].upper() != "Z":
        oh, om = int(m[8][1:3]), int(m[8][4:6])
        if oh > 23 or om > 59:
            return None
        offset = timedelta(hours=oh, minutes=om) * (-1 if m[8][0] == "-" else 1)
    try:
        at = datetime(y, mo, d, h, mi, sec, ms * 1000, timezone.utc) - offset
    except OverflowError:
        return None
    if (at.year, at.month, at.day) != (y, mo, d):
        return None
    return at.strftime(f"{at.year:04d}-%m-%dT%H:%M:%S.") + f"{ms:03d}Z"


def decimal_number(s: str):
    t = s.strip(JS_SPACE)
    if not _DECIMAL.fullmatch(t):
        return None
    x = float(t)
    return x if math.isfinite(x) else None


def normalize_scalar(v):
    """Words to booleans, then timestamps, then decimals; other strings become NFC."""
    if isinstance(v, str):
        s = v if v.isascii() else unicodedata.normalize("NFC", v)
        for rule in (boolean_word, timestamp_text, decimal_number) if _DIGIT.search(s) else (boolean_word,):
            if (out := rule(s)) is not None:
                return out
        return s
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v


def _walk(v):
    if isinstance(v, dict):
        for k in v:
            assert_safe_key(k)
        return {k: _walk(v[k]) for k in ordered(v)}
    if isinstance(v, list):
        return [_walk(x) for x in v]
    return normalize_scalar(v)


def normalize_types(doc):
    validate_document(doc)
    return _walk(doc)


def wide_integer(v: int):
    """An integer column value: a number while a double holds it, else its text."""
    return v if abs(v) <= 2**53 - 1 else str(v)
