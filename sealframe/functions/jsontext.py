"""Canonical JSON text: ECMAScript number layout, key order and escapes."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from functools import lru_cache
from json.encoder import encode_basestring

_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
_LONE = re.compile("[\ud800-\udfff]")


def utf16_key(s: str) -> bytes:
    """Sort key that orders strings by UTF-16 code unit."""
    return s.encode("utf-16-be", "surrogatepass")


def property_key(s: str):
    """Sort key of canonical text: array-index keys by number, then the rest by UTF-16."""
    if _INDEX.fullmatch(s) and int(s) < 4294967295:
        return (0, int(s), b"")
    return (1, 0, utf16_key(s))


def number_text(x) -> str:
    """Shortest round-trip text of a double; NaN and infinities are null."""
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    if 1e-4 <= abs(x) < 1e15:
        return repr(x).removesuffix(".0")
    sign, digits, exp = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exp
    minus = "-" if sign else ""
    if len(text) <= point <= 21:
        return minus + text + "0" * (point - len(text))
    if 0 < point <= 21:
        return minus + text[:point] + "." + text[point:]
    if -6 < point <= 0:
        return minus + "0." + "0" * -point + text
    e = point - 1
    mantissa = text if len(text) == 1 else text[0] + "." + text[1:]
    return f"{minus}{mantissa}e{'+' if e > 0 else '-'}{abs(e)}"


def string_text(s: str) -> str:
    out = encode_basestring(s)
    return out if out.isascii() or not _LONE.search(out) else _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", out)


#: Keys of an object up to which their order is remembered.
_FEW_KEYS = 64


def _layout(keys: tuple[str, ...]) -> tuple[tuple[str, str], ...]:
    """(key, text before its value) of an object's keys, in canonical order."""
    return tuple((k, string_text(k) + ":") for k in sorted(keys, key=property_key))


_known_layout = lru_cache(maxsize=4096)(_layout)
_utf16_order = lru_cache(maxsize=4096)(lambda keys: tuple(sorted(keys, key=utf16_key)))


def ordered(keys) -> tuple[str, ...]:
    """Keys by UTF-16 code unit."""
    keys = tuple(keys)
    return _utf16_order(keys) if len(keys) <= _FEW_KEYS else tuple(sorted(keys, key=utf16_key))


def object_text(v: dict, text) -> str:
    """Canonical text of an object; text gives that of a value."""
    keys = tuple(v)
    layout = _known_layout(keys) if len(keys) <= _FEW_KEYS else _layout(keys)
    return "{" + ",".join([head + text(v[k]) for k, head in layout]) + "}"


def canonical_text(v) -> str:
    """Canonical JSON text of a tree of dict, list, str, number, bool and None."""
    kind = type(v)
    if kind is str:
        return string_text(v)
    if kind is int and -(2**53) <= v <= 2**53:
        return str(v)
    if isinstance(v, dict):
        return object_text(v, canonical_text)
    if isinstance(v, list):
        return "[" + ",".join([canonical_text(x) for x in v]) + "]"
    if v is None:
        return "null"
    if v is True:
        return "true"
    if v is False:
        return "false"
    return number_text(v)


_decode = json.JSONDecoder(parse_constant=lambda _: None).decode


def parse(text: str):
    """Parse JSON text; the last of repeated keys wins."""
    return _decode(text)
