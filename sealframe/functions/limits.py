"""Structure limits, safe keys and the error type shared by all document functions."""

from __future__ import annotations

import math

from . import constants as C


class PacketError(ValueError):
    def __init__(self, message: str):
        super().__init__(C.ERROR_PREFIX + message)


def byte_size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def assert_safe_key(key: str) -> None:
    if key in C.UNSAFE_KEYS:
        raise PacketError(f"unsafe object key {key!r}")


#: Leaves that need no look.
_PLAIN = (int, float, bool, type(None))


def validate_document(v) -> None:
    """Check depth, sizes, keys and types of a tree; raises PacketError."""
    todo = [(v, 0)]
    while todo:
        x, depth = todo.pop()
        kind = type(x)
        if depth > C.MAX_DEPTH:
            raise PacketError("maximum depth exceeded")
        if kind in _PLAIN:
            continue
        if kind is str:
            if len(x) * 3 > C.MAX_STRING_BYTES and byte_size(x) > C.MAX_STRING_BYTES:
                raise PacketError("string exceeds the maximum UTF-8 size")
        elif isinstance(x, list):
            if len(x) > C.MAX_ARRAY_LENGTH:
                raise PacketError("array exceeds the maximum length")
            todo += [(y, depth + 1) for y in x]
        elif is_plain_object(x):
            if len(x) > C.MAX_KEYS_PER_OBJECT:
                raise PacketError("object exceeds the maximum key count")
            if not C.UNSAFE_KEYS.isdisjoint(x):
                raise PacketError(f"unsafe object key {min(C.UNSAFE_KEYS & x.keys())!r}")
            if not all(isinstance(k, str) for k in x):
                raise PacketError("object keys must be strings")
            todo += [(y, depth + 1) for y in x.values()]
        elif not isinstance(x, (str, *_PLAIN)):
            raise PacketError(f"unsupported value of type {type(x).__name__}")


def assert_json_compatible(v) -> None:
    """validate_document, and no integer that a double cannot hold."""
    validate_document(v)
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, (dict, list)):
            todo += x.values() if isinstance(x, dict) else x
        elif isinstance(x, int) and abs(x) > 2**53 - 1:
            raise PacketError("integer is too large for a number of JSON")


def is_plain_object(v) -> bool:
    return isinstance(v, dict)


def deep_equal(a, b) -> bool:
    """Structural equality where true is not 1; numbers compare as doubles, 0 is not -0 and NaN is NaN."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(deep_equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(deep_equal, a, b))
    if is_number(a) and is_number(b):
        a, b = float(a), float(b)
        return a == b and math.copysign(1, a) == math.copysign(1, b) or a != a and b != b
    return type(a) is type(b) and a == b


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)
