"""Canonical trees and key compaction."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

from . import constants as C
from .jsontext import property_key, utf16_key
from .limits import PacketError, assert_safe_key


def canonicalize(v):
    """Tree with keys in canonical order; non-finite numbers become null."""
    return _renamed(v, _same_order)


def _order(keys: tuple[str, ...], names: dict[str, str]) -> tuple[tuple[str, str], ...]:
    """(new key, old key) of an object's keys in canonical order of the new ones. Of two keys that
    get one name the last by UTF-16 stays."""
    out = {}
    for k in sorted(keys, key=utf16_key):
        assert_safe_key(k)
        to = names.get(k, k)
        assert_safe_key(to)
        out[to] = k
    return tuple((k, out[k]) for k in sorted(out, key=property_key))


def _remembered(names: dict[str, str]):
    """_order for some names, remembered for objects of few keys."""
    known = lru_cache(maxsize=4096)(lambda keys: _order(keys, names))
    return lambda keys: known(keys) if len(keys) <= 64 else _order(keys, names)


_same_order = _remembered({})


def _renamed(v, order):
    if isinstance(v, dict):
        return {to: _renamed(v[k], order) if isinstance(v[k], (dict, list, float)) else v[k] for to, k in order(tuple(v))}
    if isinstance(v, list):
        return [_renamed(x, order) for x in v]
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v


def validate_dictionary(merged: dict[str, str]) -> None:
    """Reject unsafe, reserved, ambiguous and repeated names."""
    for long, short in merged.items():
        for name in (long, short):
            assert_safe_key(name)
            if name in (C.REF_KEY, C.NUM_ADD_KEY) or name.startswith(C.RESERVED_PREFIX):
                raise PacketError(f"dictionary uses the reserved name {name!r}")
        if short != long and short in merged:
            raise PacketError(f"alias {short!r} is also a key")
    twice = [k for k, n in Counter(merged.values()).items() if n > 1]
    if twice:
        raise PacketError(f"duplicate alias {min(twice)!r}")


@lru_cache(maxsize=64)
def _compiled(custom: tuple[tuple[str, str], ...]):
    """(merged dictionary, its orders, the orders of its reverse)."""
    merged = {**C.DEFAULT_DICTIONARY, **dict(custom)}
    validate_dictionary(merged)
    return merged, _remembered(merged), _remembered({short: long for long, short in merged.items()})


def _compile(custom: dict[str, str] | None):
    return _compiled(tuple((custom or {}).items()))


def effective_dictionary(custom: dict[str, str] | None = None) -> dict[str, str]:
    return dict(_compile(custom)[0])


def compact_schema(v, dictionary: dict[str, str] | None = None):
    return _renamed(v, _compile(dictionary)[1])


def expand_schema(v, dictionary: dict[str, str] | None = None):
    return _renamed(v, _compile(dictionary)[2])


def sort_record_keys(record: dict) -> dict:
    return {k: record[k] for k in sorted(record, key=utf16_key)}


def stable_sort_strings(values) -> list[str]:
    return sorted(values, key=utf16_key)


def safe_entries(record: dict) -> list[tuple]:
    for k in record:
        assert_safe_key(k)
    return list(sort_record_keys(record).items())


def flatten_leaves(v) -> dict[str, object]:
    """Formatted path to scalar for every leaf below the root, in document order."""
    out: dict[str, object] = {}

    def walk(x, path):
        if isinstance(x, dict):
            for k, y in x.items():
                walk(y, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]")
        elif path:
            out[path] = x

    walk(v, "")
    return out
