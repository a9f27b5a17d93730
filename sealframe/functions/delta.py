"""Structural diff and patch of two documents."""

from __future__ import annotations

import math

from . import constants as C
from .jsontext import utf16_key
from .limits import assert_safe_key, deep_equal, is_number, validate_document
from .shape import canonicalize


def _plain(x: float):
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) <= 2**53 else x


def _finite(v) -> bool:
    return is_number(v) and math.isfinite(v)


def _diff(old, new, gone: str):
    if deep_equal(old, new):
        return {}
    if not (isinstance(old, dict) and isinstance(new, dict)):
        return new
    patch = {}
    for k in sorted(old.keys() | new.keys(), key=utf16_key):
        assert_safe_key(k)
        if k not in new:
            patch[k] = gone
        elif k not in old:
            patch[k] = new[k]
        elif _finite(old[k]) and _finite(new[k]):
            step = float(new[k]) - float(old[k])
            if step:
                patch[k] = {C.NUM_ADD_KEY: _plain(step)}
        elif (child := _diff(old[k], new[k], gone)) != {}:
            patch[k] = child
    return patch


def diff_documents(base, nxt, delete_sentinel: str = C.DELETE_SENTINEL):
    """Patch that turns base into nxt: removed keys, numeric steps, else the new value.

    A value that becomes {} leaves no trace, as an empty child patch means no change.
    """
    validate_document(base)
    validate_document(nxt)
    return canonicalize(_diff(canonicalize(base), canonicalize(nxt), delete_sentinel))


def _step(p):
    """The numeric step that a patch value holds, or None."""
    return p.get(C.NUM_ADD_KEY) if isinstance(p, dict) and is_number(p.get(C.NUM_ADD_KEY)) else None


def _apply(target, patch, gone: str):
    if not isinstance(patch, dict):
        return patch
    if not patch or not isinstance(target, dict):
        return patch or target
    out = dict(target)
    for k in sorted(patch, key=utf16_key):
        assert_safe_key(k)
        p, step = patch[k], _step(patch[k])
        if p == gone:
            out.pop(k, None)
        elif step is not None:
            out[k] = _plain(float(out[k]) + float(step)) if _finite(out.get(k)) else step
        elif k in out and isinstance(p, dict) and p:
            out[k] = _apply(out[k], p, gone)
        else:
            out[k] = p
    return out


def apply_delta(base, delta, delete_sentinel: str = C.DELETE_SENTINEL):
    validate_document(base)
    validate_document(delta)
    base, delta = canonicalize(base), canonicalize(delta)
    if delta == {} and isinstance(delta, dict):
        return base
    return canonicalize(_apply(base, delta, delete_sentinel))
