"""Structural dedupe of one document and its inverse.

Each container is given the number of its canonical text, bottom-up and once; from there
the work is on small integers: counting, ranking the repeated texts, and emitting.
"""

from __future__ import annotations

from collections import Counter

from . import constants as C
from .jsontext import canonical_text, object_text, ordered, utf16_key
from .limits import PacketError, assert_safe_key


class _Index:
    """Numbers the distinct containers of a tree; equal canonical text, equal number."""

    def __init__(self, root):
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.of: dict[int, int] = {}
        self.count: Counter[int] = Counter()
        self.first: dict[int, object] = {}
        if isinstance(root, (dict, list)):
            self._read(root)
            self._count(root)

    def _read(self, v) -> str:
        if not isinstance(v, (dict, list)):
            return canonical_text(v)
        if isinstance(v, list):
            text = "[" + ",".join(map(self._read, v)) + "]"
        else:
            for k in v:
                assert_safe_key(k)
            text = object_text(v, self._read)
        n = self.number.setdefault(text, len(self.text))
        if n == len(self.text):
            self.text.append(text)
        self.of[id(v)] = n
        return text

    def _count(self, v) -> None:
        n = self.of[id(v)]
        self.count[n] += 1
        self.first.setdefault(n, v)
        for x in children(v):
            if isinstance(x, (dict, list)):
                self._count(x)


def children(v):
    return v if isinstance(v, list) else (v[k] for k in ordered(v))


def dedupe_structures(doc) -> dict:
    """{value, refs, references}: the first of equal containers stays, later ones become refs.

    Ref ids follow the UTF-16 order of the texts. Each body in the ref table is written on
    its own, so what repeats inside a body is written out at its first place there.
    """
    return dedupe_with_text(doc)[0]


def dedupe_with_text(doc) -> tuple[dict, str | None]:
    """dedupe_structures, and the value's canonical text where it is at hand."""
    index = _Index(doc)
    repeated = sorted((n for n, c in index.count.items() if c > 1), key=lambda n: utf16_key(index.text[n]))
    ids = {n: f"r{i}" for i, n in enumerate(repeated)}

    def emit(v, seen: set[int]):
        if not isinstance(v, (dict, list)):
            return v
        n = index.of[id(v)]
        if n in ids:
            if n in seen:
                return {C.REF_KEY: ids[n]}
            seen.add(n)
        if isinstance(v, list):
            return [emit(x, seen) for x in v]
        return {k: emit(v[k], seen) for k in ordered(v)}

    if not ids:
        return {"value": emit(doc, set()), "refs": {}, "references": []}, index.text[index.of[id(doc)]] if index.of else None
    return {
        "value": emit(doc, set()),
        "refs": {ids[n]: emit(index.first[n], set()) for n in repeated},
        "references": [{"id": ids[n], "fingerprint": index.text[n]} for n in repeated],
    }, None


def expand_refs(v, refs: dict, depth: int = 0, chain: tuple[str, ...] = ()):
    """Replace every ref by its body; unknown, cyclic and too deep refs raise PacketError."""
    if depth > C.MAX_REF_EXPANSION_DEPTH:
        raise PacketError("reference expansion is too deep")
    if isinstance(v, list):
        return [expand_refs(x, refs, depth + 1, chain) for x in v]
    if not isinstance(v, dict):
        return v
    ref = v.get(C.REF_KEY)
    if isinstance(ref, str):
        if ref not in refs:
            raise PacketError("missing reference")
        if ref in chain:
            raise PacketError("cyclic reference")
        return expand_refs(refs[ref], refs, depth + 1, (*chain, ref))
    for k in v:
        assert_safe_key(k)
    return {k: expand_refs(v[k], refs, depth + 1, chain) for k in ordered(v)}
