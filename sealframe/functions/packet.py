"""Create, check, verify and replay packets of single documents."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone

from . import constants as C
from .codec import compress_text, decompress_text, metadata_fault
from .dedupe import dedupe_with_text, expand_refs
from .delta import diff_documents
from .jsontext import canonical_text, parse
from .limits import PacketError, byte_size, validate_document
from .normalize import normalize_types
from .shape import canonicalize, compact_schema, expand_schema

_REF = re.compile(r"r[0-9]+")
_SHELL = ("ip_version", "packet_id", "packet_hash", "created_at", "encoding", "compression", "payload", "refs", "delta", "metadata")


def packet_hash(value) -> str:
    return hashlib.sha256(canonical_text(value).encode("utf-8", "surrogatepass")).hexdigest()


def envelope(root, refs, delta) -> dict:
    return {"ip_version": C.VERSION, "encoding": C.ENCODING, "root": root, "refs": refs, "delta": delta}


def envelope_text(root: str, refs, delta) -> str:
    """Canonical text of an envelope around the canonical text of its root."""
    return f'{{"delta":{canonical_text(delta)},"encoding":"{C.ENCODING}","ip_version":"{C.VERSION}","refs":{canonical_text(refs)},"root":{root}}}'


def create_packet(doc, *, base=None, has_base: bool = False, metadata: dict | None = None, created_at: str | None = None, compression: str = "auto") -> dict:
    """Normalize, compact, dedupe, hash and compress one document.

    has_base tells a null base from none. The result is checked before it is returned.
    """
    metadata = metadata or {}
    names = metadata.get("compaction_dictionary")
    compacted = compact_schema(normalize_types(doc), names)
    parts, root_text = dedupe_with_text(compacted)
    delta = None
    if has_base or base is not None:
        delta = diff_documents(compact_schema(normalize_types(base), names), compacted)
        if not isinstance(delta, (dict, list, str)) or not delta:
            delta = None
    text = envelope_text(root_text or canonical_text(parts["value"]), parts["refs"], delta)
    if byte_size(text) > C.MAX_PACKET_BYTES:
        raise PacketError("inner envelope exceeds the maximum size")
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    payload, meta = compress_text(text, compression)
    packet = {
        "ip_version": C.VERSION,
        "spec_version": C.SPEC_VERSION,
        "packet_id": digest[:16],
        "packet_hash": digest,
        "created_at": created_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z",
        "encoding": C.ENCODING,
        "compression": meta,
        "payload": payload,
        "refs": parts["refs"],
        "delta": delta,
        "metadata": metadata,
    }
    if fault := packet_fault(packet):
        raise PacketError(fault)
    return packet


def _body_fault(refs, delta) -> str | None:
    if not isinstance(refs, dict) or len(refs) > C.MAX_KEYS_PER_OBJECT or not all(map(_REF.fullmatch, refs)):
        return "invalid reference table"
    if delta is not None and (not isinstance(delta, dict) or len(delta) > C.MAX_KEYS_PER_OBJECT or C.UNSAFE_KEYS & delta.keys()):
        return "invalid delta"
    return None


def metadata_shell_fault(meta) -> str | None:
    if not isinstance(meta, dict) or meta.keys() - {"title", "labels", "compaction_dictionary"}:
        return "invalid metadata"
    title, labels, names = meta.get("title", ""), meta.get("labels", []), meta.get("compaction_dictionary", {})
    if not isinstance(title, str) or len(title) > 65536:
        return "invalid title"
    if not isinstance(labels, list) or len(labels) > 10000 or not all(isinstance(x, str) and len(x) <= 1024 for x in labels):
        return "invalid labels"
    if not isinstance(names, dict) or len(names) > 5000 or C.UNSAFE_KEYS & names.keys() or not all(isinstance(x, str) and len(x) <= 256 for x in names.values()):
        return "invalid compaction dictionary"
    return None


def packet_fault(p) -> str | None:
    """What is wrong with a packet's shell, or None."""
    if not isinstance(p, dict) or set(p) - {"spec_version"} != set(_SHELL):
        return "packet has missing or unknown fields"
    if p["ip_version"] != C.VERSION or p["encoding"] != C.ENCODING or p.get("spec_version", C.SPEC_VERSION) != C.SPEC_VERSION:
        return "unsupported packet version"
    digest = p["packet_hash"]
    if not isinstance(digest, str) or not re.fullmatch("[a-f0-9]{64}", digest) or p["packet_id"] != digest[:16]:
        return "invalid packet hash or id"
    if not isinstance(p["created_at"], str) or len(p["created_at"]) > 128:
        return "invalid created_at"
    if not isinstance(p["payload"], str) or len(p["payload"]) > C.MAX_BASE64_PAYLOAD_CHARS:
        return "invalid payload"
    return (isinstance(p["compression"], dict) and metadata_fault(p["compression"]) if isinstance(p["compression"], dict) else "invalid compression metadata") or _body_fault(p["refs"], p["delta"]) or metadata_shell_fault(p["metadata"])


def assert_supported_version(p) -> None:
    if fault := packet_fault(p):
        raise PacketError(fault)


def inner_envelope(p: dict) -> dict:
    """The checked inner envelope of a packet; raises PacketError."""
    try:
        inner = parse(decompress_text(p["payload"], p["compression"]))
    except (ValueError, RecursionError) as e:
        raise e if isinstance(e, PacketError) else PacketError("payload is not JSON") from e
    if not isinstance(inner, dict) or set(inner) | {"root"} != {"ip_version", "encoding", "root", "refs", "delta"}:
        raise PacketError("invalid inner envelope")
    if inner["ip_version"] != C.VERSION or inner["encoding"] != C.ENCODING:
        raise PacketError("unsupported inner envelope")
    if fault := _body_fault(inner["refs"], inner["delta"]):
        raise PacketError(fault)
    for part in (inner.get("root"), *inner["refs"].values(), inner["delta"]):
        validate_document(part)
    return envelope(inner.get("root"), inner["refs"], inner["delta"])


def verify_packet(p) -> bool:
    """Whether the payload of a well-formed packet has the hash that the packet states."""
    if packet_fault(p):
        return False
    try:
        inner = inner_envelope(p)
    except PacketError:
        return False
    return packet_hash(inner) == p["packet_hash"]


#: Views of a packed document that replay gives.
VIEWS = ("normalized", "canonical", "compacted", "deduped", "expanded")


def replay_packet(p, verify_hash: bool = True, views: tuple[str, ...] = VIEWS) -> dict:
    """The asked views of the packed document; only the hashed envelope is trusted."""
    assert_supported_version(p)
    inner = inner_envelope(p)
    if verify_hash and packet_hash(inner) != p["packet_hash"]:
        raise PacketError("packet hash verification failed")
    return views_of(inner, p["metadata"].get("compaction_dictionary"), views)


def views_of(inner: dict, names: dict[str, str] | None, views: tuple[str, ...] = VIEWS) -> dict:
    deduped = expand_refs(inner["root"], inner["refs"])
    expanded = expand_schema(deduped, names) if set(views) & {"normalized", "canonical", "expanded"} else None
    make = {"normalized": lambda: normalize_types(expanded), "canonical": lambda: canonicalize(expanded), "compacted": lambda: canonicalize(deduped), "deduped": lambda: deduped, "expanded": lambda: expanded}
    return {v: make[v]() for v in views}
