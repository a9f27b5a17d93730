"""Payload compression: none, zlib, and brotli where that module is installed."""

from __future__ import annotations

import base64
import gzip
import re
import zlib
from decimal import ROUND_HALF_UP, Decimal

from . import constants as C
from .limits import PacketError

try:
    import brotli
except ImportError:
    brotli = None

_BASE64 = re.compile(r"[A-Za-z0-9+/]*=*")


def reduction_ratio(raw: int, compressed: int) -> float:
    return 0.0 if raw <= 0 else 1 - compressed / raw


def reduction_percent(raw: int, compressed: int) -> float:
    """Saved share in per cent, to four places, halves up, as lifts.reduction_percent()."""
    return float(Decimal(repr(reduction_ratio(raw, compressed) * 100)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def compress_text(text: str, method: str = "auto") -> tuple[str, dict]:
    """(base64 payload, metadata). method: none, zlib, brotli, or auto (brotli, else zlib)."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > C.MAX_PACKET_BYTES:
        raise PacketError("payload exceeds the maximum size")
    if method == "auto":
        method = "brotli" if brotli else "zlib"
    if method == "none":
        body = raw
    elif method == "zlib":
        body = zlib.compress(raw, 9)
    elif method == "brotli" and brotli:
        body = brotli.compress(raw, quality=6)
    else:
        raise PacketError(f"compression method {method!r} is not available")
    ratio = 0.0 if method == "none" else max(0.0, reduction_ratio(len(raw), len(body)))
    return base64.b64encode(body).decode(), {"method": method, "raw_bytes": len(raw), "compressed_bytes": len(body), "reduction_ratio": ratio}


def baselines(text: str) -> dict:
    """Sizes of a text under plain gzip at its fastest, and brotli where that module is installed, each with
    the share saved in per cent."""
    raw = text.encode("utf-8", "surrogatepass")
    sizes = {"gzip": len(gzip.compress(raw, 1, mtime=0)), "brotli": len(brotli.compress(raw)) if brotli else None}
    out: dict = {"raw_bytes": len(raw)}
    for name, size in sizes.items():
        out[f"{name}_bytes"] = size
        out[f"{name}_reduction_percent"] = None if size is None else reduction_percent(len(raw), size)
    return out


def metadata_fault(meta: dict) -> str | None:
    """What is wrong with compression metadata, or None."""
    method, raw, small, ratio = (meta.get(k) for k in ("method", "raw_bytes", "compressed_bytes", "reduction_ratio"))
    if method not in ("brotli", "zlib", "none") or set(meta) != {"method", "raw_bytes", "compressed_bytes", "reduction_ratio"}:
        return "unsupported compression metadata"
    if not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in (raw, small)) or not 0 <= ratio <= 1:
        return "compression metadata is out of range"
    if method == "none":
        return None if raw == small and ratio == 0 else "metadata of an uncompressed payload is inconsistent"
    if raw > 0 and abs(ratio - max(0.0, reduction_ratio(raw, small))) > 1e-6:
        return "reduction ratio is inconsistent"
    return None


def _brotli_bounded(body: bytes) -> bytes:
    """Inflate in small steps, so that no more than the limit and one step's worth is held."""
    engine, out, size = brotli.Decompressor(), [], 0
    for at in range(0, len(body), 64):
        out.append(engine.process(body[at : at + 64]))
        size += len(out[-1])
        if size > C.MAX_DECOMPRESSED_BYTES:
            raise PacketError("payload is too large")
    if not engine.is_finished():
        raise PacketError("payload is truncated")
    return b"".join(out)


def decompress_text(payload: str, meta: dict) -> str:
    """Inverse of compress_text, bounded; any inconsistency raises PacketError."""
    if fault := metadata_fault(meta):
        raise PacketError(fault)
    if meta["raw_bytes"] == 0 and meta["reduction_ratio"] != 0:
        raise PacketError("reduction ratio is inconsistent")
    if len(payload) > C.MAX_BASE64_PAYLOAD_CHARS or not _BASE64.fullmatch(payload):
        raise PacketError("payload is not valid base64")
    bare = payload.rstrip("=")
    if len(bare) % 4 == 1:
        bare = bare[:-1]
    body = base64.b64decode(bare + "=" * (-len(bare) % 4))
    if len(body) > C.MAX_COMPRESSED_BUFFER_BYTES or len(body) != meta["compressed_bytes"]:
        raise PacketError("payload length does not match its metadata")
    try:
        if meta["method"] == "zlib":
            engine = zlib.decompressobj()
            body = engine.decompress(body, C.MAX_DECOMPRESSED_BYTES + 1)
            if not engine.eof:
                raise PacketError("payload is truncated or too large")
        elif meta["method"] == "brotli":
            if brotli is None:
                raise PacketError("brotli is not available")
            body = _brotli_bounded(body)
    except (zlib.error, *([brotli.error] if brotli else [])) as e:
        raise PacketError("decompression failed") from e
    if len(body) > C.MAX_DECOMPRESSED_BYTES or len(body) != meta["raw_bytes"]:
        raise PacketError("decompressed size does not match its metadata")
    return body.decode("utf-8", "replace")
