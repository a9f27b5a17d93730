"""Dynamic lane: JSON text columns through one Arrow function per operator.

Each function takes and returns JSON text; a null document gives null. Faults of one document raise, or,
if `permissive`, give null or fill the error field where there is one; document_error() says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import codec, dedupe, delta, packet, shape
from ..functions.jsontext import canonical_text, parse
from ..functions.limits import validate_document
from ..functions.normalize import normalize_types
from ..functions.packet import VIEWS
from ..privacy import detect as D
from ..privacy import protect as P
from ..privacy.policy import PrivacyError, validate_policy

COMPRESSION = "method string, raw_bytes bigint, compressed_bytes bigint, reduction_ratio double"
PACKET = (
    "ip_version string, spec_version string, packet_id string, packet_hash string, created_at string, encoding string, "
    f"compression struct<{COMPRESSION.replace(' ', ':').replace(',:', ', ')}>, payload string, refs string, delta string, metadata string"
)
DETECTION = "array<struct<path:string,field:string,category:string,detection:string,actionRequired:boolean>>"
VERIFIED = "ok boolean, code string, message string, fieldPaths array<string>"
#: What a document can be at fault with; anything else is a bug and raises.
FAULTS = (ValueError, RecursionError)


#: Rows that a function holds as Python objects at once, however many a batch has.
_ROWS = 500


def _in_parts(one: Callable, arrow: pa.DataType, *columns: pa.Array) -> pa.Array:
    """one(*values) of each row; the memory of one part is there again for the next."""
    parts = [pa.array([one(*row) for row in zip(*(c.slice(at, _ROWS).to_pylist() for c in columns))], arrow) for at in range(0, len(columns[0]), _ROWS)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(parts) if parts else pa.array([], arrow)


def _function(returns: str, one: Callable, *columns: Column) -> Column:
    """one(*values) of each row, part by part of a batch; values and result as Python objects."""
    dtype = T.StructType.fromDDL(returns) if " " in returns.split("<")[0].split(",")[0].strip() else T.DataType.fromDDL(returns)
    arrow = to_arrow_type(dtype)

    if len(columns) == 1:

        @F.arrow_udf(dtype)
        def run(a: pa.Array) -> pa.Array:
            return _in_parts(one, arrow, a)
    else:

        @F.arrow_udf(dtype)
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return _in_parts(one, arrow, a, b)

    return run(*columns)


def _of_documents(one: Callable, *columns: Column, returns: str = "string", permissive: bool = False) -> Column:
    """one(*parsed documents); null where a document is null or, if permissive, at fault."""

    def safe(*texts):
        if any(x is None for x in texts):
            return None
        try:
            return one(*map(parse, texts))
        except FAULTS:
            if not permissive:
                raise
            return None

    return _function(returns, safe, *columns)


def canonicalize(doc: Column, permissive: bool = False) -> Column:
    return _of_documents(lambda d: canonical_text(shape.canonicalize(d)), doc, permissive=permissive)


def normalize(doc: Column, permissive: bool = False) -> Column:
    return _of_documents(lambda d: canonical_text(normalize_types(d)), doc, permissive=permissive)


def compact(doc: Column, dictionary: dict[str, str] | None = None, permissive: bool = False) -> Column:
    shape.effective_dictionary(dictionary)
    return _of_documents(lambda d: canonical_text(shape.compact_schema(d, dictionary)), doc, permissive=permissive)


def expand(doc: Column, dictionary: dict[str, str] | None = None, permissive: bool = False) -> Column:
    shape.effective_dictionary(dictionary)
    return _of_documents(lambda d: canonical_text(shape.expand_schema(d, dictionary)), doc, permissive=permissive)


def dedupe_document(doc: Column, permissive: bool = False) -> Column:
    """JSON of {references, refs, value}."""
    return _of_documents(lambda d: canonical_text(dedupe.dedupe_structures(d)), doc, permissive=permissive)


def expand_references(root: Column, refs: Column, permissive: bool = False) -> Column:
    return _of_documents(lambda r, t: canonical_text(dedupe.expand_refs(r, t)), root, refs, permissive=permissive)


def diff(base: Column, nxt: Column, permissive: bool = False) -> Column:
    return _of_documents(lambda a, b: canonical_text(delta.diff_documents(a, b)), base, nxt, permissive=permissive)


def apply_delta(base: Column, patch: Column, permissive: bool = False) -> Column:
    return _of_documents(lambda a, b: canonical_text(delta.apply_delta(a, b)), base, patch, permissive=permissive)


def content_hash(doc: Column, permissive: bool = False) -> Column:
    return _of_documents(packet.packet_hash, doc, permissive=permissive)


def document_error(doc: Column) -> Column:
    """Why a document is not accepted, or null."""

    def one(x):
        try:
            if x is not None:
                validate_document(parse(x))
        except (*FAULTS, TypeError) as e:
            return str(e)
        return None

    return _function("string", one, doc)


def compress(text: Column, method: str = "auto") -> Column:
    """Struct of base64 payload and compression metadata."""

    def one(x):
        if x is None:
            return {}
        body, meta = codec.compress_text(x, method)
        return {"payload": body, **meta}

    return _function(f"payload string, {COMPRESSION}", one, text)


def baselines(text: Column) -> Column:
    """Sizes of a text under gzip and, where installed, brotli, and the shares saved."""
    fields = ", ".join(f"{n}_bytes bigint, {n}_reduction_percent double" for n in ("gzip", "brotli"))
    return _function(f"raw_bytes bigint, {fields}", lambda x: {} if x is None else codec.baselines(x), text)


def decompress(payload: Column, meta: Column) -> Column:
    """The text of a payload, checked against its metadata, a struct as compress() gives."""

    def one(x, m):
        return None if x is None or m is None else codec.decompress_text(x, {k: m[k] for k in ("method", "raw_bytes", "compressed_bytes", "reduction_ratio")})

    return _function("string", one, payload, meta)


def _packet_row(p: dict) -> dict:
    return {**p, "refs": canonical_text(p["refs"]), "delta": None if p["delta"] is None else canonical_text(p["delta"]), "metadata": canonical_text(p["metadata"])}


_PACKET_FIELDS = ("ip_version", "spec_version", "packet_id", "packet_hash", "created_at", "encoding", "compression", "payload", "refs", "delta", "metadata")


def create_packet(doc: Column, base: Column | None = None, *, created_at: str | None = None, metadata: dict | None = None, compression: str = "auto", permissive: bool = False) -> Column:
    """Packet struct with an error field. Errors raise, or fill that field if permissive."""
    shape.effective_dictionary((metadata or {}).get("compaction_dictionary"))

    def one(x, b=None):
        if x is None:
            return {}
        try:
            extra = {} if b is None else {"base": parse(b), "has_base": True}
            return _packet_row(packet.create_packet(parse(x), metadata=metadata, created_at=created_at, compression=compression, **extra))
        except FAULTS as e:
            if not permissive:
                raise
            return {"error": str(e)}

    return _function(PACKET + ", error string", one, *((doc,) if base is None else (doc, base)))


def _packet_of(row: dict | None) -> dict | None:
    """Packet of a struct row; None for a null row."""
    if row is None or row["packet_hash"] is None and row["payload"] is None:
        return None
    p = dict(row)
    if p["spec_version"] is None:
        del p["spec_version"]
    try:
        for k in ("refs", "metadata", "delta"):
            p[k] = None if p[k] is None else {} if p[k] == "{}" else parse(p[k])
    except ValueError:
        p["refs"] = None
    return p


def _bare(p: Column) -> Column:
    return F.struct(*[p[k].alias(k) for k in _PACKET_FIELDS])


def verify_packet(p: Column) -> Column:
    def one(r):
        x = _packet_of(r)
        return None if x is None else packet.verify_packet(x)

    return _function("boolean", one, _bare(p))


def packet_error(p: Column) -> Column:
    """What is wrong with the shell of a packet, or null."""

    def one(r):
        x = _packet_of(r)
        return None if x is None else packet.packet_fault(x)

    return _function("string", one, _bare(p))


def replay_packet(p: Column, verify_hash: bool = True, permissive: bool = False, views: tuple[str, ...] = VIEWS) -> Column:
    """Struct of the asked views as JSON text, and an error field."""

    def one(r):
        x = _packet_of(r)
        try:
            return {} if x is None else {k: canonical_text(v) for k, v in packet.replay_packet(x, verify_hash, views).items()}
        except FAULTS as e:
            if not permissive:
                raise
            return {"error": str(e)}

    return _function(", ".join(f"{v} string" for v in (*views, "error")), one, _bare(p))


def audit_packet(doc: Column, *, created_at: str | None = None, metadata: dict | None = None, compression: str = "auto") -> Column:
    """{packet_hash, refs, verified, replayed}: a document packed, verified, and replayed to its
    normalized form, in one function."""

    def one(x):
        if x is None:
            return {}
        d = parse(x)
        p = packet.create_packet(d, metadata=metadata, created_at=created_at, compression=compression)
        back = packet.replay_packet(p, views=("canonical",))["canonical"]
        return {"packet_hash": p["packet_hash"], "refs": canonical_text(p["refs"]), "verified": packet.verify_packet(p), "replayed": canonical_text(back) == canonical_text(normalize_types(d))}

    return _function("packet_hash string, refs string, verified boolean, replayed boolean", one, doc)


def detect(doc: Column, names: dict[str, str] | None = None, strict_timestamp_dob: bool = False, permissive: bool = False) -> Column:
    return _of_documents(lambda d: D.detect(d, names, strict_timestamp_dob), doc, returns=DETECTION, permissive=permissive)


def _report_text(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, separators=(",", ":"))


def protect(doc: Column, policy: dict, *, permissive: bool = False, verify: bool = False, **options) -> Column:
    """Struct {data, report, error} as JSON text. Secrets stay inside the function. With `verify` also `verified`, what
    verify_privacy() says of the two texts, in the same function, so that a task has one Python worker."""
    checked = validate_policy(policy)

    def one(x):
        if x is None:
            return {}
        try:
            out = P.protect(parse(x), checked, **options)
            texts = {"data": canonical_text(out["data"]), "report": _report_text(out["report"])}
        except FAULTS as e:
            if not permissive:
                raise
            return {"error": e.code if isinstance(e, PrivacyError) else "INVALID_POLICY"}
        return {**texts, "verified": _verified(**texts)} if verify else texts

    return _function("data string, report string, error string" + f", verified struct<{VERIFIED.replace(' ', ':').replace(',:', ', ')}>" * verify, one, doc)


def privacy_report(doc: Column, transformed: Column, policy: dict, permissive: bool = False) -> Column:
    checked = validate_policy(policy)
    return _of_documents(lambda a, b: _report_text(P.create_report(a, b, checked)), doc, transformed, permissive=permissive)


def _verified(data: str, report: str) -> dict:
    return P.verify_result({"data": parse(data), "report": parse(report)})


def verify_privacy(data: Column, report: Column) -> Column:
    """Struct {ok, code, message, fieldPaths}."""
    return _function(VERIFIED, lambda x, y: {} if x is None or y is None else _verified(x, y), data, report)


def create_private_packet(doc: Column, policy: dict, *, packet_options: dict | None = None, permissive: bool = False, **options) -> Column:
    """Packet struct, privacy report and error of protect-then-pack, in one function."""
    checked = validate_policy(policy)

    def one(x):
        if x is None:
            return {}
        try:
            out = P.create_private_packet(parse(x), checked, packet_options, **options)
            return {**_packet_row(out["packet"]), "privacy": _report_text(out["privacy"])}
        except FAULTS as e:
            if not permissive:
                raise
            return {"error": e.code if isinstance(e, PrivacyError) else str(e)}

    return _function(PACKET + ", error string, privacy string", one, doc)


def residual_scan(doc: Column, permissive: bool = False) -> Column:
    return _of_documents(D.residual_pattern_scan, doc, returns="array<string>", permissive=permissive)


def leaves(doc: Column, permissive: bool = False) -> Column:
    """Array of {path, value}: value is the leaf's canonical text."""
    return _of_documents(lambda d: [{"path": p, "value": canonical_text(v)} for p, v in shape.flatten_leaves(d).items()], doc, returns="array<struct<path:string,value:string>>", permissive=permissive)
