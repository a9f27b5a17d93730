"""SQL names for the document functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .functions import delta, packet, shape
from .functions.jsontext import canonical_text, parse
from .functions.normalize import normalize_types
from .privacy.detect import detect


def register(spark: SparkSession) -> list[str]:
    """Register scalar functions and table functions; returns their names."""
    one = {
        "canonical_json": lambda d: canonical_text(shape.canonicalize(d)),
        "normalize_json": lambda d: canonical_text(normalize_types(d)),
        "compact_json": lambda d: canonical_text(shape.compact_schema(d)),
        "expand_json": lambda d: canonical_text(shape.expand_schema(d)),
        "document_hash": packet.packet_hash,
        "create_packet": lambda d: canonical_text(packet.create_packet(d)),
        "verify_packet": lambda d: "true" if packet.verify_packet(d) else "false",
        "replay_packet": lambda d: canonical_text(packet.replay_packet(d)),
    }
    two = {
        "diff_json": lambda a, b: canonical_text(delta.diff_documents(a, b)),
        "apply_delta": lambda a, b: canonical_text(delta.apply_delta(a, b)),
    }
    for name, f in one.items():
        spark.udf.register(name, _text_udf(f, 1))
    for name, f in two.items():
        spark.udf.register(name, _text_udf(f, 2))
    spark.udtf.register("detect_pii", DetectPii)
    spark.udtf.register("json_leaves", JsonLeaves)
    return [*one, *two, "detect_pii", "json_leaves"]


def _text_udf(f, args: int):
    if args == 1:

        @F.arrow_udf("string")
        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else f(parse(x)) for x in a.to_pylist()], pa.string())

        return run

    @F.arrow_udf("string")
    def run2(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(parse(x), parse(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

    return run2


@udtf(returnType=T.StructType([T.StructField(k, T.StringType()) for k in ("path", "field", "category", "detection")]))
class DetectPii:
    def eval(self, doc: str):
        for d in detect(parse(doc)) if doc is not None else ():
            yield d["path"], d["field"], d["category"], d["detection"]


@udtf(returnType=T.StructType([T.StructField(k, T.StringType()) for k in ("path", "value")]))
class JsonLeaves:
    def eval(self, doc: str):
        for path, value in (shape.flatten_leaves(parse(doc)) if doc is not None else {}).items():
            yield path, canonical_text(value)
