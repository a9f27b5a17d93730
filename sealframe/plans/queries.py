"""Queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DEFAULT_DICTIONARY, DEFAULT_REVERSE
from ..operators import columns as X
from ..operators import documents as Doc
from ..operators import lifts as L
from ..operators import typed_privacy as TP
from ..privacy import detect as D
from ..sources import generators
from ..sources.tables import spread

AT = "2026-01-01T00:00:00.000Z"
#: Secrets of the test queries; production callers pass their own.
TOKEN_SECRET, HMAC_SECRET = "query-token-secret-0123456789", "query-hmac-secret-9876543210"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function name, with its SQL if given."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _json(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


def _number(column: str) -> str:
    """Text of a double of ordinary size, as JSON writes it."""
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


def _object(**fields: str) -> str:
    """SQL of a JSON object's text, keys in the given order; values are SQL of their texts."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


TS = """'"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"'"""
_EVENT = {"event_type": _json("event_type"), "event_id": "event_id", "props": _json("props"), "ts": TS, "user_id": "user_id", "value": _number("value")}
LONG = _object(event_id=_EVENT["event_id"], event_type=_EVENT["event_type"], props=_EVENT["props"], ts=TS, user_id="user_id", value=_EVENT["value"])
SHORT = _object(et=_EVENT["event_type"], event_id=_EVENT["event_id"], props=_EVENT["props"], ts=TS, uid="user_id", value=_EVENT["value"])


def _inner(root: str) -> str:
    return f"""'{{"delta":null,"encoding":"canonical-json","ip_version":"1","refs":{{}},"root":' || {root} || '}}'"""


# --- canonical text, keys, packets -----------------------------------------------------


@query(f"SELECT event_id, {LONG} AS doc FROM events")
def canonical_json_events(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", X.document_json(df).alias("doc"))


@query(f"SELECT event_id, {SHORT} AS doc FROM events")
def compact_keys_events(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", X.document_json(df, compact=True).alias("doc"))


NUMBERS = ["1e21", "1e20", "-1e-7", "0.000001", "1.5e300", "-0.0", "123456789012345680000", "5e-324", "0.1", "100", "-2.50", "9007199254740993"]
NUMBER_TEXTS = ["1e+21", "100000000000000000000", "-1e-7", "0.000001", "1.5e+300", "0", "123456789012345680000", "5e-324", "0.1", "100", "-2.5", "9007199254740992"]


@query(f"SELECT event_id, {NUMBER_TEXTS!r}[(event_id % {len(NUMBERS)} + 1)::INT] AS typed, {NUMBER_TEXTS!r}[(event_id % {len(NUMBERS)} + 1)::INT] AS dynamic FROM events")
def number_text(spark, d):
    """Layout of doubles, by a typed column and by parsing JSON."""
    text = F.get(F.array(*map(F.lit, NUMBERS)), (F.col("event_id") % len(NUMBERS)).cast("int"))
    x = text.cast("double")
    return table(spark, d, "events").select("event_id", X.canonical_json(x, T.DoubleType()).alias("typed"), Doc.canonicalize(text).alias("dynamic"))


MAPPED = """'{"' || (event_id % 5) || '":"' || user_id || '","10":"x",' || CASE WHEN event_type < 'uid' THEN '"' || event_type || '":null,"uid":"true"}' ELSE '"uid":"true","' || event_type || '":null}' END"""


@query(f"SELECT event_id, {MAPPED} AS doc FROM events")
def map_documents(spark, d):
    """Documents of map columns: index keys by number, then names, renamed by the dictionary."""
    keys = F.array(F.lit("10"), F.col("event_type"), F.lit("user_id"), (F.col("event_id") % 5).cast("string"))
    values = F.array(F.lit("x"), F.lit(None), F.lit("true"), F.col("user_id").cast("string"))
    doc = X.canonical_json(F.col("m"), T.MapType(T.StringType(), T.StringType()), DEFAULT_DICTIONARY)
    return table(spark, d, "events").select("event_id", F.map_from_arrays(keys, values).alias("m")).select("event_id", doc.alias("doc"))


@query("SELECT event_id, event_type AS et, user_id AS uid, event_type, user_id FROM events")
def compact_expand_struct(spark, d):
    df = table(spark, d, "events")
    dtype = T.StructType([df.schema["event_type"], df.schema["user_id"]])
    short = df.select("event_id", X.rename_struct(F.struct("event_type", "user_id"), dtype, DEFAULT_DICTIONARY).alias("s"))
    back = short.withColumn("b", X.rename_struct(F.col("s"), short.schema["s"].dataType, DEFAULT_REVERSE))
    return back.select("event_id", "s.et", "s.uid", "b.event_type", "b.user_id")


EXPANDED = _object(event_id="event_id", event_type=_EVENT["event_type"], payload=_EVENT["props"], person="user_id", timestamp=TS, value=_EVENT["value"])


@query(f"SELECT event_id, {EXPANDED} AS doc FROM events")
def expand_keys_dynamic(spark, d):
    """Short names of the default dictionary and of a custom one, at their long forms again."""
    df = spread(table(spark, d, "events")).withColumnsRenamed({"user_id": "uid2", "props": "pl"})
    return df.select("event_id", Doc.expand(X.document_json(df, compact=True), {"person": "uid2", "payload": "pl"}).alias("doc"))


@query(f"SELECT event_id, sha256({_inner(SHORT)}) AS packet_hash, substr(sha256({_inner(SHORT)}), 1, 16) AS packet_id FROM events")
def packet_hash_events(spark, d):
    df = table(spark, d, "events")
    digest = F.sha2(X.envelope_json(X.document_json(df, compact=True)).cast("binary"), 256)
    return df.select("event_id", digest.alias("packet_hash")).withColumn("packet_id", F.substring("packet_hash", 1, 16))


def event_packets(spark, d) -> DataFrame:
    df = table(spark, d, "events")
    return df.select("event_id", X.flat_packet(X.document_json(df, compact=True), AT).alias("packet"))


@query(f"SELECT event_id, to_base64(encode({_inner(SHORT)})) AS payload, octet_length(encode({_inner(SHORT)})) AS raw_bytes FROM events")
def packet_none_payload(spark, d):
    return event_packets(spark, d).select("event_id", "packet.payload", F.col("packet.compression.raw_bytes").cast("int").alias("raw_bytes"))


ORDER = _object(o_custkey="o_custkey", o_orderdate="""'"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"'""", o_orderkey="o_orderkey", o_orderpriority=_json("o_orderpriority"), o_orderstatus=_json("o_orderstatus"), o_totalprice=_number("o_totalprice"))


@query(f"SELECT o_orderkey, sha256({_inner(ORDER)}) AS packet_hash FROM orders")
def create_packet_dynamic(spark, d):
    df = spread(table(spark, d, "orders"))
    return df.select("o_orderkey", Doc.create_packet(X.document_json(df), created_at=AT, compression="zlib")["packet_hash"].alias("packet_hash"))


def _mutated(p, n):
    """A packet with one of twelve changes by n; none at 0. All but the last two must be found: these
    touch what is outside the hash."""
    text = F.decode(F.unbase64(p["payload"]), "UTF-8")

    def inner(old, new):
        changed = F.replace(text, F.lit(old), F.lit(new))
        size = F.octet_length(changed).cast("long")
        return p.withField("payload", X.base64_text(changed)).withField("compression.raw_bytes", size).withField("compression.compressed_bytes", size)

    changes = [
        p.withField("payload", F.concat(F.expr("left(packet.payload, length(packet.payload) - 4)"), F.lit("AAAA"))),
        p.withField("payload", F.substring(p["payload"], 1, 8)),
        p.withField("packet_hash", F.concat(F.translate(F.substring(p["packet_hash"], 1, 1), "0123456789abcdef", "123456789abcdef0"), F.substring(p["packet_hash"], 2, 63))),
        p.withField("spec_version", F.lit("99")),
        p.withField("ip_version", F.lit("99")),
        p.withField("compression.method", F.lit("zlib")),
        p.withField("compression.raw_bytes", p["compression"]["raw_bytes"] + 1),
        p.withField("compression.compressed_bytes", p["compression"]["compressed_bytes"] + 1),
        inner('"refs":{}', '"refs":{"injected":{"ok":false}}'),
        inner('"root":{', '"root":{"__ip_ref":"r9999","z":{'),
        inner('"delta":null', '"delta":{"changed":true}'),
        p.withField("refs", F.lit('{"r0":{"forged":true}}')),
        p.withField("created_at", F.lit("2030-01-01")).withField("metadata", F.lit('{"title":"other"}')),
    ]
    out = F
    for i, c in enumerate(changes, 1):
        out = out.when(n == i, c)
    return out.otherwise(p)


@query("SELECT event_id, event_id % 14 IN (0, 12, 13) AS verified FROM events")
def verify_tampered(spark, d):
    """A matrix of mutations: those of what the hash covers are found, provenance may change."""
    df = spread(event_packets(spark, d))
    return df.select("event_id", Doc.verify_packet(_mutated(F.col("packet"), F.col("event_id") % 14)).alias("verified"))


BAD_SHELLS = {
    "packet_id": "0" * 16, "ip_version": "2", "encoding": "json", "refs": '{"x1":{}}', "delta": "[1]", "metadata": '{"title":"t","owner":"x"}', "created_at": "x" * 129,
}


@query(f"SELECT event_id, event_id % {len(BAD_SHELLS) + 1} = 0 AS typed, event_id % {len(BAD_SHELLS) + 1} = 0 AS dynamic FROM events")
def shell_validation(spark, d):
    df = spread(event_packets(spark, d))
    packet = F
    for i, (field, value) in enumerate(BAD_SHELLS.items(), 1):
        packet = packet.when(F.col("event_id") % (len(BAD_SHELLS) + 1) == i, F.col("packet").withField(field, F.lit(value)))
    packet = packet.otherwise(F.col("packet").withField("metadata", F.lit('{"labels":["a"],"title":"t"}')))
    return df.select("event_id", X.shell_valid(packet).alias("typed"), Doc.packet_error(packet).isNull().alias("dynamic"))


REPLAYED = _object(event_id="event_id", event_type=_EVENT["event_type"], props=_EVENT["props"], timestamp=TS, user_id="user_id", value=_EVENT["value"])


@query(f"SELECT event_id, {REPLAYED} AS canonical, {SHORT} AS compacted FROM events")
def replay_roundtrip(spark, d):
    """Events of key `ts` come back under the long name that the dictionary gives to it."""
    views = Doc.replay_packet(F.col("packet"), views=("canonical", "compacted"))
    return spread(event_packets(spark, d)).select("event_id", views.alias("v")).select("event_id", "v.canonical", "v.compacted")


PROPS = "regexp_replace(props, ': ', ':')"
USER_PACKETS = f"""WITH e AS (SELECT user_id, event_id, event_type, {PROPS} AS p, count(*) OVER (PARTITION BY user_id, {PROPS}) AS n, row_number() OVER (PARTITION BY user_id, {PROPS} ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, p, 'r' || (row_number() OVER (PARTITION BY user_id ORDER BY p) - 1) AS id FROM (SELECT DISTINCT user_id, p FROM e WHERE n > 1)),
t AS (SELECT user_id, '{{' || string_agg('"' || id || '":' || p, ',' ORDER BY id) || '}}' AS refs FROM r GROUP BY user_id),
b AS (SELECT user_id, string_agg('{{"et":"' || event_type || '","event_id":' || event_id || ',"props":' || CASE WHEN n > 1 AND k > 1 THEN '{{"__ip_ref":"' || id || '"}}' ELSE p END || '}}', ',' ORDER BY event_id) AS body FROM e LEFT JOIN r USING (user_id, p) GROUP BY user_id)
SELECT user_id, sha256('{{"delta":null,"encoding":"canonical-json","ip_version":"1","refs":' || coalesce(refs, '{{}}') || ',"root":{{"events":[' || body || '],"uid":' || user_id || '}}}}') AS packet_hash, coalesce(refs, '{{}}') AS refs, true AS verified, true AS replayed
FROM b LEFT JOIN t USING (user_id)"""


@query(USER_PACKETS)
def packet_user_documents(spark, d):
    """A document of repeated structures per user: packed, verified and replayed."""
    df = table(spark, d, "events")
    doc = F.to_json(F.struct("user_id", F.sort_array(F.collect_list(F.struct("event_id", "event_type", F.from_json("props", "k int").alias("props")))).alias("events")))
    grouped = df.groupBy("user_id").agg(doc.alias("doc"))
    return grouped.select("user_id", Doc.audit_packet(F.col("doc"), created_at=AT, compression="zlib").alias("a")).select("user_id", "a.*")


TURN = _object(role=_json("role"), text=_json("text"), turn="turn")


@query(f"""SELECT conv_id, sha256({_inner(_object(conv_id="conv_id", turns="'[' || turns || ']'"))}) AS packet_hash, leaves FROM (SELECT conv_id, string_agg({TURN}, ',' ORDER BY turn) AS turns, 1 + 3 * count(*) AS leaves FROM conversations GROUP BY conv_id)""")
def nested_packets(spark, d):
    """Packets of conversations: arrays of objects, with text in several scripts."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    df = spread(table(spark, d, "conversations")).groupBy("conv_id").agg(F.to_json(F.struct("conv_id", turns.alias("turns"))).alias("doc"))
    return df.select("conv_id", Doc.create_packet(F.col("doc"), created_at=AT, compression="zlib")["packet_hash"].alias("packet_hash"), F.size(Doc.leaves(F.col("doc"))).cast("long").alias("leaves"))


@query(f"""SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"turns":[' || turns || ',{{"role":"x","text":null,"turn":-1}}]}}'
 ELSE '{{"conv_id":{{"__ip_num_add":1}}}}' END AS patch, true AS same FROM (SELECT conv_id, string_agg({TURN}, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)""")
def nested_deltas(spark, d):
    """Patches of nested documents: none, an array that grew, a number that rose; each applied again."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    more = F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("x").alias("role"), F.lit(None).cast("string").alias("text")))
    df = spread(table(spark, d, "conversations")).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    kind = F.col("conv_id") % 3
    text = lambda c, t: F.to_json(F.struct(c.alias("conv_id"), t.alias("turns")), {"ignoreNullFields": "false"})
    out = df.select("conv_id", text(F.col("conv_id"), F.col("turns")).alias("a"), text(F.col("conv_id") + F.when(kind == 2, 1).otherwise(0), F.when(kind == 1, F.concat("turns", more)).otherwise(F.col("turns"))).alias("b"))
    return out.select("conv_id", Doc.diff(F.col("a"), F.col("b")).alias("patch"), (Doc.apply_delta(F.col("a"), Doc.diff(F.col("a"), F.col("b"))) == Doc.canonicalize(F.col("b"))).alias("same"))


@query(f"SELECT event_id, 1 - 0.5 AS ratio, round((1 - octet_length(encode({SHORT}))::DOUBLE / octet_length(encode({LONG}))) * 100, 4) AS reduction_pct FROM events".replace("1 - 0.5 AS ratio", f"1 - octet_length(encode({SHORT}))::DOUBLE / octet_length(encode({LONG})) AS ratio"))
def reduction_ratio(spark, d):
    df = table(spark, d, "events")
    raw, small = F.octet_length(X.document_json(df)), F.octet_length(X.document_json(df, compact=True))
    return df.select("event_id", X.reduction_ratio(raw, small).alias("ratio"), L.reduction_percent(raw, small).alias("reduction_pct"))


@query("SELECT doc_id, sha256(text) AS text_sha256, octet_length(encode(text)) AS raw_bytes FROM documents")
def zlib_roundtrip(spark, d):
    df = spread(table(spark, d, "documents")).select("doc_id", Doc.compress(F.col("text"), "zlib").alias("z"))
    back = Doc.decompress(F.col("z.payload"), F.col("z"))
    return df.select("doc_id", F.sha2(back.cast("binary"), 256).alias("text_sha256"), F.col("z.raw_bytes").cast("int").alias("raw_bytes"))


@query("SELECT doc_id, octet_length(encode(text)) AS raw_bytes, true AS smaller FROM documents WHERE length(text) > 2000")
def gzip_baseline(spark, d):
    df = spread(table(spark, d, "documents").filter(F.length("text") > 2000)).select("doc_id", Doc.baselines(F.col("text")).alias("b"))
    return df.select("doc_id", F.col("b.raw_bytes").cast("int").alias("raw_bytes"), ((F.col("b.gzip_bytes") < F.col("b.raw_bytes")) & (F.col("b.gzip_reduction_percent") == L.reduction_percent(F.col("b.raw_bytes"), F.col("b.gzip_bytes")))).alias("smaller"))


# --- normalization ---------------------------------------------------------------------

WORD_FORMS = ["TRUE", " yes ", "No", "false", "0", "1", "truth"]


@query(f"""SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', 'yes') THEN true WHEN lower(trim(w)) IN ('false', 'no') THEN false END AS flag FROM (SELECT event_id, {WORD_FORMS!r}[(event_id % 7 + 1)::INT] AS w FROM events)""")
def normalize_boolean(spark, d):
    words = F.array(*map(F.lit, WORD_FORMS))
    return table(spark, d, "events").select("event_id", X.boolean_word(F.get(words, (F.col("event_id") % 7).cast("int"))).alias("flag"))


DECIMAL_FORMS = ["49.990", "-.5", "5.", "1e5", "00123", "1.2.3", "+7.25", "-7"]


@query(f"""SELECT event_id, CASE WHEN regexp_full_match(w, '[-+]?(\\d+\\.\\d*|\\d*\\.\\d+)') THEN CAST(w AS DOUBLE) END AS number FROM (SELECT event_id, {DECIMAL_FORMS!r}[(event_id % 8 + 1)::INT] AS w FROM events)""")
def normalize_decimal(spark, d):
    words = F.array(*map(F.lit, DECIMAL_FORMS))
    return table(spark, d, "events").select("event_id", X.decimal_number(F.get(words, (F.col("event_id") % 8).cast("int"))).alias("number"))


@query("""SELECT event_id, CASE event_id % 4
  WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:00.000Z')
  WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z')
  WHEN 2 THEN CASE WHEN hour(ts) >= 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') END
  ELSE NULL END AS iso FROM events""")
def normalize_timestamp(spark, d):
    ts = F.col("ts")
    form = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd h:mm a")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.lit("2026-02-31 10:00"))
    return table(spark, d, "events").select("event_id", X.timestamp_string(form).alias("iso"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"' || event_type || '"' ELSE event_id || '.5' END AS doc FROM events""")
def normalize_dynamic(spark, d):
    w = F.when(F.col("event_id") % 3 == 0, F.lit(" Yes")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".50")))
    return table(spark, d, "events").select("event_id", Doc.normalize(X.json_quote(w)).alias("doc"))


@query(f"SELECT page_id, {_json('nfc_normalize(html)')} AS doc FROM pages")
def normalize_nfc(spark, d):
    return spread(table(spark, d, "pages")).select("page_id", Doc.normalize(X.json_quote(F.col("html"))).alias("doc"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'unsafe' WHEN 2 THEN 'depth' WHEN 3 THEN 'key count' WHEN 4 THEN 'json' END AS fault FROM pages""")
def validate_documents(spark, d):
    """Pages as documents, four of five spoilt: an unsafe key, arrays 102 deep, 10,001 keys, cut text."""
    df = spread(table(spark, d, "pages"))
    doc, kind = X.document_json(df), F.col("page_id") % 5
    keys = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10_000)), lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":0'))), ","), F.lit("}"))
    bad = F.when(kind == 1, F.concat(F.lit('{"a":[{"__proto__":'), doc, F.lit("}]}"))).when(kind == 2, F.concat(F.repeat(F.lit("["), 102), doc, F.repeat(F.lit("]"), 102))).when(kind == 3, keys).when(kind == 4, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc)
    error = Doc.document_error(bad)
    fault = F.when(error.isNull(), None).when(error.contains("unsafe"), "unsafe").when(error.contains("depth"), "depth").when(error.contains("key count"), "key count").otherwise("json")
    return df.select("page_id", fault.alias("fault"))


# --- dedupe ----------------------------------------------------------------------------


@query("SELECT user_id, props, count(*) AS n FROM events GROUP BY ALL")
def dedupe_multiplicity(spark, d):
    return L.multiplicity(table(spark, d, "events"), ["user_id"], "props")


RANKED = "r AS (SELECT user_id, props, 'r' || (row_number() OVER (PARTITION BY user_id ORDER BY props) - 1) AS ref_id FROM events GROUP BY user_id, props HAVING count(*) > 1)"


@query(f"WITH {RANKED} SELECT event_id, ref_id FROM events LEFT JOIN r USING (user_id, props)")
def dedupe_ids(spark, d):
    return L.dedupe_rows(table(spark, d, "events"), "user_id", "event_id", "props").select("event_id", "ref_id")


@query(f"""WITH {RANKED} SELECT event_id, CASE WHEN ref_id IS NULL OR row_number() OVER (PARTITION BY e.user_id, e.props ORDER BY event_id) = 1 THEN props ELSE '{{"__ip_ref":"' || ref_id || '"}}' END AS emitted FROM events e LEFT JOIN r USING (user_id, props)""")
def dedupe_emit(spark, d):
    return L.dedupe_rows(table(spark, d, "events"), "user_id", "event_id", "props").select("event_id", "emitted")


@query("SELECT event_id, props AS expanded FROM events")
def expand_refs_join(spark, d):
    flat = L.dedupe_rows(table(spark, d, "events").select("event_id", "user_id", "props"), "user_id", "event_id", "props")
    refs = flat.filter("ref_id is not null").groupBy("user_id", "ref_id").agg(F.first("props").alias("body"))
    return L.expand_rows(flat, refs, "user_id").select("event_id", "expanded")


@query(f"""WITH t AS (SELECT conv_id, {_object(role=_json("role"), text=_json("substr(text, 1, 1)"))} AS body FROM conversations),
r AS (SELECT conv_id, body, count(*) AS n FROM t GROUP BY ALL HAVING count(*) > 1)
SELECT c.conv_id, count(r.body) AS refs, true AS same, coalesce(sum(n) - count(r.body), 0)::BIGINT AS emitted FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id""")
def dedupe_expand_dynamic(spark, d):
    """Turns cut to a letter, so that many are equal: refs made and emitted, and the way back."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.substring("text", 1, 1).alias("text"))))
    df = spread(table(spark, d, "conversations")).groupBy("conv_id").agg(F.to_json(F.struct(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("doc"))
    out = df.withColumn("doc", Doc.canonicalize(F.col("doc"))).withColumn("dd", Doc.dedupe_document(F.col("doc")))
    root, refs = F.get_json_object("dd", "$.value"), F.get_json_object("dd", "$.refs")
    emitted = F.size(F.split(root, '"__ip_ref":')) - 1
    return out.select("conv_id", F.size(F.json_object_keys(refs)).cast("long").alias("refs"), (Doc.expand_references(root, refs) == F.col("doc")).alias("same"), emitted.cast("long").alias("emitted"))


WITH_NULLS = "(SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 <> 0 THEN props END AS props FROM events)"


@query(f"""WITH e AS {WITH_NULLS}, r AS (SELECT user_id, props, 'r' || (row_number() OVER (PARTITION BY user_id ORDER BY props) - 1) AS ref_id FROM e WHERE props IS NOT NULL GROUP BY user_id, props HAVING count(*) > 1)
SELECT e.event_id, count(*) OVER (PARTITION BY e.user_id, e.props) AS n, r.ref_id FROM e LEFT JOIN r ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.props = r.props""")
def dedupe_nulls(spark, d):
    """Null documents are a document, null texts have no ref, and no row is lost."""
    df = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("props"))
    return L.dedupe_rows(df, "user_id", "event_id", "props").select("event_id", "n", "ref_id")


# --- delta -----------------------------------------------------------------------------

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


LAGGED = f"(SELECT *, lag(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM (SELECT o_custkey, o_orderkey, {CENTS} AS cents FROM orders))"


@query(f"""SELECT o_orderkey, cents - previous AS step, CASE WHEN previous IS NULL THEN NULL WHEN cents = previous THEN '{{}}' ELSE '{{"cents":{{"__ip_num_add":' || (cents - previous) || '}}}}' END AS patch FROM {LAGGED}""")
def delta_num_add(spark, d):
    return L.numeric_deltas(_orders(spark, d), "o_custkey", ["o_orderkey"], "cents").select("o_orderkey", "step", "patch")


@query(f"SELECT o_orderkey, {CENTS} AS replayed FROM orders")
def delta_replay(spark, d):
    steps = L.numeric_deltas(_orders(spark, d), "o_custkey", ["o_orderkey"], "cents")
    return L.replay_deltas(steps, "o_custkey", ["o_orderkey"], "step", "cents").select("o_orderkey", "replayed")


@query(f"""SELECT o_orderkey, '{{"cents":' || cents || '}}' AS rebuilt FROM {LAGGED} WHERE previous IS NOT NULL""")
def delta_diff_apply(spark, d):
    """Patch of each snapshot against the one before, applied again."""
    df = L.numeric_deltas(_orders(spark, d), "o_custkey", ["o_orderkey"], "cents").filter("previous is not null")
    base = F.to_json(F.struct(F.col("previous").alias("cents"), F.lit("x").alias("gone")))
    nxt = F.to_json(F.struct("cents"))
    return spread(df).select("o_orderkey", Doc.apply_delta(base, Doc.diff(base, nxt)).alias("rebuilt"))


def _spent(spark, d, year):
    return table(spark, d, "orders").filter(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.nullif(F.count(F.lit(1)), F.lit(2).cast("long")).alias("n"))


@query("""WITH b AS (SELECT o_custkey, nullif(count(*), 2) n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), a AS (SELECT o_custkey, nullif(count(*), 2) n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.n AS before, a.n AS after, CASE WHEN b.o_custkey IS NULL THEN 'added' WHEN a.o_custkey IS NULL THEN 'removed' WHEN a.n IS DISTINCT FROM b.n THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.o_custkey = b.o_custkey""")
def delta_key_changes(spark, d):
    return L.key_changes(_spent(spark, d, 1995), _spent(spark, d, 1996), ["o_custkey"], "n")


# --- detection -------------------------------------------------------------------------

LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


def _line_count(spark, d, category):
    """Lines by the category that their value patterns give, under no field name."""
    return _lines(spark, d).filter(X.pattern_category("", F.col("line")) == category).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


SSN_SQL = r"regexp_matches(line, '\b\d{3}-\d{2}-\d{4}\b')"
EMAIL_SQL = r"regexp_full_match(line, '[^\s@]+@[^\s@]+\.[^\s@]+')"
PHONE_SQL = r"regexp_matches(line, '\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b')"


@query(f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE NOT {SSN_SQL} AND NOT {EMAIL_SQL} AND {PHONE_SQL} GROUP BY 1")
def detect_phone_lines(spark, d):
    return _line_count(spark, d, "phone")


@query(r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\n]+')) AS line FROM documents) WHERE " + EMAIL_SQL + " GROUP BY 1")
def detect_email_tokens(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \t\n]+")).alias("line"))
    return words.filter(F.col("line").contains("@") & (X.pattern_category("", F.col("line")) == "email")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# A made-up value for each customer, by the field name that it is under: what each value is detected as, in
# both lanes, by its pattern. Values and categories are in one order, taken in turn.
VALUES = [
    ("note", "see 123-45-6789 there", "ssn"), ("note", "123-45-67890", None), ("note", "1123-45-6789", None), ("note", "a@b.co", "email"), ("note", "a@b.co\n", None), ("note", "a b@c.de", None),
    ("note", "\u00a0a@b.co", None), ("note", "call (212) 555-0199 now", "phone"), ("note", "555-01-99", None), ("birth_day", "1990-02-03", "dob"), ("birth_day", "1990-02-03\n", None),
    ("birth_day_updated", "1990-02-03", None), ("note", "1990-02-03", None), ("my_routing", "021-000-021", "routing"), ("my_routing", "02100002", None), ("aba", "021000021", "routing"),
    ("my_iban_text", "gb82 west 1234 5698 7654 32", "iban"), ("my_iban_text", "GB8", None), ("card_the_number", "4111 1111 1111 1111", "payment_card"), ("pan", "41111111111111111111", None),
    ("credit_card_text", "4111\u20031111-1111-1111", "payment_card"), ("note", "41111 11111 11111", None), ("credit_card_text", "x 4111111111111 y", None), ("pan", "4111111111111", "payment_card"),
]
CATEGORIES = "[" + ", ".join("NULL" if c is None else f"'{c}'" for _, _, c in VALUES) + "]"


@query(f"SELECT c_custkey, {CATEGORIES}[(c_custkey % {len(VALUES)} + 1)::INT] AS typed, {CATEGORIES}[(c_custkey % {len(VALUES)} + 1)::INT] AS dynamic FROM customer")
def detect_value_kinds(spark, d):
    """Value patterns of both lanes over values that match and that just do not."""
    df, k = spread(table(spark, d, "customer")), F.col("c_custkey") % len(VALUES)
    typed, doc = F, F
    for i, (field, value, _) in enumerate(VALUES):
        typed = typed.when(k == i, X.pattern_category(field, F.lit(value)))
        doc = doc.when(k == i, F.concat(F.lit("{" + json.dumps(field) + ":"), X.json_quote(F.lit(value)), F.lit("}")))
    found = F.filter(Doc.detect(doc), lambda x: x["detection"] == "pattern")
    return df.select("c_custkey", typed.alias("typed"), F.get(found, 0)["category"].alias("dynamic"))


CONTACT = "'c' || c_custkey || '@example.com'"
PHONE = "'555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
SSN = "lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"
PEOPLE = f"(SELECT c_custkey, c_name AS full_name, {CONTACT} AS email, {PHONE} AS phone, {SSN} AS ssn, c_mktsegment AS segment FROM customer)"


def people(spark, d) -> DataFrame:
    """Customers with made-up contact fields."""
    k, s = F.col("c_custkey"), (lambda x, n: F.lpad(x.cast("string"), n, "0"))
    return table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("full_name"), F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("email"), F.concat(F.lit("555-010-"), s(k % 10000, 4)).alias("phone"),
        F.concat(s(k % 900 + 100, 3), F.lit("-"), s(k % 90 + 10, 2), F.lit("-"), s(k % 10000, 4)).alias("ssn"), F.col("c_mktsegment").alias("segment"))


@query(f"""SELECT * FROM (VALUES {", ".join(f"('work.x_{n}', '{c}')" for n, c in D.FIELD_CATEGORIES.items())}, ('full_name', 'name'), ('email', 'email'), ('phone', 'phone'), ('ssn', 'ssn'), ('seen[].My ZIP', 'zip')) t(path, category)""")
def detect_field_names(spark, d):
    """All built-in names, at the end of longer ones in a nested field, and names of other writing."""
    df = people(spark, d).withColumn("work", F.struct(*[F.lit("").alias(f"x_{n}") for n in D.FIELD_CATEGORIES])).withColumn("seen", F.array(F.struct(F.lit("").alias("My ZIP"), F.lit("").alias("ssn2"))))
    rows = [(x["path"], x["category"]) for x in TP.detected_names(df.schema)]
    return spark.createDataFrame(rows, "path string, category string")


@query("SELECT c_custkey, 'a[0].market_segment:market:field_name,a[1].note:ssn:pattern' AS found FROM customer")
def detect_custom_names(spark, d):
    """A name of the caller's own, and a value in an array of objects."""
    df = spread(table(spark, d, "customer"))
    doc = F.concat(F.lit('{"a":[{"market_segment":"'), F.col("c_mktsegment"), F.lit('"},{"note":"x 123-45-6789"}]}'))
    hits = F.transform(Doc.detect(doc, {"Market  Segment": "market"}), lambda x: F.concat_ws(":", x["path"], x["category"], x["detection"]))
    return df.select("c_custkey", F.array_join(hits, ",").alias("found"))


@query(f"SELECT c_custkey, 'full_name:name:field_name,email:email:field_name,phone:phone:field_name,ssn:ssn:field_name' AS found FROM {PEOPLE}")
def detect_dynamic(spark, d):
    df = spread(people(spark, d))
    doc = F.to_json(F.struct("full_name", "email", "phone", "ssn", "segment"))
    hits = F.transform(Doc.detect(doc), lambda x: F.concat_ws(":", x["path"], x["category"], x["detection"]))
    return df.select("c_custkey", F.array_join(hits, ",").alias("found"))


@query(f"SELECT category, detection, count(*) AS n FROM (SELECT unnest([{{'category': 'ssn', 'detection': 'pattern'}}, {{'category': 'email', 'detection': 'pattern'}}, {{'category': 'phone', 'detection': 'pattern'}}], recursive := true) FROM {PEOPLE}) GROUP BY ROLLUP (category, detection)")
def privacy_report_rollup(spark, d):
    df = people(spark, d)
    plain = df.select("email", "phone", "ssn").toDF("a", "b", "c")
    hits = plain.select(F.explode(TP.value_hits(plain)).alias("h")).select("h.category", F.lit("pattern").alias("detection"))
    return L.detection_rollup(hits)


def nested_people(spark, d) -> DataFrame:
    """Customers with nested notes: in some of them a number that no field name tells of."""
    note = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("number is "), F.col("ssn"), F.lit("."))).when(F.col("c_custkey") % 4 == 2, F.col("email")).otherwise(F.lit("nothing to see"))
    history = F.array(F.struct(F.lit("opened").alias("what"), F.array(F.lit("fine"), note).alias("remarks")))
    df = people(spark, d)
    return df.select("c_custkey", F.struct(F.col("ssn"), F.struct(F.col("email")).alias("work")).alias("person"), history.alias("history"), F.col("segment"))


NESTED_POLICY = {"version": "v1", "redact": ["person.ssn"], "tokenize": ["person.work.email"], "allow": ["c_custkey", "person.ssn", "person.work.email", "segment"]}


@query(f"SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'history[0].remarks[1]' END AS path FROM {PEOPLE}")
def residual_ssn_scan(spark, d):
    df = spread(nested_people(spark, d))
    path = F.array_join(Doc.residual_scan(X.document_json(df.drop("person"))), ",")
    return df.select("c_custkey", path.alias("path")).withColumn("path", F.nullif("path", F.lit("")))


@query("SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'License') OR contains(text, 'example.com') OR contains(text, 'password')")
def leak_scan(spark, d):
    return L.leak_scan(table(spark, d, "documents"), "text", ["License", "example.com", "password", "abc"]).select("doc_id")


# --- actions ---------------------------------------------------------------------------


@query(f"SELECT c_custkey, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) AS email, '***-***-' || right(phone, 4) AS phone, '***-**-' || right(ssn, 4) AS ssn, '****' AS segment FROM {PEOPLE}")
def mask_values(spark, d):
    return people(spark, d).select("c_custkey", X.mask(F.col("email"), "email").alias("email"), X.mask(F.col("phone"), "phone").alias("phone"), X.mask(F.col("ssn"), "ssn").alias("ssn"), X.mask(F.col("segment"), "generic").alias("segment"))


def _digest(path: str, column: str, secret: str, prefix: str) -> str:
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"""'{prefix}_{path}_' || substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode('{path}') || '\\x00'::BLOB || encode('s:' || {column})))), 1, 16)"""


@query(f"SELECT c_custkey, {_digest('email', 'email', TOKEN_SECRET, 'tok')} AS email, {_digest('full_name', 'full_name', HMAC_SECRET, 'hmac')} AS full_name FROM {PEOPLE}")
def tokenize_and_hmac(spark, d):
    s = T.StringType()
    return people(spark, d).select("c_custkey", X.keyed_field("email", F.col("email"), s, TOKEN_SECRET, "tok").alias("email"), X.keyed_field("full_name", F.col("full_name"), s, HMAC_SECRET, "hmac").alias("full_name"))


POLICY = {"version": "v1", "redact": ["ssn"], "mask": ["phone"], "tokenize": ["email"], "hmac": ["full_name"], "allow": ["c_custkey", "full_name", "email", "phone", "ssn"]}
PROTECTED = f"SELECT c_custkey, {_digest('full_name', 'full_name', HMAC_SECRET, 'hmac')} AS full_name, {_digest('email', 'email', TOKEN_SECRET, 'tok')} AS email, '***-***-' || right(phone, 4) AS phone, '[REDACTED]' AS ssn FROM {PEOPLE}"
DOCUMENT = """'{"c_custkey":' || c_custkey || ',"email":"' || email || '","full_name":"' || full_name || '","phone":"' || phone || '","ssn":"' || ssn || '"}'"""


@query(PROTECTED)
def protect_typed(spark, d):
    """Allow-list prune drops the segment; the other fields are transformed."""
    return TP.protect(people(spark, d), POLICY, TOKEN_SECRET, HMAC_SECRET)


@query(f"SELECT c_custkey, segment FROM {PEOPLE}")
def protect_remove_deny(spark, d):
    return TP.protect(people(spark, d), {"version": "v1", "remove": ["email", "phone"], "deny": ["ssn", "full_name"]})


@query(f"SELECT c_custkey, {DOCUMENT} AS data, true AS ok, 4 AS transforms FROM ({PROTECTED})")
def protect_dynamic(spark, d):
    df = spread(people(spark, d))
    out = df.select("c_custkey", Doc.protect(X.document_json(df), POLICY, verify=True, token_secret=TOKEN_SECRET, hmac_secret=HMAC_SECRET).alias("p"))
    return out.select("c_custkey", "p.data", F.col("p.verified.ok").alias("ok"), F.get_json_object("p.report", "$.transform_count").cast("int").alias("transforms"))


@query(f"SELECT c_custkey, sha256({_inner(DOCUMENT)}) AS packet_hash FROM ({PROTECTED})")
def protect_then_packet(spark, d):
    df = spread(people(spark, d))
    packed = Doc.create_private_packet(X.document_json(df), POLICY, token_secret=TOKEN_SECRET, hmac_secret=HMAC_SECRET, packet_options={"created_at": AT, "compression": "none"})
    return df.select("c_custkey", packed["packet_hash"].alias("packet_hash"))


@query(f"SELECT path, action, count(*) AS n FROM (SELECT unnest([{{'path': 'c_custkey', 'action': 'kept'}}, {{'path': 'email', 'action': 'tokenized'}}, {{'path': 'full_name', 'action': 'hmac'}}, {{'path': 'phone', 'action': 'masked'}}, {{'path': 'segment', 'action': 'removed'}}, {{'path': 'ssn', 'action': 'redacted'}}], recursive := true) FROM {PEOPLE}) GROUP BY ALL")
def leaf_diff_report(spark, d):
    df = spread(people(spark, d))
    safe = TP.protect(df, POLICY, TOKEN_SECRET, HMAC_SECRET)
    leaf = lambda x: x.select(F.col("c_custkey").alias("id"), F.explode(Doc.leaves(X.document_json(x))).alias("l")).select("id", "l.*")
    return L.leaf_actions(leaf(df), leaf(safe), ["id"]).groupBy("path", "action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'UNHANDLED_PII_FIELD' WHEN 1 THEN 'DANGEROUS_KEY' END AS error FROM customer")
def fail_closed_quarantine(spark, d):
    df = spread(people(spark, d))
    third = F.col("c_custkey") % 3
    more = F.when(third == 0, F.concat(F.lit('"phone":"'), F.col("phone"), F.lit('"'))).when(third == 1, F.lit('"constructor":1')).otherwise(F.lit('"fine":1'))
    out = Doc.protect(F.concat(F.lit('{"ssn":"'), F.col("ssn"), F.lit('",'), more, F.lit("}")), {"version": "v1", "redact": ["ssn"], "allow": ["ssn", "fine"]}, permissive=True)
    return df.select("c_custkey", out["error"].alias("error"))


_NESTED_TOKEN = _digest("person.work.email", "email", TOKEN_SECRET, "tok").replace("tok_person.work.email_", "tok_email_")
NESTED = f"""'{{"c_custkey":' || c_custkey || ',"history":[{{"remarks":["fine","nothing to see"]}}],"person":{{"ssn":"[REDACTED]","work":{{"email":"' || {_NESTED_TOKEN} || '"}}}},"segment":"' || segment || '"}}'"""


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'UNHANDLED_PII_FIELD' ELSE {NESTED} END AS typed, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'UNHANDLED_PII_FIELD' ELSE {NESTED} END AS dynamic FROM {PEOPLE}")
def protect_nested(spark, d):
    """Fail-closed on values at any depth, in both lanes: rows with a number or an address in their notes are stopped."""
    df = spread(nested_people(spark, d))
    safe = TP.protect(df, NESTED_POLICY, TOKEN_SECRET, error="error", key="c_custkey")
    typed = safe.select("c_custkey", F.coalesce("error", X.document_json(safe.drop("error"))).alias("typed"))
    out = Doc.protect(X.document_json(df), NESTED_POLICY, permissive=True, token_secret=TOKEN_SECRET)
    dynamic = df.select("c_custkey", out.alias("p")).select("c_custkey", F.coalesce("p.error", "p.data").alias("dynamic"))
    return typed.join(dynamic, "c_custkey")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ssn|phone|email|full_name|segment||false' ELSE '||||segment|full_name,email,phone,ssn|true' END AS report FROM {PEOPLE}")
def inferred_report(spark, d):
    """What a report says of a protected document, and of one that only lost a field."""
    df = spread(people(spark, d))
    doc, done = X.document_json(df), Doc.protect(X.document_json(df), POLICY, token_secret=TOKEN_SECRET, hmac_secret=HMAC_SECRET)["data"]
    out = df.select("c_custkey", doc.alias("doc"), F.when(F.col("c_custkey") % 2 == 0, done).otherwise(F.to_json(F.struct("c_custkey", "full_name", "email", "phone", "ssn"))).alias("after"))
    report = Doc.privacy_report(F.col("doc"), F.col("after"), {"version": "v1"})
    part = lambda k: F.array_join(F.from_json(F.get_json_object("report", f"$.{k}"), "array<string>"), ",")
    lists = [part(f"fields_{k}") for k in ("redacted", "masked", "tokenized", "hmac", "removed")]
    seen = F.when(F.col("c_custkey") % 2 == 1, part("unhandled_sensitive_fields")).otherwise("")
    raw = F.when(F.col("c_custkey") % 2 == 1, F.get_json_object("report", "$.raw_pii_present")).otherwise("false")
    return out.select("c_custkey", report.alias("report")).select("c_custkey", F.concat_ws("|", *lists, seen, raw).alias("report"))


@query("SELECT industry, n, '' AS leaked FROM (VALUES ('healthcare', 500), ('finance', 500), ('hr', 500), ('saas', 500), ('education', 500), ('legal', 500)) t(industry, n)")
def industry_protection(spark, d):
    """Generated records of six industries under their policies: no value that was to be hidden is left."""
    out = []
    for name, (_, actions) in generators.INDUSTRIES.items():
        rows = generators.industry_rows(spark, name, 500)
        hidden = [f for a in actions.values() for f in a]
        safe = rows.select(Doc.protect(X.document_json(rows), generators.industry_policy(name), token_secret=TOKEN_SECRET, hmac_secret=HMAC_SECRET)["data"].alias("data"), *hidden)
        leaks = F.filter(F.array(*[F.when(F.col("data").contains(F.col(f)), F.lit(f)) for f in hidden]), lambda x: x.isNotNull())
        out.append(safe.select(F.lit(name).alias("industry"), F.array_join(leaks, ",").alias("leaked")))
    return functools.reduce(DataFrame.unionByName, out).groupBy("industry").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("leaked").alias("leaked"))


# --- audit and measures ----------------------------------------------------------------


@query("SELECT event_id, event_id % 5 <> 0 AS listed FROM events")
def manifest_audit(spark, d):
    p = event_packets(spark, d).select("event_id", "packet.packet_hash")
    manifest = p.filter("event_id % 5 <> 0")
    part = lambda x, listed: x.select("event_id", F.lit(listed).alias("listed"))
    return part(L.audit(p, manifest), False).unionByName(part(L.listed(p, manifest), True))


@query("""SELECT event_type, avg(value) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, quantile_cont(value, 0.99) AS p99_ms, 1000 / avg(value) AS ops_per_sec
FROM (SELECT event_type, CAST(round(abs(value) * 100) + 1 AS DOUBLE) AS value FROM events) GROUP BY 1""")
def timing_percentiles(spark, d):
    df = table(spark, d, "events").select("event_type", (F.round(F.abs("value") * 100) + 1).alias("value"))
    return L.timing_summary(df, "event_type", "value")


@query("""SELECT event_type, sha256('{"a":2.5,"b":{"x":1,"y":null},"event_type":"' || event_type || '"}') AS hash, 1 AS hashes FROM events GROUP BY 1""")
def hash_stability(spark, d):
    """Equal documents have one hash, whatever the order of their keys and the layout of numbers."""
    df = table(spark, d, "events").select("event_type").distinct()
    ways = ['{"event_type":"%s","b":{"y":null,"x":1},"a":2.50}', '{"a":25e-1,"b":{"x":1.0,"y":null},"event_type":"%s"}']
    hashed = [df.select("event_type", Doc.content_hash(F.format_string(w, "event_type")).alias("h")) for w in ways]
    both = hashed[0].unionByName(hashed[1])
    return both.groupBy("event_type").agg(F.min("h").alias("hash"), F.count_distinct("h").cast("int").alias("hashes"))
