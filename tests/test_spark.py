import json

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import sealframe as S
from sealframe.functions import codec
from sealframe.operators import documents, lifts, typed_privacy
from sealframe.operators.columns import document_json
from sealframe.plans import queries as Q
from sealframe.sources import generators, tables
from sealframe.sql import register
from sealframe.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "customer orders events documents pages conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in got)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    out = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.SQL[name])
    names, found = [c[0] for c in want.description], want.fetchall()
    assert sorted(out.columns) == sorted(names) and rows(out.columns, map(tuple, out.collect())) == rows(names, found)


@pytest.mark.parametrize("kind", ["low", "medium", "high", "nested-low", "nested-high"])
def test_generated_records_equal_dynamic_lane(spark, kind):
    df = generators.entropy_records(spark, kind, 40)
    text = document_json(df)
    assert df.select(text.alias("t"), documents.canonicalize(F.to_json(F.struct("*"))).alias("d")).filter("t <> d").count() == 0


def test_sources_round_trip(spark, tmp_path):
    df = generators.users(spark, 20)
    df.write.parquet(str(tmp_path / "p"))
    docs = tables.read_documents(spark, str(tmp_path / "p"))
    packed = docs.select(documents.create_packet(F.col("doc"), created_at="t", compression="zlib").alias("packet"))
    tables.write_packets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(documents.verify_packet(F.struct("*")).alias("ok")).filter("ok").count() == 20
    assert tables.replicate(df.limit(3), 10, "idx").count() == 10


def test_sql_names(spark):
    register(spark)
    assert spark.sql("""SELECT canonical_json('{"b":1,"a":2.50}') AS x""").first()[0] == '{"a":2.5,"b":1}'
    assert spark.sql("""SELECT category FROM detect_pii('{"email":"x"}')""").first()[0] == "email"
    assert spark.sql("""SELECT apply_delta('{"a":1}', diff_json('{"a":1}', '{"a":5}')) AS x""").first()[0] == '{"a":5}'


def test_snapshot_stream(spark, tmp_path):
    data = [("k", 1, {"a": 1}), ("k", 2, {"a": 3}), ("j", 1, {"b": 1}), ("k", 3, {"a": 3, "c": 1})]
    spark.createDataFrame([(k, n, json.dumps(d)) for k, n, d in data], "key string, seq long, doc string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, doc string").parquet(str(tmp_path / "in"))
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    q = streams.snapshot_deltas(stream).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.seq): r.patch for r in spark.table("deltas").collect()}
    assert got == {("k", 1): None, ("k", 2): '{"a":{"__ip_num_add":2}}', ("j", 1): None, ("k", 3): '{"c":1}'}


def test_packet_stream(spark, tmp_path):
    generators.users(spark, 10).select(document_json(generators.users(spark, 10)).alias("doc")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc string").parquet(str(tmp_path / "in"))
    q = streams.packet_stream(stream, compression="none").select("packet.packet_hash").writeStream.format("memory").queryName("packets").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("packets").distinct().count() == 10


def test_distinct_packets(spark, tmp_path):
    """Equal packets within the watermark pass once, also in a later batch."""
    df = generators.users(spark, 6).withColumn("at", F.timestamp_seconds(F.col("idx") + 10_000_000))
    rows = df.select("at", document_json(df.drop("at")).alias("doc"))
    for i in range(2):
        rows.unionByName(rows.limit(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, doc string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    packed = streams.distinct_packets(streams.packet_stream(stream, compression="none", created_at="t"), "at")
    q = packed.select("packet_hash").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 6 == spark.table("once").distinct().count()


def test_typed_protect_fails_closed(spark):
    df = spark.createDataFrame([("my ssn 123-45-6789", {"ssn": "123-45-6789"})], "note string, m map<string,string>")
    with pytest.raises(S.PrivacyError, match="INVALID_POLICY"):
        typed_privacy.protect(df, {"version": "v1", "redact": ["x"]})
    with pytest.raises(Exception, match="UNHANDLED_PII_FIELD.*note"):
        typed_privacy.protect(df, {"version": "v1", "remove": ["m"]}).collect()
    deep = spark.createDataFrame([([[("x", ["ok", "a@b.co"])]],)], "a array<array<struct<k:string,v:array<string>>>>")
    with pytest.raises(Exception, match=r"UNHANDLED_PII_FIELD.*a\[0\]\[0\]\.v\[1\]"):
        typed_privacy.protect(deep, {"version": "v1"}).collect()
    assert typed_privacy.protect(deep, {"version": "v1", "mode": "permissive"}).count() == 1
    assert typed_privacy.protect(df, {"version": "v1", "redact": ["note", "m"]}).first() == ("[REDACTED]", "[REDACTED]")
    assert typed_privacy.protect(df, {"version": "v1", "allow": ["note"]}).first() == ("my ssn 123-45-6789",)


def test_lifts_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "x"), (None, 1, "y"), (None, 1, "y"), (1, 4, None), (1, 5, "\U00010000"), (1, 6, "\U00010000"), (1, 7, "\uffee"), (1, 8, "\uffee")], "d int, p int, t string")
    got = {(r.d, r.p, r.t, r.n, r.ref_id) for r in lifts.dedupe_rows(df, "d", "p", "t").collect()}
    assert got == {(1, 1, "x", 2, "r0"), (1, 2, None, 2, None), (1, 3, "x", 2, "r0"), (None, 1, "y", 2, "r0"), (1, 4, None, 2, None), *[(1, p, "\U00010000", 2, "r1") for p in (5, 6)], *[(1, p, "\uffee", 2, "r2") for p in (7, 8)]}
    emitted = [r.emitted for r in lifts.dedupe_rows(df.filter("d is null"), "d", "p", "t").collect()]
    assert sorted(emitted) == ["y", '{"__ip_ref":"r0"}']
    refs = spark.createDataFrame([(1, "r0", "x")], "d int, ref_id string, body string")
    with pytest.raises(Exception, match="missing reference r"):
        lifts.expand_rows(lifts.dedupe_rows(df, "d", "p", "t"), refs, "d").collect()
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, None), (2, 5), (None, 1)], [(1, None), (2, None), (3, None), (None, 1)]))
    assert {(r.k, r.change) for r in lifts.key_changes(a, b, ["k"], "v").collect()} == {(1, "same"), (2, "changed"), (3, "added"), (None, "same")}
    assert spark.range(1).select(lifts.reduction_percent(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_faults_of_one_document(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "doc string")
    for f in (documents.canonicalize, documents.normalize, documents.compact, documents.expand, documents.content_hash, documents.detect, documents.residual_scan, documents.leaves):
        got = [r[0] for r in df.select(f(F.col("doc"), permissive=True)).collect()]
        assert got[0] is not None and got[1:] == [None, None]
        with pytest.raises(Exception):
            df.select(f(F.col("doc"))).collect()


def test_shapes_and_industries(spark):
    seed = spark.read.json(spark.sparkContext.parallelize(['{"id":7,"state":"open","user":{"login":"u"},"labels":["l"]}']))
    out = tables.shape_records(tables.replicate(seed, 3, "id").withColumn("n", F.lit(2)), "api", "issues", "n")
    assert out.columns == ["i", "kind", "id", "state", "actor", "labels"] and out.count() == 3
    spans = spark.range(300, 301).select("id", F.lit("s").alias("name"), F.struct(F.lit("svc").alias("service.name")).alias("resource"))
    assert tuple(tables.shape_records(spans, "trace", "t", "id").first()) == (300, "t", "trace-300", "s", "svc")
    assert tables.shape_records(spans, "transaction", "t", "id").first()["hash"] == "0x000000000000012c"
    with pytest.raises(ValueError):
        tables.replicate(spark.range(tables.SEED_ROWS + 1), 3, "id")
    named = generators.named_users(tables.replicate(seed, 3, "id").withColumn("n", F.lit(5)), "web-users", "n").first()
    assert named.national_id == "SYN-WEB-USERS-000005" and named.email == "web-users.5@example.invalid"
    for kind in ("low", "medium", "high", "nested-low", "nested-high"):
        u = generators.users(spark, 30, kind)
        assert u.count() == 30
        typed_privacy.protect(u, generators.USER_POLICY, "t" * 20, "h" * 20).collect()


def test_map_documents(spark):
    df = spark.range(1).select(F.create_map(F.lit("b"), F.lit(1.5), F.lit("10"), F.lit(2.0), F.lit("9"), F.lit(None), F.lit("user_id"), F.lit(3.0)).alias("m"), F.lit(None).cast("struct<a:int>").alias("s"))
    assert df.select(document_json(df, compact=True)).first()[0] == '{"m":{"9":null,"10":2,"b":1.5,"uid":3},"s":null}'
    lists = spark.range(1).select(F.array(F.lit(1.0), F.lit(None), F.lit(1e-7)).alias("a"), F.array(F.struct(F.array(F.lit(0.5)).alias("x"))).alias("b"))
    assert lists.select(document_json(lists.select("a"))).first()[0] == '{"a":[1,null,1e-7]}'
    with pytest.raises(TypeError, match="dynamic lane"):
        document_json(lists)
    bad = spark.range(1).select(F.create_map(F.lit("__proto__"), F.lit(1)).alias("m"))
    with pytest.raises(Exception, match="unsafe"):
        bad.select(document_json(bad)).collect()


def test_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"__proto__":1}',), (None,)], "doc string")
    out = [r[0] for r in df.select(documents.create_packet(F.col("doc"), permissive=True)["error"]).collect()]
    assert out[0] is None and "unsafe" in out[1] and out[2] is None
    with pytest.raises(Exception, match="unsafe"):
        df.select(documents.create_packet(F.col("doc"))).collect()
    assert S.packet_fault({}) is not None


def test_gzip_shares_round_halves_up(spark, monkeypatch):
    """1260 of 2560 bytes save 50.78125 %, which the function gives as the expression does."""
    ties = [(raw, small) for raw in range(64, 8000, 64) for small in range(1, 2 * raw) if (raw - small) * 2_000_000 % (2 * raw) == raw]
    got = spark.createDataFrame(ties, "raw long, small long").select("raw", "small", lifts.reduction_percent(F.col("raw"), F.col("small"))).collect()
    assert len(got) > 1000 and all(codec.reduction_percent(raw, small) == p for raw, small, p in got)
    monkeypatch.setattr(codec.gzip, "compress", lambda *a, **k: b"x" * 1260)
    assert codec.baselines("y" * 2560)["gzip_reduction_percent"] == 50.7813


def test_protect_dynamic_runs_one_function_a_task(spark):
    """Whose Python objects are those of a part of a batch, and which verifies as verify_privacy() does."""
    plan = Q.QUERIES["protect_dynamic"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    df = spark.createDataFrame([('{"ssn":"123-45-6789","a":1}',), ('{"a":"my ssn 123-45-6789"}',), (None,)], "doc string")
    for policy in ({"version": "v1", "redact": ["ssn"], "mode": "permissive"}, {"version": "v1", "redact": ["ssn"], "allow": ["a", "ssn"]}):
        p = df.select(documents.protect(F.col("doc"), policy, verify=True).alias("p")).cache()
        got = p.select("p.verified", documents.verify_privacy(F.col("p.data"), F.col("p.report")).alias("v")).collect()
        assert [r.verified for r in got[:2]] == [r.v for r in got[:2]] and got[2].verified is None
    assert [r.verified.ok for r in got[:2]] == [True, False]
    held = []

    class Column(list):
        def slice(self, at, n):
            held.append(len(self[at : at + n]))
            return Column(self[at : at + n])

        def to_pylist(self):
            return list(self)

    rows = Column(range(3 * documents._ROWS + 1))
    assert documents._in_parts(lambda x: x + 1, pa.int64(), rows).to_pylist() == [x + 1 for x in rows]
    assert max(held) == documents._ROWS and len(held) == 4 and documents._in_parts(str, pa.string(), Column()).to_pylist() == []
