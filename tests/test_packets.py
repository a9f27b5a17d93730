import random

import pytest

import sealframe as S
from sealframe.functions.jsontext import number_text, parse

# Documents and the hashes that their packets must have.
GOLDEN = [
    ({"zeta": True, "alpha": "A", "count": 3, "beta": None}, "094447e01b9736163edc42849e992112c34968d909dc42ff7ece89ac0e78507e"),
    ({"user_id": "user-0001", "event_type": "login", "metadata": {"region": "us-test-1", "device": {"version": 1, "os": "test-os"}}}, "d43af7ba52fc076a138e84a0d10cb862ea6d03ab253b5a209b9f4f89cf1a517d"),
]


@pytest.mark.parametrize("doc,digest", GOLDEN)
@pytest.mark.parametrize("compression", ["none", "zlib"])
def test_golden_hashes(doc, digest, compression):
    p = S.create_packet(doc, compression=compression)
    assert p["packet_hash"] == digest and p["packet_id"] == digest[:16] and S.verify_packet(p)
    assert S.canonical_text(S.replay_packet(p)["canonical"]) == S.canonical_text(S.canonicalize(doc))


def test_number_text():
    cases = {0.0: "0", -0.0: "0", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-9: "1.5e-9", 49.99: "49.99", -2.5: "-2.5", 2e23: "2e+23", 12345678901234567890: "12345678901234567000", float("nan"): "null"}
    assert {number_text(k): v for k, v in cases.items()} == {v: v for v in cases.values()}


def test_key_order_and_escapes():
    assert S.canonical_text({"a": 1, "10": 2, "9": 3, "\U00010000": 4, "": 5}) == '{"9":3,"10":2,"a":1,"\U00010000":4,"":5}'
    assert S.canonical_text("\x01\n\"\\/ ") == '"\\u0001\\n\\"\\\\/ "'


def test_normalization():
    cases = {"49.990": 49.99, "TRUE": True, "yes": True, "1": "1", "00123": "00123", "-7": "-7", "2026-02-31": "2026-02-31", "2026-05-13 10:00 PM": "2026-05-13T22:00:00.000Z", "2026-05-13T23:30:00-05:00": "2026-05-13T23:30:00-05:00", "5.": 5.0, "1e5": "1e5", "é": "é", "0050-01-01": "0050-01-01", "2026-06-01": "2026-06-01T00:00:00.000Z"}
    assert {k: S.normalize_types(k) for k in cases} == cases


def test_dedupe_and_refs():
    row = {"kind": "metric", "metadata": {"host": "h1"}, "values": [1, 2, 3]}
    d = S.dedupe_structures(S.compact_schema({"rows": [row, row, row]}))
    assert d["value"]["rows"][1:] == [{"__ip_ref": "r2"}] * 2 and list(d["refs"]) == ["r0", "r1", "r2"]
    assert S.expand_refs(d["value"], d["refs"]) == S.compact_schema({"rows": [row, row, row]})
    for refs in ({}, {"r2": {"__ip_ref": "r2"}}):
        with pytest.raises(S.PacketError):
            S.expand_refs({"__ip_ref": "r2"}, refs)


def random_doc(r, depth=0):
    k = r.random()
    if depth > 3 or k < 0.4:
        return r.choice([None, True, False, r.randrange(-99, 99), r.random(), "text", "yes", "1.50", "2026-01-02", "é"])
    if k < 0.7:
        return [random_doc(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["a", "b", "timestamp", "user_id", "10", "z"]): random_doc(r, depth + 1) for _ in range(r.randrange(4))}


@pytest.mark.parametrize("seed", range(150))
def test_random_documents(seed):
    r = random.Random(seed)
    doc, nxt = random_doc(r), random_doc(r)
    p = S.create_packet(doc, compression="none")
    assert S.verify_packet(p) and S.canonical_text(S.replay_packet(p)["canonical"]) == S.canonical_text(S.normalize_types(doc))
    if isinstance(doc, dict) and isinstance(nxt, dict):
        patch = S.diff_documents(doc, nxt)
        if "{}" not in S.canonical_text(nxt):
            again = S.apply_delta(doc, patch)
            assert S.diff_documents(again, nxt) == {} or all(isinstance(v, (int, float)) for v in S.canonicalize(nxt).values())


def test_tampering():
    p = S.create_packet({"a": 1, "b": [1, 2]}, compression="none", created_at="x")
    other = S.create_packet({"a": 2}, compression="none")
    for change in ({"packet_hash": other["packet_hash"]}, {"payload": other["payload"]}, {"payload": "!"}, {"encoding": "x"}, {"ip_version": "2"}, {"spec_version": "9"}, {"packet_id": "0" * 16}, {"extra": 1}, {"refs": {"x": 1}}, {"delta": []}, {"compression": {**p["compression"], "raw_bytes": 1}}):
        assert not S.verify_packet({**p, **change})
    assert S.verify_packet({**p, "created_at": "later", "metadata": {"title": "t"}, "refs": {"r9": 1}})


def test_limits_and_unsafe_keys():
    deep = []
    for _ in range(120):
        deep = [deep]
    for bad in (deep, {"__proto__": 1}, {"a": {"constructor": 1}}, {"a": object()}, {str(i): 1 for i in range(10_001)}):
        with pytest.raises(S.PacketError):
            S.create_packet(bad)
    for names in ({"foo": "ts"}, {"foo": "user_id"}, {"__ip_ref": "x"}):
        with pytest.raises(S.PacketError):
            S.create_packet({}, metadata={"compaction_dictionary": names})


def test_delta():
    base, nxt = {"a": 1, "b": {"c": 2, "d": 3}, "e": [1], "g": 0}, {"a": 4, "b": {"c": 2}, "e": [2], "f": "x", "g": 0}
    patch = S.diff_documents(base, nxt)
    assert patch == {"a": {"__ip_num_add": 3}, "b": {"d": "__sealframe__:delete"}, "e": [2], "f": "x"}
    assert S.apply_delta(base, patch) == nxt
    assert S.diff_documents(base, nxt, "gone")["b"] == {"d": "gone"}
    assert S.create_packet(nxt, base=base)["delta"] is not None and S.create_packet(base, base=base)["delta"] is None
    assert parse('{"a":1,"a":2}') == {"a": 2}


def test_equality_and_json_limits():
    from sealframe.functions import limits

    same = [({"a": [1, 2.0]}, {"a": [1.0, 2]}, True), (0.0, -0.0, False), (float("nan"), float("nan"), True), (True, 1, False), (None, None, True), ({"a": 1}, {"b": 1}, False), ([1], [1, 2], False), ("a", "a", True)]
    assert [limits.deep_equal(a, b) for a, b, _ in same] == [want for _, _, want in same]
    limits.assert_json_compatible({"a": [2**53 - 1, "x", None]})
    with pytest.raises(S.PacketError):
        limits.assert_json_compatible({"a": [2**53]})
    for bad in ({1: 2}, {"a": {1, 2}}, [object()], {"a": {"constructor": 1}}):
        with pytest.raises(S.PacketError):
            limits.validate_document(bad)


@pytest.mark.parametrize("seed", range(40))
def test_every_change_of_a_packet_is_found(seed):
    """Any other byte of the payload, and any other field that the hash covers."""
    r = random.Random(seed)
    p = S.create_packet(random_doc(r), created_at="t", compression=r.choice(["none", "zlib"]))
    at = r.randrange(len(p["payload"].rstrip("=")) - 1)
    other = r.choice([c for c in "abcXYZ019+/" if c != p["payload"][at]])
    assert not S.verify_packet({**p, "payload": p["payload"][:at] + other + p["payload"][at + 1 :]})
    assert S.verify_packet({**p, "created_at": "u"}) and not S.verify_packet({**p, "packet_id": "f" * 16})
    with pytest.raises(S.PacketError):
        S.replay_packet({**p, "packet_hash": "0" * 64, "packet_id": "0" * 16})


def test_views_are_the_same_alone_and_together():
    from sealframe.functions.packet import VIEWS

    for seed in range(30):
        p = S.create_packet(random_doc(random.Random(seed)), created_at="t", compression="none")
        every = S.replay_packet(p)
        assert all(S.replay_packet(p, views=(v,)) == {v: every[v]} for v in VIEWS)
