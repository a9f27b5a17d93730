import pytest
from pyspark.sql import functions as F

import sealframe as S
from sealframe.operators import documents, typed_privacy
from sealframe.operators.columns import document_json
from sealframe.privacy import actions
from sealframe.sources.generators import USER_POLICY, users

TOKEN, HMAC = "golden-token-secret-never-leak-32", "golden-hmac-secret-never-leak-32!"
# A document, its policy, and what they must give.
DOC = {"id": "fixture-1", "email": "fixture.user@example.invalid", "account_id": "acct_fixture_001", "legal_name": "Fixture User", "phone": "555-010-9999", "ssn": "123-45-6789", "internal_note": "synthetic private note", "role": "tester"}
POLICY = {"version": "v1", "mode": "fail-closed", "redact": ["ssn", "internal_note"], "mask": ["phone"], "tokenize": ["email", "account_id"], "hmac": ["legal_name"], "allow": list(DOC)}
SAFE = {"id": "fixture-1", "email": "tok_email_22a7d1eeac5412d7", "account_id": "tok_account_id_4f6e53e57ec87642", "legal_name": "hmac_legal_name_d0e2e933c2912572", "phone": "***-***-9999", "ssn": "[REDACTED]", "internal_note": "[REDACTED]", "role": "tester"}


def test_golden_result():
    out = S.create_private_packet(DOC, POLICY, token_secret=TOKEN, hmac_secret=HMAC)
    assert out["packet"]["packet_hash"] == "61af986613ae25eda5a9b7982f31e3b96144267097819dbb21bc567e1fc51f29"
    safe = S.protect(DOC, POLICY, token_secret=TOKEN, hmac_secret=HMAC)
    assert safe["data"] == SAFE and safe["report"]["transform_count"] == 6 and S.verify_result(safe) == {"ok": True}
    inferred = S.create_report(DOC, safe["data"], POLICY)
    assert {k: sorted(inferred[k]) for k in ("fields_redacted", "fields_masked", "fields_tokenized")} == {k: sorted(safe["report"][k]) for k in ("fields_redacted", "fields_masked", "fields_tokenized")}


def test_fail_closed_and_permissive():
    with pytest.raises(S.PrivacyError) as e:
        S.protect(DOC, {"version": "v1", "redact": ["ssn"]})
    assert e.value.code == "UNHANDLED_PII_FIELD" and "email" in e.value.field_paths and "fixture.user" not in str(e.value)
    out = S.protect(DOC, {"version": "v1", "mode": "permissive", "redact": ["ssn"]})
    assert out["report"]["raw_pii_present"] and not S.verify_result(out)["ok"]


@pytest.mark.parametrize("policy,code", [
    ({"version": "v2"}, "INVALID_POLICY"), ({"version": "v1", "redact": ["a"], "mask": ["a"]}, "POLICY_CONFLICT"), ({"version": "v1", "redact": ["a[0]"]}, "INVALID_POLICY"),
    ({"version": "v1", "redact": ["a.__proto__"]}, "UNSAFE_POLICY_PATH"), ({"version": "v1", "redact": [" "]}, "UNSAFE_POLICY_PATH"), ({"version": "v1", "x": []}, "INVALID_POLICY"),
])
def test_bad_policies(policy, code):
    with pytest.raises(S.PrivacyError) as e:
        S.validate_policy(policy)
    assert e.value.code == code


def test_detection():
    doc = {"user": {"first_name": "A", "notes": ["call 555-010-1234", "ok"]}, "created_dob_at": "2020-01-01", "dob_text": "2020-01-01", "iban_code": "DE89 3704 0044 0532 0130 00", "pan": "4111 1111 1111 1111", "aba": "123-456-789", "firstName": "x", "user_state": "CA"}
    got = {(d["path"], d["category"], d["detection"]) for d in S.detect(doc)}
    assert {("user.first_name", "name", "field_name"), ("user.notes[0]", "phone", "pattern"), ("dob_text", "dob", "pattern"), ("iban_code", "iban", "pattern"), ("pan", "payment_card", "pattern"), ("aba", "routing", "pattern"), ("user_state", "location", "field_name")} <= got
    assert not any(p in ("created_dob_at", "firstName") for p, _, _ in got)
    assert S.detect("a@b.co") == []


def test_arrays_and_masks():
    doc = {"users": [{"email": "ann@x.org"}, {"email": "bob@x.org"}], "drop": [1, 2, 3]}
    policy = {"version": "v1", "mode": "permissive", "tokenize": ["users[].email"], "remove": ["drop[]"]}
    out = S.protect(doc, policy, token_secret=TOKEN)
    assert out["data"]["drop"] == [] and out["report"]["fields_tokenized"] == ["users[1].email", "users[0].email"]
    assert out["data"]["users"][0]["email"] == actions.tokenize("users[0].email", "ann@x.org", TOKEN)
    assert actions.mask("ann@x.org", "email") == "a***@x.org" and actions.mask("12", "phone") == "***-***-0012" and actions.mask("x", "ssn") == "****"


def test_typed_lane_equals_dynamic_lane(spark):
    df = users(spark, 50)
    typed = typed_privacy.protect(df, USER_POLICY, TOKEN, HMAC)
    dynamic = df.select("idx", documents.protect(document_json(df), USER_POLICY, token_secret=TOKEN, hmac_secret=HMAC)["data"].alias("d"))
    both = typed.select("idx", document_json(typed).alias("t")).join(dynamic, "idx")
    assert both.filter(F.col("t") != F.col("d")).count() == 0 and both.count() == 50
    with pytest.raises(S.PrivacyError):
        typed_privacy.protect(df, {"version": "v1", "redact": ["email"]})
