"""Synthetic documents for benches and tests, from spark.range alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _noise(i, salt: str, chars: int):
    return F.substring(F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256), 1, chars)


def entropy_records(spark: SparkSession, kind: str, rows: int, seed: int = 42) -> DataFrame:
    """Records of low, medium or high entropy, flat or nested (nested-low, nested-high)."""
    i, s = F.col("id"), f"|{seed}"
    df = spark.range(rows)
    if kind in ("low", "medium"):
        n = 50 if kind == "low" else 10_000
        k = i % n
        return df.select(k.alias("id"), F.concat(F.lit("kind_"), (k % 5).cast("string")).alias("kind"), F.concat(F.lit("tag_"), (k % 10).cast("string")).alias("tag"), (k % 100).alias("score"), F.struct((k % 7).alias("a"), F.concat(F.lit("b"), (k % 11).cast("string")).alias("b")).alias("nested"))
    if kind == "high":
        return df.select(_noise(i, "id" + s, 16).alias("id"), _noise(i, "blob" + s, 64).alias("blob"), F.array(*[_noise(i, f"n{j}{s}", 12) for j in range(3)]).alias("noise"))
    if kind == "nested-low":
        return df.select((i % 20).alias("idx"), F.struct(F.struct(F.struct(F.lit(1).alias("leaf")).alias("c")).alias("b")).alias("tree"), (i % 2 == 0).alias("flag"))
    if kind == "nested-high":
        return df.select(i.alias("idx"), F.struct(_noise(i, "a" + s, 16).alias("a"), F.struct(_noise(i, "c" + s, 16).alias("c"), F.struct(_noise(i, "e" + s, 16).alias("e"), F.array(_noise(i, "f" + s, 8), _noise(i, "g" + s, 8)).alias("f")).alias("d")).alias("b")).alias("tree"))
    raise ValueError(f"unknown kind {kind!r}")


def _padded(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def users(spark: SparkSession, rows: int, kind: str = "low", seed: int = 42) -> DataFrame:
    """Synthetic user records with fields that detection knows; kind: how much their values vary."""
    i, s = F.col("id"), f"|{seed}|{kind}"
    n = {"low": i % 20, "medium": (i * 17 + seed) % 800, "nested-low": i % 30}.get(kind)
    tail = n.cast("string") if n is not None else F.concat(_noise(i, "mail" + s, 8), F.lit("-"), i.cast("string"))
    number = _padded(i * 11 % 100_000, 6) if n is not None else F.upper(_noise(i, "id" + s, 12))
    name = n.cast("string") if n is not None else _noise(i, "name" + s, 6)
    return spark.range(rows).select(
        i.alias("idx"), F.concat(F.lit(f"{kind}.user."), tail, F.lit("@example.invalid")).alias("email"), F.concat(F.lit("555-010-"), _padded(i % 10000, 4)).alias("phone"),
        F.concat(F.lit("SYN-"), number).alias("national_id"), F.concat(F.lit("Made Up "), name).alias("legal_name"), F.concat(name, F.lit(" Example Street")).alias("addr_line"), (i % 4).alias("tier"))


USER_POLICY = {"version": "v1", "tokenize": ["email", "national_id"], "mask": ["phone"], "hmac": ["legal_name"], "allow": ["idx", "email", "phone", "national_id", "legal_name", "addr_line", "tier"]}


def named_users(seed: DataFrame, name: str, index: str) -> DataFrame:
    """Records of a seed, already replicated with their number in `index`, with made-up contact fields
    of a dataset's name in place of their own."""
    i = F.col(index)
    n, label = i.cast("string"), "".join(c if c.isascii() and c.isalnum() else "-" for c in name.upper())
    made = {
        "idx": i, "benchmark_dataset": F.lit(name), "email": F.concat(F.lit(name + "."), n, F.lit("@example.invalid")),
        "phone": F.concat(F.lit("555-"), _padded(100 + i % 800, 3), F.lit("-"), _padded(i % 10000, 4)), "national_id": F.concat(F.lit(f"SYN-{label}-"), _padded(i, 6)),
        "legal_name": F.concat(F.lit(name + " Fake User "), n), "addr_line": F.concat((i % 1000).cast("string"), F.lit(f" {name} Example Way")),
    }
    return seed.withColumns(made)


# The record of each industry, each field as its text before and after the row's number, which is
# added to a start, taken modulo a limit and padded to some digits; and the policy that protects it.
INDUSTRIES = {
    "healthcare": ({"encounter_id": ("e-", 0, 0, 0), "mrn": ("MRN-", 0, 0, 0), "dob": "1980-01-01", "phone": ("555-200-", 1000, 9000, 4), "ssn": "123-45-6789"},
        {"tokenize": ["mrn"], "hmac": ["dob"], "mask": ["phone"], "redact": ["ssn"]}),
    "finance": ({"ledger_id": ("led-", 0, 0, 0), "account_number": ("", 10**15, 0, 0), "routing_number": "021000021", "credit_card": "4111111111111111", "email": ("user", 0, 0, 0, "@finance.example")},
        {"tokenize": ["account_number", "email"], "hmac": ["routing_number"], "mask": ["credit_card"]}),
    "hr": ({"department": "ENG", "employee_id": ("E-", 0, 0, 0), "payroll_id": ("PR-", 0, 0, 0), "emergency_contact": ("555-300-", 0, 10000, 4)},
        {"tokenize": ["employee_id"], "hmac": ["payroll_id"], "mask": ["emergency_contact"]}),
    "saas": ({"user_id": ("u-", 0, 0, 0), "email": ("u", 0, 0, 0, "@saas.example"), "phone": ("555-400-", 0, 10000, 4), "full_name": ("User ", 0, 0, 0), "mailing_address": ("", 0, 0, 0, " Main St")},
        {"tokenize": ["email", "full_name"], "mask": ["phone"], "remove": ["mailing_address"]}),
    "education": ({"course_id": ("C-", 0, 0, 0), "student_id": ("STU-", 0, 0, 0), "guardian_name": ("Guardian ", 0, 0, 0), "parent_email": ("p", 0, 0, 0, "@edu.example"), "last_login_at": "2026-01-01T12:00:00Z"},
        {"tokenize": ["student_id", "guardian_name"], "hmac": ["parent_email"]}),
    "legal": ({"matter_id": ("M-", 0, 0, 0), "client_name": ("Client ", 0, 0, 0), "case_number": ("LF-", 0, 0, 0), "participant_phone": ("555-500-", 0, 10000, 4)},
        {"tokenize": ["client_name", "case_number"], "mask": ["participant_phone"]}),
}


def industry_policy(industry: str) -> dict:
    """Fail-closed policy of an industry: its actions, and every field allowed that it does not remove."""
    fields, actions = INDUSTRIES[industry]
    return {"version": "v1", "mode": "fail-closed", **actions, "allow": [f for f in fields if f not in actions.get("remove", ())]}


def industry_rows(spark: SparkSession, industry: str, rows: int) -> DataFrame:
    """Synthetic records of an industry."""

    def field(spec):
        if isinstance(spec, str):
            return F.lit(spec)
        before, start, limit, digits, *after = spec
        i = F.col("id") % limit if limit else F.col("id")
        text = (i + start).cast("string")
        return F.concat(F.lit(before), F.lpad(text, digits, "0") if digits else text, F.lit("".join(after)))

    return spark.range(rows).select(*[field(spec).alias(name) for name, spec in INDUSTRIES[industry][0].items()])
