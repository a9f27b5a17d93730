"""Policies compiled against a DataFrame's schema into one projection.

Names are detected from the schema when the policy is compiled, values by expressions that look at every
string at every depth, before and after the projection, as the dynamic lane does for documents. A row
with an open value fails the query under a fail-closed policy, or is emptied and marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..privacy import detect as D
from ..privacy.actions import mask_kind
from ..privacy.policy import Policy, PrivacyError, validate_policy
from . import columns as X

#: Marks a field that the policy takes out.
GONE = object()
HIT = "array<struct<path:string,category:string>>"


def detected_names(schema: T.StructType, names: dict[str, str] | None = None) -> list[dict]:
    """Detections by field name, known from the schema alone. Elements of arrays show as []."""
    merged, out = D.category_map(names), []

    def walk(dtype, path):
        if isinstance(dtype, T.ArrayType):
            walk(dtype.elementType, path + "[]")
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                here = f"{path}.{f.name}" if path else f.name
                if cat := D.field_category(f.name, merged):
                    out.append({"path": here, "field": f.name, "category": cat, "detection": "field_name", "actionRequired": True})
                walk(f.dataType, here)

    walk(schema, "")
    return out


def _segments(path: str) -> str:
    return path.replace("[]", "[0]")


def _refuse_map(path: str):
    raise PrivacyError("INVALID_POLICY", "the keys of a map are only known in the dynamic lane; remove or redact it here", [path])


class Compiled:
    """A policy over a schema: the projection and what it does, by schema path."""

    def __init__(self, policy: Policy, schema: T.StructType, token_secret=None, hmac_secret=None):
        self.policy, self.secrets = policy, {"tokenize": token_secret, "hmac": hmac_secret}
        for action, code in (("tokenize", "MISSING_TOKEN_SECRET"), ("hmac", "MISSING_HMAC_SECRET")):
            if action in policy.used and not self.secrets[action]:
                raise PrivacyError(code, "a secret is required")
        self.done: dict[str, str] = {}
        self.fields = {}
        for f in schema.fields:
            out = self._value(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name))
            if out is not GONE:
                self.fields[f.name] = out

    def _value(self, c: Column, dtype, path: str, concrete: Column):
        action = self.policy.rule(_segments(path))
        if action:
            self.done[path] = action
        if action in ("remove", "deny"):
            return GONE
        if action == "redact":
            return X.redact()
        if isinstance(dtype, T.MapType):
            if not self._kept(path):
                return GONE
            _refuse_map(path)
        if action and isinstance(dtype, (T.StructType, T.ArrayType)):
            raise PrivacyError("INVALID_POLICY", f"{action} of a container needs the dynamic lane", [path])
        if action == "mask":
            name = path.rsplit(".", 1)[-1]
            return X.mask(F.coalesce(c.cast("string"), F.lit("null")), mask_kind(name))
        if action in ("tokenize", "hmac"):
            message = F.concat(concrete, F.lit("\0"), X._repr(c, dtype)).cast("binary")
            label = X.field_label(_segments(path))
            return F.concat(F.lit(f"{'tok' if action == 'tokenize' else 'hmac'}_{label}_"), F.substring(X.hmac_sha256(self.secrets[action], message), 1, 16))
        if isinstance(dtype, T.StructType):
            kept = {}
            for f in dtype.fields:
                out = self._value(c[f.name], f.dataType, f"{path}.{f.name}", F.concat(concrete, F.lit("." + f.name)))
                if out is not GONE:
                    kept[f.name] = out
            return F.when(c.isNotNull(), F.struct(*[v.alias(k) for k, v in kept.items()])) if kept else GONE
        if isinstance(dtype, T.ArrayType):
            probe = self._value(c, dtype.elementType, path + "[]", concrete) if not isinstance(dtype.elementType, T.StructType) else None
            if probe is GONE:
                return F.slice(c, 1, 0)
            return F.transform(c, lambda x, i: self._element(x, i, dtype, path, concrete))
        return c if self._kept(path) or path.endswith("[]") else GONE

    def _kept(self, path: str) -> bool:
        return not self.policy.allow or self.policy.allows(_segments(path))

    def _element(self, x, i, dtype, path, concrete):
        out = self._value(x, dtype.elementType, path + "[]", F.concat(concrete, F.lit("["), i.cast("string"), F.lit("]")))
        return F.lit(None) if out is GONE else out


def _hits(c: Column, dtype, path: str, concrete: Column, field: str, skip) -> Column | None:
    """Array of {path, category} of the strings in a column that match a value pattern and are not
    detected by their name alone; None if it has no strings to look at."""
    if isinstance(dtype, T.StringType):
        if skip(path):
            return None
        kind = X.pattern_category(field, c)
        named = D.field_category(field) if field else None
        found = kind.isNotNull() if named is None else kind.isNotNull() & (kind != named)
        return F.when(found, F.array(F.struct(concrete.alias("path"), kind.alias("category")))).otherwise(F.array().cast(HIT))
    if isinstance(dtype, T.StructType):
        parts = [_hits(c[f.name], f.dataType, f"{path}.{f.name}", F.concat(concrete, F.lit("." + f.name)), f.name, skip) for f in dtype.fields]
        parts = [F.coalesce(p, F.array().cast(HIT)) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(dtype, T.ArrayType):
        if _hits(c, dtype.elementType, path + "[]", concrete, "", skip) is None:
            return None
        inner = lambda x, i: _hits(x, dtype.elementType, path + "[]", F.concat(concrete, F.lit("["), i.cast("string"), F.lit("]")), "", skip)
        return F.coalesce(F.flatten(F.transform(c, inner)), F.array().cast(HIT))
    return None


def value_hits(df: DataFrame, policy=None, done=()) -> Column:
    """Array of {path, category} of all strings of df, at any depth, whose values match a pattern;
    without those under paths that the policy allows or that are in `done`."""
    policy = policy and validate_policy(policy)
    skip = lambda path: path in done or bool(policy and policy.allows(_segments(path)))
    parts = [_hits(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name), f.name, skip) for f in df.schema.fields]
    parts = [p for p in parts if p is not None]
    return F.concat(*parts) if parts else F.array().cast(HIT)


def protect(df: DataFrame, policy, token_secret: str | None = None, hmac_secret: str | None = None, names: dict[str, str] | None = None, error: str | None = None, key: str | None = None) -> DataFrame:
    """Protected DataFrame. A fail-closed policy fails here for detected names that it leaves open, before
    anything runs. Rows with open values, in the data or in the result, fail the query, or, if
    `error` names a column, have null fields, but for `key`, and UNHANDLED_PII_FIELD in it. Maps are refused unless
    the policy takes them out."""
    policy = validate_policy(policy)
    out = Compiled(policy, df.schema, token_secret, hmac_secret)
    result = df.select(*[c.alias(k) for k, c in out.fields.items()])
    left = {d["path"] for d in detected_names(result.schema, names)}
    left |= {d["path"] for d in detected_names(df.schema, names) if d["path"] not in out.done}
    open_paths = sorted(p for p in left if not policy.allows(_segments(p)))
    if policy.mode != "fail-closed":
        return result if error is None else result.withColumn(error, F.lit(None).cast("string"))
    if open_paths:
        raise PrivacyError("UNHANDLED_PII_FIELD", "sensitive fields are not covered by the policy", open_paths)
    both = df.select(value_hits(df, policy, out.done).alias("before"), F.struct(*[c.alias(k) for k, c in out.fields.items()]).alias("row"))
    after = value_hits(both.select("row.*"), policy)
    checked = both.select("before", "row.*").select(F.concat("before", after).alias("open"), F.struct(*[F.col(f"`{k}`") for k in out.fields]).alias("row"))
    if error is not None:
        fine = F.size("open") == 0
        return checked.select(*[F.when(fine | F.lit(k == key), F.col("row")[k]).alias(k) for k in out.fields], F.when(~fine, F.lit("UNHANDLED_PII_FIELD")).alias(error))
    paths = F.array_join(F.array_distinct(F.transform("open", lambda h: h["path"])), ", ")
    fault = F.raise_error(F.concat(F.lit("UNHANDLED_PII_FIELD: sensitive fields are not covered by the policy ("), paths, F.lit(")")))
    return checked.filter(F.when(F.size("open") == 0, F.lit(True)).otherwise(fault.cast("boolean"))).select("row.*")
