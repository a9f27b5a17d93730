"""Document operators lifted to whole tables: relational plans, no Python.

Nulls are values like any other: null keys meet, null texts are scalars that repeat without a ref.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..privacy.actions import MARKS, REDACTED


def _utf16(c: Column) -> Column:
    """Sort key of strings by UTF-16 code unit."""
    return F.encode(c, "UTF-16BE")


def multiplicity(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Count of each text within its document (keys)."""
    return df.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("n"))


def dedupe_rows(df: DataFrame, doc: str, position: str, text: str) -> DataFrame:
    """Flat dedupe: one document per `doc`, its elements the rows by position.

    Adds n (multiplicity), ref_id (null if single or null) and emitted: the text at its first place, a
    ref after that; of rows at one position one is the first. Rows are dealt once, by document,
    which the array limit bounds; windows give the places and the ranks of repeated texts.
    """
    spark = df.sparkSession
    dealt = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), doc)
    same = Window.partitionBy(doc, text)
    placed = dealt.withColumn("_nth", F.row_number().over(same.orderBy(position))).withColumn("n", F.count(F.lit(1)).over(same))
    repeated = F.col(text).isNotNull() & (F.col("n") > 1)
    before = Window.partitionBy(doc).orderBy(_utf16(F.col(text)), "_nth").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum(F.when(repeated & (F.col("_nth") == 1), 1).otherwise(0)).over(before) - 1
    out = placed.withColumn("ref_id", F.when(repeated, F.concat(F.lit("r"), rank.cast("string"))))
    ref = F.concat(F.lit(f'{{"{C.REF_KEY}":"'), F.col("ref_id"), F.lit('"}'))
    return out.withColumn("emitted", F.when(F.col("ref_id").isNull() | (F.col("_nth") == 1), F.col(text)).otherwise(ref)).drop("_nth")


def expand_rows(emitted: DataFrame, refs: DataFrame, doc: str, emitted_col: str = "emitted") -> DataFrame:
    """Replace ref texts by the bodies in refs (doc, ref_id, body); an unknown ref fails."""
    ref = F.regexp_extract(emitted_col, r'^\{"' + C.REF_KEY + r'":"(r[0-9]+)"\}\z', 1)
    keyed = emitted.withColumn("_ref", F.when(ref != "", ref))
    table = refs.select(F.col(doc).alias("_doc"), F.col("ref_id").alias("_id"), "body", F.lit(True).alias("_known"))
    out = keyed.join(table, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_ref") == F.col("_id")), "left")
    missing = F.raise_error(F.concat(F.lit(C.ERROR_PREFIX + "missing reference "), "_ref")).cast("string")
    expanded = F.when(F.col("_ref").isNull(), F.col(emitted_col)).when(F.col("_known"), F.col("body")).otherwise(missing)
    return out.withColumn("expanded", expanded).drop("_doc", "_id", "_ref", "_known", "body")


def numeric_deltas(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Successive snapshots of a number per key: previous value and the step as a patch."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    step = F.col(value) - prev
    patch = F.when(prev.isNull(), F.lit(None)).when(step == 0, "{}").otherwise(F.concat(F.lit(f'{{"{value}":{{"{C.NUM_ADD_KEY}":'), step.cast("string"), F.lit("}}")))
    return df.withColumn("previous", prev).withColumn("step", step).withColumn("patch", patch)


def replay_deltas(df: DataFrame, key: str, order: list[str], step: str, first: str) -> DataFrame:
    """Rebuild each snapshot from the first value and the steps after it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("replayed", F.first(first).over(w) + F.coalesce(F.sum(step).over(w), F.lit(0)))


def _outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys where null meets null; _left and _right tell which side a row has."""
    l = left.withColumn("_left", F.lit(True))
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.lit(True).alias("_right"))
    out = l.join(r, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full_outer")
    for k in keys:
        out = out.withColumn(k, F.when(F.col("_left"), F.col(k)).otherwise(F.col(f"_{k}")))
    return out.drop(*[f"_{k}" for k in keys])


def key_changes(base: DataFrame, nxt: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed or same for every key of either side; a null value is a value."""
    b, n = base.select(*keys, F.col(value).alias("before")), nxt.select(*keys, F.col(value).alias("after"))
    change = F.when(F.col("_left").isNull(), "added").when(F.col("_right").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return _outer(b, n, keys).withColumn("change", change).drop("_left", "_right")


def leaf_actions(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Action inferred for each leaf (keys, path, value) of before against after; leaves that only
    after has are `added`."""
    b = before.select(*keys, "path", F.col("value").alias("old"))
    a = after.select(*keys, "path", F.col("value").alias("new"))
    new = F.btrim("new", F.lit('"'))
    text = F.col("old").startswith('"') & F.col("new").startswith('"')
    action = F.when(F.col("_left").isNull(), "added").when(F.col("_right").isNull(), "removed").when(new == REDACTED, "redacted")
    for name, mark in MARKS.items():
        action = action.when(F.col("new").startswith('"' + mark), name)
    action = action.when(text & (F.col("old") != F.col("new")) & F.col("new").contains("*"), "masked").otherwise("kept")
    return _outer(b, a, [*keys, "path"]).withColumn("action", action).drop("_left", "_right")


def audit(packets: DataFrame, manifest: DataFrame, key: str = "packet_hash") -> DataFrame:
    """Packets whose hash the manifest does not list."""
    return packets.join(manifest.select(key).distinct(), key, "left_anti")


def listed(packets: DataFrame, manifest: DataFrame, key: str = "packet_hash") -> DataFrame:
    """Packets whose hash the manifest lists."""
    return packets.join(manifest.select(key).distinct(), key, "left_semi")


def leak_scan(sink: DataFrame, text: str, literals: list[str]) -> DataFrame:
    """Rows of the sink that hold one of the forbidden literals of four characters or more."""
    hits = [F.col(text).contains(x) for x in literals if len(x) >= 4]
    return sink.filter(functools.reduce(operator.or_, hits, F.lit(False)))


def detection_rollup(detections: DataFrame) -> DataFrame:
    """Counts by category and way of detection, with subtotals."""
    return detections.rollup("category", "detection").agg(F.count(F.lit(1)).alias("n"))


def timing_summary(df: DataFrame, group: str, ms: str) -> DataFrame:
    """avg, min, max, interpolated p50, p95, p99 and operations per second. Percentiles are exact over the
    counts of distinct times of a group, so times should be rounded to what matters."""
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(group).agg(F.avg(ms).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), p.alias("p")).select(
        group, "avg_ms", "min_ms", "max_ms", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"), F.col("p")[2].alias("p99_ms"), (1000 / F.col("avg_ms")).alias("ops_per_sec"))


def reduction_percent(raw: Column, small: Column) -> Column:
    """Saved share in per cent, to four places; 0 for an empty text."""
    return F.when(raw > 0, F.round((1 - small / raw) * 100, 4)).otherwise(F.lit(0.0))
