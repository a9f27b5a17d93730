"""Mix sources to target weights: weighted sampling without replacement, in whole epochs first.

Each document gets an exponential key -ln(u) / quality (Efraimidis and Spirakis), u from a hash of
its id and a seed, so reruns agree. Within a source, documents go by key; a source's target
is met by whole epochs of all its documents, then by the documents whose running size comes
nearest to what is left. Running sums are taken in ranges of the key: the range totals are
summed first, then rows within a range, so a hot source is spread over tasks; a source of n rows has
about n / max(RANGE_ROWS, sqrt(n)) ranges, so neither a range nor the list of ranges grows large. Ranges
are even where qualities are alike, and may differ by the ratio of qualities else.

Rows are numbered and written once, so texts are read once; keys, windows and joins work on sizes
alone, and columns to keep come back by the row's number.

Targets: the total budget is dealt by source weight; a target stops at max_epochs times its
source's size and the excess is dealt again by weight among the rest until none is above.

Cases: null text has size 0 and takes 0; null source is a source of its own, ordered last;
rows without an id take their number from a hash of their text, and ties go by id, size, text hash, row; a
quality weight that is null, missing or not above 0 counts as 1, of several for an id the mean counts;
repeated rows are documents of their own; very long texts are counted whole; kept columns may have any
names; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

#: Rows of a source that one range of keys holds on average, at least.
RANGE_ROWS = 1_000


def word_count(c: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_column: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of MD5 of seed and id, or of seed and the text's MD5."""
    own = F.coalesce(id_column.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), own).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def targets(sizes: DataFrame, weight: Column, budget: Column | None = None, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size, ...) rows, one a source.

    With sources in order of cap over weight, those before some place are at their caps and
    the rest share what is left by weight; that place is the first where the share fits.
    The windows run over one row a source.
    """
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = (budget if budget is not None else F.sum("source_size").over(everything)).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", share).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.coalesce(F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return w.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "target")


def mix(df: DataFrame, weight_of_rank: Column, doc_id: str = "doc_id", text: str = "text", source: str = "source", qualities: DataFrame | None = None, budget: Column | None = None, max_epochs: float = 3.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its size, source_size, target, epochs taken and words taken.

    weight_of_rank: source weight as an expression of `rank`, the source's place from 0 by
    code point, null last. qualities: (doc_id, quality) weights of documents; larger ones are taken
    earlier. keep: further columns of df to carry, as a struct `kept`.
    """
    rows = numbered(df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), uniform(F.col(doc_id), F.col(text), seed).alias("u"),
        F.xxhash64(F.col(text)).alias("tie"), *([F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("kept")] if keep else []),
    ), "row")
    slim = rows.drop("kept")
    if qualities is None:
        weighed = slim.withColumn("quality", F.lit(1.0))
    else:
        q = qualities.groupBy(F.col("doc_id").alias("quality_id")).agg(F.avg("quality").alias("quality"))
        weighed = slim.join(q, F.col("doc_id") == F.col("quality_id"), "left").drop("quality_id")
    docs = written(weighed.withColumn("sampling_key", -F.ln("u") / F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)).drop("u", "quality"))
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("sampling_key").alias("mean_key"))
    by_code_point = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("rank", F.row_number().over(by_code_point) - 1)
    goal = targets(ranked.select("source", "source_size", "rank"), weight_of_rank, budget, max_epochs)
    plan = written(ranked.join(goal.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("plan_source"), "source_size", "target", "mean_key", F.ceil(F.col("docs") / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt("docs"))).alias("ranges"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    share = 1 - F.exp(-F.col("sampling_key") / F.col("mean_key"))
    keyed = docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source").withColumn("range", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("ranges")), F.col("ranges") - 1).cast("long"))
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offset = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), offset.alias("offset"))
    joined = keyed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    within = Window.partitionBy("source", "range").orderBy("sampling_key", "doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("offset") + F.sum("size").over(within)
    chosen = (end - F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    copies = F.col("epochs") + F.when(chosen, 1).otherwise(0)
    out = joined.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "sampling_key", "row")
    return out.join(rows.select("row", "kept"), "row").drop("row") if keep else out.drop("row")
