"""Corpus pipeline: drop poor documents, near copies and repeated passages; mix; encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to
the shared folder and reads back as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealframe.llm import bpe, mixing, quality, simhash_wide, substrings
from sealframe.llm.common import delete_all, made, shared_dir, written
from sealframe.llm.queries import label_weights, rank_weight, vocabulary

#: SQL has neither the classifier nor XXH64; tests compare with a brute-force version.
ORACLE_SQL = None


def site_path() -> Column:
    """Sources stand for hosts, and a source's languages for its paths; null is a value of its own."""
    return F.to_json(F.array("source", "lang"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not of low quality and not toxic, each row judged for itself.

    Null text is empty text; null ids, repeated rows and odd column names pass through; an empty
    table stays empty; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_rows(docs, labels, F.col("source"), site_path())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near copies (five words, 0.8).

    Rows without an id come last in a group; texts without words are copies of each other;
    repeated rows are copies; an empty table stays empty.
    """
    return simhash_wide.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 51 words and more stay in the smallest document that has them.

    Rows without an id or text stay as they are; n_chars, where docs has it, follows the text.
    """
    out = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those with good labels first.

    Null texts have no words and are taken as often as their source's others; null sources and ids, ties and
    repeated rows are as in the operator; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(docs, rank_weight(), qualities=label_weights(labels), keep=tuple(docs.columns))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))
    return mixed.filter("copies > 0").select(copies.alias("copy"), "kept").select("kept.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, packed, and whether they decode to it. Null text has no ids; every
    row gives one; an empty table stays empty."""
    path = vocabulary()
    # Written, so that no task has two Python workers with a vocabulary each.
    ids = written(bpe.encode(docs, path, keep=("doc_id", "source", "lang")))
    out = bpe.decode(ids, path, keep=("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


#: Tables that stages wrote on the way to results that are written by the time the next one starts.
_left: set[str] = set()


def _alone(stage):
    """A stage that first deletes what earlier ones wrote on the way; what `docs` itself reads stays."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_all(spark, _left, read=docs)
        _left.intersection_update(made())
        before = made()
        out = stage(spark, docs, sf_dir)
        _left.update(made() - before)
        return out

    return run_stage


STAGES = [(stage.__name__, _alone(stage)) for stage in (quality_classifier, near_dedup, substring_dedup, mix_sources, encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What the stages wrote on the way is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for _, stage in STAGES:
        path = shared_dir(spark)
        docs = written(stage(spark, docs, sf_dir), path)
    delete_all(spark, made() - before - {path})
    return docs
