"""Documents in and packets out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import document_json


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, **options) -> DataFrame:
    """One column `doc` of JSON text. parquet, orc, json and csv rows become documents;
    text holds one JSON document a line."""
    reader = spark.read.options(**options)
    if fmt == "text":
        return reader.text(path).select(F.col("value").alias("doc"))
    df = reader.format(fmt).load(path)
    df = df.select(*columns) if columns else df
    return df.select(document_json(df).alias("doc"))


def read_records(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """One row per element of an array field of a JSON file."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("record")).select("record.*")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores. Use it before Python work: a file of one row
    group is one task. Tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a seed that replicate() takes at most.
SEED_ROWS = 100_000


def replicate(df: DataFrame, count: int, by: str) -> DataFrame:
    """`count` rows that repeat the rows of df, ordered by `by`, in turn. df is a seed of SEED_ROWS rows
    at most; more raise ValueError."""
    n = df.limit(SEED_ROWS + 1).count()
    if n > SEED_ROWS:
        raise ValueError(f"a seed has {SEED_ROWS} rows at most")
    if not n:
        return df.limit(0)
    seed = df.withColumn("_at", F.row_number().over(Window.partitionBy().orderBy(by)) - 1)
    numbers = df.sparkSession.range(count).toDF("_n")
    return numbers.join(F.broadcast(seed), F.col("_n") % n == F.col("_at")).select(*df.columns)


#: The fields that a record of each kind is shaped to, as new name and path in the record.
SHAPES = {
    "api": (("id", "id"), ("state", "state"), ("title", "title"), ("actor", "user.login"), ("labels", "labels")),
    "telemetry": (("reason", "reason"), ("type", "type"), ("action", "action"), ("object", "regarding.kind")),
    "trace": (("span", "name"), ("service", "resource.`service.name`"), ("status", "status.code")),
    "audit": (("severity", "severity"), ("method", "protoPayload.methodName"), ("resourceType", "resource.type")),
    "webhook": (("type", "type"), ("eventId", "id"), ("created", "created"), ("object", "data.object.id")),
    "transaction": (("blockNumber", "blockNumber"), ("value", "value"), ("gas", "gas"), ("status", "status")),
    "config": (("service", "service"), ("version", "version"), ("environment", "environment"), ("features", "features"), ("limits", "limits")),
}


def _has(schema: T.DataType, path: list[str]) -> bool:
    return not path or isinstance(schema, T.StructType) and path[0] in schema.names and _has(schema[path[0]].dataType, path[1:])


def shape_records(df: DataFrame, kind: str, name: str, index: str) -> DataFrame:
    """Records of a kind with `i`, from the column `index`, `kind`, the name, and the fields of SHAPES.
    Fields that df does not have are left out; traces and transactions get an id from the index."""
    made = {"trace": ("traceId", F.concat(F.lit("trace-"), F.col(index).cast("string"))), "transaction": ("hash", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(index)), 16, "0")))}
    parts = lambda path: [p.strip("`") for p in re.findall(r"`[^`]+`|[^.]+", path)]
    own = [made[kind][1].alias(made[kind][0])] if kind in made else []
    return df.select(F.col(index).alias("i"), F.lit(name).alias("kind"), *own, *[F.col(path).alias(to) for to, path in SHAPES[kind] if _has(df.schema, parts(path))])


def write_packets(df: DataFrame, path: str, packet: str = "packet", fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.select(f"{packet}.*").write.mode(mode).format(fmt).save(path)
