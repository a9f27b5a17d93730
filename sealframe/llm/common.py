"""Shared helpers: written intermediate tables, row numbers, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



class _Made(threading.local):
    """Folders that this thread made under the shared one, and that are still there."""

    def __init__(self):
        self.paths: set[str] = set()


_MADE = _Made()


def made() -> set[str]:
    return set(_MADE.paths)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    That folder is spark.checkpoint.dir, or the context's own. Where neither is set, a local
    session, as in tests, gets a temporary one; on a cluster that is an error, as executors do
    not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sealframe-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.paths.add(path)
    return path


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read back.

    It cuts the lineage and outlives lost executors. Shuffle files behind it are released.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession, wait: float = 0.0) -> None:
    """Let the driver drop shuffle files that nothing refers to any more.

    References are found dead in one collection and cleaned after the next; `wait` seconds
    are left to the cleaner after each of two.
    """
    for _ in range(2 if wait else 1):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.paths.discard(path)


def delete_table(df: DataFrame) -> None:
    """Remove the folder of a table that written() made."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)
        for path in [p for p in made() if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]]:
            _MADE.paths.discard(path)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def delete_all(spark: SparkSession, paths: set[str], read: DataFrame | None = None) -> None:
    """Remove the given folders, but those that `read` reads. Other results that are read from them
    lazily must have been written before."""
    names = {f.rsplit("/", 2)[-2] for f in read.inputFiles()} if read is not None else set()
    for path in [p for p in paths if _name(p) not in names]:
        delete(spark, path)
    release(spark)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written; other tables that it wrote on the way are deleted."""
    before = made()
    table = make()
    path = shared_dir(table.sparkSession)
    out = written(table, path)
    del table
    delete_all(out.sparkSession, made() - before - {path})
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the Arrow batches that Python gets: texts may be long. Smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(rows, int(spark.conf.get(key, str(rows))) or rows))


def give_back() -> None:
    """Return to the system what a Python worker, which Spark uses again, holds free from earlier tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written, so that reruns of a task keep the numbers."""
    return written(df.withColumn(name, F.monotonically_increasing_id()))


#: Bytes of a table up to which it is broadcast, so that texts need not be dealt out anew.
BROADCAST_BYTES = 16_000_000


def joined(rows: DataFrame, few: DataFrame, on: str | Column | list, how: str, row_bytes: Column | int = 16) -> DataFrame:
    """rows joined with a written table, which is broadcast if its size, row_bytes summed, is small,
    and else shuffled with the rows."""
    size = few.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return rows.join(F.broadcast(few) if size <= BROADCAST_BYTES else few, on, how)


#: Edges that a task contracts at once.
_EDGES = 200_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), in order of a, to stars: each node of a run of _EDGES edges but the smallest of its
    part, with that smallest one. A run keeps an edge of the last node of the run before it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> tuple[list[int], list[int]]:
        up: dict[int, int] = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in held:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        tops = list(map(top, nodes))
        return [x for x, t in zip(nodes, tops) if x != t], [t for x, t in zip(nodes, tops) if x != t]

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= _EDGES:
            last = int(held[-1][0][-1])
            a, b = stars()
            held = [(np.array([last]), np.array([dict(zip(a, b)).get(last, last)]))]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if held:
        a, b = stars()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges contracted where they are, so that no node has more of them than there are tasks and
    runs, then by their larger node."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.mapInArrow(contract, "a long, b long").repartition(n, "a").sortWithinPartitions("a").mapInArrow(contract, "a long, b long")


def _settled(star: DataFrame) -> bool:
    """Whether links (a, b), b < a, are stars: each a has one b, and no b is an a."""
    twice = star.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    inner = star.select(F.col("b").alias("a")).distinct().join(star.select("a"), "a", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b): the smallest node reachable.

    Each round contracts edges to stars within bounded runs, first where they are, then dealt by
    their larger node, and moves each edge on to what its smaller node is linked to, by a join of
    two shuffled sides, whose skewed keys adaptive execution splits. Rounds are written to the
    shared folder. Ends when all that is left are stars.
    """
    star = written(_contracted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")))
    for _ in range(rounds):
        if _settled(star):
            break
        further = star.select(F.col("a").alias("b"), F.col("b").alias("c")).distinct()
        moved = star.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        after = written(_contracted(moved))
        delete_table(star)
        star = after
    else:
        raise RuntimeError("components did not converge")
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Rows of a site from which it is large, at least; and large sites at most.
LARGE_SITE, LARGE_SITES = 1_000, 20_000


def joined_by_site(rows: DataFrame, sites: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the columns of sites, one a value of keys, that holds the rows' number in `count`.
    Sites with very many rows, LARGE_SITES at most, are broadcast, so no task gets all rows of one."""
    total = sites.agg(F.sum(count)).first()[0] or 0
    heavy = max(LARGE_SITE, 2 * total // LARGE_SITES)
    more = [c for c in sites.columns if c not in keys]
    large = sites.filter(F.col(count) > heavy).select(*keys, F.struct(*more).alias("_large"))
    known = rows.join(F.broadcast(large), keys, "left")
    few = known.filter("_large is null").drop("_large").join(sites.filter(F.col(count) <= heavy), keys)
    many = known.filter("_large is not null").select(*rows.columns, *[F.col("_large")[c].alias(c) for c in more])
    return many.unionByName(few.select(*rows.columns, *more))
