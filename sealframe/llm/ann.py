"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing, exact reranking.

Vectors are scaled to length one, where larger cosine is smaller distance. A table has some Gaussian
(2-stable) directions, each cut in cells of WIDTH; a vector is indexed in its cell of every table, in
double precision. The number of directions follows the number of vectors, so that a cell holds
about CELL_ROWS.

A query visits cells in the order of their estimated success: what is at distance r of it differs by
a normal of deviation r along a direction, which gives each cell a probability of holding it. r is
read off a bounded sample of SAMPLE vectors, as the distance at which about k of all vectors are nearer.
Cells are visited, largest first (by a heap over the directions' cells), until they hold SUCCESS of the
probability in each table; clustered vectors so need few cells and vectors without structure most. A
query that would need over PROBES cells, or that finds fewer than k candidates, is compared with
all vectors instead. Candidates of all tables are ranked by exact cosine on the original vectors, computed by
one formula whatever block they are in.

Equal vectors are indexed once, with the first rows of each (one more than neighbours are asked for,
so the result is whole). Cells are split into blocks of BLOCK_ROWS, which are dealt into groups of about
GROUP_ROWS; a group's queries are dealt into parts of GROUP_QUERIES, each with its own copy of
the group, so a task holds a bounded number of both.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
as query or candidate; vectors of other lengths than the query's are no candidates; rows with a
null id take no part; ties go to the smaller id; repeated ids are separate rows, each a query and a
candidate of the others; a query with fewer candidates returns all; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, numbered, written

WIDTH = 1.5
TABLES = 2
SEED = 7
CELL_ROWS = 500
SUCCESS = 0.78
PROBES = 400
SAMPLE = 2_000
SAMPLE_BYTES = 16_000_000
BLOCK_ROWS = 4_000
GROUP_ROWS = 20_000
GROUP_QUERIES = 5_000


def directions(dim: int, table: int, projections: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng([seed, dim, table])
    return g.normal(size=(dim, projections)), g.uniform(0, WIDTH, projections)


def projections_for(rows: int) -> int:
    """Directions of a table: one more for each threefold of rows beyond CELL_ROWS."""
    return max(1, min(24, round(math.log(max(rows, 1) / CELL_ROWS) / math.log(2.7)))) if rows > CELL_ROWS else 1


def _below(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


def probe_cells(h: np.ndarray, spread: float, success: float = SUCCESS, probes: int = PROBES) -> list[tuple[int, ...]] | None:
    """Cells to visit for a query at h, most promising first, until they hold what is at a distance of
    `spread` with probability `success`; h and spread in cell widths. None if that takes over `probes`."""
    base, options = np.floor(h).astype(int), []
    reach = 1 + math.ceil(4 * spread)
    for x in (h - base).tolist():
        steps = np.arange(-reach, reach + 1)
        p = np.diff(_below((np.append(steps, reach + 1) - x) / max(spread, 1e-9)))
        order = np.argsort(-p, kind="stable")
        order = order[p[order] > 1e-6]
        options.append([(float(p[i]), int(steps[i])) for i in order])
    start = (0,) * len(options)
    heap = [(-math.prod(o[0][0] for o in options), start)]
    out, held = [], 0.0
    while heap and held < success:
        if len(out) == probes:
            return None
        p, at = heapq.heappop(heap)
        held -= p
        out.append(tuple((base + [options[i][j][1] for i, j in enumerate(at)]).tolist()))
        # Each cell is reached once: from the one whose last moved direction is a step back.
        for i in range(max((k for k, j in enumerate(at) if j), default=0), len(options)):
            if at[i] + 1 < len(options[i]):
                heapq.heappush(heap, (p / options[i][at[i]][0] * options[i][at[i] + 1][0], (*at[:i], at[i] + 1, *at[i + 1 :])))
    return out


def _cell_keys(table: int, dim: int, cells: np.ndarray) -> np.ndarray:
    """64-bit keys of cells (rows); cells that clash are only ever extra candidates."""
    key = np.full(len(cells), np.uint64(table * 1_000_003 + dim), np.uint64)
    for c in cells.T:
        key = (key ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows (x[i], y[i]) of original vectors."""
    a, b = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def clean(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, vec): vec as packed doubles, only of vectors that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    good = F.forall("e", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists("e", lambda v: v != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column(1)
            flat, at = e.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(e.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["vec_id", "vec"])

    return numbered(rows.filter(good).mapInArrow(run, "vec_id long, vec binary"), "row")


def _sizes(raw: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """(dimension, places) of vectors by length."""
    for size in sorted({len(v) for v in raw}):
        yield size // 8, [i for i, v in enumerate(raw) if len(v) == size]


def _indexed(members: DataFrame, projections: int) -> DataFrame:
    """(tab, cell, rep, vid, vec): a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            for dim, at in _sizes(raw):
                unit = _unit(_vectors([raw[i] for i in at]))
                for t in range(TABLES):
                    a, shift = directions(dim, t, projections)
                    cells = _cell_keys(t, dim, np.floor((unit @ a + shift) / WIDTH).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(cells), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary())], names=["tab", "cell", "rep", "vid", "vec"])

    return members.select("rep", "vid", "vec").mapInArrow(run, "tab int, cell long, rep long, vid long, vec binary")


def _sample(members: DataFrame) -> list[bytes]:
    """Vectors with the smallest hashes: SAMPLE at most, and about SAMPLE_BYTES."""
    first = members.orderBy(F.xxhash64("vec"), "rep").limit(SAMPLE).select(F.octet_length("vec").alias("n"))
    n = min(SAMPLE, int(SAMPLE_BYTES // max(1, first.agg(F.max("n")).first()[0] or 1)))
    return [bytes(r["vec"]) for r in members.orderBy(F.xxhash64("vec"), "rep").limit(max(1, n)).select("vec").collect()]


def _asked(queries: DataFrame, projections: int, sample: list[bytes], rows: int, k: int) -> DataFrame:
    """(query, cell) of the cells that each query visits; a null cell stands for all vectors."""
    shared = queries.sparkSession.sparkContext.broadcast({dim: _unit(_vectors([sample[i] for i in at])) for dim, at in _sizes(sample)})
    near = max(1, math.ceil(k * len(sample) / max(rows, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            who: list[int] = []
            cells: list[int | None] = []
            for dim, at in _sizes(raw):
                unit, known = _unit(_vectors([raw[i] for i in at])), shared.value.get(dim)
                if known is None or len(known) <= near:
                    who += [ids[i] for i in at]
                    cells += [None] * len(at)
                    continue
                # Of the nearest, the query itself may be one.
                best = -np.sort(-(unit @ known.T), axis=1)[:, : near + 1]
                itself = best[:, 0] > 1 - 1e-12
                reach = np.sqrt(np.maximum(0, 2 - 2 * best[np.arange(len(at)), near - 1 + itself])) / WIDTH
                for t in range(TABLES):
                    a, shift = directions(dim, t, projections)
                    for i, h, r in zip(at, (unit @ a + shift) / WIDTH, reach):
                        visited = probe_cells(h, float(r))
                        keys = [None] if visited is None else _cell_keys(t, dim, np.array(visited)).tolist()
                        who += [ids[i]] * len(keys)
                        cells += keys
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(cells, pa.int64())], names=["query", "cell"])

    found = queries.select(F.col("row").alias("query"), "vec").mapInArrow(run, "query long, cell long")
    everything = F.max(F.col("cell").isNull()).over(Window.partitionBy("query"))
    return found.withColumn("all", everything).filter(~F.col("all") | F.col("cell").isNull()).select("query", "cell").distinct()


def _nearest(k: int):
    """Queries and index rows of a group, to the nearest rows of each query in the cells it visits."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "vid": np.zeros(0, np.int64), "score": np.zeros(0)})]
        right = right.sort_values(["cell", "rep"], ignore_index=True)
        right["dim"] = right["vec"].map(len)
        left = left.assign(dim=left["vec"].map(len))
        for dim, mine in right.groupby("dim"):
            asked = left[left["dim"] == dim].reset_index(drop=True)
            if not len(asked):
                continue
            x, q = _vectors(mine["vec"].tolist()), _vectors(asked["vec"].tolist())
            ux, uq = _unit(x), _unit(q)
            reps, vids, cells = mine["rep"].to_numpy(), mine["vid"].to_numpy(), mine["cell"].to_numpy()
            owner = np.repeat(np.arange(len(asked)), [len(c) for c in asked["cells"]])
            wanted = np.concatenate(asked["cells"].to_list())
            every = np.array([len(c) == 0 for c in asked["cells"]])
            parts = [(np.flatnonzero(every), 0, len(mine))] if every.any() else []
            lo, hi = np.searchsorted(cells, wanted), np.searchsorted(cells, wanted, side="right")
            order = np.argsort(wanted, kind="stable")
            for run_ in np.split(order, np.flatnonzero(np.diff(wanted[order])) + 1) if len(order) else []:
                parts.append((owner[run_], lo[run_[0]], hi[run_[0]]))
            for who, a, b in parts:
                for at in range(0, len(who), 1000) if b > a else ():
                    some = who[at : at + 1000]
                    s = uq[some] @ ux[a:b].T
                    n = min(k + 1, b - a)
                    least = np.partition(s, b - a - n, axis=1)[:, b - a - n]
                    row, col = np.nonzero(s >= least[:, None] - 1e-12)
                    out.append(pd.DataFrame({"query": asked["query"].to_numpy()[some[row]], "rep": reps[a + col], "vid": vids[a + col], "score": cosine(q[some[row]], x[a + col])}))
        return pd.concat(out).sort_values(["query", "score", "vid"], ascending=[True, False, True]).groupby("query").head(k + 2)

    return run


def _search(asked: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query, rep, vid, score) of the nearest reps in the cells that queries ask for."""
    blocks = written(index.groupBy("tab", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("blocks"), F.count(F.lit(1)).alias("n")))
    groups = max(1, math.ceil((blocks.agg(F.sum("n")).first()[0] or 0) / GROUP_ROWS / TABLES))
    group = (F.col("tab") * groups + F.pmod(F.xxhash64("cell", "block"), F.lit(groups))).cast("long")
    one = asked.filter("cell is not null").join(blocks.drop("n"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    one = one.withColumn("group", group).groupBy("query", "group").agg(F.collect_set("cell").alias("cells"))
    whole = asked.filter("cell is null").select("query", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.array().cast("array<bigint>").alias("cells"))
    wanted = written(one.unionByName(whole))
    parts = wanted.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("long").alias("parts"))
    left = wanted.join(queries.select(F.col("row").alias("query"), "vec"), "query").join(parts, "group").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))
    right = index.join(blocks.drop("n"), ["tab", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("group", group)
    right = right.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left, right = left.select("group", "part", "query", "cells", "vec"), right.select("group", "part", "cell", "rep", "vid", "vec")
    found = left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInPandas(_nearest(k), "query long, rep long, vid long, score double")
    return found.distinct()


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found. is_query: over vec_id."""
    return alone(lambda: _nearest_found(df, is_query, k, vec_id, embedding))


def _nearest_found(df: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str) -> DataFrame:
    rows = clean(df, vec_id, embedding)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id", "row"))
    same = rows.withColumn("n", place).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.min("row").alias("rep"), F.min("vec_id").alias("vid"), F.collect_list(F.struct("vec_id", "row")).alias("rows"))
    members = written(same)
    total = members.count()
    projections = projections_for(total)
    index = written(_indexed(members, projections))
    queries = rows.filter(is_query)
    asked = written(_asked(queries, projections, _sample(members), total, k))

    def ranked(found: DataFrame) -> DataFrame:
        best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vid", "rep"))).filter(F.col("n") <= k + 2).drop("n")
        each = best.join(members.select("rep", "rows"), "rep").select("query", "score", F.explode("rows").alias("r")).filter("r.row <> query")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "r.vec_id", "r.row"))
        return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "r.vec_id", "score")

    first = written(ranked(_search(asked, queries, index, k)))
    done = first.groupBy("query").agg(F.max("rank").alias("n")).filter(F.col("n") == k).select("query")
    done = done.unionByName(asked.filter("cell is null").select("query")).distinct()
    short = written(queries.select(F.col("row").alias("query")).join(done, "query", "left_anti").withColumn("cell", F.lit(None).cast("long")))
    if not short.isEmpty():
        again = ranked(_search(short, queries, index, k))
        first = first.join(short.select("query"), "query", "left_anti").unionByName(again)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return first.join(names, "query").select("query_id", "rank", "vec_id", "score")


def visited_share(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """Mean share of all distinct vectors that a query is compared with, for tuning."""
    rows = clean(df, vec_id, embedding)
    members = written(rows.groupBy("vec").agg(F.min("row").alias("rep"), F.min("vec_id").alias("vid")))
    total = members.count()
    index = written(_indexed(members, projections_for(total)))
    asked = written(_asked(rows.filter(is_query), projections_for(total), _sample(members), total, k))
    met = asked.filter("cell is not null").join(index.select("cell", "rep"), "cell").select("query", "rep").distinct().count()
    n = asked.select("query").distinct().count()
    return (met + asked.filter("cell is null").count() * total) / max(1, n * total)
