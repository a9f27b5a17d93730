"""SimHash fingerprints and their near-duplicate components by a binary trie self-join.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word shingles,
repeats included. Equal fingerprints are one class. Two of 64 bits may differ, so of three
segments one is equal: distinct fingerprints meet in groups of one segment's value, and in each
group the fingerprints form a binary trie that is joined with itself: pairs of nodes go down
together, differing bits add up, and a pair over the budget is dropped. A group above
GROUP_ROWS is split by its most balanced bits: each row goes to every pair of sub-tries that is
within the budget, so no link is lost. A task keeps a spanning forest of the links it finds;
components of all links are found by star contraction. Fingerprints are linked, not ids.

Cases: null text is empty text; a text without words has fingerprint 0, linked like any other;
fewer words than a shingle make one shingle of all; rows with a null id link like any other and
take their component's smallest id (null if it has none); repeated rows stay; empty in, empty out;
other columns are ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, components, written

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of a group that one trie holds before it is split.
GROUP_ROWS = 2_000
_CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a text's lower-cased word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if shingle > 1 else words
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist())


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def trie_links(fps: np.ndarray, starts: np.ndarray, budget: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a before b, of all pairs within a group that differ in at most budget bits.

    fps: sorted within each group; starts: where groups begin. A trie node is a range of
    places that share their leading bits. All pairs of nodes of a depth are held as arrays and
    go down one bit at a time; a pair of single leaves is compared at once.
    """
    found_a, found_b = [], []
    ends = np.append(starts[1:], len(fps))
    big = ends - starts > 1
    alo, ahi = starts[big], ends[big]
    blo, bhi, diff = alo, ahi, np.zeros(len(alo), np.int64)
    for bit in range(63, -1, -1):
        if not len(alo):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        twin = alo == blo
        other = ~twin
        parts = [
            (alo, amid, blo, bmid, diff),
            (amid, ahi, bmid, bhi, diff),
            (alo, amid, bmid, bhi, diff + 1),
            tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1)),
        ]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts))
        keep = (alo < ahi) & (blo < bhi) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1))
        leaf = keep & (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaf], blo[leaf]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
        found_a.append(a[near])
        found_b.append(b[near])
        alo, ahi, blo, bhi, diff = (x[keep & ~leaf] for x in (alo, ahi, blo, bhi, diff))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Links (node, smallest node of its part) that join what a-b joins."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(up) if top(x) != x]


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, fp) sorted by g, to links of fingerprints; whole groups at a time."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _by_unsigned(rows)
        starts = np.flatnonzero(np.append(True, rows["g"][1:] != rows["g"][:-1])) if len(rows) else np.zeros(0, np.int64)
        a, b = trie_links(rows["fp"].view(np.uint64), starts)
        links = forest(rows["fp"][a].tolist(), rows["fp"][b].tolist())
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, [("g", np.int64), ("fp", np.int64)])
        for name in rows.dtype.names:
            rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
        held.append(rows)
        if sum(map(len, held)) >= _CHUNK and held[0]["g"][0] != rows["g"][-1]:
            rows = np.concatenate(held)
            cut = np.flatnonzero(rows["g"] != rows["g"][-1])[-1] + 1
            held = [rows[cut:]]
            yield from solve(rows[:cut])
    if held:
        yield from solve(np.concatenate(held))


def _by_unsigned(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["fp"].view(np.uint64), rows["g"]))]


#: Bits by which a group is split at most: enough for GROUP_ROWS * 2**MOST_CUTS fingerprints.
MOST_CUTS = 20


def _near_masks() -> Column:
    """For each number of cut bits, the masks of at most two of them."""
    return F.array(*[F.array(*[F.lit(m).cast("long") for m in sorted({1 << i | 1 << j for i in range(n) for j in range(n)} | {0})]) for n in range(MOST_CUTS + 1)])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), as spanning forests."""
    segments = F.array(*[F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (at, n) in enumerate(SEGMENTS)])
    rows = distinct.select("fp", F.explode(segments).alias("x")).select("fp", "x.s", "x.v")
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    hot = rows.groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS)
    sums = rows.join(hot, ["s", "v"]).groupBy("s", "v", "n").agg(*bits)
    balance = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"b{i}") * 2 - F.col("n")).alias("d"), F.lit(i).alias("i")) for i in range(64)]))
    wanted = F.least(F.lit(MOST_CUTS - 1), F.ceil(F.log2(F.col("n") / GROUP_ROWS))).cast("int") + 1
    splits = sums.select("s", "v", F.transform(F.slice(balance, F.lit(1), wanted), lambda b: b["i"]).alias("cut"))
    marked = rows.join(splits, ["s", "v"], "left")
    prefix = F.aggregate("cut", F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.getbit(F.col("fp"), i).cast("long"))
    masks = F.element_at(_near_masks(), F.size("cut") + 1)
    spread = F.when(F.col("cut").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(masks, lambda m: F.least(F.col("p"), F.col("p").bitwiseXOR(m)) * F.lit(1 << MOST_CUTS) + F.greatest(F.col("p"), F.col("p").bitwiseXOR(m))))
    tasks = marked.withColumn("p", F.when(F.col("cut").isNotNull(), prefix)).withColumn("pair", F.explode(spread))
    grouped = tasks.select(F.xxhash64("s", "v", "pair").alias("g"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(n, "g").sortWithinPartitions("g").mapInArrow(_link_groups, "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document: the smallest id reachable by links."""
    return alone(lambda: _components(df, doc_id, text, shingle))


def _components(df: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    prints = written(fingerprints(df, doc_id, text, shingle))
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(least.select("fp")))
    parts = least.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(parts.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
