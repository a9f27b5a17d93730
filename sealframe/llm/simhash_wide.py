"""Near duplicates at a word-shingle similarity of LIKE and more: wide SimHash, then an exact check.

Fingerprints have 256 bits; texts whose sets of five-word shingles have a similarity of 0.8 differ in
15 % of them. Distinct fingerprints meet in groups that agree on one of TABLES fixed choices of
KEY_BITS bits, and candidates differ in at most BUDGET bits. Candidates are checked by the exact
similarity of their shingle sets, and only pairs of LIKE and more are links.

Candidates are found as parts. In a task each row meets its neighbours in several sort orders of its group;
then the group's fingerprints form a binary trie that is joined with itself: pairs of nodes go
down together, differing bits add up, and a pair is dropped if it is over the budget, or if
all its leaves are in one part already. A task passes on a spanning forest of what it found, so a large
group of near copies costs about its rows. Components of the forests are the candidate parts, and in each
part the shingle sets of all pairs, that links do not join already, are compared, those of one fingerprint and
those over the budget too; a task passes on a spanning forest of the links. So rows that are alike are found whether they met
themselves or over others, and no pair leaves a task but as a link of a forest.

Groups above GROUP_ROWS, and parts above PART_ROWS, are dealt into blocks, and each row goes to every pair of
blocks that has its own, so nothing is lost; the rows of such a group grow with its square over
that number. Whether two texts meet does not depend on other rows but that these may join them;
a pair at similarity 0.8 meets with a probability of about 0.9, more similar ones nearly always.

Cases: null and empty texts are alike; fewer words than a shingle make one shingle of all; every
row counts, with its own number, whether its id is null or repeated; of a component the row with the
smallest id, nulls last, is the first; empty in, empty out; other columns pass through or are
ignored, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, components, free_name, joined, numbered, small_batches, written
from .simhash import forest

WORDS = 4
BITS = 64 * WORDS
SHINGLE = 5
LIKE = 0.8
#: Similarity 0.8 has 38 differing bits, with a deviation of 6.
BUDGET = 56
TABLES = 40
KEY_BITS = 16
GROUP_ROWS = 1_500
PART_ROWS = 1_000
#: Pairs of rows of one group that are worked on at once.
_PAIRS = 2_000_000
_CHUNK = 40_000
_SALT = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(WORDS)], np.uint64)
#: The bits of each table's key.
KEYS = np.stack([np.random.default_rng([17, t]).choice(BITS, KEY_BITS, replace=False) for t in range(TABLES)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's lower-cased word shingles; none for no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = {b" ".join(words)} if len(words) < shingle else set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words of shingle hashes; a bit is set if it is in over half of them."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 2048):
        wide = _mix(h[at : at + 2048, None] ^ _SALT)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


_FPS = [f"f{i}" for i in range(WORDS)]
_FP_TYPES = ", ".join(f"{f} long" for f in _FPS)
#: Rows that agree in these, `which` being the hash of the shingle set, are copies of each other.
_SET = ["which", *_FPS]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            fps = np.stack(list(map(fingerprint, sets))).view(np.int64)
            which = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(which), *[pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WORDS)]], names=["row", "id", "which", *_FPS])


def keys(fps: np.ndarray, table: int) -> np.ndarray:
    """Group numbers of fingerprints in a table."""
    out = np.full(len(fps), table, np.uint64)
    for at in KEYS[table].tolist():
        word, shift = divmod(at, 64)
        out = out << np.uint64(1) | fps[:, word] >> np.uint64(shift) & np.uint64(1)
    return _mix(out).view(np.int64)


def _columns(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False) for n in names]


def _tabled(slim: bool):
    """Each row (rep, f0 …) under its group in every table; slim: the groups alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.stack(_columns(b, _FPS), axis=1).view(np.uint64)
            for t in range(TABLES):
                g = pa.array(keys(fps, t))
                if slim:
                    yield pa.RecordBatch.from_arrays([g], names=["g"])
                else:
                    yield pa.RecordBatch.from_arrays([g, *b.columns], names=["g", *b.schema.names])

    return run


def differ(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of pairs (a, b) that join two parts when pairs are taken in turn."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[x] = y
            out.append(i)
    return out


def neighbours(group: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of neighbours in a group's sort orders, a word of the fingerprint leading in each."""
    a, b = [], []
    for first in range(WORDS):
        order = np.lexsort([*(fps[:, (first + WORDS - 1 - k) % WORDS] for k in range(WORDS)), group])
        x, y = order[:-1], order[1:]
        near = group[x] == group[y]
        x, y = x[near], y[near]
        near = differ(fps, x, y) <= budget
        a.append(x[near])
        b.append(y[near])
    return np.concatenate(a), np.concatenate(b)


def trie_pairs(group: np.ndarray, fps: np.ndarray, part: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (a, b) of a group and of different parts that differ in at most budget
    bits. Rows are sorted by group, then by fingerprint words. A trie node is a range of rows."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
    same_until = change[np.searchsorted(change, np.arange(n), side="right")]
    found_a, found_b = [], []
    alo = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ahi = np.append(alo[1:], n)
    blo, bhi, diff = alo, ahi, np.zeros(len(alo), np.int64)
    for level in range(BITS + 1):
        one = (same_until[alo] >= ahi) & (same_until[blo] >= bhi) & (part[alo] == part[blo])
        leaf = ~one & (ahi - alo == 1) & (bhi - blo == 1)
        a, b = alo[leaf], blo[leaf]
        near = differ(fps, a, b) <= budget
        found_a.append(a[near])
        found_b.append(b[near])
        alo, ahi, blo, bhi, diff = (x[~one & ~leaf] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo) or level == BITS:
            break
        word, bit = divmod(level, 64)
        ones = np.concatenate([[0], np.cumsum((fps[:, word] >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        other = alo != blo
        pieces = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1), tuple(x[other] for x in (amid, ahi, blo, bmid, diff + 1))]
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*pieces))
        keep = (alo < ahi) & (blo < bhi) & (diff <= budget) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, diff = (x[keep] for x in (alo, ahi, blo, bhi, diff))
    return np.concatenate(found_a), np.concatenate(found_b)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of whole groups, of about _PAIRS pairs each."""
    at = first = pairs = 0
    for size in sizes.tolist():
        if pairs and pairs + size * size > _PAIRS:
            yield first, at
            first, pairs = at, 0
        at, pairs = at + size, pairs + size * size
    if at > first:
        yield first, at


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], rows: int, solve) -> Iterator[pa.RecordBatch]:
    """solve(*columns) of whole groups, of about so many rows at a time; rows come sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_columns(batch, names))
        if sum(len(h[0]) for h in held) >= rows and held[0][0][0] != held[-1][0][-1]:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = np.flatnonzero(cols[0] != cols[0][-1])[-1] + 1
            held = [[c[cut:] for c in cols]]
            yield from solve(*(c[:cut] for c in cols))
    if held:
        yield from solve(*(np.concatenate(c) for c in zip(*held)))


def parts_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of each of n places that pairs (a, b) join, as its smallest place."""
    part = np.arange(n)
    for x, low in forest(a.tolist(), b.tolist()):
        part[x] = low
    return part


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, rep, f0 …) sorted by g, to spanning forests of the pairs within the budget."""

    def solve(g, rep, *cols):
        fps = np.stack(cols, axis=1).view(np.uint64)
        order = np.lexsort([*(fps[:, k] for k in range(WORDS - 1, -1, -1)), g])
        g, rep, fps = g[order], rep[order], fps[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sizes = np.diff(np.append(first, len(g)))
        several = np.repeat(sizes > 1, sizes)
        if not several.any():
            return
        g, rep, fps = g[several], rep[several], fps[several]
        a, b = neighbours(g, fps)
        part = parts_of(len(g), a, b)
        found = [(a, b)]
        for lo, hi in _slices(sizes[sizes > 1]):
            x, y = trie_pairs(g[lo:hi], fps[lo:hi], part[lo:hi])
            some = spanning(x, y)
            found.append((lo + x[some], lo + y[some]))
        a, b = (rep[np.concatenate(x)] for x in zip(*found))
        some = spanning(a, b)
        yield from _edges(a[some], b[some])

    return _whole_groups(batches, ["g", "rep", *_FPS], _CHUNK, solve)


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _in_blocks(rows: DataFrame, group: str, rep: str, n: Column, limit: int) -> DataFrame:
    """rows with `key` in place of their group: for groups of over `limit` rows, one for each pair of blocks that
    has the row's own. n: rows of the group, or null for few."""
    blocks = F.when(n > limit, F.ceil(2 * n / limit))
    own = F.pmod(F.xxhash64(rep), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda q: F.xxhash64(group, F.least(own, q), F.greatest(own, q)))
    return rows.withColumn("key", F.explode(F.when(blocks.isNull(), F.array(F.col(group))).otherwise(pairs)))


def candidates(distinct: DataFrame) -> DataFrame:
    """Spanning forests (a, b), a < b, of the pairs of reps of distinct fingerprints (rep, f0 …) that meet
    within the budget."""
    spark, rows = distinct.sparkSession, distinct.select("rep", *_FPS)
    sizes = written(rows.mapInArrow(_tabled(True), "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS))
    dealt = _in_blocks(rows.mapInArrow(_tabled(False), f"g long, rep long, {_FP_TYPES}").join(sizes, "g", "left"), "g", "rep", F.col("n"), GROUP_ROWS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(F.col("key").alias("g"), "rep", *_FPS).repartition(n, "g").sortWithinPartitions("g").mapInArrow(_meet, "a long, b long").distinct()


def like_pairs(sets: list[np.ndarray], fps: np.ndarray, like: float, budget: int = BITS) -> tuple[list[int], list[int]]:
    """A spanning forest (a, b) of the pairs of sorted distinct sets whose Jaccard similarity is `like` and
    more, and whose fingerprints differ in at most `budget` bits, if that is fewer than all. Two empty sets are alike.

    Sets are numbers of a common vocabulary, end to end; a set's marks give its overlap with all the others
    at once.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.zeros(0), np.zeros(0, np.int64))
    starts = np.cumsum(sizes) - sizes
    marks, part = np.zeros(len(vocabulary) + 1, np.int32), np.arange(n)
    found_a, found_b = [], []
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(part[j] != part[i]) & (np.minimum(sizes[j], sizes[i]) >= like * np.maximum(sizes[j], sizes[i]) - 1e-9)]
        if budget < BITS and len(j):
            j = j[np.bitwise_count(fps[j] ^ fps[i]).sum(axis=1, dtype=np.int64) <= budget]
        if not len(j):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marks[own] = 1
        at = np.repeat(starts[j] - (np.cumsum(sizes[j]) - sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
        sums = np.append(0, np.cumsum(marks[flat[at]]))
        ends = np.cumsum(sizes[j])
        both = sums[ends] - sums[ends - sizes[j]]
        marks[own] = 0
        for k in j[both >= like * (sizes[j] + sizes[i] - both) - 1e-9].tolist():
            if part[k] != part[i]:
                found_a.append(i)
                found_b.append(k)
                part[part == part[k]] = part[i]
    return found_a, found_b


def _compare(like: float):
    """Rows (key, rep, s, f0 …) sorted by key, to spanning forests of the links in each group."""

    def solve(key, rep, s, *cols):
        fps = np.stack(cols, axis=1).view(np.uint64)
        for at in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
            if len(at) > 1:
                a, b = like_pairs([np.frombuffer(s[i], np.uint64) for i in at.tolist()], fps[at], like)
                if a:
                    yield from _edges(rep[at[a]], rep[at[b]])

    return lambda batches: _whole_groups(batches, ["key", "rep", "s", *_FPS], PART_ROWS, solve)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["rep", "s"])


def links(parts: DataFrame, reps: DataFrame, rows: DataFrame, row: str, text: str, like: float = LIKE) -> DataFrame:
    """Spanning forests (a, b) of the links within candidate parts (rep, component): pairs whose shingle sets
    have a similarity of `like` and more."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = joined(rows.select(F.col(row).alias("rep"), F.col(text).alias("text")), written(parts.select("rep")), "rep", "left_semi")
    sets = written(texts.mapInArrow(_sets, "rep long, s binary"))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART_ROWS)
    dealt = _in_blocks(parts.join(written(sizes), "component", "left"), "component", "rep", F.col("n"), PART_ROWS).select("key", "rep")
    whole = dealt.join(reps.select("rep", *_FPS), "rep").join(sets, "rep")
    return whole.select("key", "rep", "s", *_FPS).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(like), "a long, b long")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", like: float = LIKE) -> tuple[DataFrame, DataFrame, str]:
    """(rows, classes, row): the rows of df, written with a number in the column named `row`; and
    (row, component_id, first) of each, the smallest id reachable by links and its row."""
    small_batches(df.sparkSession)
    row = free_name(df, "row_number")
    rows = numbered(df, row)
    return rows, alone(lambda: _classes(rows, row, doc_id, text, like)), row


def _members(reps: DataFrame, firsts: DataFrame, parts: DataFrame) -> DataFrame:
    """(rep, component) of all sets of the fingerprints in `parts`, and of those that several sets have. firsts: the
    first rep of each fingerprint, and its sets."""
    more = firsts.filter("sets > 1").join(parts, "rep", "left").select(*_FPS, F.col("rep").alias("first"), F.coalesce("component", "rep").alias("component"))
    others = joined(reps.select("rep", *_FPS), written(more), _FPS, "inner", 48).filter("rep <> first").select("rep", "component")
    return parts.select("rep", "component").unionByName(others).unionByName(more.select(F.col("first").alias("rep"), "component")).distinct()


def _classes(rows: DataFrame, row: str, doc_id: str, text: str, like: float) -> DataFrame:
    ids = F.col(doc_id).cast("long")
    prints = written(rows.select(F.col(row).alias("row"), ids.alias("id"), F.col(text).alias("text")).mapInArrow(_prints, f"row long, id long, which long, {_FP_TYPES}"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    reps = written(prints.groupBy(*_SET).agg(F.min("row").alias("rep"), least))
    firsts = written(reps.groupBy(*_FPS).agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("sets")))
    parts = written(_members(reps, firsts, components(candidates(firsts)).withColumnRenamed("node", "rep")))
    # Links are written first, so that no task has both their Python worker and that of components().
    linked = components(written(links(parts, reps, rows, row, text, like))).select(F.col("node").alias("rep"), "component")
    classes = reps.join(linked, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least_of = classes.groupBy("component").agg(F.min("least").alias("first"))
    classes = written(classes.join(least_of, "component").select(*_SET, "first"))
    return prints.join(classes, _SET).select("row", F.col("first.id").alias("component_id"), F.col("first.row").alias("first"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", like: float = LIKE) -> DataFrame:
    """df with the first row only of each component of near duplicates."""
    rows, classes, row = near_duplicates(df, doc_id, text, like)
    gone = classes.filter("row <> first").select(F.col("row").alias(row))
    return joined(rows, gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
