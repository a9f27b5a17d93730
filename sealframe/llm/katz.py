"""Katz backoff language model: counts, model tables and scores of whole texts.

Tokens are words (lower-cased A-Z, cut at ASCII white space) and one end a text; a text starts
in a start context. The model is a bigram model over a unigram model over one event for all
unknown words:

    P(w | h) = d(c) c(h, w) / c(h)        if h, w was seen c times
               alpha(h) P(w)              else;  P(w) if h was never seen
    P(w)     = d(c) c(w) / N              if w was seen, else what is left over

d are Good-Turing discounts of counts up to K (Katz's formula; where the counts of counts do not
allow it, absolute discounting with n1 / (n1 + 2 n2)). alpha(h) is exact: the mass that h's seen
words leave, over one less the lower-order mass of those words. A context without discounted
counts keeps 1 / (c(h) + 1) back. So P sums to one over the known words and the unknown event.

Texts are held as blocks of about TOKENS tokens: local word numbers, and hashes of the distinct
words. A block sends its distinct words, and then its distinct word pairs, with counts to hash
buckets as packed arrays, one row a bucket; a bucket adds up counts over blocks, stores the
model's rows, and answers each block in the order asked. Every pair of a context is in one
bucket, but contexts with more than a share of all tokens are spread over all buckets by pair,
and their sums, one row a bucket and such a context, are added up. Words are numbered by bucket,
so pairs are small. All steps are written to the shared folder. Words are told apart by 64-bit hashes:
two of a corpus of 10^8 different words clash with a probability of 0.0003, and then count as one.

Cases: null text is empty text: one end token; rows with a null train flag are not trained on;
ids may be null or repeat, each row has its own score; without training text every token is the
unknown event with probability 1; empty in, empty out; a text of any length is one document of
its block; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, release, shared_dir

K = 5
TOKENS = 2_000_000
MAX_BUCKETS = 4096
SEED = 3
#: Neither can be a word: words hold no white space.
END, START = b"\n", b" "


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


# --- blocks ----------------------------------------------------------------------------

BLOCK = "block long, docs binary, lengths binary, trained binary, tokens binary, words binary"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, train, text) to blocks. Columns in order: row number, train flag, text."""
    partition, serial = TaskContext.get().partitionId(), 0
    rows, flags, lengths, parts, numbers, total = [], [], [], [], None, 0

    def done():
        words = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in numbers), np.uint64, len(numbers))
        values = [[partition << 32 | serial], [pack(np.array(rows, np.int64))], [pack(np.array(lengths, np.uint32))], [pack(np.array(flags, np.uint8))], [pack(np.concatenate(parts))], [pack(words)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int64()] + [pa.binary()] * 5)], names=["block", "docs", "lengths", "trained", "tokens", "words"])

    for batch in batches:
        for row, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if numbers is None:
                numbers = _Numbers()
                numbers[START], numbers[END] = 0, 1
            words = (text.as_py() or "").encode().lower().split()
            words.append(END)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            rows.append(row)
            flags.append(bool(train))
            lengths.append(len(words))
            total += len(words)
            if total >= TOKENS:
                yield done()
                serial += 1
                rows, flags, lengths, parts, numbers, total = [], [], [], [], None, 0
    if parts:
        yield done()


@dataclass
class Block:
    """A block unpacked: tokens with their contexts, and the distinct pairs of both."""

    row: pd.Series

    def __post_init__(self):
        r = self.row
        self.docs, self.lengths, self.trained = unpack(r.docs, np.int64), unpack(r.lengths, np.uint32).astype(np.int64), unpack(r.trained, np.uint8)
        self.tokens, self.words = unpack(r.tokens, np.uint32).astype(np.int64), unpack(r.words)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flags = np.repeat(self.trained, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens, self.flags, len(self.words)).astype(np.uint64)

    def pairs(self):
        """(context, word, training count) of the distinct pairs, and the pair of each token."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = 0
        code, where = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        return code // len(self.words), code % len(self.words), np.bincount(where, self.flags, len(code)).astype(np.uint64), where


# --- words -----------------------------------------------------------------------------

ANSWER = "kind string, bucket int, block long, hot boolean, a binary, b binary, c binary, d binary, stats array<long>"
_COLUMNS = ["kind", "bucket", "block", "hot", "a", "b", "c", "d", "stats"]


def _row(kind, bucket, block=-1, hot=False, a=b"", b=b"", c=b"", d=b"", stats=()):
    return (kind, bucket, block, hot, a, b, c, d, list(stats))


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _count_stats(c: np.ndarray) -> list[int]:
    """[tokens, types, n1 … n(K+1)] of counts."""
    c = c[c > 0]
    return [int(c.sum()), len(c), *np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].tolist()]


def _ask_words(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                b = Block(r)
                n, to = b.word_counts(), (b.words % np.uint64(buckets)).astype(np.int64)
                yield _frame([_row("ask", k, r.block, a=pack(b.words[at]), b=pack(n[at])) for k in range(buckets) if len(at := np.flatnonzero(to == k))])

    return run


def _answer_words(buckets: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        bucket = int(key[0])
        words, counts = [unpack(x) for x in f.a], [unpack(x) for x in f.b]
        distinct, where = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.uint64)
        number = np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        out, at = [_row("model", bucket, a=pack(distinct), b=pack(total), stats=_count_stats(total))], 0
        for block, w in zip(f.block, words):
            mine = where[at : at + len(w)]
            out.append(_row("words", bucket, int(block), a=pack(number[mine]), b=pack(total[mine])))
            at += len(w)
        return _frame(out)

    return run


# --- discounts -------------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[r] for r = 0 … K, from n1 … n(K+1); d[0] is not used."""
    n = np.array([0, *counts_of_counts], np.float64)
    r = np.arange(1, K + 1)
    if (n[1 : K + 2] > 0).all():
        common = (K + 1) * n[K + 1] / n[1]
        if common < 1:
            d = ((r + 1) * n[2 : K + 2] / (r * n[1 : K + 1]) - common) / (1 - common)
            if (d > 0).all() and (d < 1).all():
                return np.append(1.0, d)
    drop = float(np.clip(n[1] / (n[1] + 2 * n[2]), 0.05, 0.95)) if n[1] + n[2] else 0.5
    return np.append(1.0, (r - drop) / r)


@dataclass(frozen=True)
class Unigrams:
    tokens: int
    types: int
    d: np.ndarray

    def kept(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        c = c.astype(np.float64)
        return c * np.where(c <= K, self.d[np.minimum(c, K).astype(np.int64)], 1.0)


@dataclass(frozen=True)
class Lower:
    """Unigram probabilities by count. unknown: of the one unknown event."""

    u: Unigrams
    total: float
    unknown: float

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.u.kept(c) / max(self.total, 1.0), self.unknown)


def lower_order(stats: list[int]) -> Lower:
    tokens, types, *n = stats
    u = Unigrams(tokens, types, discounts(n))
    if not tokens:
        return Lower(u, 0.0, 1.0)
    lost = sum((1 - u.d[r]) * r * n[r - 1] for r in range(1, K + 1))
    return Lower(u, float(tokens), lost / tokens) if lost > 0 else Lower(u, tokens + 1.0, 1 / (tokens + 1))


# --- pairs -----------------------------------------------------------------------------


def _with_answers(block, answers: pd.DataFrame, buckets: int):
    """(block, number and total of each local word)."""
    b = Block(block)
    to = (b.words % np.uint64(buckets)).astype(np.int64)
    number, total = np.zeros(len(to), np.uint64), np.zeros(len(to), np.uint64)
    for r in answers[answers.kind == "words"].itertuples():
        at = np.flatnonzero(to == r.bucket)
        number[at], total[at] = unpack(r.a), unpack(r.b)
    return b, number, total


def _routes(h: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(bucket, hot, places in order of context and word) of pairs."""
    to = (mix(np.where(hot, h * np.uint64(0x9E3779B1) ^ mix(w), h)) % np.uint64(buckets)).astype(np.int64) * 2 + hot
    order = np.lexsort((w, h, to))
    cuts = np.flatnonzero(np.diff(to[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(to[at[0]]) >> 1, bool(to[at[0]] & 1), at


def _hot_contexts(total: np.ndarray, limit: float, texts: int) -> np.ndarray:
    """Whether each local word is a hot context; the start's count is that of texts."""
    hot = total > limit
    hot[0] = texts > limit
    return hot


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def _ask_pairs(buckets: int, limit: float, texts: int):
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in blocks.itertuples():
            b, number, total = _with_answers(r, answers, buckets)
            h, w, n, _ = b.pairs()
            hot = _hot_contexts(total, limit, texts)[h]
            hs, ws = number[h], number[w]
            for bucket, is_hot, at in _routes(hs, ws, hot, buckets):
                out.append(_row("ask", bucket, int(r.block), is_hot, pack(_steps(hs[at])), pack(ws[at]), pack(n[at]), pack(total[w[at]])))
        return _frame(out)

    return run


def _context_stats(h: np.ndarray, c: np.ndarray, low: np.ndarray):
    """(contexts, their counts of counts 1 … K and sum of larger counts, lower-order mass of
    their seen words) of distinct pairs in order of context."""
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.where(c == r, 1, 0), first) for r in range(1, K + 1)] if len(h) else [np.zeros(0, np.int64)] * K
    big = np.add.reduceat(np.where(c > K, c, 0).astype(np.int64), first) if len(h) else np.zeros(0, np.int64)
    mass = np.add.reduceat(np.where(c > 0, low, 0.0), first) if len(h) else np.zeros(0)
    return h[first], np.stack([*sums, big]).astype(np.uint64), mass


def _answer_pairs(lower: Lower):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), []
        for hot, part in f.groupby("hot"):
            hs, ws = [np.cumsum(unpack(x), dtype=np.uint64) for x in part.a], [unpack(x) for x in part.b]
            h, w = np.concatenate(hs), np.concatenate(ws)
            n, cw = (np.concatenate([unpack(x) for x in part[k]]) for k in ("c", "d"))
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
            first = np.flatnonzero(new)
            c = np.add.reduceat(n[order], first)
            contexts, sums, mass = _context_stats(h[first], c, lower.p(cw[order][first]))
            seen = c > 0
            out.append(_row("model", bucket, hot=bool(hot), a=pack(_steps(h[first][seen])), b=pack(w[first][seen]), c=pack(c[seen]), stats=_count_stats(c)))
            if hot:
                out += [_row("hot", bucket, int(x), True, c=pack(s), d=pack(np.array([m]).view(np.uint64))) for x, s, m in zip(contexts, sums.T, mass)]
            count = np.empty(len(order), np.uint64)
            count[order] = c[np.cumsum(new) - 1]
            at = 0
            for block, mine in zip(part.block, hs):
                answer, at = count[at : at + len(mine)], at + len(mine)
                own = [b"", b""]
                if not hot:
                    where = np.searchsorted(contexts, mine[np.append(True, mine[1:] != mine[:-1])])
                    own = [pack(sums[:, where].reshape(-1)), pack(mass[where].view(np.uint64))]
                out.append(_row("pairs", bucket, int(block), bool(hot), pack(answer), c=own[0], d=own[1]))
        return _frame(out)

    return run


# --- scores ----------------------------------------------------------------------------


def backoff(c: np.ndarray, low: np.ndarray, sums: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(w | h) of pairs. c: pair counts; low: P(w); sums, mass: their contexts' statistics."""
    r = np.arange(1, K + 1, dtype=np.float64)[:, None]
    total = (r * sums[:K]).sum(axis=0) + sums[K]
    left = ((1 - d[1:, None]) * r * sums[:K]).sum(axis=0)
    plain = left <= 0
    whole = np.where(plain, total + 1, np.maximum(total, 1))
    left = np.where(plain, 1.0, left) / whole
    seen = c * np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0) / whole
    return np.where(total == 0, low, np.where(c > 0, seen, left / np.maximum(1 - mass, 1e-300) * low))


SCORES = "row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, limit: float, texts: int, lower: Lower, d: np.ndarray, hot_table: dict):
    def run(key: tuple, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in blocks.itertuples():
            b, number, total = _with_answers(r, answers, buckets)
            h, w, _, where = b.pairs()
            hot = _hot_contexts(total, limit, texts)[h]
            hs, ws = number[h], number[w]
            count, sums, mass = np.zeros(len(h)), np.zeros((K + 1, len(h))), np.zeros(len(h))
            given = {(x.bucket, x.hot): x for x in answers[answers.kind == "pairs"].itertuples()}
            for bucket, is_hot, at in _routes(hs, ws, hot, buckets):
                x, mine = given[bucket, is_hot], hs[at]
                count[at] = unpack(x.a)
                new = np.append(True, mine[1:] != mine[:-1])
                which = np.cumsum(new) - 1
                if is_hot:
                    found = [hot_table[int(c)] for c in mine[new]]
                    table, own = np.stack([s for s, _ in found], axis=1), np.array([m for _, m in found])
                else:
                    table, own = unpack(x.c).reshape(K + 1, -1), unpack(x.d).view(np.float64)
                sums[:, at], mass[at] = table[:, which], own[which]
            low = lower.p(total[w])
            logs = np.log10(backoff(count, low, sums, mass, d))[where]
            known = total[b.tokens]
            base = np.log10((known + 1.0) / (lower.u.tokens + lower.u.types + 1.0))
            out.append(pd.DataFrame({
                "row": b.docs, "held_out": b.trained == 0, "n_tokens": b.lengths, "n_known": np.add.reduceat((known > 0).astype(np.int64), b.starts), "train_tokens": lower.u.tokens,
                "base_score": np.add.reduceat(base, b.starts), "score": np.add.reduceat(logs, b.starts)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])

    return run


def fit_and_score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(scores, model folder). Scores hold doc_id, held_out, token counts, base_score and score
    of every row. The folder holds the tables words and pairs, partitioned by kind; their
    `model` rows are the counts of each bucket: word hashes and counts; contexts (as steps),
    words and counts, by word number."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession)

    def store(rows: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        rows.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(f"{root}/{name}")
        schema = rows.schema
        del rows
        release(spark, 0.7)
        return spark.read.schema(schema).parquet(f"{root}/{name}")

    source = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    del df
    blocks = store(source.select("id", "train", "text").mapInArrow(_null_safe(_block_rows), BLOCK), "blocks")
    many = blocks.count()
    buckets = max(8, min(MAX_BUCKETS, many))
    asked = blocks.mapInPandas(_ask_words(buckets), ANSWER)
    words = store(asked.groupBy("bucket").applyInPandas(_answer_words(buckets), ANSWER), "words", ["kind"])
    del asked
    lower = lower_order(_sum_stats(words))
    texts = blocks.select("trained").mapInPandas(_trained_texts, "n long").agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, lower.u.tokens / (2 * buckets))
    replies = words.filter("kind = 'words'")
    asked = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_ask_pairs(buckets, limit, texts), ANSWER)
    pairs = store(asked.groupBy("bucket").applyInPandas(_answer_pairs(lower), ANSWER), "pairs", ["kind"])
    del asked
    release(spark, 0.7)
    d = discounts(_sum_stats(pairs)[2:])
    # At most 2 * buckets contexts hold over tokens / (2 * buckets) tokens each, and the start.
    # Their rows, one a bucket, are added up by context before the driver gets them.
    hot = pairs.filter("kind = 'hot'").mapInPandas(_hot_sums, "context long, bucket int, mass double, sums array<long>")
    each = hot.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("bucket", "mass"))).alias("masses"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(K + 1)])
    mass = F.aggregate("masses", F.lit(0.0), lambda acc, x: acc + x["mass"])
    table = {r["context"]: (np.array([r[f"s{i}"] for i in range(K + 1)], np.float64), r["mass"]) for r in each.withColumn("mass", mass).drop("masses").collect()}
    replies = words.filter("kind = 'words'").unionByName(pairs.filter("kind = 'pairs'"))
    scores = store(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_score(buckets, limit, texts, lower, d, table), SCORES), "scores")
    delete(spark, f"{root}/blocks")
    for name in ("words/kind=words", "pairs/kind=pairs"):
        delete(spark, f"{root}/{name}")
    out = scores.withColumn("doc_id", F.when(F.col("row") != _NULL_ID, F.col("row")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), root


#: Stands for a null id within blocks.
_NULL_ID = -(2**63)


def _null_safe(run):
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays([b.column(0).fill_null(_NULL_ID), b.column(1), b.column(2)], names=["id", "train", "text"]) for b in batches)

    return wrapped


def _hot_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"context": f["block"], "bucket": f["bucket"], "mass": [float(unpack(x).view(np.float64)[0]) for x in f["d"]], "sums": [unpack(x).astype(np.int64).tolist() for x in f["c"]]})


def _trained_texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"n": [int(unpack(x, np.uint8).sum()) for x in f.trained]})


def _sum_stats(table: DataFrame) -> list[int]:
    """Summed stats of a table's model rows: one row of K + 3 sums."""
    sums = table.filter("kind = 'model'").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3)]).first()
    return [int(x or 0) for x in sums]
