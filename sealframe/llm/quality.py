"""Quality classifier: text evidence combined with host and path priors by empirical Bayes.

A logistic classifier of text features gives each document a probability of being low quality
and one of being toxic. Their sums by host and by path within the host (grouped aggregation
over all documents) give site priors: a host's mean is shrunk toward the global prior and a
path's toward its host's, by strengths estimated from the spread between sites, so sparse
sites hardly move. A document's own share is taken out of its site's sums. The site prior then
replaces the global one in the document's odds.

The classifier is fitted on a bounded sample of labelled rows (at most SAMPLE_ROWS, those with
the smallest hashes of the id); everything else covers all rows. Sums of probabilities are taken
in fixed point, so reruns agree to the last bit.

Cases: null text is empty text; null host or path is a site of its own; null labels are not
learned from; with no labels of a kind, its probability is 0 and nothing is rejected for it;
a document with several labels is used once for each; repeated rows and null ids stay, each row
with its own result; an empty table gives an empty result, empty labels keep every row; columns
that are kept may have any names; texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, joined_by_site, written

SAMPLE_ROWS = 6_000
#: Sampled rows that a feature has to be in.
LEAST_COUNT = 5
BUCKETS = 1 << 18
#: The first features are binned measures, the others hashed.
SHAPES = 256
STEPS = 100
TARGETS = ("bad", "toxic")
_EDGE = ".,;:!?\"'()[]{}|"


def _kinds(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is upper case, a symbol, a digit."""
    return c.isupper(), not c.isalnum() and not c.isspace(), c.isdigit()


_ASCII_KINDS = np.array([_kinds(chr(i)) for i in range(128)], np.int64)


def _kind_counts(s: str) -> np.ndarray:
    """Upper-case characters, symbols and digits in a text."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 128
    out = np.bincount(codes[low], minlength=128) @ _ASCII_KINDS
    for i, v in Counter(codes[~low].tolist()).items():
        out = out + np.array(_kinds(chr(i))) * v
    return out


class Words(dict):
    """Of a lower-cased word, packed: its three hashed features (a short word repeats its
    first), and whether it ends like a shout. A bounded cache, made anew for each partition."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        bare = word.strip(_EDGE)
        at = [SHAPES + crc32(x.encode("utf-8", "replace")) % (BUCKETS - SHAPES) for x in (bare, "^" + bare[:4], "^" + bare[:5])]
        at = [x if i == 0 or len(bare) > 3 + i else at[0] for i, x in enumerate(at)]
        found = at[0] | at[1] << 18 | at[2] << 36 | word.endswith(("!", "*", "%", "$", "&")) << 54
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = found
        return found


def features(text: str | None, known: Words | None = None) -> np.ndarray:
    """Feature numbers of a text: hashed words, word starts, and binned shape measures."""
    known = Words() if known is None else known
    s = text or ""
    words = Counter(s.lower().split())
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    shouts = (packed >> 54) @ np.fromiter(words.values(), np.int64, len(words))
    n, chars = max(1, words.total()), max(1, len(s))
    upper, symbol, digit = _kind_counts(s).tolist()
    lines = [x for x in s.split("\n") if x]
    measures = {
        "upper": upper / chars,
        "symbol": symbol / chars,
        "digit": digit / chars,
        "distinct": len(words) / n,
        "lines": len(set(lines)) / max(1, len(lines)),
        "word": min(1.0, chars / n / 20),
        "length": min(1.0, math.log2(n + 1) / 16),
        "shouts": int(shouts) / n,
    }
    shape = [21 * i + int(20 * v) for i, v in enumerate(measures.values())]
    hashed = [(packed >> i & BUCKETS - 1).astype(np.int32) for i in (0, 18, 36)]
    out = np.sort(np.concatenate([*hashed, np.array(shape, np.int32)]))
    return out[np.append(True, out[1:] != out[:-1])]


@dataclass
class Classifier:
    """Weights of the features that were learned, for each target; prior: the target's share."""

    index: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    prior: np.ndarray

    def logits(self, sets: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return np.stack([dense[s].sum(axis=0) for s in sets]) + self.bias if sets else np.zeros((0, len(self.bias)))

    def dense(self) -> np.ndarray:
        out = np.zeros((BUCKETS, len(self.bias)))
        out[self.index] = self.weights
        return out


def fit(sets: list[np.ndarray], y: np.ndarray, steps: int = STEPS, penalty: float = 2e-4, least: int = LEAST_COUNT) -> Classifier:
    """Logistic regression by Adam over all rows. y: (rows, targets) of 0, 1 or NaN.

    Measures count fourfold and hashed features by the size of their naive Bayes log ratio,
    so that few strong ones lead.
    """
    k = y.shape[1]
    empty = Classifier(np.zeros(0, np.int64), np.zeros((0, k)), np.full(k, -30.0), np.zeros(k))
    if not len(sets):
        return empty
    flat = np.concatenate(sets)
    index = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) >= min(least, len(sets)))
    place = np.full(BUCKETS, -1, np.int32)
    place[index] = np.arange(len(index))
    col = place[flat]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[col >= 0]
    col = col[col >= 0]
    weights, biases, priors = np.zeros((len(index), k)), np.full(k, -30.0), np.zeros(k)
    for t in range(k):
        known = ~np.isnan(y[:, t])
        if not known.any() or not (y[known, t] > 0).any():
            continue
        target, use = np.where(known, y[:, t], 0), known / known.sum()
        prior = float(np.clip(target[known].mean(), 1e-4, 1 - 1e-4))
        seen = [np.bincount(col, (known & (target == side))[row], minlength=len(index)) + 1 for side in (1, 0)]
        ratio = np.log(seen[0] / (target[known].sum() + 2)) - np.log(seen[1] / ((1 - target[known]).sum() + 2))
        scale = np.where(index < SHAPES, 4.0, np.abs(ratio))
        value = scale[col]
        w, b = 0.02 * np.sign(ratio), math.log(prior / (1 - prior))
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):
            z = np.bincount(row, w[col] * value, minlength=len(sets)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * use
            grad, gb = np.bincount(col, g[row] * value, minlength=len(index)) + penalty * w, g.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
            a, c = 1 - 0.9**step, 1 - 0.99**step
            w = w - 0.05 * (m / a) / (np.sqrt(v / c) + 1e-7)
            b = b - 0.05 * (mb / a) / (math.sqrt(vb / c) + 1e-7)
        weights[:, t], biases[t], priors[t] = w * scale, b, prior
    return Classifier(index, weights, biases, priors)


_SLICE = 500


def _featured(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    rows = df.select(*keep, F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            sets = [features(t.as_py(), known).tobytes() for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most `rows` labelled rows. labels: doc_id, quality, toxic.

    A hash limit under which about that many labels are leaves few rows to featurize; the
    driver gets the first `rows` of them by hash, however often an id repeats.
    """
    marked = labels.select(F.col("doc_id").alias("label_id"), "quality", "toxic", F.abs(F.shiftright(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), 1)).alias("h")).filter("label_id is not null")
    total = marked.count()
    chosen = marked.filter(F.col("h") < int(min(1.0, rows / max(1, total)) * 2**62))
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, F.col("doc_id") == F.col("label_id"))
    found = _featured(joined, "text", ["doc_id", "h", "quality", "toxic"])
    got = found.orderBy("h", "doc_id", F.xxhash64("features"), "quality", "toxic").limit(rows).collect()
    sets = [np.frombuffer(bytes(r["features"]), np.int32) for r in got]
    y = np.array([[math.nan if r["quality"] is None else float(r["quality"] == 0), math.nan if r["toxic"] is None else float(r["toxic"] == 1)] for r in got]).reshape(-1, 2)
    del got
    return fit(sets, y)


def evidence(docs: DataFrame, model: Classifier, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` as the struct `row`, and the classifier's log odds of each target. The text
    is sent to Python once."""
    carried = list(dict.fromkeys([*keep, text]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"))
    wanted = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")).schema.fields
    schema = T.StructType([*wanted, *[T.StructField(f"z_{t}", T.DoubleType()) for t in TARGETS]])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, whole = carried.index(text), carried == list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, known = shared.value.dense(), Words()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                row = batch.column(0).slice(at, _SLICE)
                fields = row.flatten()
                z = shared.value.logits([features(t.as_py(), known) for t in fields[place]], dense)
                out = row if whole else pa.StructArray.from_arrays(fields[: len(keep)], names=list(keep))
                yield pa.RecordBatch.from_arrays([out, *[pa.array(z[:, i], pa.float64()) for i in range(len(TARGETS))]], names=schema.names)

    return rows.mapInArrow(run, schema)


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.ln(q / (1 - q))


def _strength(groups: DataFrame, n: str, total: str, prior: float) -> float:
    """Prior strength in documents, by moments: the spread between groups beyond what groups
    of their sizes would show by chance."""
    mean = F.col(total) / F.col(n)
    r = groups.filter(F.col(n) > 1).agg(F.avg((mean - prior) ** 2).alias("spread"), F.avg(F.lit(prior * (1 - prior)) / F.col(n)).alias("chance")).first()
    if r["spread"] is None:
        return 100.0
    between = max(r["spread"] - r["chance"], 1e-9)
    return float(min(1e6, max(2.0, prior * (1 - prior) / between - 1)))


#: Units of a probability in sums.
_UNIT = 1e12


def _total(p: Column) -> Column:
    return F.sum(F.round(p * _UNIT).cast("decimal(20,0)"))


def scored_rows(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, p_bad, p_toxic, site priors, keep) of every document, row being a struct of the columns `keep`."""
    model = train(docs, labels, doc_id, text)
    h, p = free_name(docs, "site_host"), free_name(docs, "site_path")
    sited = docs.withColumn(h, F.coalesce(host.cast("string"), F.lit("\0"))).withColumn(p, F.coalesce(path.cast("string"), F.lit("\0")))
    found = evidence(sited, model, text, [*keep, h, p])
    kept = F.struct(*[F.col("row")[c].alias(c) for c in keep])
    scored = written(found.select(kept.alias("row"), F.col("row")[h].alias("host"), F.col("row")[p].alias("path"), *[f"z_{t}" for t in TARGETS]))
    share = {t: 1 / (1 + F.exp(-F.col(f"z_{t}"))) for t in TARGETS}
    by_path = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n_path"), *[_total(share[t]).alias(f"path_{t}") for t in TARGETS]))
    by_host = by_path.groupBy("host").agg(F.sum("n_path").alias("n_host"), *[F.sum(f"path_{t}").alias(f"host_{t}") for t in TARGETS])
    sites = by_path.join(by_host, "host")
    sites = written(sites.select("host", "path", "n_path", "n_host", *[(F.col(f"{k}_{t}").cast("double") / _UNIT).alias(f"{k}_{t}") for k in ("path", "host") for t in TARGETS]))
    hosts = sites.groupBy("host").agg(F.first("n_host").alias("n_host"), *[F.first(f"host_{t}").alias(f"host_{t}") for t in TARGETS])
    total = by_path.agg(F.sum("n_path").alias("n"), *[F.sum(f"path_{t}").cast("double").alias(t) for t in TARGETS]).first()
    out = joined_by_site(scored, sites, ["host", "path"], "n_path")
    for i, t in enumerate(TARGETS):
        prior = min(1 - 1e-6, max(1e-6, (total[t] or 0.0) / _UNIT / (total["n"] or 1)))
        k_host, k_path = _strength(hosts, "n_host", f"host_{t}", prior), _strength(sites, "n_path", f"path_{t}", prior)
        theta_host = (F.col(f"host_{t}") - share[t] + k_host * prior) / (F.col("n_host") - 1 + k_host)
        theta_path = (F.col(f"path_{t}") - share[t] + k_path * theta_host) / (F.col("n_path") - 1 + k_path)
        z = F.col(f"z_{t}") + _logit(theta_path) - _logit(F.lit(prior))
        out = out.withColumn(f"site_{t}", theta_path).withColumn(f"p_{t}", F.lit(0.0) if model.prior[i] == 0 else 1 / (1 + F.exp(-z)))
    return out.select("row", *[f"p_{t}" for t in TARGETS], *[f"site_{t}" for t in TARGETS], ((F.col("p_bad") < 0.5) & (F.col("p_toxic") < 0.5)).alias("keep"))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_bad, p_toxic, site priors, keep) of every document."""
    out = scored_rows(docs, labels, host, path, [doc_id], doc_id, text)
    return out.select(F.col("row")[doc_id].alias("doc_id"), *out.columns[1:])


def good_rows(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows of low quality or toxic; each row is judged for itself."""
    return scored_rows(docs, labels, host, path, docs.columns, doc_id, text).filter("keep").select("row.*")


def url_host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def url_path(url: Column) -> Column:
    """Host and first path segment of a URL."""
    return F.concat_ws("/", url_host(url), F.get(F.split(F.parse_url(url, F.lit("PATH")), "/"), 1))
