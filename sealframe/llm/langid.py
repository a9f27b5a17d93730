"""Language identification with a blended-spectrum string kernel.

A text's features are its distinct character n-grams of lengths 1 to 3, after lower-casing and
with every run of other characters than letters and their marks as one space. The kernel of two texts is the
number of n-grams they share over the root of the product of their numbers. Landmark texts
give the Nyström map, and one-versus-rest ridge regression is solved in it; texts are scored
in batches, as products of their presence matrix with the landmarks'.

The model is fitted on a bounded, fixed sample: the PER_LABEL training texts with letters of each language
with the smallest hashes, of the LABELS most frequent languages, and LANDMARKS of them as landmarks,
dealt evenly over languages.

Cases: a text that is null or has no letter (Unicode's L) is `und` with score 0; labels that are null, and
texts without letters, are not learned from; without any label all is `und`; repeated rows
count; null ids are never held out nor learned from; of equal scores the first label by code point
wins; an empty table gives an empty result; texts are read whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_LABEL = 300
LANDMARKS = 128
RIDGE = 0.3
SHARPNESS = 6.0
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Languages that are learned.
LABELS = 256
_BATCH = 64


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct n-grams of a text, as 64-bit numbers of up to three code points;
    empty if it has no letter."""
    s = _OTHER.sub(" ", (text or "").lower()).strip()
    if not _LETTER.search(s):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {s} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    two = c[:-1] << 21 | c[1:]
    return np.unique(np.concatenate([c, two, two[:-1] << 21 | c[2:]]))


@dataclass
class Model:
    labels: list[str]
    vocabulary: np.ndarray
    #: Presence of each vocabulary n-gram in each landmark, and the roots of landmark sizes.
    landmarks: np.ndarray
    roots: np.ndarray
    #: Coefficients of the kernel with each landmark, and a constant, for each label.
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Kernel of texts with the landmarks; table: landmarks as float32."""
        present = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for i, s in enumerate(sets):
            at = np.searchsorted(self.vocabulary, s)
            at[at == len(self.vocabulary)] = 0
            present[i, at[self.vocabulary[at] == s]] = 1
        sizes = np.sqrt(np.array([max(1, len(s)) for s in sets], np.float64))
        return (present @ table).astype(np.float64) / sizes[:, None] / self.roots

    def scores(self, sets: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Probability of each label for each text."""
        m = SHARPNESS * (self.kernel(sets, table) @ self.weights + self.bias)
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on texts that all have letters; None without any."""
    if not texts:
        return None
    names = sorted(set(labels))
    sets = [grams(t) for t in texts]
    by_label = {n: [i for i, x in enumerate(labels) if x == n] for n in names}
    chosen: list[int] = []
    for k in range(max(map(len, by_label.values()))):
        chosen += [by_label[n][k] for n in names if k < len(by_label[n])]
    chosen = chosen[: max(landmarks, len(names))]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    table = np.zeros((len(vocabulary), len(chosen)), np.uint8)
    for j, i in enumerate(chosen):
        table[np.searchsorted(vocabulary, sets[i]), j] = 1
    roots = np.sqrt(table.sum(axis=0, dtype=np.float64))
    model = Model(names, vocabulary, table, roots, np.zeros((len(chosen), len(names))), np.zeros(len(names)))
    wide = table.astype(np.float32)
    k = np.concatenate([model.kernel(sets[a : a + _BATCH], wide) for a in range(0, len(sets), _BATCH)])
    values, vectors = np.linalg.eigh((lambda q: (q + q.T) / 2)(k[chosen]))
    inverse_root = vectors @ np.diag(np.where(values > 1e-6 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)) @ vectors.T
    x = np.column_stack([k @ inverse_root, np.ones(len(sets))])
    y = np.array([[1.0 if t == n else -1.0 for n in names] for t in labels])
    share = np.array([len(sets) / len(names) / len(by_label[t]) for t in labels])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(x.T @ (x * share[:, None]) + penalty, x.T @ (y * share[:, None]))
    model.weights, model.bias = inverse_root @ solved[:-1], solved[-1]
    return model


def sample(df: DataFrame, label: str, key: str, text: str, per_label: int = PER_LABEL) -> tuple[list[str], list[str]]:
    """(texts, labels): of each label the rows with the smallest hashes of key.

    Label counts set a hash limit under which about twice per_label rows are to be expected, so few
    texts are sorted; the driver gets per_label of a label, however often a key repeats.
    """
    lettered = df.select(F.col(label).alias("label"), F.col(text).alias("text"), F.abs(F.shiftright(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 1)).alias("h")).filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = lettered.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS).collect()
    if not counts:
        return [], []
    keep = F.lit(False)
    for name, n in ((r["label"], r["count"]) for r in counts):
        keep = keep | ((F.col("label") == name) & (F.col("h") <= int(min(1.0, (2 * per_label + 50) / n) * 2**62)))
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    rows = lettered.filter(keep).withColumn("n", first).filter(F.col("n") <= per_label).select("label", "text", "n").collect()
    rows.sort(key=lambda r: (r["label"], r["n"]))
    return [r["text"] for r in rows], [r["label"] for r in rows]


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), label_type: T.DataType = T.StringType()) -> DataFrame:
    """`keep`, lang_pred and score of every row."""
    rows = df.select(*keep, F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = m.landmarks.astype(np.float32) if m else None
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                b = batch.slice(at, _BATCH)
                sets = [grams(t.as_py()) for t in b.column(b.num_columns - 1)]
                if m:
                    p = m.scores(sets, table)
                    best = p.argmax(axis=1)
                    found = [(m.labels[j], float(q[j])) if len(s) else (UNKNOWN, 0.0) for s, q, j in zip(sets, p, best)]
                else:
                    found = [(UNKNOWN, 0.0)] * len(sets)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from rows where `train` holds, predict all."""
    texts, labels = sample(df.filter(train), label, doc_id, text)
    return predict(df, fit(texts, labels), text, keep)
