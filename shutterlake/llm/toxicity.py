"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import forget, read, stored
from shutterlake.llm.kernels import LETTERS, combined, groups, text_bytes, words
from shutterlake.llm.language import held_out

#: log2 of the feature space; the most training documents and the most features of all of them (documented bounds).
BITS, TRAINING_ROWS, TRAINING_FEATURES = 20, 12288, 1 << 25
#: Distances between a feature's words: single words, pairs, and pairs that skip one word.
GRAMS = ((0,), (0, 1), (0, 2))


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the optimiser: per-coordinate rates from alpha and beta, sparsity from l1."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 4


@dataclass
class Weights:
    """The compact model: sorted indices of the features with a weight, their weights, the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def lookup(self, bits: int) -> np.ndarray:
        """The weight of every feature of the space, most of them 0."""
        out = np.zeros(1 << bits)
        out[self.index] = self.value
        return out


def row_features(column: pa.Array, bits: int = BITS, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: each row's distinct hashed features, and the bounds of the rows among them.

    Given flags of the `wanted` features, others are dropped before those of a row are made distinct.
    """
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in groups(offsets):
        hashes, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], LETTERS)
        row = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(at))
        keys = []
        for gaps in GRAMS:
            h = combined(hashes, gaps) >> np.uint64(64 - bits)
            n = len(h)
            here = row[:n] == row[max(gaps) : max(gaps) + n] if wanted is None else np.flatnonzero(wanted[h.astype(np.int64)])
            if wanted is not None:
                here = here[row[here] == row[here + max(gaps)]]
            keys.append((row[:n][here] << np.uint64(bits)) | h[here])
        keys = np.unique(np.concatenate(keys))
        bounds = np.searchsorted(keys, np.arange(b - a + 1, dtype=np.uint64) << np.uint64(bits))
        yield (keys & np.uint64((1 << bits) - 1)).astype(np.int64), bounds


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, p: Ftrl = Ftrl()) -> Weights:
    """FTRL-proximal over the rows, in their order, for some epochs; the bias is a coordinate without l1."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(p.epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= p.l1, 0.0, (np.sign(zi) * p.l1 - zi) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            wb = -zb / ((p.beta + np.sqrt(nb)) / p.alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[x] += g - sigma * w
            n[x] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    index = np.flatnonzero(w)
    return Weights(index, w[index], float(-zb / ((p.beta + np.sqrt(nb)) / p.alpha)))


_FEATURES = "doc_id long, n long, x binary"


def _extracted(bits: int):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f[a:b].astype(np.int32) for f, bounds in row_features(batch.column("text"), bits) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, rows), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "n", "x"])

    return extract


def train(docs: DataFrame, labels: DataFrame, may_learn: F.Column, bits: int = BITS, most_rows: int = TRAINING_ROWS, most_features: int = TRAINING_FEATURES, p: Ftrl = Ftrl()) -> Weights:
    """Fits on docs(doc_id, text) with labels(doc_id, toxic), of which only rows that may be learned from count.

    The bound: the most_rows labelled documents whose hashed doc_id comes first, and of these in that order each that
    keeps their features within most_features. Null labels and ids don't count; of several labels of a document the
    largest does, of several texts the first in order. A text of any length is read whole. Without any labelled
    document the model is empty and every score one half.
    """
    spark = docs.sparkSession
    known = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    taken = {r.doc_id: (r.h, int(r.toxic)) for r in known.orderBy("h", "doc_id").limit(most_rows).collect()}
    if not taken:
        return Weights(np.empty(0, np.int64), np.empty(0), 0.0)
    ids = spark.createDataFrame([(i,) for i in taken], "doc_id long")  # at most most_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    kept = stored(rows.mapInArrow(_extracted(bits), _FEATURES), "toxicity")
    total, chosen = 0, []
    for r in sorted(kept.select("doc_id", "n").collect(), key=lambda r: (taken[r.doc_id][0], r.doc_id)):
        if total + r.n <= most_features:
            total += r.n
            chosen.append((r.doc_id,))
    got = kept.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi").collect()
    forget(kept)
    got = sorted(got, key=lambda r: (taken[r.doc_id][0], r.doc_id))
    return fit([np.frombuffer(r.x, np.int32) for r in got], np.array([taken[r.doc_id][1] for r in got], float), bits, p)


_SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _scored(model: Weights, bits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.lookup(bits)
        wanted = weight != 0
        for batch in batches:
            margins = []
            for features, bounds in row_features(batch.column("text"), bits, wanted):
                total = np.concatenate([[0.0], np.cumsum(weight[features])])
                margins.append(total[bounds[1:]] - total[bounds[:-1]] + model.bias)
            s = 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(margins) if margins else np.empty(0), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return score


def score(docs: DataFrame, model: Weights, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of docs(doc_id, held_out, text), one row for each of its rows.

    Null and empty texts, and those without letters, score as the bias alone; a text of any length is read whole.
    Repeated rows score the same; an empty table gives no rows. Extra columns are dropped.
    """
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scored(model, bits), _SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the toxicity of every document, learned without labels of those whose crc32(doc_id) is divisible by 5."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rest = held_out("doc_id", 5, 0)
    return score(docs.withColumn("held_out", rest), train(docs, labels, ~rest))
