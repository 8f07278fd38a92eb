"""Toxicity severity by cumulative-link ordinal regression over hashed word features.

P(y <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all
thresholds, which are kept in order by construction. x marks the distinct words
of the whole text and their first ``STEM`` bytes, hashed to ``BITS`` bits. The severity is the expected grade.
Grades are whatever integers the label column has (0 and 1 where it is a flag).

The model is fitted on a bounded sample of labelled documents: the ``SAMPLE``
labelled doc_ids of smallest hash, a bound that is a parameter. Scoring takes
every document.

Edge cases: a null or empty text has no words, its severity comes from the
thresholds alone; labels without a document and null labels are not learned
from, a doc_id with several labels counts with its largest and one with several
documents is learned from once, by its smallest text; rows without a doc_id are
scored but not learned from; with no labels, or one grade only, that grade (0
without any) is the severity of all; very long texts are a set of words too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, bounded_batches, keep_rows, only
from .decontaminate import words_of

BITS = 18
SAMPLE = 20_000
#: Words in fewer sampled documents than this get no weight.
LEAST_DOCS = 2
#: Standard errors by which a feature's grades must differ from all grades to get a weight.
SCREEN = 3.5
#: Bytes at the beginning of a longer word that are a feature besides the word, for forms not seen before.
STEM = 5
L2, STEPS, RATE = 2e-5, 250, 0.1


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted slots of the distinct words and of their beginnings."""
    mask = (1 << bits) - 1
    words = set(words_of(text))
    stems = {w[:STEM] for w in words if len(w) > STEM}
    return np.unique(np.array([zlib.crc32(w) & mask for w in words] + [zlib.crc32(w, 1) & mask for w in stems], np.int32))


class Ordinal:
    """Proportional-odds model over rows of active slots."""

    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = np.array(grades, float), weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: list[int], bits: int = BITS, l2: float = L2, steps: int = STEPS, rate: float = RATE, least_docs: int = LEAST_DOCS, screen: float = SCREEN) -> Ordinal:
        grades = sorted(set(y)) or [0]
        w = np.zeros(1 << bits)
        if len(grades) == 1:
            return cls(grades, w, np.zeros(0))
        k = np.searchsorted(grades, y)
        top = len(grades) - 1
        size = np.array([len(r) for r in rows])
        slot = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), size)
        # Screened by the score test of each feature alone, so that chance words don't crowd the model.
        count = np.bincount(slot, minlength=1 << bits)
        spread = np.sqrt(np.maximum(count * (1 - count / len(rows)), 1e-9)) * np.std(k)
        often = (count >= least_docs) & (np.abs(np.bincount(slot, (k - k.mean())[row], 1 << bits)) >= screen * spread)
        slot, row = slot[often[slot]], row[often[slot]]
        used, col = np.unique(slot, return_inverse=True)
        beta = np.zeros(len(used))
        share = np.clip(np.cumsum(np.bincount(k, minlength=top + 1))[:-1] / len(k), 1e-4, 1 - 1e-4)
        start = np.log(share / (1 - share))
        # First threshold free, the others by log gaps: always in order.
        free = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
        n = len(rows)
        both = np.concatenate((beta, free))
        m1, m2 = np.zeros_like(both), np.zeros_like(both)
        for step in range(1, steps + 1):
            beta, free = both[: len(used)], both[len(used) :]
            gap = np.exp(free[1:])
            theta = free[0] + np.concatenate(([0.0], np.cumsum(gap)))
            score = np.bincount(row, beta[col], n)
            edges = np.concatenate(([-np.inf], theta, [np.inf]))
            hi, lo = _sigmoid(edges[k + 1] - score), _sigmoid(edges[k] - score)
            p = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            d_score = (d_hi - d_lo) / n
            d_theta = np.array([(d_lo[k == j + 1].sum() - d_hi[k == j].sum()) / n for j in range(top)])
            d_free = np.concatenate(([d_theta.sum()], [d_theta[j + 1 :].sum() * gap[j] for j in range(top - 1)]))
            grad = np.concatenate((np.bincount(col, d_score[row], len(used)) + l2 * beta, d_free))
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad * grad
            both = both - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w[used] = both[: len(used)]
        free = both[len(used) :]
        return cls(grades, w, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:])))))

    def probabilities(self, slots: np.ndarray) -> np.ndarray:
        """Of each grade."""
        below = _sigmoid(self.thresholds - self.weights[slots].sum())
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> Ordinal:
    graded = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{grade}`").cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    # At most sample rows of two numbers: small enough to broadcast whatever the tables hold.
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = only(docs, doc_id, text).toDF("id", "text").join(F.broadcast(chosen), "id")
    # One row an id, so that the sample bounds what comes to the driver.
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t, bits) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["y", "slots"])

    bounded_batches(docs.sparkSession)
    got = rows.mapInArrow(go, "y int, slots array<int>").toArrow()
    slots = got.column("slots").combine_chunks()
    parts = np.split(slots.flatten().to_numpy(), np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(slots) else []
    return Ordinal.fit([p.astype(np.int64) for p in parts], got.column("y").to_pylist(), bits)


def severity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "toxic", cut: float = 0.5, model: Ordinal | None = None, **options) -> DataFrame:
    """Per document row: doc_id, severity (expected grade), grade (the likeliest), toxic (the chance of a grade above the lowest is over the cut)."""
    model = model or train(docs, labels, doc_id=doc_id, text=text, grade=grade, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    bits = int(np.log2(len(model.weights)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = [m.probabilities(features(t, bits)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(x @ m.grades) for x in p], pa.float64()), pa.array([int(m.grades[x.argmax()]) for x in p], pa.int32()), pa.array([_over(x, cut) for x in p], pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean")


def _over(p: np.ndarray, cut: float) -> bool:
    return len(p) > 1 and bool(1 - p[0] > cut)


def without_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", cut: float = 0.5, **options) -> DataFrame:
    """The documents, in all their columns, that aren't toxic."""
    model = train(docs, labels, text=text, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(np.log2(len(model.weights)))

    def judge():
        m = shared.value
        return lambda texts: [not _over(m.probabilities(features(t, bits)), cut) for t in texts]

    return keep_rows(docs, judge, text)
