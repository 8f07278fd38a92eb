"""Near-duplicate embeddings by binary codes of random rotations (Gao and Long, 2024).

A unit vector o, padded to a power of two d, is turned by random rotations
(three rounds of random signs and a Hadamard transform each); the signs of its
coordinates are its codes. The first code, as the unit vector x = signs /
sqrt(d), is stored with its correction factor f = <x, o'>. For any unit vector
q, <x, q'> / f is an unbiased estimate of <o, q>; what it misses is at most
sqrt(1 - f^2) / f * sqrt(1 - <o, q>^2), and within ``CONFIDENCE`` / sqrt(d - 1)
of that but for a chance of some 1e-8. So a pair whose estimate lies below the
threshold by more than its confidence bound (from either side) is dropped, one
that the sure bound proves is taken, and every other one is computed again in
double precision from the vectors.

Candidates meet in buckets: a table's key is a run of code bits, and pairs at
the threshold share one of the tables' keys but for a chance of ``MISSED``. The
number of bits follows the largest label, so buckets keep about ``TARGET``
members; the number of tables follows from the bits. A pair is counted in the
first table that has it. Up to ``TARGET`` vectors a label all pairs are one
bucket and nothing can be missed.

Equal vectors of one label are one class with a weight, so copies are never
compared. A bucket over ``BLOCK`` is cut into blocks and each pair of blocks is
a task. A task hands on sums of weights and, for each member, the smallest
member that its links there reach: at most one row a member, never the pairs.
Distinct near copies of one group are compared with each other, as their
numbers of links ask for: 4 to 20 ns a pair.

Edge cases: null labels, null and zero vectors and those with null or
non-finite components link with nothing; vectors of different lengths don't
link; repeated rows are vectors of their own, with one class; a row with a null
vec_id counts, and its component has the smallest id that is not null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, only, shared_root, stored
from .components import components

THRESHOLD, CONFIDENCE, MISSED, SEED = 0.93, 6.0, 1e-6, 11
#: Members that a bucket has about, and members that one side of a task has at most about.
TARGET, BLOCK = 1024, 2048
#: Slack for estimates in single precision.
_SLACK = 1e-4
#: Cells of a block of estimates.
_CELLS = 1 << 20


def rotate(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """The rows of x (a power of two long) under random rotation number so and so."""
    n, d = x.shape
    for signs in np.random.default_rng([seed, number, d]).choice([-1.0, 1.0], (3, d)):
        x = x * signs
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def plan(largest: int, threshold: float = THRESHOLD, target: int = TARGET, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a key and number of tables for groups of so many vectors at most."""
    bits = max(0, math.ceil(math.log2(max(1, largest) / target)))
    if not bits:
        return 0, 1
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - same))


def codes(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors (padded): the first code's correction factors, and all code bits that the estimate and the keys need, packed."""
    d = x.shape[1]
    turned = [rotate(x, r, seed) for r in range(max(1, -(-bits * tables // d)))]
    return np.abs(turned[0]).sum(1) / math.sqrt(d), np.packbits(np.concatenate([t > 0 for t in turned], axis=1), axis=1)


def keys_of(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each vector's key in each table."""
    if not bits:
        return np.zeros((len(packed), tables), np.int64)
    runs = np.unpackbits(packed, axis=1)[:, : bits * tables].reshape(len(packed), tables, bits)
    return runs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def bounds(f: np.ndarray, d: int, threshold: float, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """For codes with these factors the least estimate that a link can have (but for a small chance), and the one from which a link is sure."""
    miss = np.sqrt(np.maximum(0, 1 - f * f)) / f
    wide = math.sqrt(1 - threshold * threshold)
    low = threshold - miss * min(1.0, confidence / math.sqrt(d - 1)) * wide - _SLACK
    # The largest estimate that a cosine below the threshold can have.
    high = np.where(threshold <= 1 / np.sqrt(1 + miss * miss), threshold + miss * wide, np.sqrt(1 + miss * miss)) + _SLACK
    return low, high


class Bucket:
    """Members of one bucket, or of two of its blocks: rows of vectors, factors, packed codes."""

    def __init__(self, raw: np.ndarray, factor: np.ndarray, packed: np.ndarray, table: int, bits: int, tables: int, threshold: float, confidence: float, seed: int):
        self.x, self.threshold = unit(raw), threshold
        d = padded(raw.shape[1])
        wide = np.zeros((len(raw), d))
        wide[:, : raw.shape[1]] = self.x
        self.turned = rotate(wide, 0, seed).astype(np.float32)
        self.signs = ((2.0 * np.unpackbits(packed[:, : d // 8], axis=1) - 1) / (math.sqrt(d) * factor[:, None])).astype(np.float32)
        self.low, self.high = (z.astype(np.float32) for z in bounds(factor, d, threshold, confidence))
        self.keys = keys_of(packed, bits, tables)[:, :table]
        #: Pairs seen, dropped by the estimate, taken as sure, computed again.
        self.seen = np.zeros(4, np.int64)

    def links(self, left: np.ndarray, right: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of left x right, or within left, that no earlier table has."""
        within = right is None
        right = left if within else right
        step = max(1, _CELLS // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            cols = right[at:] if within else right
            by_right, by_left = self.turned[rows] @ self.signs[cols].T, self.signs[rows] @ self.turned[cols].T
            may = (by_right >= self.low[cols]) & (by_left >= self.low[rows][:, None])
            if within:
                may &= np.arange(len(cols))[None] > np.arange(len(rows))[:, None]
            i, j = np.nonzero(may)
            sure = (by_right[i, j] >= self.high[cols[j]]) | (by_left[i, j] >= self.high[rows[i]])
            self.seen += (len(rows) * len(cols), len(rows) * len(cols) - len(i), int(sure.sum()), int((~sure).sum()))
            if len(i) > may.size // 16:
                cosine = (self.x[rows] @ self.x[cols].T)[i, j]
                yield self._new(rows[i], cols[j], sure | (cosine >= self.threshold))
                continue
            part = max(1, _CELLS // self.x.shape[1])
            for k in range(0, len(i), part):
                a, b = rows[i[k : k + part]], cols[j[k : k + part]]
                yield self._new(a, b, sure[k : k + part] | (np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.threshold))

    def _new(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = a[linked], b[linked]
        old = np.zeros(len(a), bool)
        for t in range(self.keys.shape[1]):
            old |= self.keys[a, t] == self.keys[b, t]
        return a[~old], b[~old]


def reached(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the smallest that the pairs link it with."""
    least = np.arange(n)
    while True:
        before = least.copy()
        for a, b in pairs:
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def _usable(label: str, embedding: str):
    ok = F.col(label).isNotNull() & F.col(embedding).isNotNull()
    finite = F.forall(embedding, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(ok & finite & F.exists(embedding, lambda v: F.coalesce(v != 0, F.lit(False))), F.lit(False))


def class_links(classes: DataFrame, *, threshold: float = THRESHOLD, target: int = TARGET, block: int = BLOCK, missed: float = MISSED, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """cid, links, root of (cid, label, weight, embedding): sums of linked weights by bucket, and a smaller class that it is linked with, directly or not."""
    most = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(most, threshold, target, missed)
    label = classes.schema["label"].dataType.simpleString()
    # Vectors travel as they are stored, single or double.
    kind = "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column("embedding")
            lengths = np.diff(values.offsets.to_numpy())
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for at in range(0, len(rows), max(1, _CELLS // padded(dim))):
                    own = rows[at : at + max(1, _CELLS // padded(dim))]
                    x = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                    wide = np.zeros((len(own), padded(dim)))
                    wide[:, :dim] = unit(x.astype("<f8"))
                    factor, packed = codes(wide, bits, tables, seed)
                    keys = keys_of(packed, bits, tables)
                    blob = np.concatenate([x.view(np.uint8).reshape(len(own), -1), factor.astype("<f8").view(np.uint8).reshape(-1, 8), packed], axis=1)
                    blobs = pa.array([r.tobytes() for r in blob], pa.binary())
                    part = b.take(pa.array(own))
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.full(len(own), dim), pa.int32()), pa.array(np.full(len(own), t), pa.int32()), pa.array(keys[:, t]), part.column("cid"), part.column("weight"), blobs], ["label", "dim", "tab", "key", "cid", "weight", "blob"])

    rows = by_batch(classes.select("cid", "label", "weight", "embedding"), keyed, f"label {label}, dim int, tab int, key long, cid long, weight long, blob binary")
    bucket = ["label", "dim", "tab", "key"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    met = rows.join(counts, bucket).select(*bucket, "cid", "weight", "blob", own.alias("own"), F.explode(pairs).alias("pair"))
    dealt = met.select(F.struct(*bucket, "pair").alias("bucket"), "own", "cid", "weight", "blob").repartition("bucket").sortWithinPartitions("bucket", "cid")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(at: dict, owns: list[int], cids: list[int], weights: list[int], blobs: list[bytes]) -> tuple[list, list, list]:
            dim, table = at["dim"], at["tab"]
            blob = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
            cut = int(kind[-1]) * dim
            read = lambda part, kind: np.ascontiguousarray(part).view(kind).astype("<f8")
            b = Bucket(read(blob[:, :cut], kind), read(blob[:, cut : cut + 8], "<f8")[:, 0], blob[:, cut + 8 :], table, bits, tables, threshold, confidence, seed)
            side, w = np.array(owns), np.array(weights, np.int64)
            x, y = at["pair"]["x"], at["pair"]["y"]
            pairs = list(b.links(np.flatnonzero(side == x), None if x == y else np.flatnonzero(side == y)))
            links = np.zeros(len(w), np.int64)
            for p, q in pairs:
                np.add.at(links, p, w[q])
                np.add.at(links, q, w[p])
            some = np.flatnonzero(links)
            least = reached(len(w), pairs)
            cid = np.array(cids, np.int64)
            return cid[some], links[some], cid[least[some]]

        def made(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts] or [[]]).astype(np.int64)) for k in range(3)], ["cid", "links", "root"])

        now, held = None, ([], [], [], [])
        for b in batches:
            parts = []
            for at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != now:
                    if len(held[0]) > 1:
                        parts.append(found(now, *held))
                    now, held = at, ([], [], [], [])
                for h, v in zip(held, row, strict=True):
                    h.append(v)
            yield made(parts)
        if len(held[0]) > 1:
            yield made([found(now, *held)])

    return by_batch(dealt, judged, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", **options) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id that links reach), kept (it is the row's own)."""
    shared_root(vectors.sparkSession)
    rows = only(vectors, vec_id, label, embedding).toDF("vec_id", "label", "embedding").withColumn("usable", _usable("label", "embedding"))
    equal = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(equal.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = stored(class_links(classes, **options), "links")
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("cid", "least").join(roots, F.col("cid") == F.col("vertex")).select("cid", "least", "root")
    least = grouped.groupBy("root").agg(F.min("least").alias("component"))
    component = grouped.join(least, "root").select("cid", "component")
    told = stored(classes.join(sums, "cid", "left").join(component, "cid", "left").select("label", "embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id")), "components")
    linked = rows.where("usable").join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def one_of_each(vectors: DataFrame, *, vec_id: str = "vec_id", **options) -> DataFrame:
    """The rows, in all their columns, whose vec_id is its component's smallest; ids that repeat stay as often as they occur."""
    kept = near_duplicates(vectors, vec_id=vec_id, **options).where("kept").select(F.col("vec_id").alias("_kept")).distinct()
    names = vectors.columns
    inner = vectors.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(vec_id)}"
    return inner.join(kept, F.col(own).eqNullSafe(F.col("_kept")), "left_semi").toDF(*names)
