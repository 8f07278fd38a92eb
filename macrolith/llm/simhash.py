"""SimHash near-duplicates with keys from the binary Golay code.

A 64-bit fingerprint is made of the XXH64 (seed 42) of its word shingles. Two
fingerprints link at ``3`` or fewer differing bits. They are cut into four
segments of 16 bits. Of three errors over four segments, some segment i is free
of errors while its successor i + 1 has at most one: were that false, each
errorless segment would stand before a segment with two errors or more, and
three errors leave room for only one such segment, yet at least one errorless
segment more. So the four keys (segment i exact, segment i + 1 up to one error)
meet every pair.

"Up to one error" is the Golay part: the (23, 12) code is perfect, each word
lies within three bits of exactly one codeword. A segment, padded to 23 bits,
is decoded together with all its one-bit neighbours; the indices met (1 or at
most 6) are its keys. Two segments one bit apart share an index, since each
decodes the other. Keys have 16 + 12 bits.

Fingerprints are made distinct first, so exact copies cost one row. Within a
bucket of one key a breadth-first search over Hamming distances keeps only a
spanning forest of the links, at most one row a member: all pairs are never
emitted. A bucket with more than ``BLOCK`` members is cut into blocks by a hash
and each pair of blocks is searched by its own task, so no bucket is gathered
in one place and no link is lost.

Edge cases: no words (null, empty, white space): fingerprint zero, linked as
any other; fewer words than a shingle: the whole sequence is the one shingle;
equal texts have equal fingerprints; repeated rows come out as often as they go
in; an empty table gives an empty result. Null doc_ids count as larger than any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, only, shared_root, stored
from .components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Members of a bucket that one task searches at once.
BLOCK = 2048
#: Generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011

_UPPER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []
    if not words:
        return 0
    n = len(words)
    row = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = np.array([h(row, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([h(row[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        count += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def _remainder(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k in range(22, 10, -1):
        x ^= ((x >> k) & 1) * (GOLAY << (k - 11))
    return x


def golay_table() -> np.ndarray:
    """Index of the one codeword within three bits, for each of the 2^23 words; by syndromes."""
    flips = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)] + [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
    flips = np.array(flips, np.int64)
    leader = np.zeros(1 << 11, np.int64)
    leader[_remainder(flips)] = flips
    return leader


def segment_keys(bits: int = SEGMENT_BITS) -> list[np.ndarray]:
    """For each word of a segment the codeword indices of itself and its one-bit neighbours."""
    leader = golay_table()
    x = np.arange(1 << bits, dtype=np.int64)
    index = (x ^ leader[_remainder(x)]) >> 11
    near = np.stack([index, *[index[x ^ (1 << b)] for b in range(bits)]], axis=1)
    near.sort(axis=1)
    first = np.concatenate((np.ones((len(x), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
    return [row[f] for row, f in zip(near, first, strict=True)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    near = segment_keys()
    size = np.array([len(k) for k in near])
    flat, at = np.concatenate(near), np.concatenate(([0], np.cumsum(size)))
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        seg = fp.astype("<i8").view("<u2").reshape(-1, 4).astype(np.int64)
        keys, own = [], []
        for i in range(SEGMENTS):
            s = seg[:, (i + 1) % SEGMENTS]
            n = size[s]
            begin = np.repeat(at[s] - (np.cumsum(n) - n), n)
            index = flat[begin + np.arange(n.sum())]
            rows = np.repeat(np.arange(len(fp)), n)
            keys.append(i << 28 | seg[rows, i] << 12 | index)
            own.append(fp[rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(own))], ["key", "fp"])


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect whatever is within the distance of one another: breadth-first, each found member once."""
    x = fps.astype(np.int64).view(np.uint64)
    out, left = [], np.arange(len(x))
    while len(left) > 1:
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(x[left] ^ x[a]) <= distance
            if near.any():
                found = left[near]
                out += [(int(fps[a]), int(fps[b])) for b in found]
                queue += found.tolist()
                left = left[~near]
    return out


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links of distinct fingerprints (column fp) that connect exactly what is within the distance (3 at most)."""
    if distance > 3:
        raise ValueError("four segments meet pairs of at most three differing bits")
    keyed = stored(by_batch(fps.select("fp"), _keys, "key long, fp long"), "keys")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(counts, "key")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket here has at most 2 * block members."""
        now, held = None, []

        def flush() -> tuple[list, list]:
            f = forest(np.array(held, np.int64), distance)
            return [p[0] for p in f], [p[1] for p in f]

        for b in batches:
            a_out, b_out = [], []
            for k, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if len(held) > 1:
                        x, y = flush()
                        a_out += x
                        b_out += y
                    now, held = k, []
                held.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
        if len(held) > 1:
            x, y = flush()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    # Blocks of a large bucket: member m of block i goes to each pair of blocks that has i.
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("fp"), blocks)
    pair = F.when(blocks == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j)))
    tasks = shared.select("key", "fp", F.explode(pair).alias("pair")).select(F.xxhash64("key", "pair").alias("task"), "key", "pair", "fp")
    dealt = tasks.repartition(F.col("task")).sortWithinPartitions("key", "pair").select(F.struct("key", "pair").alias("bucket"), "fp")
    return dealt.select(F.concat_ws(",", "bucket.key", "bucket.pair").alias("bucket"), "fp").mapInArrow(within, "a long, b long")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, text_hash: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), with text_hash also the text's XXH64."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    cols = ["doc_id", "text"]
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long"
    if text_hash:
        rows, cols, kind = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), [*cols, "text_hash"], kind + ", text_hash long"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *cols[2:]])

    return by_batch(rows, go, kind)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE, text_hash: bool = False) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    With text_hash also text_hash and root, a fingerprint that names the
    component even where several components have rows of the same doc_id.
    """
    shared_root(docs.sparkSession)
    own = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed, text_hash=text_hash), "fingerprints")
    distinct = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, distance))
    grouped = distinct.join(roots, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(grouped.join(least, "root").select("fp", "component_id", "root"), "components")
    more = ["text_hash", "root"] if text_hash else []
    return own.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, in all their columns, one of each component: the row of the smallest doc_id, then of the smallest text hash; of fully equal rows one."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, text_hash=True, **options)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_hash").alias("h"))).alias("k")).select(F.col("k.doc_id").alias("_keep_id"), F.col("k.h").alias("_keep_hash"))
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    keyed = inner.withColumns({"_i": F.col(i), "_h": F.xxhash64(t)})
    kept = keyed.join(stay, (F.col("_i").eqNullSafe(F.col("_keep_id"))) & (F.col("_h") == F.col("_keep_hash")), "left_semi")
    return kept.dropDuplicates(["_i", "_h"]).drop("_i", "_h").toDF(*names)
