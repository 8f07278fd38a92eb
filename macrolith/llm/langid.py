"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A text is
encoded with every dictionary and belongs to the one that makes it smallest.
Long texts are cut into blocks of ``BLOCK`` bytes that are each encoded afresh,
all of them, so that the dictionary counts throughout and memory stays bounded.
A text is encoded in as many rotations of its words as make up ``LEAST`` bytes
(``TURNS`` at most, one from there on), as the size of one encoding is coarse.
The margin is 1 - smallest size / second smallest size; a text whose margin is
under the limit is rejected. Sizes are whole bytes, which tie now and then and
then say nothing; so languages within ``MARGIN`` of the smallest are measured
again in fractions of a bit, by how an arithmetic coder would encode the text
with the dictionary's contexts of up to ``ORDER`` bytes, and that tells the
language and the margin. What ties even so goes to the language first in name
order.

Dictionaries hold up to ``DICTIONARY`` bytes a language, from the ``SALTS``
documents that have the smallest hash in their share of the hashes: a bounded
sample of the labelled rows, found by a scan of ids and languages alone; of each
a stretch of ``PIECE`` bytes that begins at a place told by its hash. Rows
that share a doc_id (or have none) and a language count as one in it, by their
smallest text.

Edge cases: null texts and texts without a letter (category L; numerals are
none) get ``und`` with score 0; null languages and null texts are not learned
from; without any labelled row all is ``und``; with one language the score is
1; repeated rows get equal results; very long texts are encoded block by block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, keep_rows, only

DICTIONARY, SALTS, BLOCK, LEVEL = 110 << 10, 128, 4 << 10, 6
#: Bytes of a stretch of one sampled document that a dictionary takes at most.
PIECE = 1 << 10
#: Shares of the smallest size under which a margin counts as narrow.
MARGIN = 0.001
#: Bytes that the rotations of a text make up, and the most rotations.
LEAST, TURNS = 2 << 10, 8
#: Bytes of context in the finer measure.
ORDER = 4
_LETTER = regex.compile(r"\p{L}")


class Contexts:
    """Bits of a text after a sample: contexts of 0 to ORDER bytes, each blended with the next shorter by its number of different followers."""

    def __init__(self, sample: bytes, order: int = ORDER):
        self.order = order
        self.grams = [Counter(sample[a : a + k + 1] for a in range(len(sample) - k)) for k in range(order + 1)]
        self.seen, self.kinds = [], []
        for grams in self.grams:
            seen: Counter[bytes] = Counter()
            for g, n in grams.items():
                seen[g[:-1]] += n
            self.seen.append(seen)
            self.kinds.append(Counter(g[:-1] for g in grams))

    def bits(self, raw: bytes) -> float:
        raw, total = b"\n" + raw, 0.0
        for at in range(1, len(raw)):
            p = 1 / 256
            for k in range(min(at, self.order) + 1):
                before = raw[at - k : at]
                if not (t := self.kinds[k][before]):
                    break
                p = (self.grams[k][raw[at - k : at + 1]] + t * p) / (self.seen[k][before] + t)
            total -= math.log2(p)
        return total


class Model:
    """Picklable: language names and dictionary bytes."""

    def __init__(self, samples: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.samples, self.level, self.block = dict(sorted(samples.items())), level, block
        self._packers, self._contexts = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_packers": None, "_contexts": {}}

    def bits(self, name: str, raw: bytes) -> float:
        if name not in self._contexts:
            self._contexts[name] = Contexts(self.samples[name])
        return self._contexts[name].bits(raw)

    def sizes(self, raw: bytes) -> list[int]:
        if self._packers is None:
            self._packers = []
            for s in self.samples.values():
                d = zstandard.ZstdCompressionDict(s, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._packers.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False, write_content_size=False).compress)
        parts = [raw[a : a + self.block] for a in range(0, len(raw), self.block)]
        turns = min(TURNS, -(-LEAST // max(1, len(raw))))
        if turns > 1:
            w = raw.split()
            parts = [b" ".join(w[k:] + w[:k]) for k in sorted({len(w) * t // turns for t in range(turns)})]
        return [sum([len(f(p)) for p in parts]) for f in self._packers]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        if not text or not self.samples or not _LETTER.search(text):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")
        sizes = self.sizes(raw)
        best = min(sizes)
        near = [name for name, x in zip(self.samples, sizes, strict=True) if 1 - best / x < MARGIN]
        if len(near) > 1:
            order = sorted((self.bits(name, raw), name) for name in near)
            return order[0][1], 1 - order[0][0] / order[1][0]
        k = sizes.index(best)
        rest = sizes[:k] + sizes[k + 1 :]
        return list(self.samples)[k], (1 - best / min(rest)) if rest else 1.0


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dictionary: int = DICTIONARY, salts: int = SALTS, piece: int = PIECE, block: int = BLOCK) -> Model:
    """Learns from documents with a language; filter them before to hold some out."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null").withColumn("h", F.xxhash64("id", "lang"))
    # Text of some length only, which the second scan checks; so thresholds take the first two of each share.
    share = F.pmod(F.shiftright("h", 7), F.lit(salts))
    cuts = rows.where("text is not null").groupBy("lang", share.alias("salt")).agg(F.min("h").alias("h"))
    picked = [r.h for r in cuts.select("h").collect()]  # languages times salts
    if not picked:
        return Model({}, block=block)
    # One row a hash, so that what comes to the driver is bounded whatever repeats.
    begin = (F.pmod(F.shiftright("h", 14), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1).cast("int")
    got = rows.where(F.col("h").isin(picked)).select("lang", "h", F.substring(F.col("text"), begin, F.lit(piece)).alias("text")).where("text is not null").groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    samples: dict[str, bytes] = {}
    for r in sorted(got, key=lambda r: (r.lang, -len(r.text), r.h)):
        had = samples.get(r.lang, b"")
        own = r.text.lower().encode("utf-8", "surrogatepass")[:piece].decode("utf-8", "ignore").encode()
        if len(had) < dictionary:
            samples[r.lang] = had + own + b"\n"
    return Model({k: v[:dictionary] for k, v in samples.items()}, block=block)


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Per document row: doc_id, lang_pred, score (the margin, 0 to 1), rejected (und, or a margin under the limit)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in p], pa.string()), pa.array([x[1] for x in p], pa.float64()), pa.array([x[0] == "und" or x[1] < margin for x in p], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def with_language(docs: DataFrame, model: Model, *, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The documents, in all their columns, whose language is told by more than a narrow margin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge():
        m = shared.value
        return lambda texts: [p[0] != "und" and p[1] >= margin for p in map(m.predict, texts)]

    return keep_rows(docs, judge, text)
