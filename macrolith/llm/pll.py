"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts each token from the ``SIDE`` tokens before and after it:
one table of rows a position, summed and rectified, then a softmax over token
classes and one over the tokens of the class. The score of a document is the
sum of log P(token | both sides) over all its tokens.

Tokens are lower-cased words. All words of the corpus are counted exactly. The
most frequent ones are entries of the network; words beyond them share
``BUCKETS`` hashed entries, and P(word) there is P(entry | both sides) times
the word's share of its entry's count. The table of those words is as long as
the corpus has words, stays in the shared folder, and is joined with the words
of the documents.

Training is data-parallel and sees every token of every document. Documents are
dealt to shards of about ``SHARD`` words by a hash of their id and text, so a
text that many rows share is spread; a shard's documents, in the order of their
hashes, run through minibatch descent from the shared weights, and the mean of
the shards' weights, weighted by their words, starts the next round. What is
gathered is thus the counts of all words and one set of weights a shard, which
grow with the corpus. Weights are summed as whole numbers, and a document is
scored by itself, so scores do not depend on how rows lie in files or tasks.

Edge cases: each hashed entry holds one more count for all words that the
scorer never saw, spelled out byte by byte, so that they score below any word
seen; a null or empty text has no tokens and scores 0 with perplexity
null; sides beyond a document's ends are a boundary token; repeated rows get
equal scores; without any token the network stays as it starts; a very long
text is trained on and scored in steps of ``STEP`` words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import words_of_batch
from .common import bounded_batches, by_batch, only, stored

SIDE, HIDDEN, CLASSES = 2, 16, 32
BUCKETS = 64
ROUNDS, RATE, STEP = 1, 2.0, 4096
#: Words of one shard.
SHARD = 4_000_000
#: Weights are summed in units of one part in this many.
UNIT = 1 << 26
#: Words that a task's partial counts hold before they are handed on.
COUNTED = 200_000
#: The most frequent words whose counts the workers hold, at most; all others' counts are joined, with the same result.
KNOWN = 200_000
#: A byte of an unseen word: one of the 164 that words are made of, and whether it is the last.
SPELL = -float(np.log(2 * 164))


class Network:
    """Weights in one flat float32 vector."""

    def __init__(self, hidden: int = HIDDEN, classes: int = CLASSES, side: int = SIDE, seed: int = 7):
        self.hidden, self.classes, self.side = hidden, classes, side
        self.size = classes * classes
        v, h, c = self.size + 1, hidden, classes
        self.shapes = {"table": (2 * side * v, h), "bias": (h,), "to_class": (h, c), "class_bias": (c,), "shift": (c, h), "to_slot": (h, c), "slot_bias": (c, c)}
        rng = np.random.default_rng(seed)
        self.flat = np.concatenate([(rng.normal(0, 0.1, int(np.prod(s))) if len(s) == 2 and k != "slot_bias" else np.zeros(int(np.prod(s)))) for k, s in self.shapes.items()]).astype(np.float32)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in self.shapes.items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return out

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the table for the sides of each token; ids come with ``side`` boundary tokens at both ends."""
        n, s, v = len(ids) - 2 * self.side, self.side, self.size + 1
        return np.stack([ids[k : k + n] + v * j for j, k in enumerate([*range(s), *range(s + 1, 2 * s + 1)])], axis=1)

    def forward(self, w: dict[str, np.ndarray], rows: np.ndarray, target: np.ndarray):
        z = w["bias"] + w["table"][rows[:, 0]]
        for k in range(1, rows.shape[1]):
            z += w["table"][rows[:, k]]
        h = np.maximum(z, 0)
        c, t = target // self.classes, target % self.classes
        at = np.arange(len(target))
        a = h @ w["to_class"] + w["class_bias"]
        g = h + w["shift"][c]
        b = g @ w["to_slot"] + w["slot_bias"][c]
        logp = a[at, c] + b[at, t]
        a -= a.max(1, keepdims=True)
        b_top = b.max(1, keepdims=True)
        a_top = (logp - b[at, t] - a[at, c])[:, None]
        b -= b_top
        np.exp(a, out=a)
        np.exp(b, out=b)
        sa, sb = a.sum(1, keepdims=True), b.sum(1, keepdims=True)
        logp = logp - (a_top + np.log(sa) + b_top + np.log(sb))[:, 0]
        return logp, h, g, a / sa, b / sb, c, t

    def step(self, flat: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One minibatch of descent, in place."""
        w = self.parts(flat)
        _, h, g, a, b, c, t = self.forward(w, rows, target)
        n = len(target)
        at = np.arange(n)
        a[at, c] -= 1
        b[at, t] -= 1
        r = np.float32(rate / n)
        d_g = b @ w["to_slot"].T
        d_h = (a @ w["to_class"].T + d_g) * (h > 0)
        w["to_class"] -= r * (h.T @ a)
        w["class_bias"] -= r * a.sum(0)
        w["to_slot"] -= r * (g.T @ b)
        _sum_rows(w["slot_bias"], c, b, r)
        _sum_rows(w["shift"], c, d_g, r)
        w["bias"] -= r * d_h.sum(0)
        for k in range(rows.shape[1]):
            # A row's step is scaled up to the share of the batch that it is in.
            _sum_rows(w["table"], rows[:, k], d_h, r * 8)


def _sum_rows(table: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: np.float32) -> None:
    order = np.argsort(rows, kind="stable")
    r = rows[order]
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    table[r[first]] -= rate * np.add.reduceat(grad[order], first, axis=0)


def bucket(word: bytes) -> int:
    return (len(word) * 131 + word[0] * 31 + word[-1]) % BUCKETS


class Scorer:
    """Vocabulary and network; picklable without the table of counts (word, n), which only the driver needs."""

    def __init__(self, words: list[bytes], net: Network, counts: DataFrame | None = None, known: int = KNOWN):
        self.net, self.counts, base = net, counts, net.size - BUCKETS
        self.ids = {w: k for k, w in enumerate(words)}
        self.known, entry, own = dict(self.ids), list(range(len(words))), [0.0] * len(words)
        #: log of each hashed entry's count, with the one for words never seen.
        self.held = np.zeros(BUCKETS)
        if counts is not None:
            self.held = np.log(1.0 + _held(counts, self.ids))
            for w, n in _frequent(counts, known):
                if w not in self.known:
                    self.known[w] = len(entry)
                    entry.append(base + bucket(w))
                    own.append(float(np.log(n) - self.held[bucket(w)]))
        #: By number of a word in known: its entry, and log P(word | entry). The last is for words that are not in it.
        self.entry, self.own = np.array([*entry, 0], np.int64), np.array([*own, 0.0])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def entries(self, words: list[bytes]) -> np.ndarray:
        ids, base = self.ids, self.net.size - BUCKETS
        return np.array([ids[w] if w in ids else base + bucket(w) for w in words], np.int64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries; log P(word | entry), without the count of words that are not in known; where those are."""
        get, base = self.known.get, self.net.size - BUCKETS
        number = np.array([get(w, -1) for w in words], np.int64)
        entry, own, beyond = self.entry[number], self.own[number], np.flatnonzero(number < 0)
        entry[beyond] = [base + bucket(words[k]) for k in beyond.tolist()]
        own[beyond] = -self.held[entry[beyond] - base]
        return entry, own, beyond

    def sides(self, entries: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Rows of the table for the sides of each token, of texts of so many tokens one after another."""
        s, v = self.net.side, self.net.size + 1
        at = np.arange(len(entries)) + s * (1 + np.repeat(np.arange(len(count)), count))
        flat = np.full(len(entries) + s * (len(count) + 1), self.net.size, np.int64)
        flat[at] = entries
        return np.stack([flat[at + d] + v * j for j, d in enumerate([*range(-s, 0), *range(1, s + 1)])], axis=1)

    def logps(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        w = self.net.parts(self.net.flat)
        return np.concatenate([np.zeros(0, np.float32), *[self.net.forward(w, rows[a : a + STEP], target[a : a + STEP])[0] for a in range(0, len(target), STEP)]])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each word is in all documents."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches:
            index, words, _ = words_of_batch(b.column(0))
            for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
                held[w] += n
            if len(held) > COUNTED:
                yield out()
        yield out()

    return by_batch(only(docs, text), go, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _first(counts: DataFrame, size: int) -> list[bytes]:
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def vocabulary(docs: DataFrame, size: int, text: str = "text") -> list[bytes]:
    """The most frequent words of all documents; ties by the word."""
    return _first(word_counts(docs, text), size)


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words and counts above the least power of 2 ** 0.25 that at most so many words reach."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 4)
    cut, seen = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        seen += r.words
        if seen > most:
            break
        cut = r.level
    return [] if cut is None else [(bytes(r.word), r.n) for r in counts.where(level >= cut).collect()]


def _held(counts: DataFrame, ids: dict[bytes, int]) -> np.ndarray:
    """The count of each hashed entry."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * BUCKETS
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in ids:
                    total[bucket(w)] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(total, pa.int64())], ["entry", "n"])

    out = np.zeros(BUCKETS)
    for r in by_batch(only(counts, "word", "n"), go, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        out[r.entry] = r.n
    return out


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hidden: int = HIDDEN, classes: int = CLASSES, rounds: int = ROUNDS, rate: float = RATE, shard: int = SHARD) -> Scorer:
    spark = docs.sparkSession
    net = Network(hidden, classes)
    counts = stored(word_counts(docs, text), "words")
    scorer = Scorer(_first(counts, net.size - BUCKETS), net, counts)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return scorer
    shards = -(-total // shard)
    rows = only(docs, doc_id, text).toDF("doc_id", "text").where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    dealt = rows.repartitionById(shards, F.pmod("h", F.lit(shards)).cast("int")).sortWithinPartitions("h", "text").select("text")
    slices = np.array_split(np.arange(len(net.flat)), 16)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(scorer)

        def go(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            flat, seen = s.net.flat.copy(), 0
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def steps(last: bool) -> None:
                """Steps are cut by words alone, wherever batches end."""
                nonlocal seen
                rows, target = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = len(target) if last else len(target) // STEP * STEP
                for a in range(0, end, STEP):
                    t = target[a : min(a + STEP, end)]
                    s.net.step(flat, rows[a : a + len(t)], t, rate * len(t) / STEP)
                    seen += len(t)
                held[:] = [(rows[end:], target[end:])]

            for b in batches:
                index, words, begin = words_of_batch(b.column(0))
                target = s.entries(words)[index] if len(index) else np.zeros(0, np.int64)
                held.append((s.sides(target, np.diff(begin)), target))
                if sum(len(t) for _, t in held) >= 16 * STEP:
                    steps(False)
            if held:
                steps(True)
            if seen:
                whole = np.rint(flat.astype(np.float64) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([seen] * len(slices), pa.int64()), pa.array([whole[k] for k in slices], pa.list_(pa.int64()))], ["slice", "n", "w"])

        bounded_batches(spark)
        got = stored(dealt.mapInArrow(go, "slice int, n long, w array<long>"), "weights")
        # Weighted mean, position by position, combined before the shuffle; whole numbers add up alike in any order.
        each = got.select("slice", "n", F.posexplode("w").alias("at", "x")).groupBy("slice", "at").agg(F.sum(F.col("x").cast("decimal(38,0)") * F.col("n")).alias("x"))
        mean = each.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("slice", F.col("v.x").alias("x")).orderBy("slice").collect()
        net.flat = np.concatenate([np.array([float(v) / (UNIT * total) for v in r.x], np.float32) for r in mean])
    return scorer


def score(docs: DataFrame, scorer: Scorer | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_tokens, pll (sum of log probabilities), perplexity (exp of minus their mean)."""
    scorer = scorer or train(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = only(docs, doc_id, text).toDF("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["doc_id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row for each document, and one for each of its words that are not in known. The former have a key that is no word and differs from row to row, so the join spreads them.
        s = shared.value
        for b in batches:
            index, words, begin = words_of_batch(b.column(1))
            entry, own, beyond = s.look_up(words)
            target, ends = entry[index] if len(index) else np.zeros(0, np.int64), begin.tolist()
            own_all = own[index] if len(index) else np.zeros(0)
            # Each text by itself, so that its sum has the same last bits whatever lies beside it.
            count = np.diff(begin)
            sides = s.sides(target, count)
            total = [float(s.logps(sides[x:y], target[x:y]).sum(dtype=np.float64) + own_all[x:y].sum()) if y > x else 0.0 for x, y in zip(ends, ends[1:], strict=False)]
            unknown = np.zeros(len(words), bool)
            unknown[beyond] = True
            at = np.flatnonzero(unknown[index]) if len(index) else np.zeros(0, np.int64)
            pair, times = np.unique(np.repeat(np.arange(len(count)), count)[at] * max(1, len(words)) + index[at], return_counts=True)
            row, of = b.column(2), pair // max(1, len(words))
            word = [b"\0%d" % n for n in row.to_pylist()] + [words[k] for k in (pair % max(1, len(words))).tolist()]
            more, first = len(pair), b.column(0)
            cols = [pa.concat_arrays([row, row.take(pa.array(of))]), pa.concat_arrays([first, pa.nulls(more, first.type)]), pa.array(np.concatenate((count, np.zeros(more, np.int64)))), pa.array(total + [0.0] * more, pa.float64()), pa.array(word, pa.binary()), pa.array(np.concatenate((np.zeros(len(count), np.int64), times)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_tokens", "pll", "word", "times"])

    parts = by_batch(rows.select("doc_id", "text", "row"), go, f"row long, doc_id {kind}, n_tokens long, pll double, word binary, times int")
    if scorer.counts is not None:
        parts = parts.join(only(scorer.counts, "word", "n"), "word", "left")
        own = F.coalesce(F.log(F.col("n").cast("double")), F.octet_length("word") * F.lit(SPELL))
        parts = parts.withColumn("pll", F.when(F.col("times") > 0, F.col("times") * own).otherwise(F.col("pll")))
    scored = parts.groupBy("row").agg(F.first("doc_id", True).alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("pll").alias("pll")).drop("row")
    # Counts that are joined add up in any order, so the last bits are rounded off.
    scored = scored.withColumn("pll", F.round("pll", 3))
    return scored.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.round(F.exp(-F.col("pll") / F.col("n_tokens")), 6)))
