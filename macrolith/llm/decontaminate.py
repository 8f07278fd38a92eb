"""Benchmark decontamination with a generalised suffix automaton over words.

The test items are normalised to words and put into one automaton whose states
know which items they occur in. Document words are streamed through it: the
length of the longest match that ends at each word says whether a window (13
item words, or a whole shorter item) ends there. Runs of adjacent word pairs
that no item has are skipped with a vectorised filter before the automaton is
walked; that changes nothing but the time.

The automaton is built on the driver and broadcast only while a block of items
has at most ``BLOCK_WORDS`` words; a larger benchmark is cut into such blocks
(overlapping by window - 1 words where an item itself is larger) that are
matched one after another, the hits being carried along with the rows.

Edge cases: a null or empty text has no words and comes out with zeros and
contaminated = false; null or empty items have no window; items without an id
count as one item in n_items and are not in items or their digest; repeated rows are
judged each for itself; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_batch, bounded_batches, only, stored

WINDOW = 13
#: Coverage from which a document is contaminated: hit words times this are at least all words.
COVER = 20
#: Words of one automaton; its arrays take some 60 bytes a word, its dictionary some 300.
BLOCK_WORDS = 200_000

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences; picklable as flat arrays."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        edges: list[dict[int, int]] = [{}]
        length, link = [0], [-1]
        texts, ids = [], []
        for item, words in items:
            if words:
                texts.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                ids.append(item)
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(edges, length, link, last, c)
        width = len(self.vocabulary) + 1
        self.width = width
        size = len(length)
        order = sorted(range(1, size), key=length.__getitem__)
        # The state that holds the window-long suffix of each longer state.
        at = list(range(size))
        for s in order:
            if length[link[s]] >= window:
                at[s] = at[link[s]]
        marks: dict[int, set[int]] = {}
        short: dict[int, tuple[int, int]] = {}
        shortest = window
        for k, text in enumerate(texts):
            s = n = 0
            for c in text:
                s = edges[s][c]
                n += 1
                if n >= window:
                    marks.setdefault(self._suffix_state(s, length, link, window), set()).add(k)
            if n < window:
                shortest = min(shortest, n)
                short[s] = (n, s)
                marks.setdefault(-s, set()).add(k)
        # The nearest whole short item at or above each state.
        above = [-1] * size
        for s in order:
            above[s] = s if s in short else above[link[s]]
        self.shortest, self.ids = shortest, ids
        self.length = np.array(length, np.int32)
        self.link = np.array(link, np.int32)
        self.at = np.array(at, np.int32)
        self.above = np.array(above, np.int32)
        self.whole = {s: n for s, (n, _) in short.items()}
        self.marks = {s: sorted(v) for s, v in marks.items()}
        source = np.repeat(np.arange(size, dtype=np.int64), [len(e) for e in edges])
        self.edge_key = source * width + np.fromiter((c for e in edges for c in e), np.int64, len(source))
        self.edge_to = np.fromiter((t for e in edges for t in e.values()), np.int32, len(source))
        pairs = [a * width + b for t in texts for a, b in zip(t, t[1:], strict=False)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self._ready = None

    @staticmethod
    def _suffix_state(s: int, length: list[int], link: list[int], window: int) -> int:
        while length[link[s]] >= window:
            s = link[s]
        return s

    @staticmethod
    def _extend(edges: list[dict[int, int]], length: list[int], link: list[int], last: int, c: int) -> int:
        def split(p: int, q: int) -> int:
            edges.append(dict(edges[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            new = len(edges) - 1
            link[q] = new
            while p >= 0 and edges[p].get(c) == q:
                edges[p][c] = new
                p = link[p]
            return new

        if c in edges[last]:
            q = edges[last][c]
            return q if length[q] == length[last] + 1 else split(last, q)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, p = len(edges) - 1, last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            link[new] = q if length[q] == length[p] + 1 else split(p, q)
        return new

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": None}

    def _tables(self):
        if self._ready is None:
            step = dict(zip(self.edge_key.tolist(), self.edge_to.tolist(), strict=True))
            bits = max(16, int(np.ceil(np.log2(len(self.pairs) + 1))) + 6)
            seen = np.zeros(1 << bits, bool)
            seen[self._slot(self.pairs, bits)] = True
            self._ready = step, seen, bits, self.length.tolist(), self.link.tolist(), self.at.tolist(), self.above.tolist()
        return self._ready

    @staticmethod
    def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) intervals of hit words, and the positions in ids of the items with a window here."""
        n = len(words)
        if n < self.shortest or not self.ids:
            return [], set()
        step, seen, bits, length, link, at, above = self._tables()
        get = self.vocabulary.get
        unknown = self.width - 1
        code = np.fromiter([get(w, unknown) for w in words], np.int64, n)
        if self.shortest == 1:
            runs = self._runs(code != unknown, 1)
        else:
            both = (code[:-1] != unknown) & (code[1:] != unknown)
            near = np.zeros(n - 1, bool)
            k = np.flatnonzero(both)
            near[k] = seen[self._slot(code[k] * self.width + code[k + 1], bits)]
            runs = [(a, b + 1) for a, b in self._runs(near, self.shortest - 1)]
        spans: list[list[int]] = []
        found: set[int] = set()
        window, width, whole, marks = self.window, self.width, self.whole, self.marks
        for a, b in runs:
            s = n_now = 0
            for i, c in enumerate(code[a:b].tolist(), a):
                t = step.get(s * width + c)
                while t is None and s:
                    s = link[s]
                    n_now = length[s]
                    t = step.get(s * width + c)
                if t is None:
                    continue
                s = t
                n_now += 1
                m = 0
                if n_now >= window:
                    m = window
                    found.update(marks.get(at[s], ()))
                w = above[s]
                if w == s and whole[s] > n_now:
                    w = above[link[s]]
                while w > 0:
                    m = max(m, whole[w])
                    found.update(marks[-w])
                    w = above[link[w]]
                if m:
                    lo = i + 1 - m
                    while spans and spans[-1][0] >= lo:
                        spans.pop()
                    if spans and spans[-1][1] >= lo:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], found

    @staticmethod
    def _runs(flag: np.ndarray, least: int) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
        lo, hi = edge[::2], edge[1::2]
        k = hi - lo >= least
        return list(zip(lo[k].tolist(), hi[k].tolist(), strict=True))


def _blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of at most block_words words each, one at a time. An item beyond that is cut with an overlap."""
    pairs = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    # Bytes bound words; only a benchmark that fits one block is collected at once.
    total = pairs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    rows = pairs.collect() if total <= 16 * block_words else stored(pairs, "items").toLocalIterator()
    for r in rows:
        words = words_of(r.t)
        cuts = [words] if len(words) <= block_words else [words[a : a + block_words] for a in range(0, len(words) - window + 1, block_words - window + 1)]
        for part in cuts:
            if held and held + len(part) > block_words:
                yield Automaton(block, window)
                block, held = [], 0
            block.append((r.i, part))
            held += len(part)
    if block:
        yield Automaton(block, window)


def _in_order(found: set[str | None]) -> list[str | None]:
    """Sorted, null last."""
    return sorted(found - {None}) + [None] * (None in found)


def _digest(found: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest()


_CARRIED = "_spans array<int>, _items array<string>"


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(a + b):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(x, y) for x, y in out]


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, cover: int = COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word intervals as start, end, ...), longest_span, items."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    blocks = _blocks(items, item_id, item_text, window, block_words)
    automaton = next(blocks, None) or Automaton([], window)
    carried, number = False, 0
    while (after := next(blocks, None)) is not None:
        rows = by_batch(rows, _carry(sc.broadcast(automaton), carried), f"doc_id {kind}, text string, {_CARRIED}")
        automaton, carried, number = after, True, number + 1
        if number % 3 == 0:
            rows = stored(rows, "hits")
    return by_batch(rows, _final(sc.broadcast(automaton), carried, cover), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, longest_span int, items array<string>")


def _carry(shared, carried: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            spans, items = [], []
            for text, old, known in zip(b.column(1).to_pylist(), *_before(b, carried), strict=True):
                s, f = a.matches(words_of(text))
                s = _union(s, old)
                spans.append([x for p in s for x in p])
                items.append(_in_order(known | {a.ids[k] for k in f}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "_spans", "_items"])

    return go


def _before(b: pa.RecordBatch, carried: bool):
    if not carried:
        return [[]] * b.num_rows, [set()] * b.num_rows
    return [list(zip(x[::2], x[1::2], strict=True)) for x in b.column(2).to_pylist()], [set(x) for x in b.column(3).to_pylist()]


def _final(shared, carried: bool, cover: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        none = _digest(set())
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for text, old, known in zip(b.column(1).to_pylist(), *_before(b, carried), strict=True):
                words = words_of(text)
                s, f = a.matches(words)
                if old:
                    s = _union(s, old)
                items = known | {a.ids[k] for k in f}
                hit = sum(y - x for x, y in s)
                for to, v in zip(out, (len(words), hit, len(items), _digest(items) if items else none, hit > 0 and cover * hit >= len(words), [x for p in s for x in p], max((y - x for x, y in s), default=0), sorted(items - {None})), strict=True):
                    to.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "longest_span", "items"])

    return go


def _word_spans(text: str) -> list[tuple[int, int]]:
    """Byte offsets of the words of the UTF-8 text."""
    flag = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8) != 0x20
    return Automaton._runs(flag, 1)


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    raw, at, out, last = text.encode("utf-8", "surrogatepass"), _word_spans(text), [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, cover: int = COVER, longest: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, in all their columns, without contaminated ones.

    A document goes whole when its hit words reach the coverage limit. With
    ``longest``, spans of more hit words than that are cut out of the others,
    whose remaining text stays; without, the others stay as they are.
    A null text is never contaminated.
    """
    sc = docs.sparkSession.sparkContext
    k, schema = docs.columns.index(text), docs.schema
    bounded_batches(docs.sparkSession)
    rows = docs.toDF(*[f"c{i}" for i in range(len(schema))])
    inner = rows.schema
    wide = T.StructType([*inner.fields, T.StructField("_spans", T.ArrayType(T.IntegerType()))])
    blocks = _blocks(items, item_id, item_text, window, block_words)
    automaton, carried, number = next(blocks, None) or Automaton([], window), False, 0
    # Beyond one block the rows carry their hits from one to the next, and no more than three blocks are held at once.
    while (after := next(blocks, None)) is not None:
        rows = rows.mapInArrow(_adding(sc.broadcast(automaton), k, len(schema), carried), wide)
        automaton, carried, number = after, True, number + 1
        if number % 3 == 0:
            rows = stored(rows, "hits")
    return rows.mapInArrow(_judging(sc.broadcast(automaton), k, len(schema), carried, cover, longest), inner).toDF(*schema.names)


def _spans(shared, b: pa.RecordBatch, k: int, width: int, carried: bool) -> list[list[tuple[int, int]]]:
    old = [list(zip(x[::2], x[1::2], strict=True)) for x in b.column(width).to_pylist()] if carried else [[]] * b.num_rows
    found = [shared.value.matches(words_of(t))[0] for t in b.column(k).to_pylist()]
    return [_union(s, o) if o else s for s, o in zip(found, old, strict=True)]


def _adding(shared, k: int, width: int, carried: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[x for p in s for x in p] for s in _spans(shared, b, k, width, carried)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(spans, pa.list_(pa.int32()))], [*b.schema.names[:width], "_spans"])

    return go


def _judging(shared, k: int, width: int, carried: bool, cover: int, longest: int | None):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = pa.RecordBatch.from_arrays(b.columns[:width], schema=pa.schema([b.schema.field(i) for i in range(width)]))
            yield _judged(kept, k, _spans(shared, b, k, width, carried), cover, longest)

    return go


def _judged(kept: pa.RecordBatch, k: int, spans: list, cover: int, longest: int | None) -> pa.RecordBatch:
    texts = kept.column(k).to_pylist()
    stay = []
    for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
        hit = sum(y - x for x, y in s)
        stay.append(not (hit and cover * hit >= len(words_of(t))))
        if longest is not None and stay[-1] and (cut := [(x, y) for x, y in s if y - x > longest]):
            texts[i] = excise(t, cut)
    if longest is not None:
        kept = kept.set_column(k, kept.schema.field(k), pa.array(texts, kept.schema.field(k).type))
    return kept.filter(pa.array(stay, pa.bool_()))
