"""Spelling variants: words one edit apart, grouped under their commonest form.

Words are runs of letters, A-Z in lower case; every 97th (document, word) by
its crc32 loses one letter, so that a corpus has misspellings to find. A batch's
texts are split in Arrow; crc32 of ``<doc_id>:<word>`` is put together from the
crc32 of both parts, as zeros shift it linearly. Counts are summed in a task,
then by word.

Search: of one error in a word one half is free. Each word is asked for in the
automaton of words with its first letters, matched exactly up to half its
length and completed with one error, and its mirror image in the automaton of
mirrored words with its last letters. What the mirrored search finds with an
exact first half the other one has already, so nothing is found twice. The
automata are minimal and acyclic; each transition carries the number of words
before it, so a path adds up to a word's number in its sorted list (a perfect
hash), which leads to its spelling and count.

The lexicon is dealt out by the first letters (two to ``PREFIX``, never more
than half a word has), and a word stands wherever a word of its length, one
less or one more may ask for it. A bucket of more than ``BLOCK`` words is cut
into blocks by a hash, each with an automaton of its own, and all its words ask
in every block: no automaton outgrows a worker and no pair is lost. Only the
number of near words and the best of them leave a task.

``form`` is the near word of the largest count, if that is twice the word's or
more; ``root`` follows forms to the last one by doubling, each round a join of
tables with one row a word, written to the shared folder.

Edge cases: null and empty texts have no words; words of any length are
searched; equal counts go to the word that is first in code-point order;
repeated rows count as often as they occur; a null doc_id reads ``null``; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, drop, keep, only, reread, shared_root, stored

#: One (document, word) in so many loses a letter; least letters and occurrences of a word; a form has so many times the word's occurrences.
EVERY, LETTERS, OCCURRENCES, TIMES = 97, 5, 3, 2
#: First letters that deal out the lexicon at most, words of one automaton at most.
PREFIX, BLOCK = 4, 100_000
#: Words whose counts a task holds before it hands them on.
_HELD = 400_000

_NOT_LETTERS = r"[^A-Za-z\x{C0}-\x{FF}]+"


def _shortened(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def batch_counts(ids: list, texts: pa.Array, every: int = EVERY) -> dict[str, int]:
    """How often each word occurs in the texts, after one letter of every so many (document, word) is deleted."""
    split = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), _NOT_LETTERS, " "), " ")
    flat = split.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    n = len(words)
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    key, times = np.unique(row * max(n, 1) + index, return_counts=True)
    row, index = np.divmod(key, max(n, 1))
    total = np.bincount(index, times, n).astype(np.int64)
    raw = [w.encode() for w in words]
    size, last = np.fromiter(map(len, raw), np.int64, n), np.fromiter(map(zlib.crc32, raw), np.int64, n)
    # crc32(head + word) = crc32(head + zeros) ^ crc32(zeros) ^ crc32(word), zeros as long as the word.
    lengths, kind = np.unique(size, return_inverse=True)
    zeros = [bytes(k) for k in lengths.tolist()]
    plain = np.array([zlib.crc32(z) for z in zeros], np.int64)
    heads = [zlib.crc32(b"%s:" % str("null" if i is None else i).encode()) for i in ids]
    used = np.unique(row * max(len(lengths), 1) + kind[index])
    shifted = np.zeros(len(heads) * len(lengths), np.int64)
    shifted[used] = [zlib.crc32(zeros[k % len(lengths)], heads[k // len(lengths)]) for k in used.tolist()]
    h = shifted[row * len(lengths) + kind[index]] ^ plain[kind[index]] ^ last[index]
    out = defaultdict(int)
    for k in np.flatnonzero(h % every == 0).tolist():
        if words[w := index[k]]:
            total[w] -= times[k]
            out[_shortened(words[w], int(h[k]))] += int(times[k])
    for w, c in zip(words, total.tolist(), strict=True):
        if c:
            out[w] += c
    return out


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, every: int = EVERY) -> DataFrame:
    """word, n: the distinct words of so many letters and occurrences at least."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for w, c in batch_counts(b.column(0).to_pylist(), b.column(1), every).items():
                if len(w) >= letters:
                    held[w] = held.get(w, 0) + c
            if len(held) > _HELD:
                yield out()
                held = {}
        yield out()

    rows = by_batch(only(docs, doc_id, text), go, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words; paths add up to a word's number in that list."""

    def __init__(self, words: list[str]):
        #: By state: letter -> (next state, words before it), and whether a word ends there.
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        register: dict = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""

        def close(node: tuple[dict[str, int], list[bool]]) -> int:
            key = (node[1][0], tuple(node[0].items()))
            if (known := register.get(key)) is None:
                known = register[key] = len(self.next)
                n, own = int(node[1][0]), {}
                for letter, child in node[0].items():
                    own[letter] = (child, n)
                    n += self._size[child]
                self.next.append(own)
                self.final.append(node[1][0])
                self._size.append(n)
            return known

        for w in words:
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            for at in range(len(before), k, -1):
                state = close(path.pop())
                path[-1][0][before[at - 1]] = state
            for letter in w[k:]:
                path[-1][0][letter] = -1
                path.append(({}, [False]))
            path[-1][1][0] = True
            before = w
        for at in range(len(before), 0, -1):
            state = close(path.pop())
            path[-1][0][before[at - 1]] = state
        self.start = close(path[0])
        del self._size

    def follow(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that goes on with word[at:], -1 if there is none."""
        for letter in word[at:] if at else word:
            step = self.next[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin with word[:exact] and are exactly one insertion, deletion or replacement away."""
        state, number = self.start, 0
        for letter in word[:exact]:
            step = self.next[state].get(letter)
            if step is None:
                return []
            state, number = step[0], number + step[1]
        out, n = [], len(word)
        for at in range(exact, n + 1):
            here = word[at] if at < n else ""
            for letter, (child, more) in self.next[state].items():
                if letter != here:  # a letter inserted before its like is the same as after it
                    if (k := self.follow(child, number + more, word, at)) >= 0 if at < n else self.final[child]:
                        out.append(k if at < n else number + more)
                    if at < n and (k := self.follow(child, number + more, word, at + 1) if at + 1 < n else (number + more if self.final[child] else -1)) >= 0:
                        out.append(k)
            if at == n:
                break
            if at + 1 == n or word[at + 1] != here:  # of equal letters the last one is deleted
                if (k := self.follow(state, number, word, at + 1) if at + 1 < n else (number if self.final[state] else -1)) >= 0:
                    out.append(k)
            step = self.next[state].get(here)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, n_near, best_n, best: rows come sorted by bucket (side, key, block); those that stand in the block make its automaton, those that ask are asked."""

    def bucket(side: int, words: list[str], counts: list[int], ask: list[tuple[str, int]]) -> list[tuple]:
        order = sorted(range(len(words)), key=words.__getitem__)
        words, counts = [words[k] for k in order], [counts[k] for k in order]
        a, out = Automaton(words), []
        for word, n in ask:
            half = len(word) // 2
            found = a.one_error(word, len(word) - half if side else half)
            if side and found:
                head = word[-half:]  # the first half, mirrored: the other side has those that keep it
                found = [k for k in found if words[k][-half:] != head]
            if found:
                most = max(counts[k] for k in found)
                names = [words[k][::-1] if side else words[k] for k in found if counts[k] == most]
                out.append((word[::-1] if side else word, n, len(found), most, min(names)))
        return out

    now, words, counts, ask = None, [], [], []
    kinds = [("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [x for x, _ in kinds])
    for b in batches:
        out = []
        for key, word, n, asks, stands in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now:
                if ask and words:
                    out += bucket(now["side"], words, counts, ask)
                now, words, counts, ask = key, [], [], []
            if stands:
                words.append(word)
                counts.append(n)
            if asks:
                ask.append((word, n))
        yield made(out)
    if ask and words:
        yield made(bucket(now["side"], words, counts, ask))


def near_words(words: DataFrame, *, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, best_n, best of (word, n): how many other words are exactly one edit away, the commonest of them and its count."""
    size = F.length("word")
    own = F.least(F.floor(size / 2), F.lit(prefix)).cast("int")
    stands = F.array_distinct(F.transform(F.array(F.greatest(size - 1, F.lit(2)), size, size + 1), lambda q: F.least(F.floor(q / 2), F.lit(prefix)).cast("int")))
    sides = words.select("n", own.alias("own"), stands.alias("stands"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))).alias("s")).select("s.side", "s.word", "n", "own", F.explode("stands").alias("c"))
    keyed = stored(sides.select("side", F.substring(F.col("word"), F.lit(1), F.col("c")).alias("key"), "word", "n", (F.col("own") == F.col("c")).alias("asks")), "words")
    counts = keyed.groupBy("side", "key").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks")).where("blocks > 1")
    cut = keyed.join(counts, ["side", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at = F.pmod(F.xxhash64("word"), F.col("blocks"))
    # A word stands in one block; if it asks, it asks in all.
    dealt = cut.select("side", "key", "word", "n", "asks", at.alias("at"), F.explode(F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(at))).alias("block"))
    rows = dealt.select(F.struct("side", "key", "block").alias("bucket"), "word", "n", "asks", (F.col("at") == F.col("block")).alias("stands"))
    placed = rows.repartition("bucket").sortWithinPartitions("bucket")
    found = by_batch(placed, _search, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the last word that forms lead to. Every chain must end; lengths double each round."""
    spark = forms.sparkSession
    now = forms.where("form is not null").select("word", F.col("form").alias("root"))
    path = keep(now, "roots")
    now = reread(now, path)
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved"))
        after = keep(moved, "roots")
        drop(spark, path)
        path, moved = after, reread(moved, after)
        now = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, times: float = TIMES, every: int = EVERY, prefix: int = PREFIX, block: int = BLOCK) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n, as the module says."""
    if letters < 4:
        raise ValueError("halves of words need two letters: letters must be 4 or more")
    shared_root(docs.sparkSession)
    words = stored(word_counts(docs, doc_id=doc_id, text=text, letters=letters, occurrences=occurrences, every=every), "lexicon")
    near = near_words(words, prefix=prefix, block=block)
    led = F.col("best_n") >= times * F.col("n")
    forms = stored(near.select("word", "n_near", F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")), "forms")
    last = roots(forms)
    out = words.join(forms, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
