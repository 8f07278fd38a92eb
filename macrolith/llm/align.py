"""Alignment of two tokenizers over the bytes of the same text.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with
byte fallback. B puts a space before each text, so A gets one too; both then
cover the same bytes. The ends of A's and B's tokens, united, cut the bytes
into elementary intervals: each is the overlap of one A and one B token, its
owners found by binary search in either array of ends. An end that both share
closes a group. A text is left out whose joined bytes differ from space + text
in A or B (B turns U+2581 into a space, say).

Neither tokenizer looks across a place where a visible character stands before
a space or line feed (checked from the files; other files take whole texts), so
texts are cut there into chunks, both tokenizers see each distinct chunk of a
batch once, and the arrays of all new chunks are united in one go. A worker
keeps the alignments of chunks in a memo that starts anew when it has its bytes.

``align`` stores a row a text with its links as distinct id pairs and their
numbers. ``pair_counts`` sums these over the corpus. ``align_corpus`` looks
each text's pairs up in blocks of the counted table, at most ``BLOCK`` pairs
each (14 bytes a pair), the only thing that is broadcast: a larger table takes
more passes over the stored rows and no more memory, and no link is shuffled.
``group_products`` gives the pairs of whole groups, all A x all B tokens.

Edge cases: null and empty texts, and those left out, have zeros and an empty
string; a text of any length is one row and a chunk of any length is aligned whole;
repeated rows count as often as they
occur; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, only, shared_root, stored

#: Id pairs of one block of the counted table.
BLOCK = 4 << 20
#: Bytes that a worker's memo takes about before it starts anew.
MEMO_BYTES = 128 << 20
#: Bytes of a memo entry besides its strings.
_ENTRY = 250
#: Chunks that the tokenizers get at once.
_AT_ONCE = 1 << 15

#: Fixed value: what may be white space for either tokenizer; a chunk ends after any other character.
_BLANKS = r"\x{00}-\x{20}\x{7F}-\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{2581}\x{3000}\x{FEFF}"
_CUT = rf"([^{_BLANKS}])([ \n])"
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a visible letter: itself if printable, else the next letter from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their ids, and what they say about where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            form = json.load(f)
        special = {x["id"]: x["content"].encode() for x in form["added_tokens"]}
        size = max([*form["model"]["vocab"].values(), *special]) + 1
        self.bytes_a = [b""] * size
        for piece, k in form["model"]["vocab"].items():
            self.bytes_a[k] = special[k] if k in special else bytes(letters[c] for c in piece)
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(SPACE)
        pre = form.get("pre_tokenizer") or {}
        self.cuts = (
            not form.get("normalizer")
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and all(x["special"] for x in form["added_tokens"])
            and not form["model"].get("dropout")
            and self.blank != self.b.unk_id()
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        )
        self.size_b = n
        #: An id pair is a << bits | b.
        self.bits = 16 if max(size, n) <= 1 << 16 else 32
        self.word = f"<u{self.bits // 4}"
        self.len_a, self.len_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.raw_a, self.raw_b = (np.array([*y, None], object)[:-1] for y in (self.bytes_a, self.bytes_b))
        names = lambda n, end: np.array([b"%d%s" % (k, end) for k in range(n)], object)
        self.names_a = {end: names(size, end) for end in (b",", b"|")}
        self.names_b = {end: names(n, end) for end in (b",", b";", b"")}
        self.forget()

    def forget(self) -> None:
        """An empty memo: slots of chunks, and by slot the numbers (n_a, n_b, n_groups, n_links), validity, where links begin, and the written groups."""
        self.slot: dict[str, int] = {}
        self.numbers, self.good, self.begin, self.links = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, self.word)
        self.groups: list[bytes] = []
        self.held = 0

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk. B adds a space: it stands for the chunk's own first one, or is taken off again."""
        own = [c[0] == " " and len(c) > 1 for c in chunks]
        found = self.b.encode([c[1:] if o else c for c, o in zip(chunks, own, strict=True)], num_threads=1)
        return [ids if o else [self.blank] if c == " " else ids[1:] for c, o, ids in zip(chunks, own, found, strict=True)]

    def learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For each chunk its numbers (n_a, n_b, n_groups, n_links), whether its bytes come back from both, its links one after another, its groups as written."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        ids_b = self.encode_b(chunks)
        flat = lambda ids: np.fromiter(chain.from_iterable(ids), np.int64)
        good = np.ones(len(chunks), bool)
        a, b = flat(ids_a), flat(ids_b)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        raw = [c.encode() for c in chunks]
        long = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        bytes_to = [np.concatenate(([0], np.cumsum(size[ids])))[np.cumsum(n)] for ids, n, size in ((a, n_a, self.len_a), (b, n_b, self.len_b))]
        whole = b"".join(raw)
        if not all((x == long).all() for x in bytes_to) or any(b"".join(pool[ids].tolist()) != whole for pool, ids in ((self.raw_a, a), (self.raw_b, b))):
            join_a, join_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
            good = np.array([b"".join(map(join_a, x)) == t == b"".join(map(join_b, y)) for t, x, y in zip(raw, ids_a, ids_b, strict=True)], bool)
            a, b = (flat(x for x, ok in zip(ids, good, strict=True) if ok) for ids in (ids_a, ids_b))
            n_a, n_b = n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[of_a] == ends) & (ends_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        # Tokens of the groups before a token move its place in the written form.
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[of_a[shared]] = last_b[of_b[shared]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        through_a, through_b = of_a[shared] + 1, np.concatenate(([0], of_b[shared] + 1))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        final = np.zeros(len(b), bool)
        final[stop_b[n_b > 0] - 1] = True
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + through_b[group_a]] = np.where(last_a, self.names_a[b"|"][a], self.names_a[b","][a])
        if len(b):
            text[np.arange(len(b)) + through_a[group_b]] = np.where(final, self.names_b[b""][b], np.where(last_b, self.names_b[b";"][b], self.names_b[b","][b]))
        text = text.tolist()
        cuts = np.concatenate(([0], stop_a + stop_b)).tolist()
        upto = lambda total: np.diff(np.concatenate(([0], total))[np.concatenate(([0], stop_a))])  # noqa: E731  of each chunk, from running totals over A's tokens
        numbers = np.stack([n_a, n_b, upto(np.cumsum(last_a)), upto(np.searchsorted(ends, ends_a) + 1)], axis=1)
        return numbers, good, (a[of_a] << self.bits | b[of_b]).astype(self.word), [b"".join(text[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]

    def slots(self, chunks: list[str]) -> np.ndarray:
        """Where the memo has each of the distinct chunks, which are learned if they are new."""
        if self.held > MEMO_BYTES:
            self.forget()
        found = list(map(self.slot.get, chunks))
        miss = [k for k, v in enumerate(found) if v is None]
        parts = []
        for at in range(0, len(miss), _AT_ONCE):
            part = [chunks[k] for k in miss[at : at + _AT_ONCE]]
            parts.append(self.learn(part))
            self.slot.update(zip(part, range(len(self.groups), len(self.groups) + len(part)), strict=True))
            self.groups += parts[-1][3]
            self.held += sum(map(len, part)) + sum(map(len, parts[-1][3])) + parts[-1][2].nbytes + _ENTRY * len(part)
        if parts:
            self.numbers = np.concatenate([self.numbers, *[x[0] for x in parts]])
            self.good = np.concatenate([self.good, *[x[1] for x in parts]])
            self.links = np.concatenate([self.links, *[x[2] for x in parts]])
            self.begin = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
            for k in miss:
                found[k] = self.slot[chunks[k]]
        return np.array(found, np.int64)

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """Each text, with its space before it, as chunks."""
        full = pc.binary_join_element_wise("", pc.fill_null(texts, ""), " ")
        mark = next(m for m in map(chr, [*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE)]) if not pc.any(pc.match_substring(full, m)).as_py())
        return pc.split_pattern(pc.replace_substring_regex(full, _CUT, rf"\1{mark}\2") if self.cuts else full, mark)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]:
        """For each text its numbers (n_a, n_b, n_groups, n_links) as a row, its groups as written, its distinct id pairs ascending and how many links hold each, as bytes."""
        split = self.chunks(texts)
        flat = split.flatten().dictionary_encode()
        slots = self.slots(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        if not len(lengths):
            return np.zeros((0, 4), np.int64), [], [], []
        stop = np.cumsum(lengths)
        start = stop - lengths
        full = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > 0
        good = np.logical_and.reduceat(self.good[slots], start) & full
        each = self.numbers[slots] * np.repeat(good, lengths)[:, None]
        numbers = np.add.reduceat(each, start)
        n = each[:, 3]
        at = np.repeat(self.begin[slots] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(np.arange(len(lengths)), numbers[:, 3])
        pair = self.links[at].astype(np.int64)
        if self.bits == 16:
            key = np.sort(row << 32 | pair)
            row, pair = key >> 32, key & 0xFFFFFFFF
        else:
            order = np.lexsort((pair, row))
            row, pair = row[order], pair[order]
        first = np.ones(len(pair), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
        where = np.flatnonzero(first)
        times = np.diff(np.append(where, len(pair))).astype("<i4").tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(row[where], minlength=len(lengths))))).tolist()
        pairs, w = pair[where].astype(self.word).tobytes(), self.bits // 4
        written = [b";".join([self.groups[k] for k in slots[i:j].tolist()]) if ok else b"" for i, j, ok in zip(start.tolist(), stop.tolist(), good.tolist(), strict=True)]
        return numbers, written, [pairs[w * i : w * j] for i, j in zip(cuts, cuts[1:], strict=False)], [times[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process, with its memo."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_KEPT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times: the distinct id pairs (a << bits | b, little-endian), ascending, and how many links hold each, as int."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for b in batches:
            numbers, written, pairs, times = own.align(b.column(1))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in written]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(numbers[:, k]) for k in range(4)], pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_KEPT}")


def _links(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs and their numbers of a batch of (pairs, times), and the row of each."""
    pairs, times = (b"".join(c.to_pylist()) for c in (b.column("pairs"), b.column("times")))
    n = pc.binary_length(b.column("times")).to_numpy(zero_copy_only=False) // 4
    width = 4 * len(pairs) // max(1, len(times)) or 4
    return np.frombuffer(pairs, f"<u{width}").astype(np.int64), np.frombuffer(times, "<i4").astype(np.int64), np.repeat(np.arange(b.num_rows), n)


def pair_counts(aligned: DataFrame, bits: int) -> DataFrame:
    """pair, n, top: links of the corpus that hold the pair, and whether no pair of its B id has more."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        waiting, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([held[0], *[w[0] for w in waiting]]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([held[1], *[w[1] for w in waiting]]))
            return keys, sums

        for b in batches:
            pairs, times, _ = _links(b)
            waiting.append((pairs, times))
            size += len(pairs)
            if size > 1 << 20:
                held, waiting, size = merged(), [], 0
                if len(held[0]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])
                    held = (held[0][:0], held[1][:0])
        held = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])

    counts = by_batch(aligned.select("pairs", "times"), go, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = F.col("pair").bitwiseAND((1 << bits) - 1)
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def align_corpus(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, as the module says."""
    spark = docs.sparkSession
    shared_root(spark)
    aligned = stored(align(docs, path_a, path_b, doc_id=doc_id, text=text), "aligned")
    counts = stored(pair_counts(aligned, aligner(path_a, path_b).bits), "pair-counts")
    blocks = max(1, -(-counts.count() // block))
    numbered = counts.withColumn("block", F.pmod(F.xxhash64("pair"), F.lit(blocks)))
    out = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        table = numbered.where(F.col("block") == k).select("pair", "n", "top").toArrow()
        order = np.argsort(keys := table["pair"].to_numpy())
        known = spark.sparkContext.broadcast((keys[order], table["n"].to_numpy()[order], table["top"].to_numpy()[order]))
        out = _looked_up(out, known)
        if k + 1 < blocks:
            out = stored(out, "looked-up")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looked_up(rows: DataFrame, known) -> DataFrame:
    """The rows, with what their pairs of this block add to n_best and count_sum."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = known.value
        for b in batches:
            pairs, times, row = _links(b)
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            at, times, row = at[hit], times[hit], row[hit]
            best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(best, row, times * top[at])
            np.add.at(total, row, times * n[at])
            for name, more in (("n_best", best), ("count_sum", total)):
                k = b.schema.get_field_index(name)
                b = b.set_column(k, name, pa.array(b.column(k).to_numpy() + more))
            yield b

    return by_batch(rows, go, rows.schema)


def group_products(groups: str) -> list[tuple[int, int]]:
    """All A x all B ids of each group of a written alignment: the many-to-many pairs that the links of a group imply."""
    out = []
    for g in filter(None, groups.split(";")):
        a, b = ([int(k) for k in side.split(",")] for side in g.split("|"))
        out += [(i, j) for i in a for j in b]
    return out


def group_text(text: str | None, path_a: str, path_b: str) -> str:
    """The written alignment of one text: groups of A ids | B ids, in order."""
    return aligner(path_a, path_b).align(pa.array([text], pa.string()))[1][0].decode()
