"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

From the merge list one pass in rank order computes the sufficient lookahead:
how many symbols to the right of a token's end can still decide whether it
stands. The transducer reads a word symbol by symbol. A sequence of tokens is
an encoding exactly if each two neighbours are the encoding of what they spell
together; so each prefix has one last token, found among the tokens that end
there by asking whether it may follow the last token before it. A trie of the
tokens follows all that may still be growing. A token is stable when every
growing one leads back to it, and is emitted then; what is held stays within
the lookahead and the longest token (tested), however long a word is.

``Lanes`` feeds the texts of a batch in pieces of ``PIECE`` characters, cut at
the last blank, for no token crosses it; each distinct chunk between blanks goes
through the transducer once and what it emitted is kept in a memo of bounded
size. A text whose piece has no blank keeps a transducer of its own open from
there on. The ids that a round emits go straight into the digests.

Normaliser, splitter and merges come from a public tokenizer file in the JSON
form of the tokenizers library; only the parts listed in ``Spec`` are known,
others raise ValueError. The decoder is a state machine fed one id at a time,
which writes either what the library's decode() gives without a decoder entry
(tokens joined by blanks) or the text of the bytes, holding back incomplete
UTF-8 sequences. For batches both are tables of what each id writes, gathered
in Arrow, with the open UTF-8 sequence as the state between pieces.

Edge cases: null and empty texts have no ids and decode to the empty text;
repeated rows give repeated results; invalid UTF-8 decodes to U+FFFD; a very
long text is fed in pieces; other columns are left alone; null and repeated
doc_ids come out as they went in.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .chunks import MEMO_BYTES, ChunkTable, layout
from .common import by_batch, only

#: Words that an encoder remembers for single texts, and pairs of tokens whose following is remembered.
MEMO, PAIRS = 20_000, 2_000_000
#: Characters of a text that are fed at once.
PIECE = 1 << 12
_SHIFT = 20


def byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> int:
    """Symbols of the input beyond a token's end that can still change whether it is a token."""
    size = lambda t: len(t.removesuffix(end)) if end else len(t)
    reach: dict[str, int] = {}
    most = 1
    for left, right in merges:
        old_left, old_right = reach.get(left, 0), reach.get(right, 0)
        beyond = max(old_right, old_left - size(right))
        reach[left] = max(old_left, size(right) + old_right)
        reach[right] = beyond
        reach[left + right] = max(reach.get(left + right, 0), beyond)
        most = max(most, reach[left])
    return most


class Spec:
    """What a tokenizer file says, for: NFC, white space to a blank, lower case; one splitting pattern whose matches are kept; byte level; BPE with an optional word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.nfc = self.lower = self.blank = False
        n = j.get("normalizer")
        for x in [] if n is None else n.get("normalizers", [n]):
            if x["type"] == "NFC":
                self.nfc = True
            elif x["type"] == "Lowercase":
                self.lower = True
            elif x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ":
                self.blank = True
            else:
                raise ValueError(f"normalizer {x} is not known")
        steps = j["pre_tokenizer"].get("pretokenizers", [j["pre_tokenizer"]])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("only one kept-matches split before plain byte level is known")
        m = j["model"]
        if m["type"] != "BPE" or m.get("continuing_subword_prefix") or m.get("byte_fallback") or m.get("ignore_merges") or m.get("dropout") or j.get("decoder") or j.get("post_processor"):
            raise ValueError("this kind of model is not known")
        self.pattern = steps[0]["pattern"]["Regex"]
        self.end = m.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = m["vocab"]
        self.merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        if any(x[k] for x in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not known")
        self.lookahead = sufficient_lookahead(self.merges, self.end)


class Encoder:
    """What a transducer needs of a tokenizer: normaliser, splitter, symbols and merges."""

    def __init__(self, path: str):
        s = self.spec = Spec(path)
        self.pattern = regex.compile(s.pattern)
        self.space = regex.compile(r"\s+")
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(s.special, key=len, reverse=True))) if s.special else None
        self.longest_special = max(map(len, s.special), default=0)
        chars = byte_chars()
        self.chars = {ord(c): x for c, x in zip(map(chr, range(256)), chars, strict=True)}
        self.inner = {c: s.vocab[c] for c in chars}
        self.last = {c: s.vocab[c + s.end] for c in chars}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (a, b) in enumerate(s.merges):
            self.rank[s.vocab[a] << _SHIFT | s.vocab[b]] = k
            self.made.append(s.vocab[a + b])
        self.size = {i: len(t.removesuffix(s.end) if s.end else t) for t, i in s.vocab.items()}
        self.inner_of, self.last_of = [self.inner[c] for c in chars], [self.last[c] for c in chars]
        self.words: dict[str, tuple[int, ...]] = {}
        #: What tokens are spelled with, and a trie of them; a token stands under -1.
        self.spelled = {i: (i,) for i in {*self.inner_of, *self.last_of}}
        for pair, made in zip(self.rank, self.made, strict=True):
            self.spelled.setdefault(made, self.spelled[pair >> _SHIFT] + self.spelled[pair & (1 << _SHIFT) - 1])
        self.trie: dict = {}
        for i, x in self.spelled.items():
            if len(x) == 1 or self.merge(list(x)) == [i]:
                node = self.trie
                for c in x:
                    node = node.setdefault(c, {})
                node[-1] = i
        self.longest = max(map(len, self.spelled.values()))
        self.follows: dict[int, bool] = {}
        #: Symbols fed to transducers so far.
        self.fed = 0

    def normal(self, text: str) -> str:
        s = self.spec
        if s.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if s.blank:
            text = self.space.sub(" ", text)
        # Letter by letter: a sigma at a word's end is as any other.
        return text.replace("Σ", "σ").lower() if s.lower else text

    def symbols(self, word: str, ended: bool) -> list[int]:
        s = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.chars)
        inner = self.inner
        ids = [inner[c] for c in s]
        if ended:
            ids[-1] = self.last[s[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merges, lowest rank first and leftmost among equals."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made, none = self.rank.get, self.made, len(self.made)
        ranks = [get(a << _SHIFT | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            new = ids[k] = made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << _SHIFT | new, none)
            if k < len(ranks):
                ranks[k] = get(new << _SHIFT | ids[k + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, made, n = self.rank.get, self.made, len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << _SHIFT | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = made[r], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) >= 0 and (q := get(ids[x] << _SHIFT | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def may_follow(self, a: int, b: int) -> bool:
        """Are these two tokens the encoding of what they spell together?"""
        if len(self.follows) > PAIRS:
            self.follows.clear()
        v = self.follows[a << _SHIFT | b] = self.merge([*self.spelled[a], *self.spelled[b]]) == [a, b]
        return v

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            t = Word(self)
            ids = tuple(t.push(self.symbols(word, True), True))
            if len(self.words) > MEMO:
                self.words.clear()
            self.words[word] = ids
        return ids

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of the text, and whether each is a special token."""
        last = 0
        if self.special and "<" in text:
            for m in self.special.finditer(text):
                yield text[last : m.start()], False
                yield m[0], True
                last = m.end()
        yield text[last:], False

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text, by a transducer."""
        t, text = Transducer(self), text or ""
        return [i for at in range(0, len(text), PIECE) for i in t.feed(text[at : at + PIECE])] + t.close()


class Word:
    """The state of one word: of each prefix since what was emitted its last token and where that begins, and the tokens that are growing."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        #: By places since the last emitted token, which stands at place 0 (None at the word's begin).
        self.token: list[int | None] = [None]
        self.begin: list[int] = [0]
        self.growing: list[tuple[int, dict]] = []

    def push(self, symbols: list[int], ended: bool) -> list[int]:
        """Reads symbols; returns the tokens that have become stable, all of them when the word has ended."""
        e, token, begin, growing = self.e, self.token, self.begin, self.growing
        known, trie = e.follows.get, e.trie
        e.fed += len(symbols)
        for c in symbols:
            growing.append((len(token) - 1, trie))
            now, found = [], False
            for at, node in growing:
                node = node.get(c)
                if node is None:
                    continue
                now.append((at, node))
                if not found and (t := node.get(-1)) is not None:
                    last = token[at]
                    ok = last is None or known(last << _SHIFT | t)
                    if ok is None:
                        ok = e.may_follow(last, t)
                    if ok:
                        token.append(t)
                        begin.append(at)
                        found = True
            growing = now
        self.growing = growing
        n = len(token) - 1
        chain, at = [], n
        while at:
            chain.append(at)
            at = begin[at]
        if not ended:
            # Every token that is growing leads back to the chain at some place; what lies before the first of these stands.
            on, stable = {0, *chain}, n
            for at, _ in growing:
                while at not in on:
                    at = begin[at]
                stable = min(stable, at)
            chain = [k for k in chain if k <= stable]
        out = [token[k] for k in reversed(chain)]
        if chain and not ended:
            k = chain[0]
            self.token, self.begin = token[k:], [max(0, x - k) for x in begin[k:]]
            self.growing = [(at - k, node) for at, node in growing]
        return out

    @property
    def held(self) -> int:
        return len(self.token) - 1


class Transducer:
    """Takes pieces of a text and returns ids as soon as they are stable; what it holds is bounded."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self.raw = self.text = ""
        self.run: regex.Pattern | None = None  # the class of the word that is being emitted
        self.open: Word | None = None
        self.last = ""  # the open word's last character, which may turn out to be its end

    def feed(self, piece: str) -> list[int]:
        e, out = self.e, []
        self.raw += piece
        parts = list(e.parts(self.raw))
        for part, special in parts[:-1]:
            out += self._text(part, True) if not special else [e.spec.special[part]]
        self.raw = parts[-1][0]
        # Before a plain character nothing composes, and no special token that began earlier is open.
        cut = len(self.raw) - e.longest_special
        while cut > 0 and not self.raw[cut].isascii():
            cut -= 1
        if cut > 0:
            done, self.raw = self.raw[:cut], self.raw[cut:]
            out += self._text(done, False)
        return out

    def close(self) -> list[int]:
        raw, self.raw = self.raw, ""
        return [i for part, special in self.e.parts(raw) for i in ([self.e.spec.special[part]] if special else self._text(part, True))]

    def _text(self, raw: str, ended: bool) -> list[int]:
        e, out = self.e, []
        self.text += e.normal(raw)
        if self.run:
            m = self.run.match(self.text)
            out += self._more(m[0], False)
            self.text = self.text[m.end() :]
            if not self.text and not ended:
                return out
            out += self._more("", True)
        last = 0
        for m in e.pattern.finditer(self.text):
            if not ended and m.end() > len(self.text) - 2:
                break
            out += e.word(m[0])
            last = m.end()
        else:
            last = len(self.text) if ended else max(last, len(self.text) - 2)
        self.text = self.text[last:]
        if not ended and len(self.text) > e.longest and (m := e.pattern.search(self.text)) and len(m[0]) > e.longest:
            self.run = regex.compile(r"\p{L}*" if regex.match(r"\p{L}", m[0]) else r"[^\s\p{L}\p{N}]*")
            out += self._more(m[0], False)
            self.text = self.text[m.end() :]
        return out

    def _more(self, word: str, ended: bool) -> list[int]:
        """Adds to the open word. Its last character stays held, for it may turn out to be the word's end."""
        self.open = self.open or Word(self.e)
        word = self.last + word
        if ended:
            out = self.open.push(self.e.symbols(word, True), True)
            self.run, self.open, self.last = None, None, ""
            return out
        self.last = word[-1:]
        return self.open.push(self.e.symbols(word[:-1], False), False) if len(word) > 1 else []


class Decoder:
    """Fed one id at a time. joined: the tokens with blanks between; else the text of their bytes, a word's end being a blank."""

    def __init__(self, spec: Spec, joined: bool = False):
        self.joined, self.begun = joined, False
        self.token = {i: t for t, i in spec.vocab.items()} | {i: t for t, i in spec.special.items()}
        self.special, self.end = set(spec.special.values()), spec.end
        self.byte = {c: b for b, c in enumerate(byte_chars())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, i: int) -> str:
        t = self.token.get(i)
        if t is None:
            return ""
        if self.joined:
            t = " " + t if self.begun else t
            self.begun = True
            return t
        if i in self.special:
            out = self.utf8.decode(b"", True) + t
            self.utf8.reset()
            return out
        stop = self.end and t.endswith(self.end)
        t = t.removesuffix(self.end) if stop else t
        return self.utf8.decode(bytes(self.byte[c] for c in t)) + " " * bool(stop)

    def close(self) -> str:
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        self.begun = False
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join([*map(self.feed, ids), self.close()])


class Lanes:
    """The transducers of a batch of texts, side by side."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES, piece: int = PIECE):
        words, fold = layout(path)
        self.e, self.piece, self.width = Encoder(path), piece, 4
        if not words:
            raise ValueError("a tokenizer that looks across blanks is not known")
        self.table = ChunkTable(self._emissions, self.width, fold, True, memo_bytes=memo_bytes)
        d = {i: t for t, i in self.e.spec.vocab.items()} | {i: t for t, i in self.e.spec.special.items()}
        byte, end = {c: b for b, c in enumerate(byte_chars())}, self.e.spec.end
        special = set(self.e.spec.special.values())

        def written(i: int) -> bytes:
            t = d.get(i, "")
            if i in special:
                return t.encode()
            stop = bool(end) and t.endswith(end)
            return bytes(byte[c] for c in (t.removesuffix(end) if stop else t)) + b" " * stop

        every = range(max(d) + 1)
        #: What each id writes: its number and its token, each after a blank, and its bytes.
        self.numbers = pa.array([b" %d" % i for i in every], pa.large_binary())
        self.tokens = pa.array([b" " + d[i].encode() if i in d else b"" for i in every], pa.large_binary())
        self.bytes = pa.array([written(i) for i in every], pa.large_binary())

    def _emissions(self, chunks: list[bytes]) -> list[bytes]:
        """What a transducer emits for each chunk that a blank or the text's end closes."""
        e, out = self.e, []
        inner, last = e.inner_of, e.last_of
        for c in chunks:
            if c.isalpha():
                low = c.lower() if e.spec.lower else c
                ids = Word(e).push([*[inner[b] for b in low[:-1]], last[low[-1]]], True)
            else:
                ids = []
                for part, special in e.parts(c.decode()):
                    if special:
                        ids.append(e.spec.special[part])
                    else:
                        for w in e.pattern.findall(e.normal(part)):
                            ids += Word(e).push(e.symbols(w, True), True)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def rounds(self, texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Feeds a piece of each text at a time; gives the rows fed, the ids that became stable, and where each row's begin (with the end of the last)."""
        if (pc.max(pc.utf8_length(texts)).as_py() or 0) <= self.piece:
            yield list(range(len(texts))), *self.table.ids(texts)
            return
        left = {k: (t or "", 0, "") for k, t in enumerate(texts.to_pylist())}
        own: dict[int, tuple[str, int, Transducer]] = {}
        while left or own:
            rows, fed, after = list(left), [], {}
            for k, (t, at, held) in left.items():
                piece = held + t[at : at + self.piece]
                at += self.piece
                if at >= len(t):
                    fed.append(piece)
                    continue
                cut = max(piece.rfind(" "), piece.rfind("\n")) + 1
                fed.append(piece[:cut])
                if cut:
                    after[k] = (t, at, piece[cut:])
                else:
                    own[k] = (t, at - len(piece), Transducer(self.e))
            if rows:
                yield rows, *self.table.ids(pa.array(fed, pa.large_string()))
            left = after
            # Texts without a blank for so long go on by themselves.
            rows, ids = [k for k in own if k not in left], []
            for k in rows:
                t, at, machine = own.pop(k)
                ids.append(machine.feed(t[at : at + self.piece]))
                if at + self.piece >= len(t):
                    ids[-1] += machine.close()
                else:
                    own[k] = (t, at + self.piece, machine)
            if rows:
                yield rows, np.array([i for x in ids for i in x], "<u4"), np.cumsum([0, *map(len, ids)])


class _Digests:
    """Of one text's ids as decimal numbers, of its joined decoding and of its bytes' text, each fed as it comes."""

    def __init__(self):
        self.n = 0
        self.ids, self.joined, self.text = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, n: int, numbers: memoryview, tokens: memoryview, raw: memoryview) -> None:
        if n:
            skip = not self.n
            self.ids.update(numbers[skip:])
            self.joined.update(tokens[skip:])
            self.text.update(self.utf8.decode(raw).encode())
            self.n += n

    def close(self) -> tuple[int, str, str, str]:
        self.text.update(self.utf8.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.joined.hexdigest(), self.text.hexdigest()


def _pieces(table: pa.Array, ids: np.ndarray, begin: np.ndarray) -> list[memoryview]:
    """What the ids of each row write, one memory view a row."""
    got = table.take(pa.array(ids))
    _, offsets, data = got.buffers()
    at = np.frombuffer(offsets, np.int64, len(got) + 1, 8 * got.offset)[begin].tolist() if len(got) else [0] * len(begin)
    view = memoryview(data if data is not None else b"")
    return [view[a:b] for a, b in zip(at, at[1:], strict=False)]


@functools.lru_cache(1)
def _lanes(path: str) -> Lanes:
    """One for a worker process, so that its memo serves all the tasks the worker runs."""
    return Lanes(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by blanks), decoded_sha256 (of the joined decoding), text_sha256 (of the text of the ids' bytes)."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes(tokenizer_path)
        for b in batches:
            own = [_Digests() for _ in range(b.num_rows)]
            for fed, ids, begin in lanes.rounds(b.column(1)):
                for k, n, x, y, z in zip(fed, np.diff(begin).tolist(), *[_pieces(t, ids, begin) for t in (lanes.numbers, lanes.tokens, lanes.bytes)], strict=True):
                    own[k].feed(n, x, y, z)
            out = list(zip(*[d.close() for d in own], strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), *[pa.array(x, pa.string()) for x in out[1:]]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string")


def encoded(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, decoded (the text of the ids' bytes)."""
    rows = only(docs, doc_id, text).toDF("doc_id", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = _lanes(tokenizer_path)
        d = Decoder(lanes.e.spec)
        for b in batches:
            ids: list[list[int]] = [[] for _ in range(b.num_rows)]
            for fed, got, begin in lanes.rounds(b.column(1)):
                for k, x in zip(fed, np.split(got, begin[1:-1]), strict=True):
                    ids[k] += x.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return by_batch(rows, go, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
