"""Ids of whole batches of texts by way of their chunks between blanks.

A batch's texts are split at blanks and line feeds and their chunks made
distinct in Arrow; each distinct chunk is looked up in a worker's memo or
learned once, and the ids of all texts are gathered from there. Punctuation at
a chunk's ends is a word of its own for the tokenizers at hand, so a blank is
put between it and the letters, which are learned once whatever stands about them.

This is exact for tokenizers that drop white space and never look across it.
Letters A-Z are folded first if the tokenizer lower-cases, except in texts that
may hold a special token. The memo is bounded by its bytes: when the younger
half is full it becomes the older one, and what the older one held is dropped.

Edge cases: null and empty texts have no ids; a chunk of any length is learned
whole but kept only if it is short; surrogates can't occur in Arrow strings.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker's memo takes about, and the longest chunk kept in it.
MEMO_BYTES, MEMO_LENGTH = 64 << 20, 48
#: Bytes of a memo entry besides its key and its ids.
_ENTRY = 190
#: Marks that are words of their own between a blank and an ASCII letter or digit: no apostrophe, and nothing that special tokens are made of.
_EDGE = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+"
_TRAIL, _LEAD = f"([0-9A-Za-z])({_EDGE})( |$)", f"(^| )({_EDGE})([0-9A-Za-z])"


class ChunkTable:
    """learn(chunks) gives the ids of each as little-endian bytes; word_edges says that punctuation at an edge stands alone."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], width: int, fold: bool, word_edges: bool, special: bytes = b"<|", memo_bytes: int = MEMO_BYTES):
        self.learn, self.width, self.fold, self.edges, self.special = learn, width, fold, word_edges, special.decode()
        self.half, self.young, self.old, self.held = memo_bytes // 2, {}, {}, 0
        self.learned = 0

    def _keep(self, chunks: list[bytes], ids: list[bytes]) -> None:
        self.young.update(zip(chunks, ids, strict=True))
        for c in chunks:
            if len(c) > MEMO_LENGTH:
                del self.young[c]
        self.held += _ENTRY * len(chunks) + sum(map(len, chunks)) + sum(map(len, ids))
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0

    def values(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct chunks."""
        out = list(map(self.young.get, chunks))
        new = [c for c, v in zip(chunks, out, strict=True) if v is None]
        if new:
            known = dict(zip(new, map(self.old.get, new), strict=True))
            missing = [c for c, v in known.items() if v is None]
            if missing:
                self.learned += len(missing)
                known.update(zip(missing, self.learn(missing), strict=True))
            self._keep(new, list(known.values()))
            out = [known[c] if v is None else v for c, v in zip(chunks, out, strict=True)]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's begin (with the end of the last)."""
        n = len(texts)
        texts = pc.fill_null(texts, "")
        if self.fold:
            low = pc.ascii_lower(texts)
            may = pc.match_substring(texts, self.special) if self.special else None
            texts = pc.if_else(may, texts, low) if may is not None and pc.any(may).as_py() else low
        texts = pc.replace_substring(texts, "\n", " ")
        if self.edges:
            texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, _TRAIL, r"\1 \2\3"), _LEAD, r"\1\2 \3")
        split = pc.split_pattern(texts, " ")
        flat = split.flatten().dictionary_encode()
        index = flat.indices.to_numpy(zero_copy_only=False)
        values = self.values(flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        pool = np.frombuffer(b"".join(values), f"<u{self.width}")
        each = size[index]
        ends = np.cumsum(each)
        out = pool[np.repeat((np.cumsum(size) - size)[index] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        count = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()] if n else np.zeros(1, np.int64)
        return out, count


#: Fixed value: the splitting pattern of the word tokenizers that are known here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def layout(path: str) -> tuple[bool, bool]:
    """What a tokenizer file (JSON form) says: it never looks across a blank or line feed and gives none for them, words being split by WORD_PATTERN and then byte level; it lower-cases."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    n = j.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = n.get("normalizers", [n])
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    words = (
        all(x["type"] in ("NFC", "Lowercase") or x == blank for x in steps)
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"] == {"Regex": WORD_PATTERN}
        and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
        and not (pre[1]["use_regex"] or pre[1]["add_prefix_space"])
        and not any(x[k] for x in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        and all(x["content"].startswith("<|") and not set(x["content"]) & set(" \n") for x in j["added_tokens"])
        and j["model"].get("type") == "BPE"
        and not j["model"].get("dropout")
    )
    return words, words and any(x["type"] == "Lowercase" for x in steps)


def words_of_batch(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """As ``words_of`` of each text: each word's number, the distinct words by number, and where each text's words begin (with the end of the last)."""
    n = len(texts)
    plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    split = pc.split_pattern(plain, " ")
    flat = split.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    begin = split.offsets.to_numpy() - split.offsets[0].as_py() if n else np.zeros(1, np.int64)
    if b"" in words:
        # Marks at a text's ends leave an empty word there.
        k = words.index(b"")
        real = index != k
        begin = np.concatenate(([0], np.cumsum(real)))[begin]
        index = index[real]
        index -= index > k
        del words[k]
    return index, words, begin.astype(np.int64)
