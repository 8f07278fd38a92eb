"""Token-ID files: independent zstandard frames, a document index and a trailing seek table.

A file is a run of zstandard frames, each of whole documents' ids (little-endian
unsigned integers of 2 or 4 bytes), closed at about ``FRAME_BYTES``. Then comes
one skippable frame (magic 0x184D2A50) with the zstandard-compressed document
index, and last one skippable frame (magic 0x184D2A5E) in the public seekable
format: for each frame its compressed size, its size and the low 32 bits of the
XXH64 of its content, then the number of frames, a descriptor byte (0x80: with
checksums) and the magic 0x8F92EAB1. A reader takes the table from the end of
the file and decompresses just the frames of the documents asked for.

Files of a dataset follow one another in ascending doc_id order. Documents are
encoded where they are read; only ids are shuffled, to ranges of doc_id whose
bounds come from a scan of doc_id alone. Rows of one doc_id are all kept; an id
that fills several ranges is dealt out over them. A range is written as files of
about ``FILE_BYTES``, so that neither a file nor its index grows with the data.

Edge cases: a null text has no ids but the end id; documents without a doc_id
come after all others and are marked in the index; no documents give no files; a
doc_id that isn't of an integer type raises ValueError; other columns are left
alone; a very long text is one document of one frame.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import MEMO_BYTES, ChunkTable, layout
from .common import by_batch, bounded_batches, only, shared_path, stored

FRAME_BYTES = 256 << 10
LEVEL = 3
SKIP_INDEX, SKIP_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_HEAD = struct.Struct("<II")
_ENTRY = struct.Struct("<III")
_FOOT = struct.Struct("<IBI")
#: Of the document index: bytes of an id, documents, and how many of them, the last ones, have no doc_id.
_INDEX = struct.Struct("<BQQ")
#: Bytes of ids after which a file is closed and the next one begun.
FILE_BYTES = 256 << 20
#: Bytes of files that one reader task takes about.
READ_BYTES = 32 << 20


def _byte_chars() -> dict[int, int]:
    """The printable characters by which byte-level tokenizers write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in plain)}


_BYTE_CHARS = _byte_chars()


class FrameWriter:
    """Writes one file to a binary stream; close() ends it."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs, self.counts, self.frame_of = array("q"), array("I"), array("I")
        self.held: list[bytes] = []
        self.held_bytes = self.tokens = self.nameless = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Documents without an id come after those with one."""
        if doc_id is None:
            self.nameless += 1
        elif self.nameless:
            raise ValueError("documents without an id come last")
        self.docs.append(0 if doc_id is None else doc_id)
        self.counts.append(len(ids) // self.width)
        self.frame_of.append(len(self.frames))
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.tokens += len(ids) // self.width
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        index = self.pack.compress(_INDEX.pack(self.width, len(self.docs), self.nameless) + b"".join(np.array(x).astype(k).tobytes() for x, k in ((self.docs, "<i8"), (self.counts, "<u4"), (self.frame_of, "<u4"))))
        self.out.write(_HEAD.pack(SKIP_INDEX, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(_ENTRY.pack(*f) for f in self.frames) + _FOOT.pack(len(self.frames), 0x80, SEEK_END)
        self.out.write(_HEAD.pack(SKIP_SEEK, len(table)) + table)


class FrameReader:
    """Reads documents of a seekable binary stream; only their frames are decompressed."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - _FOOT.size)
        count, flags, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        f.seek(size - _FOOT.size - count * _ENTRY.size)
        table = [_ENTRY.unpack_from(raw, k * _ENTRY.size) for raw in [f.read(count * _ENTRY.size)] for k in range(count)]
        self.frames = table[:-1]
        self.offsets = np.concatenate(([0], np.cumsum([t[0] for t in table]))).tolist()
        f.seek(self.offsets[-2])
        magic, length = _HEAD.unpack(f.read(8))
        if magic != SKIP_INDEX:
            raise ValueError("no document index before the seek table")
        raw = zstandard.ZstdDecompressor().decompress(f.read(length))
        self.width, n, nameless = _INDEX.unpack_from(raw)
        at = _INDEX.size
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.named = n - nameless
        self.counts = np.frombuffer(raw, "<u4", n, at + 8 * n).astype(np.int64)
        self.frame_of = np.frombuffer(raw, "<u4", n, at + 12 * n)
        self.starts = np.cumsum(self.counts) - self.counts
        self._first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))
        self._kept: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            packed, size, check = self.frames[k]
            self.f.seek(self.offsets[k])
            raw = zstandard.ZstdDecompressor().decompress(self.f.read(packed))
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self._kept = (k, raw)
        return self._kept[1]

    def ids(self, n: int) -> np.ndarray:
        """Ids of the file's n-th document."""
        k = int(self.frame_of[n])
        at = int(self.starts[n] - self.starts[self._first[k]])
        return np.frombuffer(self.frame(k), f"<u{self.width}", int(self.counts[n]), at * self.width)

    def find(self, doc_id: int) -> list[np.ndarray]:
        lo, hi = np.searchsorted(self.doc_ids[: self.named], [doc_id, doc_id + 1])
        return [self.ids(n) for n in range(lo, hi)]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, as executors reach it."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


class LibraryEncoder:
    """Ids of batches of texts by the tokenizers library; where the file's layout allows, each distinct chunk is encoded once (see ``chunks``)."""

    def __init__(self, path: str, width: int, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.width, self.code, self.model = width, {2: "H", 4: "I"}[width], self.tokenizer.model
        words, self.fold = layout(path)
        self.table = ChunkTable(self._learn, width, self.fold, True, memo_bytes=memo_bytes) if words else None

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (with the end of the last)."""
        if self.table:
            return self.table.ids(texts)
        got = [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, f"<u{self.width}"), *got]), np.cumsum([0, *map(len, got)])

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """Words of letters only go to the library's model itself, which saves the steps before it."""
        out: list[bytes] = [b""] * len(chunks)
        rest, tokenize, code = [], self.model.tokenize, self.code
        for k, c in enumerate(chunks):
            s = c.decode()
            if s.isalpha() and (s.isascii() or max(s) < "\u0250" and is_normalized("NFC", s)):
                s = s.lower() if self.fold else s
                if s.isascii() or s.isalpha():
                    out[k] = array(code, [t.id for t in tokenize(s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
                    continue
            rest.append(k)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for k, e in zip(part, self.encode([chunks[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = array(code, e.ids).tobytes()
        return out


@functools.lru_cache(1)
def library_encoder(path: str, width: int) -> LibraryEncoder:
    """One for a worker process, so that its memo serves all the tasks the worker runs."""
    return LibraryEncoder(path, width)


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> pa.Array:
    """A binary value a text: its ids and the end id."""
    n, w = len(begin) - 1, ids.dtype.itemsize
    out = np.insert(ids, begin[1:], end_id)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((begin + np.arange(n + 1)) * w), pa.py_buffer(out)])


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", parts: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every document's ids below the folder ``out``; returns the manifest: file number, path, documents, tokens, bytes, first token.

    ``parts`` ranges of doc_id are written side by side, each as files of about
    ``file_bytes``. Each task attempt writes files of its own names, and the
    manifest lists the ones that count, so a task that is run again does no harm.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer_path)
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be of an integer type")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, total, named = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [1.0], max(10_000, 20 * parts)), F.count("*"), F.count("doc_id")).first()
    bounds = np.array((cuts or [])[: parts - 1], np.int64)
    # Documents without an id follow, over their share of the parts.
    spare = -(-parts * (total - named) // max(1, total))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path, width)
        seen = 0
        for b in batches:
            d = b.column(0)
            at = np.arange(seen, seen + len(d))
            seen += len(d)
            x = pc.fill_null(d, 0).to_numpy(zero_copy_only=False)
            # An id that fills several ranges is dealt out over all of them.
            lo, hi = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
            part = lo + at % (hi - lo + 1)
            none = d.is_null().to_numpy(zero_copy_only=False)
            part[none] = len(bounds) + 1 + at[none] % max(1, spare)
            ids = with_end(*encoder.ids(b.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([d, pa.array(part.astype(np.int32)), ids.cast(pa.binary())], ["doc_id", "part", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, stream, number = None, None, None, 0
        done: list[tuple] = []

        def close():
            writer.close()
            stream.close()
            done.append((now, number, path, len(writer.docs), writer.tokens))

        for b in batches:
            for d, p, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != now or writer.tokens * width >= file_bytes:
                    if writer:
                        close()
                    number = number + 1 if p == now else 0
                    now = p
                    store, root = file_system(out)
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{p:06d}-{number:06d}-{uuid.uuid4().hex}.zst"
                    stream = store.open_output_stream(path, compression=None)
                    writer = FrameWriter(stream, width)
                writer.add(d, ids.as_py())
        if writer:
            close()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "number", "path", "docs", "tokens"])

    encoded = by_batch(rows, encode, "doc_id long, part int, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1 + spare, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")
    # One row for each file, so that one partition and one ordered window hold them whatever the tables hold.
    written = dealt.mapInArrow(write, "part int, number int, path string, docs long, tokens long").repartition(1)
    manifest = stored(written, "manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({"bytes": F.col("tokens") * width, "first_token": F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")})


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 (over the ids as 32-bit little-endian integers), ids."""
    return _read(manifest, out, True)


def token_digests(manifest: DataFrame, out: str) -> DataFrame:
    """As read_tokens, without the ids."""
    return _read(manifest, out, False)


def _read(manifest: DataFrame, out: str, ids: bool) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, _ = file_system(out)
                with store.open_input_file(path) as f:
                    r = FrameReader(f, f.size())
                    for lo in range(0, len(r.doc_ids), 512):
                        part = range(lo, min(lo + 512, len(r.doc_ids)))
                        raw = [r.ids(n).astype("<u4") for n in part]
                        cols = [pa.array(r.doc_ids[lo : part.stop], mask=np.arange(lo, part.stop) >= r.named), pa.array(first + r.starts[lo : part.stop]), pa.array(r.counts[lo : part.stop]), pa.array([zlib.crc32(x.tobytes()) for x in raw], pa.int64())]
                        if ids:
                            cols.append(pa.array([x.astype(np.int64) for x in raw], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    files, size = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(files, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, (size or 0) // READ_BYTES)))
    rows = manifest.select("path", "first_token").repartition(tasks)
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes to a new folder below the shared one and reads the digests back."""
    bounded_batches(docs.sparkSession)
    out = shared_path(docs.sparkSession, "tokens")
    return token_digests(write_tokens(docs, tokenizer_path, out, **options), out)
