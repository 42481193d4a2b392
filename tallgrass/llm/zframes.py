"""Token files: one zstandard frame for each document, and a seek table at the end.

A file is a sequence of independent frames, each the token ids of one document as little-endian unsigned 32-bit integers, with the frame's own content checksum. After them
stands a skippable frame with the document ids, and last a seek table in the public zstandard seekable format: for each frame its compressed and plain size and the
low 32 bits of the XXH64 of its plain bytes. A reader takes the table and the document ids from the file's end and decompresses the frames of
the documents that it wants, no other.

Rows are dealt by ranges of the document id and each task writes its own files under names that no other attempt uses; the manifest, written to the shared folder
before anything is read, names the files of the attempts that succeeded. Files of lost attempts are never read.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir

#: Fixed values of the seekable format, and the magic number of the frame that holds the document ids.
SKIPPABLE, DOC_IDS, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUMS = 0x80
#: A file is closed once it has so many bytes or documents.
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20
MANIFEST = "part int, number int, path string, docs bigint, ids bigint, bytes bigint"
#: Most chunks that a worker keeps, and their most characters.
KEPT, KEPT_CHARS = 300_000, 8 << 20
#: Marks before white space or the end and after a letter or digit that no normal form takes apart.
_TRAILING = re.compile(r"[.,;:!?*$%&#](?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ].)[.,;:!?*$%&#]*(?=\s|$)")


def _xxh32(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Appends documents to one file."""

    def __init__(self, path: str, level: int = 1):
        import zstandard

        self.fs, self.at = pafs.FileSystem.from_uri(path)
        self.path, self.out = path, self.fs.open_output_stream(self.at, compression=None)
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self.table, self.docs, self.size, self.ids = [], [], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.zip(data)
        self.out.write(frame)
        self.table.append((len(frame), len(data), _xxh32(data)))
        self.docs.append(doc_id)
        self.size += len(frame)
        self.ids += len(data) // 4

    def close(self) -> None:
        known = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        body = self.zip(known.tobytes() + ids.tobytes())
        body = struct.pack("<II", DOC_IDS, len(body)) + body
        self.table.append((len(body), 0, _xxh32(b"")))
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        self.out.write(body + struct.pack("<II", SKIPPABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE))
        self.out.close()


class FrameReader:
    """Reads single documents of one file, or all in turn."""

    def __init__(self, path: str):
        import zstandard

        self.fs, at = pafs.FileSystem.from_uri(path)
        self.file, self.unzip = self.fs.open_input_file(at), zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table with checksums")
        head = self._read(size - 9 - 12 * n - 8, 8 + 12 * n)
        if struct.unpack_from("<II", head) != (SKIPPABLE, 12 * n + 9):
            raise ValueError(f"{path} has a damaged seek table")
        table = np.frombuffer(head, "<u4", offset=8).reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.table = table[:-1]
        last = self._read(int(self.starts[n - 1]), int(table[-1, 0]))
        if struct.unpack_from("<I", last)[0] != DOC_IDS:
            raise ValueError(f"{path} has no document ids")
        ids = self.unzip(last[8:])
        known, values = np.frombuffer(ids, np.uint8, n - 1), np.frombuffer(ids, "<i8", n - 1, n - 1)
        self.docs = [int(v) if k else None for k, v in zip(known, values, strict=True)]

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _plain(self, i: int, frame: bytes) -> bytes:
        data = self.unzip(frame) if self.table[i, 1] else b""
        if len(data) != self.table[i, 1] or _xxh32(data) != self.table[i, 2]:
            raise ValueError(f"frame {i} doesn't match its checksum")
        return data

    def frame(self, i: int) -> bytes:
        return self._plain(i, self._read(int(self.starts[i]), int(self.table[i, 0])))

    def find(self, wanted: set[int]) -> Iterator[tuple[int, bytes]]:
        for i, d in enumerate(self.docs):
            if d in wanted:
                yield d, self.frame(i)

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in file order; neighbouring frames are read together, a few MB at a time."""
        i, n = 0, len(self.table)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + (4 << 20), side="right")) - 1)
            j = min(j, n)
            block, base = self._read(int(self.starts[i]), int(self.starts[j] - self.starts[i])), int(self.starts[i])
            for k in range(i, j):
                yield self.docs[k], self._plain(k, block[int(self.starts[k]) - base : int(self.starts[k + 1]) - base])
            i = j


class WordEncoder:
    """Encodes by a tokenizer that lower-cases, never joins what white space parts, nor letters and digits with other marks, and that ends each run of letters with its own kind of token.

    Marks that stand between a letter or digit of Latin-1 and a space are therefore parted from it (other letters may end in a combining mark once they are normalised, which joins the marks
    that follow), texts of Latin-1 characters are lower-cased, and chunks between spaces are kept with their ids as bytes, up to KEPT of them. New runs of Latin-1 letters are encoded in one call and parted where a token ends a word; all other new chunks, special tokens among
    them, are encoded whole. A text that may hold a special token isn't lower-cased, as that could make one.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # for lower-cased runs of letters, of which nothing is to be normalised or parted
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end = struct.pack("<I", end_id)
        self.kept: dict[str, bytes] = {"": b""}
        self.size = 0
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn_runs(self, runs: list[str]) -> None:
        groups = [runs[at : at + 500] for at in range(0, len(runs), 500)]
        for group, e in zip(groups, self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for run, stop in zip(group, (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist(), strict=True):
                self.kept[run] = data[at:stop]
                at = stop

    def _learn(self, chunks: set[str], lowered: bool) -> None:
        """lowered: all chunks are lower-case Latin-1."""
        runs = {c: c if lowered else c.lower() for c in chunks if c.isalpha() and (lowered or max(c) < "\u0100")}
        whole = list(chunks.difference(runs))
        self._learn_runs(list(runs if lowered else set(runs.values()).difference(self.kept)))
        if whole:
            self.kept.update(zip(whole, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)), strict=True))
        if not lowered:
            self.kept.update((c, self.kept[low]) for c, low in runs.items() if c != low)
        self.size += sum(map(len, chunks))

    def encode(self, text: str) -> bytes:
        lowered = "<|" not in text
        if lowered:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                lowered = False
        chunks = _TRAILING.sub(r" \g<0>", text).replace("\n", " ").split(" ")
        new = set(chunks).difference(self.kept)
        if new:
            if len(self.kept) + len(new) > KEPT or self.size > KEPT_CHARS:  # one text's chunks at most beyond the bound
                self.kept, self.size = {"": b""}, 0
                new = set(chunks) - {""}
            self._learn(new, lowered)
        return b"".join(map(self.kept.__getitem__, chunks)) + self.end


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def write_tokens(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text in ascending order of id_col and returns the manifest, a row for each file: part and number (files in order), path, docs, ids, bytes.

    id_col is a long; null ids come first, rows with one id are ordered by a hash of their texts, and all of them are written. A null text is an empty one. An empty table
    has no files. encoder is called in each task and gives a function from a text to its ids as bytes. Other columns are ignored.
    """
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, done, open_ = encoder(), TaskContext.get().partitionId(), [], None

        def close():
            open_.close()
            done.append((part, len(done), open_.path, len(open_.docs), open_.ids, open_.size))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if open_ and (open_.size >= FILE_BYTES or len(open_.docs) >= FILE_DOCS):
                    close()
                    open_ = None
                open_ = open_ or FrameWriter(f"{folder}/{run}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok.zst")
                open_.add(doc_id, encode(text.as_py() or ""))
        if open_:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i == 2 else pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(zip(*done, strict=True))], names=["part", "number", "path", "docs", "ids", "bytes"])

    files, at = pafs.FileSystem.from_uri(f"{folder}/{run}")
    files.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))
    manifest = ranged.mapInArrow(write, MANIFEST).checkpoint()
    return manifest


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the files: id, start (number of ids in all documents before it), and ids (binary, little-endian unsigned 32-bit)."""
    before = Window.orderBy("part", "number")  # one row for each file
    placed = manifest.withColumn("base", F.sum("ids").over(before) - F.col("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["id", "start", "ids"])

        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows, size = [], 0
                for doc_id, data in FrameReader(path):
                    rows.append((doc_id, at, data))
                    at += len(data) // 4
                    size += len(data)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = partitions(manifest.sparkSession)
    return placed.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).mapInArrow(read, "id bigint, start bigint, ids binary")


def find_tokens(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """The documents with the wanted ids (a stated list), of which alone the frames are read: id and ids (binary).

    Several documents with one id all come; null and unknown ids give no row, nor does a manifest without files.
    """
    ids = set(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                if got := list(FrameReader(path).find(ids)):
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["id", "ids"])

    return manifest.mapInArrow(find, "id bigint, ids binary")


def op3_zstd_frames(spark, sf_dir: str, *, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the token files that hold the ids of all whole texts (null: empty) in ascending order of doc_id."""
    import public_tokenizers as P

    path = P.path("word_bpe_49k.json")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), lambda: word_encoder(path, end_id).encode, f"{shared_dir(spark)}/token-files")
    return read_tokens(manifest).select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
