"""Byte-level BPE encoding and decoding with the tokenizers library, from a table of ranks.

A text is cut by the vocabulary's pattern and each match is encoded by itself. The library works on characters, so the bytes of a match are mapped one to one to printable
characters, and a token's characters back to bytes; the character offsets that it reports are then byte offsets into the match. Matches recur, so each worker keeps what
it has encoded, up to KEPT matches.

Ranks name the result of a merge, not its two sides, so every split of a token into two tokens becomes a merge, in order of rank. By ranks the leftmost of several pairs that make one token is
merged first, by a merge list the pair that is listed first. That matters only where two such pairs overlap, x y z with xy = yz the token, so xy is listed before yz. (If x equals z, the token is
a word repeated, as in runs of one mark, and pairs can't be told apart by their order; tests go through all such runs.)
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most matches that a worker keeps, and their most characters and bytes of ids; matches that are encoded in one call.
KEPT, KEPT_BYTES, TOGETHER = 250_000, 32 << 20, 500


@functools.cache
def byte_chars() -> str:
    """A printable character for each byte: itself where it is printable Latin-1 without spaces, else the next free one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(spare)) for b in range(256))


def splits(token: bytes, known) -> list[int]:
    """Where a token can be split into two known tokens, in the order in which these merges are listed: of two overlapping ones the one whose pair would stand to the left first."""
    n = len(token)
    border = lambda k: 0 < k < n and token[:k] == token[n - k :]
    late = lambda i: border(i) - border(n - i)  # noqa: E731  1: the pair's left side ends the token too, so another pair may stand to its left
    return sorted((i for i in range(1, n) if token[:i] in known and token[i:] in known), key=lambda i: (late(i), i))


class Codec:
    """Encodes and decodes by one rank file."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.table = dict(enumerate(byte_chars()))
        chars = {t: t.decode("latin-1").translate(self.table) for t in ranks}
        merges = [(chars[t[:i]], chars[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in splits(t, ranks)]
        # a line end stands for no byte, so it can part matches that are encoded in one call
        self.gap = max(ranks.values()) + 1
        self.bpe = Tokenizer(models.BPE(vocab={chars[t]: r for t, r in ranks.items()} | {"\n": self.gap}, merges=merges, ignore_merges=True))
        self.bpe.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        byte_of = {c: b for b, c in self.table.items()}  # the byte table reversed
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.bpe.get_vocab().items() if i != self.gap}
        self.sizes = np.zeros(self.gap + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.sizes[i] = len(t)
        self.matches = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def _map(self, pieces: list[str]) -> str:
        return "\n".join(p.encode("utf-8").decode("latin-1").translate(self.table) for p in pieces)

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), TOGETHER):
            group = new[at : at + TOGETHER]
            ids = np.array(self.bpe.encode(self._map(group), add_special_tokens=False).ids, "<i4")
            data, start = ids.tobytes(), 0
            for piece, end in zip(group, [*(4 * np.flatnonzero(ids == self.gap)).tolist(), len(data)], strict=True):
                self.kept[piece] = data[start:end]
                start = end + 4
            self.size += sum(map(len, group)) + len(data)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        found = self.matches(text)
        new = set(found).difference(self.kept)
        if new:
            if len(self.kept) + len(new) > KEPT or self.size > KEPT_BYTES:  # one text's matches at most beyond the bound
                self.kept.clear()
                self.size = 0
                new = set(found)
            self._learn(list(new))
        return b"".join(map(self.kept.__getitem__, found))

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte of the text where each token begins: as characters stand for bytes, what the library's offsets of each match come to when they are added up."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes

    def library_offsets(self, match: str) -> list[tuple[int, int]]:
        """The offsets that the library reports for one match, in bytes."""
        return self.bpe.encode(self._map([match]), add_special_tokens=False).offsets

    def decode(self, ids) -> bytes:
        """The bytes of ids, through the characters that stand for bytes in the library's vocabulary; an id outside it raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_parts(self, ids) -> Iterator[str]:
        """The text that each id completes: a character split over several ids comes with the last of them; bytes that are no UTF-8 come as U+FFFD."""
        import codecs

        held = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield held.decode(self.bytes_of[i])
        yield held.decode(b"", True)


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _lists(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) // 4 for v in values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and ids (array of int) for each row of docs, in no order. Null and empty texts have no ids. Repeated rows and null ids are kept; other columns are ignored."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in _small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([c.encode(t or "") for t in b.column(1).to_pylist()])], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_with_offsets(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with starts (array of int): the byte of the text where each token begins, and n_split: how many tokens begin inside a character of several bytes."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in _small(batches):
            ids, starts, split = [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                ids.append(c.encode(t))
                at = c.starts(np.frombuffer(ids[-1], "<i4"))
                starts.append(at.astype("<i4").tobytes())
                split.append(0 if t.isascii() else int(((np.frombuffer(t.encode("utf-8"), np.uint8)[at] & 0xC0) == 0x80).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), _lists(starts), pa.array(split, pa.int64())], names=[id_col, "ids", "starts", "n_split"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, n_split bigint")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the binary column out: the bytes of ids_col (null for null). A column of that name is replaced. cast(out as string) is the text, if the ids are a whole one."""
    kinds = tokens.drop(out).schema

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in _small(batches):
            ids = b.column(b.schema.get_field_index(ids_col))
            flat, null = iter(ids.flatten().to_numpy(zero_copy_only=False).tolist()), ids.is_null().to_pylist()
            sizes = [n or 0 for n in ids.value_lengths().to_pylist()]
            got = pa.array([None if x else c.decode(itertools.islice(flat, n)) for x, n in zip(null, sizes, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out])

    return tokens.drop(out).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + f", `{out}` binary")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of documents (null: empty), last_start (the byte where the last token begins; null without tokens) and n_split (tokens that begin inside a character)."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = encode_with_offsets(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, P.PATTERN)
    last = tokens.select("doc_id", "ids", F.try_element_at("starts", F.lit(-1)).alias("last_start"), "n_split")
    return decode(last, path, P.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "last_start", "n_split"
    )
