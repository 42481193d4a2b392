"""Best-fit packing of documents into sequences of a fixed length, with conflicts.

Documents of one source, or of one cluster of duplicates, never share a sequence. Bins are kept in the order of their residual space and carry a bitmap of their sources and one
of their clusters; a document goes to the tightest bin that has room and no conflict: the search begins at the first bin with room and goes on to its successors until
one is compatible. Documents come in descending order of length.

The rows are dealt into groups of about GROUP by a hash, and each group is packed by itself as its rows stream by, so that neither a hot source nor a large cluster meets in one
task and memory is bounded. Equal rows are counted first and get numbers, which the hash takes in, so that copies of one row are dealt to all groups too.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

CAPACITY, GROUP = 2048, 4096
#: Bin numbers: the group times this, plus the bin's number within the group.
BINS = 1 << 24


class Bins:
    """Open bins, tightest first."""

    def __init__(self, first: int):
        self.next, self.order = first, []  # (residual, bin)
        self.sources: dict[int, int] = {}
        self.clusters: dict[int, int] = {}
        self.bit: dict = {}

    def _mask(self, kind: str, value) -> int:
        return 0 if value is None else 1 << self.bit.setdefault((kind, value), len(self.bit))

    def place(self, need: int, capacity: int, source, cluster) -> tuple[int, int]:
        """Bin and offset of a document that needs at most capacity."""
        s, c = self._mask("s", source), self._mask("c", cluster)
        order, sources, clusters = self.order, self.sources, self.clusters
        at, end = bisect_left(order, (need, -1)), len(order)
        while at < end and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < end:
            residual, b = order.pop(at)
        else:
            residual, b = capacity, self.next
            self.next += 1
            sources[b] = clusters[b] = 0
        if residual > need:
            sources[b] |= s
            clusters[b] |= c
            insort(order, (residual - need, b))
        else:
            del sources[b], clusters[b]
        return b, capacity - residual


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for i, (doc_id, length, source, cluster, mine) in enumerate(zip(*cols, strict=True)):
                if mine != group:
                    group, bins = mine, Bins(mine * BINS)
                whole, rest = divmod(length, capacity)
                for piece in range(whole):
                    out.append((doc_id, piece, bins.next, 0, capacity))
                    bins.next += 1
                if rest or not whole:
                    at, offset = bins.place(rest, capacity, source, cluster)
                    out.append((doc_id, whole, at, offset, rest))
                if len(out) >= 10_000:
                    yield _batch(out, b.schema.field(0).type)
                    out = []
            if out:
                yield _batch(out, b.schema.field(0).type)

    def _batch(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "piece", "bin", "start", "n_tokens"])

    return run


def pack(docs: DataFrame, length: Column, *, id_col: str = "doc_id", source: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Returns id_col, piece, bin, start and n_tokens: where in which sequence each document, or each piece of a document longer than capacity, lies.

    length (null: 0) is in tokens. The full pieces of a long document fill bins of their own, the rest of it is packed as a document is. A document of length 0 takes no room but has a
    place. A null source or cluster conflicts with none. The order in a group is: longest first, then by id, cluster and source; equal rows are placed one by one. Rows with null ids are
    packed too. Bins are numbered without meaning. Other columns of docs are ignored; an empty table gives an empty result.
    """
    none = F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        (source if source is not None else none).cast("string").alias("source"), (cluster if cluster is not None else none).cast("string").alias("cluster"),
    )
    groups = max(1, -(-docs.count() // group))
    counted = rows.groupBy("id", "length", "source", "cluster").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    dealt = counted.select("id", "length", "source", "cluster", F.pmod(F.xxhash64("id", "length", "source", "cluster", "copy"), F.lit(groups)).alias("group"))
    ordered = dealt.repartition(partitions(docs.sparkSession), "group").sortWithinPartitions("group", F.desc("length"), "id", "cluster", "source")
    kind = docs.schema[id_col].dataType.simpleString()
    return ordered.mapInArrow(_pack(capacity), f"id {kind}, piece int, bin bigint, start int, n_tokens int").withColumnRenamed("id", id_col)


def bins(packed: DataFrame) -> DataFrame:
    """The sequences: bin, n_docs and used tokens; none for an empty table."""
    return packed.groupBy("bin").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("used"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packs documents by their words and an end mark; sources must not meet, nor equal texts."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    return pack(docs, words, source=F.col("source"), cluster=F.xxhash64(F.coalesce("text", F.lit(""))))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, bin, start and n_tokens of every document in sequences of 2,048 words and end marks."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
