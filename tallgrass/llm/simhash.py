"""SimHash fingerprints, linked within a Hamming budget by a self-join of binary tries.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word shingles. Two fingerprints link if they differ in at most `budget` bits. Then they
agree on at least one of budget + 1 blocks of bits, so every distinct fingerprint is dealt once for each block, with the bits arranged so that this block stands
first: fingerprints with one block value are the leaves of one trie. (Of very many fingerprints two of budget + 2 blocks stand first, which agree as surely and are shared by fewer.) The self-join descends through pairs of nodes of that trie
together, adds up the bits in which their paths differ, and leaves a pair as soon as the sum exceeds the budget. What it finds is reduced at once to a spanning
forest, at most one link per leaf, so that a dense group never gives all its pairs.

Equal fingerprints are merged before any of this, so exact copies cost nothing. A block value with more than CHUNK fingerprints is cut into chunks by a hash, and every
two chunks are joined in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, shared_dir
from .components import connected

WIDTH, BITS, BUDGET = 3, 64, 3
#: Most kinds of fingerprints that are joined at once.
TABLES = 16
#: Most fingerprints of one block value in a task, from each of the two chunks that meet there.
CHUNK = 8192
#: Up to so many fingerprints one block stands first, beyond it two do; both find the same links. Dealt rows for each task on average.
ONE_BLOCK, TASK_ROWS = 1 << 28, 500_000
#: Tables of block values or ids are sent to all executors up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 500_000
#: Node pairs that are handled at once, and the product of node sizes below which leaves are compared directly.
FRONTIER, DIRECT = 1 << 18, 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit integer. No words, empty and null texts: 0. Fewer words than width: the whole sequence is the only shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    n = len(starts)
    hashes = np.fromiter((digest(view[i:j], 42) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # a long text is counted piece by piece
        ones += np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def simhash_udf(width: int):
    """Texts to fingerprints over word shingles of a width."""

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return F.pandas_udf(prints, "bigint")


class Forest:
    """Disjoint sets over 0 to n-1, merged in batches."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(s, r):
                self.up[x] = r
                return r
            r = s

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b = ra[apart], rb[apart]
            self.up[np.maximum(a, b)] = np.minimum(a, b)


def trie_links(keys: np.ndarray, group: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """For each leaf the smallest index of the leaves that are linked to it, directly or through others of its group.

    keys (unsigned, equal in their upper bits above `bits` within a group) ascend within each group, and groups are contiguous. A node is a range of leaves; a pair
    of nodes is (lo, hi, lo, hi, differing bits so far, bits still below).
    """
    n = len(keys)
    sets = Forest(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    last = np.append(first[1:], n)
    wide = last - first > 1
    stack = [np.stack([first[wide], last[wide], first[wide], last[wide], np.zeros(wide.sum(), np.int64), np.full(wide.sum(), bits)], axis=1)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [pairs[FRONTIER:]]
            pairs = pairs[:FRONTIER]
        sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (sizes <= DIRECT) | (pairs[:, 5] == 0)
        near = pairs[small]
        if len(near):
            count, across = sizes[small], near[:, 3] - near[:, 2]
            which = np.repeat(np.arange(len(near)), count)
            within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            a, b = near[which, 0] + within // across[which], near[which, 2] + within % across[which]
            hit = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            sets.merge(a[hit], b[hit])
        far = pairs[~small]
        if not len(far):
            continue
        below = far[:, 5] - 1
        cut_a, cut_b = _cuts(keys, far[:, 0], far[:, 1], below), _cuts(keys, far[:, 2], far[:, 3], below)
        alike = (far[:, 0] == far[:, 2]) & (far[:, 1] == far[:, 3])
        d = far[:, 4]
        down = [
            (far[:, 0], cut_a, far[:, 2], cut_b, d, below),
            (cut_a, far[:, 1], cut_b, far[:, 3], d, below),
            (far[:, 0], cut_a, cut_b, far[:, 3], d + 1, below),
            (cut_a, far[:, 1], far[:, 2], cut_b, np.where(alike, budget + 1, d + 1), below),  # of a node with itself once
        ]
        below_all = np.concatenate([np.stack(x, axis=1) for x in down])
        keep = (below_all[:, 4] <= budget) & (below_all[:, 0] < below_all[:, 1]) & (below_all[:, 2] < below_all[:, 3])
        keep &= ~((below_all[:, 0] == below_all[:, 2]) & (below_all[:, 1] == below_all[:, 3]) & (below_all[:, 1] - below_all[:, 0] == 1))
        if keep.any():
            stack.append(below_all[keep])
    return sets.root(np.arange(n))


def _cuts(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each range lo to hi the leaves with the given bit set begin: a binary search over all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        bits = (keys[np.minimum(mid, len(keys) - 1)] >> bit.astype(np.uint64)) & one
        hi = np.where(open_ & (bits == 1), mid, hi)
        lo = np.where(open_ & (bits == 0), mid + 1, lo)
    return lo


def _arranged(budget: int, picked: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of `picked` of budget + picked blocks: all blocks as (lowest bit, width), the chosen first, and the width of the chosen together."""
    edge = [BITS * i // (budget + picked) for i in range(budget + picked + 1)]
    blocks = [(BITS - b, b - a) for a, b in zip(edge, edge[1:], strict=False)]
    out = []
    for chosen in combinations(range(len(blocks)), picked):
        rest = [k for k in range(len(blocks)) if k not in chosen]
        out.append(([blocks[k] for k in (*chosen, *rest)], sum(blocks[k][1] for k in chosen)))
    return out


def _link_partition(budget: int, picked: int = 1):
    arranged = _arranged(budget, picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        fp, node = t["fp"].to_numpy().astype(np.int64).view(np.uint64), t["node"].to_numpy()
        task, block = t["task"].to_numpy() * TABLES + t["kind"].to_numpy(), t["block"].to_numpy()
        for k, (parts, width) in enumerate(arranged):
            mine = np.flatnonzero(block == k)
            if not len(mine):
                continue
            x = fp[mine]
            key = np.zeros(len(x), np.uint64)
            for low, wide in parts:
                key = key << np.uint64(wide) | (x >> np.uint64(low)) & np.uint64((1 << wide) - 1)
            order = np.lexsort((key, key >> np.uint64(BITS - width), task[mine]))
            name, key, part = node[mine][order], key[order], task[mine][order]
            value = key >> np.uint64(BITS - width)
            new = np.concatenate(([True], (value[1:] != value[:-1]) | (part[1:] != part[:-1])))
            root = trie_links(key, np.cumsum(new), BITS - width, budget)
            joined = np.flatnonzero(root != np.arange(len(root)))
            for at in range(0, len(joined), 100_000):
                j = joined[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(name[j]), pa.array(name[root[j]])], names=["a", "b"])

    return run


def hamming_links(prints: DataFrame, *, budget: int = BUDGET, chunk: int = CHUNK, picked: int | None = None) -> DataFrame:
    """Links (a, b) between nodes: their components are those of all pairs of nodes with fingerprints of one kind within the budget.

    prints has a row (node, kind, fp) for each fingerprint of a node, all longs, kind from 0 to TABLES - 1; rows must be distinct. Any two nodes within the budget, unless their fingerprints are
    equal, are both linked to one b or are a link themselves. picked is the number of blocks that stand first (by default as many as the number of fingerprints asks for).
    """
    least = prints.groupBy("kind", "fp").agg(F.min("node").alias("node"), F.max("node").alias("most")).checkpoint()  # equal fingerprints never meet in a task
    n = least.count()
    picked = picked or (1 if n <= ONE_BLOCK else 2)
    arranged = _arranged(budget, picked)

    def value(parts: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for low, wide in parts[:picked]:
            out = F.shiftleft(out, wide).bitwiseOR(F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << wide) - 1)))
        return out

    several = least.where("node <> most").select("kind", "fp", F.col("node").alias("b"))
    equal = None if several.isEmpty() else prints.join(several, ["kind", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b")
    dealt = least.select("node", "kind", "fp", F.posexplode(F.array(*[value(parts) for parts, _ in arranged])).alias("block", "value"))
    crowded = dealt.groupBy("kind", "block", "value").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("kind", "block", "value", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")).checkpoint()
    n_crowded = crowded.count()
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    code = lambda i, j: F.least(i, j) * F.col("chunks") + F.greatest(i, j)
    tasks = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda j: j != mine), lambda j: code(mine, j))
    )
    if n_crowded == 0:  # as it is mostly: then no row needs to look its block value up
        looked_up = dealt.withColumn("chunks", F.lit(None).cast("int"))
    else:
        looked_up = dealt.join(F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded, ["kind", "block", "value"], "left")
    spread = looked_up.select("node", "kind", "fp", "block", "value", F.explode(tasks).alias("task"))
    tasks_ = max(partitions(prints.sparkSession), -(-n * len(arranged) // TASK_ROWS))
    near = spread.repartition(tasks_, "kind", "block", "value", "task").select("node", "kind", "fp", "block", "task").mapInArrow(_link_partition(budget, picked), "a bigint, b bigint")
    return near if equal is None else near.union(equal)


def near_groups(docs: DataFrame, *, id_col: str, text_col: str, width: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), one for each row of docs, and roots (fp, root), one for each distinct fingerprint; rows are written to the shared folder."""
    shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), simhash_udf(width)(F.col(text_col)).alias("fp")).checkpoint()
    nodes = rows.select("fp").distinct()
    roots = connected(hamming_links(nodes.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("kind"), "fp"), budget=budget))
    return rows, nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """Returns id_col, fingerprint (16 lowercase hex digits) and component_id (the smallest id that links reach, the row's own included), one row per row of docs.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null id get the smallest id of their component, null if it has none.
    Repeated rows are one class. Other columns of docs are ignored. An empty table gives an empty result.
    """
    rows, roots = near_groups(docs, id_col=id_col, text_col=text_col, width=width, budget=budget)
    least = rows.groupBy("fp").agg(F.min("id").alias("id")).join(roots, "fp")
    named = least.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay if one document of each group of near duplicates does; see shingles.one_of_each."""
    from .shingles import one_of_each as of_each  # which builds on this module

    return of_each(docs, id_col=id_col, text_col=text_col, budget=budget)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of documents, as near_components gives them for three-word shingles and 3 bits."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
