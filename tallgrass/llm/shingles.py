"""Near duplicates by the Jaccard similarity of five-word shingles: fingerprints propose, an exact comparison of both shingle sets decides.

Texts with equal shingle sets are one node. Nodes are proposed to each other if they share a bucket: one of BANDS hashes of ROWS min-hashes each, or a group of SimHash fingerprints of the shingle
sets that a trie has linked within the Hamming budget (see simhash.py). A pair with similarity s misses all bands with probability (1 - s^ROWS)^BANDS, whatever the edit: 7 in 100,000 at 0.8.

A bucket is never taken on trust. HUBS times its members are compared with one of them, which then leaves the bucket; what is linked by then needs no further test, and a bucket of one component is done. What the rounds leave, members
of buckets that still hold several components, is joined by rare shingles: with shingles in one order for all sets, the frequent ones last, a larger set x and a smaller set y that reach the threshold share a shingle among the first
|x| - 0.8 |x| + 1 of x and the first |y| - 8/9 |y| + 1 of y, behind each of which enough shingles are left. So sets of one template whose own parts differ too much don't meet at all, and no pair that is alike is lost. Only names,
places and sizes are joined; whole sets move for pairs that pass, and every pair is tested exactly once a round. The components are those of all proposed pairs that reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_dir
from .components import connected
from .simhash import _LOWER, BROADCAST_ROWS, BUDGET, hamming_links

WIDTH = 5
#: The threshold as a fraction, so that comparisons are exact.
LIKE = 4, 5
BANDS, ROWS = 24, 5
#: Rounds in which every bucket compares its members with one of them; cells of the table that orders shingles by how frequent they are (4 MB, whatever the input).
HUBS, CELLS = 4, 1 << 20
_RNG = np.random.default_rng(42)
_XOR, _TIMES = (_RNG.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending. Fewer words than width: the whole sequence is the only shingle. No words: none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(s ^ (s >> np.uint64(31)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending sets reaches the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LIKE[1] >= LIKE[0] * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> tuple[int, int, int, list[int]]:
    """A set's name, size, SimHash and band hashes; zeros and no bands for the empty set."""
    if not len(s):
        return 0, 0, 0, []
    low, ones = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        low = np.minimum(low, ((part ^ _XOR) * _TIMES).min(axis=1))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bands = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)
    name = int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))
    return name, len(s), int(np.packbits(ones * 2 > len(s)).view(np.int64)[0]), bands.tolist()


def sketch_udf(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(shingle_set(t)) for t in texts], columns=["node", "size", "fp", "bands"])

    return F.pandas_udf(run, "node bigint, size int, fp bigint, bands array<bigint>")(text)


def set_udf(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def alike_udf(a: str, b: str) -> Column:
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xs, ys, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)


def _buckets(nodes: DataFrame, budget: int) -> DataFrame:
    """Rows (bucket, node, size) of every bucket that holds two nodes or more."""
    sizes = nodes.select("node", "size", "fp")
    prints = nodes.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("kind"), "fp").distinct()
    near = hamming_links(prints, budget=budget).checkpoint()
    same = nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("fp", F.col("fp").alias("b"))
    held = near.select(F.col("a").alias("fp"), "b").union(near.select(F.col("b").alias("fp"), "b")).union(same).distinct()
    tries = sizes.join(held, "fp").select(F.xxhash64(F.lit("simhash"), "b").alias("bucket"), "node", "size")
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "size").union(tries)
    wide = members.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("bucket")
    return members.join(wide, "bucket").distinct().checkpoint()


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (column s) fall into each of CELLS cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for b in batches:
            for s in b.column(0):
                np.add.at(total, _cells(np.frombuffer(s.as_buffer(), np.uint64)), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell], pa.int64())], names=["cell", "n"])

    found = sets.select("s").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out = np.zeros(CELLS, np.int32)
    out[found.column("cell").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.int32).max)
    return out


def rare_prefix(s: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, in order, of which a set that is alike and not larger has one, and how many of them a set that is alike and not smaller has one of."""
    n = len(s)
    first = n - -(-LIKE[0] * n // LIKE[1]) + 1
    among = n - -(-2 * LIKE[0] * n // (LIKE[0] + LIKE[1])) + 1
    return s[np.lexsort((s, frequency[_cells(s)]))[:first]], among


def _rare_pairs(rest: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Pairs of the rest (node, label, s) that may be alike and have different labels: a, b, la, lb."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [(*rare_prefix(s, frequency), len(s)) for s in (np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("s"))]
            for at in range(0, len(parts), 500):
                some = parts[at : at + 500]
                k = [len(p) for p, _, _ in some]
                place = np.concatenate([np.arange(n) for n in k]) if k else np.zeros(0, np.int64)
                cols = [np.repeat(np.asarray(b.column(c))[at : at + 500], k) for c in ("node", "label")] + [np.concatenate([p for p, _, _ in some]).view(np.int64), np.repeat([n for _, _, n in some], k), place, place < np.repeat([m for _, m, _ in some], k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["node", "label", "shingle", "size", "place", "low"])

    each = rest.select("node", "label", "s").mapInArrow(prefixes, "node bigint, label bigint, shingle bigint, size int, place int, low boolean")
    common = each.groupBy("shingle").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("shingle")
    each = each.join(common, "shingle").checkpoint()
    x = each.select("shingle", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("size").alias("nx"), F.col("place").alias("px"))
    y = each.where("low").select("shingle", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("size").alias("ny"), F.col("place").alias("py"))
    left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))  # as many shingles at most can still be common
    enough = left * (LIKE[0] + LIKE[1]) >= LIKE[0] * (F.col("nx") + F.col("ny"))
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    met = x.join(y, "shingle").where(larger & (F.col("lx") != F.col("ly")) & (F.col("ny") * LIKE[1] >= F.col("nx") * LIKE[0]) & enough)
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("lx").alias("la"), F.col("ly").alias("lb"), F.col("nx").alias("na"), F.col("ny").alias("nb"))


def near_classes(docs: DataFrame, *, id_col: str, text_col: str, budget: int = BUDGET, hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, node), one for each row of docs, and roots (node, root), for all nodes that share a bucket with another."""
    shared_dir(docs.sparkSession)
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), sketch_udf(text).alias("s")).select("id", "digest", "s.*").checkpoint()
    rows = found.select("id", "digest", "node")
    members = _buckets(found.where("size > 0").select("node", "size", "fp", "bands").dropDuplicates(["node"]).checkpoint(), budget)
    if members.isEmpty():
        return rows, rows.select("node", F.col("node").alias("root")).limit(0)
    one = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("best"))
    one = one.select(F.col("node").alias("node_"), F.col("best.id").alias("id_"), F.col("best.digest").alias("digest_")).checkpoint()
    one = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one  # then only the texts that are asked for leave their tasks
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    sets = texts.join(one, F.col("id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("digest_"))).dropDuplicates(["node_"]).select("node_", set_udf(F.col("text")).alias("s")).checkpoint()

    def tested(pairs: DataFrame) -> DataFrame:
        """Links (la, lb) between the labels of those pairs that are alike; each pair is compared once."""
        likely = pairs.where(F.least("na", "nb") * LIKE[1] >= F.greatest("na", "nb") * LIKE[0])
        both = F.array_sort(F.array(F.struct(F.col("a").alias("node"), F.col("la").alias("label")), F.struct(F.col("b").alias("node"), F.col("lb").alias("label"))))
        once = likely.select(both.alias("p")).select(F.col("p")[0]["node"].alias("a"), F.col("p")[1]["node"].alias("b"), F.col("p")[0]["label"].alias("la"), F.col("p")[1]["label"].alias("lb")).dropDuplicates(["a", "b"])
        met = once.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        return met.where(alike_udf("sa", "sb")).select("la", "lb").distinct().checkpoint()

    def renamed(df: DataFrame, roots: DataFrame) -> DataFrame:
        return df.join(roots.toDF("label", "root"), "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")

    mark = F.xxhash64("node")
    alone = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y")).groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    named = members.join(alone, "bucket").select("bucket", "node", "size", F.col("node").alias("label")).checkpoint()  # of buckets with the same members one is enough
    labels = named.select("node", "label").distinct().checkpoint()
    for turn in range(hubs):
        hub = named.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min_by(F.struct("node", "size", "label"), F.xxhash64("node", F.lit(turn))).alias("hub")).where("l0 <> l1")
        open_ = named.join(hub.select("bucket", F.col("hub.node").alias("b"), F.col("hub.size").alias("nb"), F.col("hub.label").alias("lb")), "bucket").where("node <> b").checkpoint()
        if open_.isEmpty():
            named = open_.select("bucket", "node", "size", "label")
            break
        links = tested(open_.where("label <> lb").select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("label").alias("la"), "b", "nb", "lb"))
        named = open_.select("bucket", "node", "size", "label")
        if not links.isEmpty():
            roots = connected(links, "la", "lb")
            named, labels = renamed(named, roots), renamed(labels, roots).checkpoint()
        named = named.checkpoint()
    mixed = named.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("bucket")
    rest = named.join(mixed, "bucket", "left_semi").select("node", "label").distinct().join(sets.withColumnRenamed("node_", "node"), "node").checkpoint()
    if not rest.isEmpty():
        links = tested(_rare_pairs(rest, frequencies(rest)))
        if not links.isEmpty():
            labels = renamed(labels, connected(links, "la", "lb")).checkpoint()
    return rows, labels.select("node", F.col("label").alias("root"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs that stay if one document of each component does: the one with the smallest id (null last; ties by a hash of the text).

    Documents are linked if the Jaccard similarity of their five-word shingles is 0.8 at least; texts without words are one component.
    All columns of docs are kept. Rows equal in id and text are one document, of which one row stays.
    """
    rows, roots = near_classes(docs, id_col=id_col, text_col=text_col, budget=budget)
    rank = F.struct(F.col("id").isNull(), "id", "digest")
    least = rows.groupBy("node").agg(F.min(rank).alias("best")).join(roots, "node", "left")
    best = least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    keep_id, keep_digest = fresh(docs, "_keep_id"), fresh(docs, "_keep_digest")
    keep = best.select(F.col("best.id").alias(keep_id), F.col("best.digest").alias(keep_digest))
    kept = docs.join(keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.xxhash64(F.col(text_col)) == F.col(keep_digest)))
    return kept.dropDuplicates([keep_id, keep_digest]).drop(keep_id, keep_digest)
