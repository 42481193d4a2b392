"""One-permutation MinHash fingerprints of word shingles.

Every shingle is hashed once. The top bits of the hash choose one of BINS bins, and a bin keeps its smallest hash. An empty bin takes the value of the first
occupied bin on its own fixed random walk over all bins (optimal densification), so that two texts agree on a bin with a probability equal to
their Jaccard similarity. Only the low BITS bits of each bin are stored; two unrelated values then agree by chance once in 2**BITS, which likeness() corrects.

All of it is array functions on the row itself: nothing is shuffled to fingerprint a text, and a very long text is one array.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, partitions

SHINGLE, BINS, BITS, SEED = 5, 128, 8, 20240229
#: Steps of a bin's walk that are tried before the whole walk is.
FIRST_STEPS = 8
#: with_next: bytes of a range on average, ranges for each partition at least, and ranges that are cut at once; more are cut within these.
RANGE_BYTES, PER_PARTITION, CUT_AT_ONCE = 64 << 20, 16, 4096
SPACE = r"[\x20\x09-\x0D]+"


def _walks(bins: int, seed: int) -> tuple[list[int], list[int]]:
    """Start and odd step of each bin's walk; as bins is a power of two, a walk visits every bin once."""
    rng = random.Random(seed)
    return [rng.randrange(bins) for _ in range(bins)], [rng.randrange(1, bins, 2) for _ in range(bins)]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of width words; of the whole text if it has fewer words; none if it has no word."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        return (
            F.when(n >= width, F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))
            .when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def fingerprint(text: Column, *, width: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = SEED) -> Column:
    """Lowercase hex of bins values of bits bits each (a multiple of 4); empty for null and for a text without words."""
    if bins & (bins - 1) or bits % 4 or not 4 <= bits <= 32:
        raise ValueError("bins must be a power of two, bits 4 to 32 in steps of 4")
    shift = 64 - (bins.bit_length() - 1)
    starts, steps = (F.lit(x) for x in _walks(bins, seed))

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    #: The largest hash of each bin stands for an empty one: sorted together with the hashes, every bin has a smallest.
    fillers = [signed((k << shift) | ((1 << shift) - 1)) for k in range(bins)]

    def of(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift)

    def minima(h: Column) -> Column:
        """The smallest hash of each bin, null where there is none. As hashes are signed, the upper half of the bins is sorted before the lower."""
        s = F.sort_array(F.concat(h, F.lit(fillers).cast("array<bigint>")))
        heads = let(s, lambda s: F.filter(s, lambda x, i: (i == 0) | (of(x) != of(F.get(s, i - 1)))))
        half = bins // 2
        return let(heads, lambda m: F.transform(F.concat(F.slice(m, half + 1, bins - half), F.slice(m, 1, half)), lambda x, i: F.nullif(x, F.get(F.lit(fillers).cast("array<bigint>"), i))))

    def seen(m: Column, i: Column, walk: int) -> Column:
        ahead = F.transform(F.sequence(F.lit(0), F.lit(walk - 1)), lambda a: F.get(m, (F.get(starts, i) + a * F.get(steps, i)).bitwiseAND(F.lit(bins - 1))))
        return F.get(F.filter(ahead, lambda x: x.isNotNull()), F.lit(0))

    def filled(m: Column) -> Column:
        return F.transform(m, lambda v, i: F.coalesce(v, seen(m, i, FIRST_STEPS), seen(m, i, bins)))

    def packed(m: Column) -> Column:
        low = lambda v: v.bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1 << bits)  # noqa: E731  the leading 1 keeps the zeros
        return F.lower(F.array_join(F.transform(filled(m), lambda v: F.substring(F.hex(low(v)), 2, bits // 4)), ""))

    return let(shingle_hashes(text, width), lambda h: F.when(F.size(h) == 0, F.lit("")).otherwise(let(minima(h), packed)))


def likeness(a: Column, b: Column, *, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimate of the Jaccard similarity of two texts from their fingerprints, corrected for values that agree by chance.

    Two texts without words are alike (1.0), one without words is unlike any with (0.0).
    """
    size, chance = bits // 4, 2.0**-bits
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * size + 1, F.lit(size)) == F.substr(b, i * size + 1, F.lit(size))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (agree / bins - chance) / (1 - chance)))


def _place(cuts: Column, n: int, key: Column) -> Column:
    """How many of at most n ascending cuts are at or below the key, found by halving."""
    steps = F.lit([1 << b for b in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, half: F.when(F.get(cuts, at + half - 1) <= key, at + half).otherwise(at))


def with_next(df: DataFrame, order: str, values: list[str], *, weigh: list[str] | None = None, range_bytes: int = RANGE_BYTES, at_once: int = CUT_AT_ONCE) -> DataFrame:
    """Adds next_<value>: the values (strings) of the row that follows in ascending order (a long; nulls first; ties by a hash of the values); after the last comes the first.

    Columns of these names are replaced. The rows are dealt into ranges, so many as their bytes ask for, each a window of its own. The first row of every range is dealt to the end of the range before it too,
    so that no range needs another. Up to at_once ranges are cut by quantiles of all rows; of more, each of these is cut again by quantiles of its own. Tables of ranges are broadcast: a row for
    range_bytes bytes of values. Rows with one order value lie in one range. weigh names the values whose bytes count, as those that are costly to compute may be left out.
    """
    key, kind = F.col(order), df.schema[order].dataType
    at, copied, to, first, before, inner = (fresh(df, c) for c in ("_range", "_copied", "_to", "_first", "_before", "_inner"))
    size = sum((F.coalesce(F.octet_length(v), F.lit(0)) for v in weigh or values), F.lit(0).cast("long"))
    seen = df.agg(F.sum(size), F.percentile_approx(order, [i / at_once for i in range(1, at_once)], 4 * at_once)).first()
    n = max(2, PER_PARTITION * partitions(df.sparkSession), -(-(seen[0] or 0) // range_bytes))
    outer = min(n, at_once)
    grid = seen[1] or []
    cuts = sorted({grid[i * at_once // outer - 1] for i in range(1, outer)}) if grid else []
    ranged = df.withColumn(at, F.when(key.isNull(), F.lit(-1)).otherwise(_place(F.lit(cuts), len(cuts), key) if cuts else F.lit(0)).cast("long"))
    if n > outer:
        m = -(-n // outer)
        inside = ranged.groupBy(at).agg(F.percentile_approx(order, [i / m for i in range(1, m)], max(10_000, 4 * m)).alias(inner))
        ranged = ranged.join(F.broadcast(inside), at).withColumn(at, F.col(at) * m + F.when(key.isNull(), F.lit(0)).otherwise(_place(F.col(inner), m - 1, key))).drop(inner)
    bounds = ranged.groupBy(at).agg(F.min(order).cast(kind).alias(first))  # a row for each range
    bounds = bounds.withColumn(before, F.coalesce(F.lag(at).over(Window.orderBy(at)), F.max(at).over(Window.partitionBy())))
    here = F.struct(F.col(at).alias("range"), F.lit(False).alias("copied"))
    copies = F.when(key.eqNullSafe(F.col(first)), F.array(here, F.struct(F.col(before).alias("range"), F.lit(True).alias("copied")))).otherwise(F.array(here))
    dealt = ranged.join(F.broadcast(bounds), at).withColumn(to, F.explode(copies)).withColumn(at, F.col(to)["range"]).withColumn(copied, F.col(to)["copied"]).drop(to, first, before)
    along = Window.partitionBy(at).orderBy(copied, F.asc_nulls_first(order), F.xxhash64(*values))
    return dealt.withColumns({f"next_{v}": F.lead(v).over(along) for v in values}).where(~F.col(copied)).drop(at, copied)


def op8_oph_minhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprints of every whole text of documents (null: empty) and of its edited text, and their likenesses, as its contract says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", ["text", "fingerprint"], weigh=["text"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"),
    )
    printed = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
