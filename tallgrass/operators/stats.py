"""Paired comparisons and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh
from .ordered import numbered, running


#: Abramowitz and Stegun, 26.2.17: the upper tail of the normal distribution, to 7.5e-8; fixed values.
_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """The probability that a standard normal value is greater than z, for z of 0 or more."""
    t = 1 / (1 + 0.2316419 * z)
    series = F.lit(0.0)
    for c in reversed(_TAIL):
        series = (series + c) * t
    return F.exp(-z * z / 2) / 2.5066282746310002 * series


def rank_sum_tail(doubled: Column, most: Column) -> Column:
    """The share of all choices of signs under which the doubled ranks (an array of ints, halves being whole) with a plus sum up to `most` at most: the number of choices of each sum is folded rank by rank."""
    total = F.aggregate(doubled, F.lit(0), lambda a, r: a + r)
    start = F.transform(F.sequence(F.lit(0), total), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(doubled, start, lambda ways, r: F.transform(ways, lambda w, s: w + F.when(s >= r, F.get(ways, s - r)).otherwise(0.0)))
    return F.aggregate(F.slice(counts, F.lit(1), most + 1), F.lit(0.0), lambda a, w: a + w) / F.pow(F.lit(2.0), F.size(doubled))


def wilcoxon(pairs: DataFrame, group: str, a: str, b: str, *, exact: int = 50) -> DataFrame:
    """Signed-rank sums, normal z, two-sided p and Cohen's d of paired values in each group; differences of zero are left out, equal sizes share their mean rank.

    p comes from the distribution of the rank sums themselves up to `exact` differences, with half ranks for ties, and from z beyond. Ranks are counted over ranges, so that a group of any size is spread over tasks.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, (F.col(a) - F.col(b)).alias("d"))
    size = rows.where("d <> 0").groupBy(group, F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    ranked = running(size, [group], ["m"], F.col("n"), before="_before", total="_all").withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2)
    few = F.when(F.col("_all") <= exact, F.array_repeat((2 * F.col("rank")).cast("int"), F.col("n").cast("int")))
    sums = ranked.groupBy(group).agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"),
        F.flatten(F.collect_list(few)).alias("ranks"),
    )
    n, least = F.col("n"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.when(spread > 0, (least - n * (n + 1) / 4) / spread)
    p = F.least(F.lit(1.0), 2 * F.when(n <= exact, rank_sum_tail(F.col("ranks"), (2 * least).cast("int"))).otherwise(normal_tail(F.abs(z))))
    d = rows.groupBy(group).agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    return sums.join(d, group).select(group, "n", "w_plus", "w_minus", z.alias("z"), p.alias("p"), "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).alias("cohen_d"))


def bootstrap_mean(df: DataFrame, group: str, item: str, value: str, *, rounds: int = 200, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval of each group's mean under resampling: in each round an item counts Poisson(1) times, by a hash of group, item and round, so that no group is gathered."""
    u = (F.pmod(F.xxhash64(group, item, "round", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k + 1
    drawn = df.where(F.col(value).isNotNull()).select(group, item, value, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    means = drawn.groupBy(group, "round").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    found = means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return df.groupBy(group).agg(F.avg(value).alias("mean")).join(found, group)


def quota_split(df: DataFrame, strata: list[str], order: list, shares: dict[str, float], out: str = "split", *, least: int = 0) -> DataFrame:
    """Deals each stratum in order into splits by cumulative shares, rounded half to even, so that what one split is short of goes to the next; the first split gets `least` rows of every stratum at least. Places are counted over
    ranges, so a stratum may be of any size; order holds names and columns."""
    names = {fresh(df, f"_order{i}"): o for i, o in enumerate(order) if not isinstance(o, str)}
    place, size = fresh(df, "_rank"), fresh(df, "_n")
    columns = iter(names)
    placed = numbered(df.withColumns(names) if names else df, strata, [o if isinstance(o, str) else next(columns) for o in order], number=place, size=size).drop(*names)
    column, total = None, 0.0
    for name, share in shares.items():
        total += share
        most = F.bround(F.col(size) * F.lit(round(total, 9)), 0)
        hit = F.col(place) <= (F.greatest(most, F.lit(least)) if column is None and least else most)
        column = F.when(hit, name) if column is None else column.when(hit, name)
    return placed.withColumn(out, column.otherwise(list(shares)[-1])).drop(place, size)


