"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to 2**bits order-preserving bins at its quantiles, so that a cell of the grid is a box of metadata values. The cells
are ordered by their index on the Hilbert curve and the sequence of rows is cut into runs of equal length: each shard then covers a compact box, and a reader
that filters on any of the dimensions can skip most shards by their minima and maxima.

A row's place is (start of its cell) + (start of its salt within the cell) + (its number within the salt). Cells and salts are counted, not sorted, and equal rows are one row with a count, so no
task holds all rows, all rows of a hot cell or all copies of a row: a cell with a share s of all rows is spread over about s * SPREAD salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, shared_dir

#: Salts over all cells; the tables of cells and salts that are broadcast have at most 2**(bits * dimensions) + SPREAD rows.
SPREAD = 16_384
MAX_CELLS = 1 << 16


def string_cuts(df: DataFrame, columns: dict[str, Column], bits: int) -> dict[str, list[str]]:
    """For each string column its values at the quantiles k / 2**bits, in the order of whole strings.

    Distinct values are counted, dealt into ranges, and added up range by range, so that a column may have any number of them; the cuts alone come to the driver.
    """
    if not columns:
        return {}
    each = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("dim"), c.alias("value")) for k, c in columns.items()])))
    ranged = each.groupBy("dim", "value").agg(F.count("*").alias("n")).repartitionByRange("dim", "value").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = ranged.groupBy("dim", "part").agg(F.sum("n").alias("all"))  # a row for each range
    along, whole = Window.partitionBy("dim").orderBy("part"), Window.partitionBy("dim")
    before = parts.select("dim", "part", (F.sum("all").over(along) - F.col("all")).alias("before"), F.sum("all").over(whole).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("dim", "part").orderBy("value"))
    placed = ranged.join(F.broadcast(before), ["dim", "part"]).select("dim", "value", "n", "total", upto.alias("upto"))
    share = lambda c: F.floor(c * (1 << bits) / F.col("total"))
    found = placed.select("dim", "value", share(F.col("upto") - F.col("n")).alias("low"), F.least(share(F.col("upto")), F.lit((1 << bits) - 1)).alias("high")).where("low < high").collect()
    return {k: sorted(r["value"] for r in found if r["dim"] == k for _ in range(r["low"], r["high"])) for k in columns}


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Skilling's transform of grid coordinates to the index on the Hilbert curve, as a fold over (bit, axis) steps."""
    n, top = len(axes), 1 << (bits - 1)

    def step(x: Column, s: Column) -> Column:
        q, i = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        p, head, mine = q - 1, F.get(x, F.lit(0)), F.get(x, i)
        swap = head.bitwiseXOR(mine).bitwiseAND(p)
        return F.transform(
            x,
            lambda v, j: F.when(mine.bitwiseAND(q) != 0, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)),
        )

    turns = F.array(*[F.array(F.lit(top >> b), F.lit(i)) for b in range(bits - 1) for i in range(n)]) if bits > 1 else F.array().cast("array<array<int>>")
    turned = F.aggregate(turns, F.array(*[a.cast("int") for a in axes]), step)
    gray = F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, F.lit(1), j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def finish(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        flip = reduce(lambda t, b: t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))), range(1, bits), F.lit(0))
        spread = [
            F.shiftleft(F.shiftright(F.get(g, F.lit(i)).bitwiseXOR(flip), b).bitwiseAND(F.lit(1)).cast("long"), b * n + (n - 1 - i))
            for b in range(bits)
            for i in range(n)
        ]
        return reduce(lambda a, b: a + b, spread)

    return F.get(F.transform(F.array(gray), finish), F.lit(0))


def hilbert_shards(df: DataFrame, dims: dict[str, Column], *, id_col: str = "doc_id", keep: dict[str, Column] | None = None, n_shards: int = 16, bits: int = 4) -> DataFrame:
    """Returns id_col, the keep columns, curve (index of the row's cell), shard and slot for each row of df.

    Law rows: shard sizes differ by one row at most; slot counts from 0 within a shard without gaps. dims are numeric or string columns (strings compare as a whole); null sorts before
    all values, as the empty string does. Rows of one cell are ordered by a hash of the id and the keep columns, then by themselves; rows equal in them are
    interchangeable. An empty table gives an empty result. Columns of df that are not named are ignored.
    """
    if (1 << (bits * len(dims))) > MAX_CELLS or n_shards < 1:
        raise ValueError("2 ** (bits * dimensions) cells must not exceed 65,536, and there must be a shard")
    shared_dir(df.sparkSession)
    kinds = dict(df.select(*[c.alias(k) for k, c in dims.items()]).dtypes)
    keys = {k: F.coalesce(c, F.lit("")) if kinds[k] == "string" else c.cast("double") for k, c in dims.items()}
    numbers = {k: c for k, c in keys.items() if kinds[k] != "string"}
    cuts = string_cuts(df, {k: c for k, c in keys.items() if kinds[k] == "string"}, bits)
    if numbers:
        at = [i / (1 << bits) for i in range(1, 1 << bits)]
        got = df.agg(*[F.percentile_approx(c, at, 10_000).alias(f"_d{i}") for i, c in enumerate(numbers.values())]).first()
        cuts |= {k: got[i] or [] for i, k in enumerate(numbers)}

    axes, kept = [f"_a{i}" for i in range(len(keys))], {k: f"_k{i}" for i, k in enumerate(keep or {})}
    binned = [reduce(lambda a, b: a + b, [F.coalesce((c > F.lit(x)).cast("int"), F.lit(0)) for x in cuts[k]], F.lit(0)).alias(axes[i]) for i, (k, c) in enumerate(keys.items())]
    named = df.select(F.col(id_col).alias("_id"), *[c.alias(kept[k]) for k, c in (keep or {}).items()], *binned)
    alike = named.groupBy("_id", *kept.values(), *axes).agg(F.count("*").alias("_copies")).checkpoint()

    along = Window.orderBy("curve")
    cells = (
        alike.groupBy(*axes).agg(F.sum("_copies").alias("_n"))
        .withColumn("curve", hilbert_index([F.col(a) for a in axes], bits))
        .withColumn("_start", F.sum("_n").over(along) - F.col("_n"))  # one row a cell
        .withColumn("_all", F.sum("_n").over(Window.partitionBy()))
        .withColumn("_salts", F.ceil(F.col("_n") * SPREAD / F.col("_all")))
        .drop("_n")
    )
    own = ["_id", *kept.values()]
    salted = alike.join(F.broadcast(cells), axes).withColumn("_salt", F.pmod(F.xxhash64(*own, "curve"), F.col("_salts")))
    within = Window.partitionBy("curve").orderBy("_salt")
    salts = salted.groupBy("curve", "_salt").agg(F.sum("_copies").alias("_m")).select("curve", "_salt", (F.sum("_m").over(within) - F.col("_m")).alias("_offset"))
    order = Window.partitionBy("curve", "_salt").orderBy(*own)
    first = F.col("_start") + F.col("_offset") + F.sum("_copies").over(order) - F.col("_copies")
    return (
        salted.join(F.broadcast(salts), ["curve", "_salt"])
        .withColumn("_first", first)
        .withColumn("_rank", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)))
        .withColumn("shard", F.expr(f"cast((_rank * {n_shards}) div _all as int)"))
        .withColumn("slot", F.expr(f"_rank - (shard * _all + {n_shards - 1}) div {n_shards}"))
        .select(F.col("_id").alias(id_col), *[F.col(c).alias(k) for k, c in kept.items()], "curve", "shard", "slot")
    )


def write_shards(df: DataFrame, path: str, dims: list[str], *, n_shards: int = 16, bits: int = 4) -> DataFrame:
    """Writes df as Parquet with one folder a shard, rows in slot order, and returns the manifest: shard, n_rows and the minimum and maximum of each dimension.

    Every row is written, with all its columns: rows are told apart by a number of their own, so ids don't matter, nor nulls and repeated rows. The folder's column is called shard, or shard_ and so on where df
    has such a column. An empty table gives an empty manifest and no shard.
    """
    shared_dir(df.sparkSession)
    row, shard, slot = fresh(df, "_row"), fresh(df, "shard"), fresh(df, "_slot")
    numbered = df.withColumn(row, F.monotonically_increasing_id()).checkpoint()
    places = hilbert_shards(numbered, {d: F.col(d) for d in dims}, id_col=row, n_shards=n_shards, bits=bits).select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
    ordered = numbered.join(places, row).repartitionById(n_shards, F.col(shard)).sortWithinPartitions(shard, slot)
    ordered.drop(row, slot).write.mode("overwrite").partitionBy(shard).parquet(f"{path}/data")
    back = df.sparkSession.read.schema(df.withColumn(shard, F.lit(0)).schema).parquet(f"{path}/data")
    manifest = back.groupBy(shard).agg(F.count("*").alias("n_rows"), *[f(d).alias(f"{p}_{d}") for d in dims for p, f in (("min", F.min), ("max", F.max))])
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark, path: str, dim: str, low, high) -> DataFrame:
    """The rows whose dim lies in low to high, read only from shards whose bounds meet that range. Null values lie in no range."""
    manifest = spark.read.parquet(f"{path}/manifest")
    shard = manifest.columns[0]
    hit = [r[0] for r in manifest.where((F.col(f"max_{dim}") >= F.lit(low)) & (F.col(f"min_{dim}") <= F.lit(high))).select(shard).collect()]
    return spark.read.parquet(f"{path}/data").where(F.col(shard).isin(hit) & F.col(dim).between(low, high))


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """The place of every document in 16 runs of the Hilbert curve through source, language and length, law rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = hilbert_shards(
        docs,
        {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars")},
        keep={"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)},
    )
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
