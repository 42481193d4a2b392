"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces just those partitions of a Parquet folder that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def copy_shared(df: DataFrame, target: DataFrame) -> DataFrame:
    """The columns that both tables have, in the target's order and types; values that don't cast are null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(have[f.name.lower()]).try_cast(f.dataType).alias(f.name) for f in target.schema if f.name.lower() in have])


def release_copy(df: DataFrame, path: str, *, drop: list[str], keep: Column | None = None, types: dict[str, str] | None = None) -> None:
    """Writes the rows that are to be kept (None: all; rows for which keep is null go) without some columns, which must not be among the table's else; types names the types of columns that are cast (what doesn't cast is null)."""
    rows = df if keep is None else df.where(keep)
    rows = rows.drop(*drop)
    rows.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items()}).write.mode("overwrite").parquet(path)


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables without the rows that go, and how many go from each. gone has the key of the first link's parent table, whose rows with such a key go; links (parent, key, child, foreign key), parents first, hand this on.

    A child goes if its foreign key is among the keys of the rows of the parent that go. Null keys never match. Rows are found by semi-joins; what is left is an anti-join, to be written by the caller.
    """
    lost: dict[str, DataFrame] = {}
    first, key = links[0][:2]
    lost[first] = tables[first].join(gone.select(key).dropna().distinct(), key, "left_semi")
    for parent, own, child, foreign in links:
        if parent in lost:
            keys = lost[parent].select(F.col(own).alias(foreign)).dropna().distinct()
            more = tables[child].join(keys, foreign, "left_semi")
            lost[child] = more if child not in lost else lost[child].union(more).distinct()
    left, counts = dict(tables), {}
    own_key = {parent: own for parent, own, _, _ in links} | {}
    for name, rows in lost.items():
        counts[name] = rows.count()
        reasons = [(foreign, lost[parent].select(F.col(own).alias(foreign)).dropna().distinct()) for parent, own, child, foreign in links if child == name and parent in lost]
        if name == first:
            reasons.append((own_key[first], gone.select(key).dropna().distinct()))
        for column, keys in reasons:
            left[name] = left[name].join(keys, column, "left_anti").select(*tables[name].columns)
    return left, counts


def valid_json(c: Column) -> Column:
    """A JSON text as it is; any other text as a JSON string; null for null."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(quoted)


def nested_json(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str, path: str | None = None) -> DataFrame:
    """Parents with their children as an ordered array of structs; written as JSON lines if there is a path."""
    fields = [*order, *[c for c in children.columns if c not in (*order, key)]]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(lists, key, "left")
    if path:
        out.write.mode("overwrite").json(path)
    return out


def csv_export(df: DataFrame, path: str, *, order: list[str] | None = None) -> None:
    """CSV files with a header; quotes are doubled and fields quoted where they have to be, nulls are empty and empty texts quoted. With an order the files' names follow it."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue='""', nullValue="")


LOG = "run string, stage string, status string, at timestamp, n_rows bigint, error string"


def log_entry(spark: SparkSession, path: str, run: str, stage: str, status: str, *, n_rows: int | None = None, error: str | None = None) -> None:
    """Appends an entry to the processing log, a Parquet folder: started, done or failed. Entries are never changed, so runs may log at once."""
    row = spark.createDataFrame([(run, stage, status, n_rows, error)], "run string, stage string, status string, n_rows bigint, error string")
    row.select("run", "stage", "status", F.current_timestamp().alias("at"), "n_rows", "error").coalesce(1).write.mode("append").parquet(path)


def log_state(log: DataFrame) -> DataFrame:
    """One row for each run and stage: when it started, its last status (that of its latest entry; of entries at one instant the one that isn't started), when that was, rows and error."""
    last = F.max_by(F.struct("status", "at", "n_rows", "error"), F.struct("at", (F.col("status") != "started").cast("int"))).alias("l")
    return log.groupBy("run", "stage").agg(F.min(F.when(F.col("status") == "started", F.col("at"))).alias("started_at"), last).select("run", "stage", "started_at", "l.status", "l.at", "l.n_rows", "l.error")


def open_stages(log: DataFrame) -> DataFrame:
    """The stages that have started and neither done nor failed, and those that failed: what a resumed run has to do again."""
    return log_state(log).where("status <> 'done'").select("run", "stage", "status")
