"""Readers of raw files: coded lists, archives of notes, markup and line formats. Every reader goes through Spark's own file sources, so that any store works."""

from __future__ import annotations

import io
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str, *, keep: Column | None = None, **renamed: str) -> DataFrame:
    """A CSV file with a header as strings; renamed maps new names to the file's columns, keep filters on the file's columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df if keep is None else df.where(keep)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in renamed.items()]) if renamed else df


def snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated release file with a header and no quoting: its active rows."""
    return spark.read.csv(path, header=True, sep="\t", quote="", escape="").where("active = '1'")


def closure_table(spark: SparkSession, path: str, *, kinds: DataFrame | None = None, only: DataFrame | None = None, subtype: str = "subtypeId", supertype: str = "supertypeId", kind: str = "typeId") -> DataFrame:
    """A tab-separated file of pairs with a header, such as a transitive closure or typed relationships: distinct rows (node, ancestor), with kind if the file has that column.

    kinds (a column kind) keeps the rows of these kinds, only (a column node) those of these subtypes; both filter as semi-joins. Rows without either id and, if the file has a column active, those that aren't are left out.
    """
    rows = spark.read.csv(path, header=True, sep="\t", quote="", escape="")
    if "active" in rows.columns:
        rows = rows.where("active = '1'")
    typed = [F.trim(kind).alias("kind")] if kind in rows.columns else []
    rows = rows.select(F.trim(subtype).alias("node"), F.trim(supertype).alias("ancestor"), *typed).where("node <> '' AND ancestor <> ''")
    if kinds is not None:
        rows = rows.join(kinds.select(F.col("kind").cast("string")).distinct(), "kind", "left_semi")
    if only is not None:
        rows = rows.join(only.select(F.col("node").cast("string")).distinct(), "node", "left_semi")
    return rows.distinct()


def fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Order file of codes: code in columns 7 to 13, flag in 15, long text from 78 on, else the short one from 17 on; lines under 17 characters are skipped.

    The code gets a dot after three characters; flag 0 marks a header.
    """
    line = F.col("value")
    code = F.trim(F.substring(line, 7, 7))
    long_text, short_text = F.trim(F.substring(line, 78, 10_000)), F.trim(F.substring(line, 17, 60))
    return spark.read.text(path).where(F.length("value") >= 17).select(
        F.when(F.length(code) > 3, F.concat(F.substring(code, 1, 3), F.lit("."), F.substring(code, 4, 10))).otherwise(code).alias("code"),
        F.when(long_text != "", long_text).otherwise(short_text).alias("description"), (F.substring(line, 15, 1) == "0").alias("is_header"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").na.drop("all")


def markdown_rows(spark: SparkSession, path: str) -> DataFrame:
    """The numbered rows of pipe tables: n and the other cells."""
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return spark.read.text(path).where(F.col("value").rlike(r"^\s*\|\s*\d+\s*\|")).select(cells.alias("c")).select(F.get("c", F.lit(0)).cast("int").alias("n"), F.slice("c", 2, 1000).alias("cells"))


def note_edges(spark: SparkSession, path: str, row_tag: str = "diag") -> DataFrame:
    """Code references in the notes of an XML list: (code, note kind, referenced three-character category other than the code's own)."""
    kinds = ("codeFirst", "useAdditionalCode", "codeAlso")
    note = ", ".join(f"{k} struct<note:array<string>>" for k in kinds)
    rows = spark.read.format("xml").options(rowTag=row_tag).schema(f"name string, {note}").load(path)
    texts = rows.select("name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"{k}.note"), F.array().cast("array<string>")).alias("notes")) for k in kinds])).alias("k")).select("name", "k.kind", F.explode("k.notes").alias("note"))
    refs = texts.select("name", "kind", F.explode(F.regexp_extract_all("note", F.lit(r"\b([A-Z]\d[0-9A-Z])(?:\.[0-9A-Z-]+)?"), 1)).alias("ref"))
    return refs.where(F.col("ref") != F.substring("name", 1, 3)).distinct()


def zip_member(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of the first member of each zip file whose name matches the pattern: path, n, line."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in sorted(z.namelist()) if re.search(pattern, n)]
                    lines = z.read(names[0]).decode("utf-8", "replace").splitlines() if names else []
                yield pd.DataFrame({"path": p, "n": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, n int, line string")


def note_archives(spark: SparkSession, path: str) -> DataFrame:
    """Notes of archives that hold an SQLite collection: path, note_id, model, deck, tags, fields (map of name to text).

    Of two collections in a file the newer one is read. Fields beyond the model's names that aren't blank are called _extra_field_<i>, missing ones are empty. A note's deck is that of its card with the least
    ordinal. One archive is handled by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame(_notes(p, content), columns=["path", "note_id", "model", "deck", "tags", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, note_id bigint, model string, deck string, tags string, fields map<string,string>")


def _notes(path: str, content: bytes) -> list[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = next((n for n in ("collection.anki21", "collection.anki2") if n in z.namelist()), None)
        if name is None:
            return []
        data = z.read(name)
    with tempfile.NamedTemporaryFile(suffix=".db", delete=False) as f:  # SQLite opens files only; it is this task's alone
        f.write(data)
    try:
        db = sqlite3.connect(f.name)
        models, decks = (json.loads(x or "{}") for x in db.execute("SELECT models, decks FROM col").fetchone())
        first = {}
        for nid, did, _ in db.execute("SELECT nid, did, ord FROM cards ORDER BY nid, ord"):
            first.setdefault(nid, did)
        out = []
        for nid, mid, tags, flds in db.execute("SELECT id, mid, tags, flds FROM notes ORDER BY id"):
            model = models.get(str(mid), {})
            names, values = [x["name"] for x in model.get("flds", [])], flds.split("\x1f")
            fields = dict(zip(names, [*values, *[""] * len(names)], strict=False))
            fields |= {f"_extra_field_{i}": v for i, v in enumerate(values) if i >= len(names) and v.strip()}
            out.append((path, nid, model.get("name"), decks.get(str(first.get(nid)), {}).get("name"), tags, fields))
        db.close()
        return out
    finally:
        os.unlink(f.name)


def outermost_boxes(boxes: DataFrame, group: str) -> DataFrame:
    """Boxes (x0, y0, x1, y1) of a group that no other box holds; of equal boxes the one with the smallest id stays."""
    b = boxes.select(group, *[F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    holds = "b_x0 <= x0 AND b_y0 <= y0 AND b_x1 >= x1 AND b_y1 >= y1 AND b_id <> id AND (b_x0 < x0 OR b_y0 < y0 OR b_x1 > x1 OR b_y1 > y1 OR b_id < id)"
    return boxes.alias("a").join(b.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & F.expr(holds), "left_anti")


def table_text(cells: DataFrame, table: str, row: str) -> DataFrame:
    """Text of tables given as rows of cells (array of strings): a row with an empty first cell continues the row before it; blank rows go."""
    from tallgrass.operators.timeline import islands

    live = cells.where(F.exists("cells", lambda c: F.trim(c) != ""))
    runs = islands(live, [table], [row], F.trim(F.get("cells", F.lit(0))) != "", "_run")
    lines = runs.withColumn("line", F.array_join(F.filter(F.transform("cells", lambda c: F.replace(F.trim(c), F.lit("\n"), F.lit("; "))), lambda c: c != ""), " | "))
    merged = lines.groupBy(table, "_run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(row, "line"))), lambda x: x["line"]), " ").alias("line"))
    return merged.groupBy(table).agg(F.concat(F.lit("[TABLE]\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", "line"))), lambda x: x["line"]), "\n"), F.lit("\n[/TABLE]")).alias("text"))
