"""Notes from rows: sections in a fixed order, and lines from placed characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(sections: DataFrame, key: str, section: str, text: str, order: dict[str, str], *, merged: tuple[str, str] | None = None, merged_header: str = "") -> DataFrame:
    """Rows (key, note): each key's sections in the order of `order` (name: header), each under its header, an empty line between two.

    Of `merged` the second's text follows the first's under one header, if a key has both. Of repeated sections the alphabetically first text counts; empty and unknown sections are left out, and keys without any give an empty note.
    One aggregate by key with one value for each section: nothing is gathered or sorted.
    """
    names = list(order)
    texts = sections.groupBy(key).agg(*[F.min(F.when((F.col(section) == n) & (F.col(text) != ""), F.col(text))).alias(f"s{i}") for i, n in enumerate(names)])
    part = {n: F.col(f"s{i}") for i, n in enumerate(names)}
    under = lambda n, header, body: F.concat(F.lit(f"{header}:\n"), body)
    blocks: list[Column] = []
    for n in names:
        block = under(n, order[n], part[n])
        if merged and n == merged[0]:
            block = F.when(part[merged[1]].isNotNull(), under(n, merged_header, F.concat(part[n], F.lit("\n\n"), part[merged[1]]))).otherwise(block)
        if merged and n == merged[1]:
            block = F.when(part[merged[0]].isNull(), block)
        blocks.append(block)
    return texts.select(key, F.concat_ws("\n\n", *blocks).alias("note"))


def joined_characters(df: DataFrame, line: list[str], begins: str, ends: str, char: str, *, gap: float = 2.0) -> DataFrame:
    """Rows (line, text): the characters of each line from left to right, with a blank where one begins more than `gap` after the one before it ends; ties by the character. A line is the unit of work and of bounded length."""
    window = Window.partitionBy(*line).orderBy(begins, char)
    spaced = F.concat(F.when(F.col(begins) - F.lag(ends).over(window) > gap, " ").otherwise(""), F.col(char))
    placed = df.select(*line, F.struct(F.row_number().over(window).alias("n"), spaced.alias("c")).alias("x"))
    return placed.groupBy(*line).agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["c"]), "")).alias("text"))
