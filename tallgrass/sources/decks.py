"""Deck files: which profile a file belongs to, and a collection's main deck."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """The regular expression of a file glob: * and ? stand for any characters, [..] for one of a set, [!..] for one outside it."""
    parts = re.split(r"(\*|\?|\[!?[^\]]+\])", glob)
    known = {"*": ".*", "?": ".", "": ""}
    spell = lambda p: known[p] if p in known else f"[^{p[2:]}" if p.startswith("[!") and p.endswith("]") else p if re.fullmatch(r"\[[^\]]+\]", p) else re.sub(r"([^\w\s])", r"\\\1", p)
    return f"(?s)^{''.join(map(spell, parts))}\\z"


def discovered(found: DataFrame, profiles: list[dict], filename: str = "filename") -> DataFrame:
    """Files with their profile (name, role, priority): of the profiles with a glob that fits the name, the one with the smallest priority (ties: the one listed first). Null for files that none fits, and for null names.

    Profiles are configuration, so they become one expression over each file's name and nothing is joined.
    """
    chain = F.lit(None).cast("struct<name:string,role:string,priority:int>")
    for p in reversed(sorted(profiles, key=lambda p: p["priority"])):
        fits = F.col(filename).rlike("|".join(glob_pattern(g) for g in p["globs"]) or "(?!)")
        chain = F.when(fits, F.struct(F.lit(p["name"]).alias("name"), F.lit(p["role"]).alias("role"), F.lit(p["priority"]).cast("int").alias("priority"))).otherwise(chain)
    return found.withColumn("profile", chain)


def primary_deck(decks: DataFrame, group: str, name: str) -> DataFrame:
    """The main deck of each group: not Default if there is another, the one with the fewest ::, then the first by name. Null names don't count."""
    depth = F.size(F.split(name, "::"))
    best = F.min(F.when(F.col(name) != "Default", F.struct(depth.alias("depth"), F.col(name).alias("name"))))
    return decks.groupBy(group).agg(F.coalesce(best["name"], F.lit("Default")).alias(name))
