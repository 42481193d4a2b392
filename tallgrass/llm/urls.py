"""URL filter lists, matched by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits its host and all subdomains, if the URL's path starts with the rule's path. Every URL is
expanded into host-suffix + path-prefix expressions; these are equi-joined with the rules on the first bytes of their SHA-256, the full
digests are compared, and the longest rule wins.

Only distinct (host, path) pairs are expanded, so a URL that a third of all pages share is expanded once; the pages get their verdicts by
a join on (host, path), which adaptive execution splits where a pair is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

SALTS = 16


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased. Path: then up to ? # or end. Null or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _rules(rules: DataFrame, prefix_hex: int) -> DataFrame:
    host, path = lower_ascii(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    return (
        rules.select(host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where((F.col("r_host") != "") & ((F.col("r_path") == "") | F.col("r_path").startswith("/")) & F.col("r_verdict").isin("allow", "block"))
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # block after allow: it wins
        .withColumn("rule", F.concat("r_host", "r_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("key", F.substring("digest", 1, prefix_hex))
    )


def match_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", prefix_hex: int = 8, broadcast_rows: int = 100_000) -> DataFrame:
    """Returns the keep columns with host, path, rule (text of the winning rule, else null) and verdict (the rule's, else default).

    One row for each row of pages, repeated rows and null ids included. Null URLs and URLs without :// have an empty host and path, fit no rule and get
    the default. Of two rules of one length, the longer host wins. A rule given twice with two verdicts blocks; a rule without a host, with
    a path that is neither empty nor begins with /, or with another verdict is no rule. Columns of pages outside keep are ignored, whatever their
    names. An empty rule table gives every page the default.

    Rules up to broadcast_rows are sent to all executors; more are joined by shuffle, with the URL side salted against expressions that
    nearly all URLs share (such as com/).
    """
    known = _rules(rules, prefix_hex)
    shape = known.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.length("r_path")), F.lit(0)).alias("length"),
        F.collect_set(F.when(~F.col("r_path").endswith("/"), F.length("r_path"))).alias("odd"),  # at most one entry per path length
    ).first()

    host, path = host_path(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(shape["labels"] - 1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    odd = F.array(*[F.lit(x) for x in sorted(shape["odd"])]) if shape["odd"] else F.array().cast("array<int>")
    prefixes = F.transform(
        F.filter(
            F.sequence(F.lit(0), F.least(F.length("path"), F.lit(shape["length"]))),
            lambda i: (F.substr(F.col("path"), F.greatest(i, F.lit(1)), F.least(i, F.lit(1))) == "/") | F.array_contains(odd, i),
        ),
        lambda i: F.substr(F.col("path"), F.lit(1), i),
    )
    asked = (
        rows.select("host", "path")
        .where("host <> ''")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("expression", F.concat("suffix", "prefix"))
        .withColumn("asked_digest", F.sha2("expression", 256))
        .withColumn("key", F.substring("asked_digest", 1, prefix_hex))
    )
    if shape["n"] <= broadcast_rows:
        found = asked.join(F.broadcast(known), "key")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    best = (
        found.where("asked_digest = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), F.length("r_host").alias("host_size"), "rule", "r_verdict")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("r_verdict"))
    )
    return rows.join(best, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query: fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark, rules=RULES) -> DataFrame:
    if not rules:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules])))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return match_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), rules(r_host, r_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT host, path, r_host || r_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path AND f.k = 1
"""
