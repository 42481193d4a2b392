"""Queries on what texts name: an assistant's first turn is a summary, the turns around it and an order's parts give the lists it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import findings, metrics

from .evaluation import ranked
from .registry import ORACLE_SQL, query
from .texts import TOKENS

KEYS = ["wanted", "new", "resolved", "off_target", "future"]


def visits(t):
    """A conversation's summary with lists of word runs: of the user's turn before it (wanted: pairs, new: words) and of that after it (resolved: threes, off_target: pairs, future: words)."""
    turn = lambda n: t.conversations.where(F.col("turn") == n).select("conv_id", F.col("text").alias(f"t{n}"))
    both = turn(1).join(turn(0), "conv_id").join(turn(2), "conv_id", "left")
    runs = lambda c, n: text.ngrams(text.words(F.col(c)), n)
    return both.select("conv_id", F.col("t1").alias("summary"), F.col("t0").alias("source"), runs("t0", 2).alias("wanted"), runs("t0", 1).alias("new"), runs("t2", 3).alias("resolved"), runs("t2", 2).alias("off_target"), runs("t2", 1).alias("future"))


_WORDS = r"list_filter(regexp_split_to_array({c}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RUNS = "list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))"
VISITS = rf"""b AS (SELECT a.conv_id, a.text AS s, u.text AS u, {_WORDS.format(c="u.text")} AS x, {_WORDS.format(c="coalesce(v.text, '')")} AS y FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = 0
  LEFT JOIN conversations v ON v.conv_id = a.conv_id AND v.turn = 2 WHERE a.turn = 1),
l AS (SELECT conv_id, 'wanted' AS kind, unnest({_RUNS.format(w="x", n=2)}) AS f FROM b UNION ALL SELECT conv_id, 'new', unnest(x) FROM b UNION ALL SELECT conv_id, 'resolved', unnest({_RUNS.format(w="y", n=3)}) FROM b
  UNION ALL SELECT conv_id, 'off_target', unnest({_RUNS.format(w="y", n=2)}) FROM b UNION ALL SELECT conv_id, 'future', unnest(y) FROM b),
d AS (SELECT DISTINCT conv_id, f, list_distinct({TOKENS.format(c="f")}) AS p FROM l), k AS (SELECT conv_id, lower(s) AS low, {TOKENS.format(c="s")} AS t FROM b),
h AS (SELECT conv_id, f, contains(low, lower(f)) OR (len(p) > 0 AND len(list_intersect(p, t)) >= 0.7 * len(p)) AS hit FROM d JOIN k USING (conv_id)),
g AS (SELECT conv_id, avg(hit::INT) FILTER (kind = 'wanted') AS recall, avg(hit::INT) FILTER (kind = 'new') AS delta_new, avg(hit::INT) FILTER (kind = 'resolved') AS delta_resolved, avg(hit::INT) FILTER (kind = 'off_target') AS off_target_rate,
  avg(hit::INT) FILTER (kind = 'future') AS future_leakage, avg(hit::INT) FILTER (kind IN ('off_target', 'future')) AS unwanted FROM l JOIN h USING (conv_id, f) GROUP BY conv_id),
q AS (SELECT conv_id, u, unnest(list_filter(string_split(regexp_replace(trim(s, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 10)) AS one FROM b),
z AS (SELECT conv_id, avg((len(list_intersect(o, w)) < 0.15 * len(o))::INT) AS ungrounded FROM (SELECT conv_id, list_distinct({_WORDS.format(c="lower(one)")}) AS o, list_distinct({_WORDS.format(c="lower(u)")}) AS w FROM q) GROUP BY conv_id),
e AS (SELECT conv_id, recall, delta_new, delta_resolved, off_target_rate, future_leakage, unwanted, len({_WORDS.format(c="s")}) AS n_words, coalesce(ungrounded, 0) AS ungrounded FROM b LEFT JOIN g USING (conv_id) LEFT JOIN z USING (conv_id))"""
SHARES = ["recall", "delta_new", "delta_resolved", "off_target_rate", "future_leakage", "unwanted", "ungrounded"]


@query("visit_scores", f"WITH {VISITS} SELECT conv_id, n_words::INT AS n_words, {', '.join(f'round({c}, 6) AS {c}' for c in SHARES)} FROM e")
def visit_scores(t):
    each = findings.current_visit(visits(t), ["conv_id"], source="source")
    return each.select("conv_id", "n_words", *[F.round(c, 6).alias(c) for c in SHARES])


@query("visit_score_means", f"""WITH {VISITS}, m AS (SELECT count(*) AS n, {', '.join(f'coalesce(avg({c}), 0) AS {c}' for c in [*SHARES, 'n_words'])} FROM e)
SELECT n, {', '.join(f'round({c}, 6) AS {c}' for c in [*SHARES, 'n_words'] if c != 'unwanted')}, round(1 - recall, 6) AS omission_rate, round(2 * recall * (1 - unwanted) / (recall + 1 - unwanted), 6) AS selection_f1 FROM m""")
def visit_score_means(t):
    found = findings.current_visit_means(findings.current_visit(visits(t), ["conv_id"], source="source"))
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("finding_cascade", """
WITH n AS (SELECT c_custkey AS item, c_custkey % 3 AS kind, floor(abs(c_acctbal) / 1000) AS v FROM customer), f AS (SELECT unnest(['chronic cough', 'fever', 'hyperkalemia']) AS finding),
x AS (SELECT item, finding, CASE finding WHEN 'chronic cough' THEN CASE WHEN kind < 2 THEN 'phrase' END WHEN 'hyperkalemia' THEN CASE WHEN kind = 1 THEN 'phrase' WHEN kind = 0 AND v > 5 THEN 'value' END END AS how FROM n, f)
SELECT item, finding, how FROM x WHERE how IS NOT NULL""")
def finding_cascade(t):
    """What a customer's note of three shapes says of three findings: named, denied in its clause, or reported by a value and its range."""
    v, kind = F.floor(F.abs("c_acctbal") / 1000).cast("int").cast("string"), F.col("c_custkey") % 3
    note = F.when(kind == 0, F.concat(F.lit("Patient has a chronic cough and no fever, and was seen on the ward this morning. Potassium "), v, F.lit(" mmol/L (ref 2 - 5)"))).when(kind == 1, "No fever but chronic cough. Hyperkalemia persists").otherwise("Without chronic cough, without fever; potassium low")
    gold = t.customer.select(F.col("c_custkey").alias("item"), F.explode(F.array(*[F.lit(f) for f in ("chronic cough", "fever", "hyperkalemia")])).alias("finding"))
    return findings.found_in(t.customer.select(F.col("c_custkey").alias("item"), note.alias("text")), gold)


@query("imaging_scores", r"""
WITH l AS (SELECT l_orderkey AS item, row_number() OVER () AS n, l_returnflag AS f, 'E' || (p_partkey % 40) AS code, lower(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT * FROM l WHERE f <> 'R'), p AS (SELECT * FROM l WHERE f = 'R'),
h AS (SELECT r.item, r.n, r.name, r.code, coalesce(bool_or(p.code = r.code OR contains(p.name, r.name) OR contains(r.name, p.name)), false) AS dx, coalesce(bool_or(contains(p.name, split_part(r.name, ' ', 1))), false) AS fi FROM r LEFT JOIN p ON p.item = r.item GROUP BY ALL),
c AS (SELECT item, avg(dx::INT) AS cover, avg(fi::INT) AS recall FROM h GROUP BY item),
w AS (SELECT item, list_distinct(flatten(list(string_split(name, ' ')) FILTER (f = 'R'))) AS a, list_distinct(flatten(list(string_split(name, ' ')) FILTER (f <> 'R'))) AS b FROM l GROUP BY item)
SELECT item, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN 2 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS question_f1, round(cover, 6) AS differential_coverage, round(recall, 6) AS findings_recall FROM w LEFT JOIN c USING (item)""")
def imaging_scores(t):
    """An order's returned parts as a pre-read, its other parts as the reference."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("item"), "l_partkey", "l_returnflag").join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    given, code = F.col("l_returnflag") == "R", F.concat(F.lit("e. "), (F.col("p_partkey") % 40).cast("string"))
    listed = lambda c, x: F.collect_list(F.when(c, x))
    sides = {"": given, "ref_": ~given}
    rows = lines.groupBy("item").agg(
        *[F.array_join(listed(c, F.col("p_name")), " ").alias(f"{n}question") for n, c in sides.items()], *[listed(c, F.struct(code.alias("code"), F.col("p_name").alias("name"))).alias(f"{n}differential") for n, c in sides.items()],
        listed(given, F.col("p_name")).alias("findings"), listed(~given, F.get(F.split("p_name", " "), F.lit(0))).alias("ref_findings"))
    found = findings.imaging(rows, ["item"])
    return found.select("item", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query("latency_ndcg", f"""
SELECT c_mktsegment, round(avg(ndcg10), 6) AS ndcg10, round(avg(ndcg10) / log2(1 + avg(abs(c_acctbal)) / 1000), 6) AS adjusted FROM ({ORACLE_SQL["ranking_metrics"]}) m JOIN customer ON c_custkey = item GROUP BY c_mktsegment""")
def latency_ndcg(t):
    """Rankings by market segment, with a customer's balance as milliseconds."""
    each = metrics.ranking_metrics(ranked(t), "item", k=10).join(t.customer.select("c_custkey", "c_mktsegment", F.abs("c_acctbal").alias("ms")), F.col("item") == F.col("c_custkey"))
    means = each.groupBy("c_mktsegment").agg(F.avg("ndcg10").alias("ndcg10"), F.avg("ms").alias("ms"))
    return means.select("c_mktsegment", F.round("ndcg10", 6).alias("ndcg10"), F.round(metrics.latency_adjusted(F.col("ndcg10"), F.col("ms")), 6).alias("adjusted"))
