"""Further assessments: set coverage, visit deltas, agreement-based selection, vector centroids, full-text match."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import timeline

from .registry import query, sql
from .timelines import ITEMS_AT, items_at


@query("fulltext_and", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 3) AS k FROM documents)
SELECT doc_id, CAST(len(list_filter(k, lambda t: t IN ('the', 'that'))) AS INT) AS hits, round(len(list_filter(k, lambda t: t IN ('the', 'that'))) / len(k), 6) AS density
FROM d WHERE list_contains(k, 'the') AND list_contains(k, 'that')""")
def fulltext_and(t):
    """Documents that hold every word of a query, with the number and share of its occurrences."""
    asked = ["the", "that"]
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("k")).where(F.array_contains("k", asked[0]) & F.array_contains("k", asked[1]))
    hits = F.size(F.filter("k", lambda w: w.isin(asked)))
    return rows.select("doc_id", hits.alias("hits"), F.round(hits / F.size("k"), 6).alias("density"))


sql("reorder_planned", """
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(try_cast(get_json_object(props, '$.k') AS INT), 0), event_id) - 1 AS INT) AS planned FROM {events}""",
    """SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0), event_id) - 1 AS INT) AS planned FROM events""")


@query("findings_recall", """
WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT p_brand) FILTER (l_returnflag = 'N'), []) AS found, coalesce(list(DISTINCT p_brand) FILTER (l_returnflag <> 'N'), []) AS given FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN len(given) > 0 THEN len(list_intersect(found, given)) / len(given) END, 6) AS recall, round(CASE WHEN len(found) > 0 THEN len(list_intersect(found, given)) / len(found) END, 6) AS precision_ FROM s""")
def findings_recall(t):
    """Brands among an order's open lines against those among its returned or accepted ones; null where a side is empty."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    open_ = F.col("l_returnflag") == "N"
    sides = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(open_, F.col("p_brand"))).alias("found"), F.collect_set(F.when(~open_, F.col("p_brand"))).alias("given"))
    both = F.size(F.array_intersect("found", "given"))
    share = lambda side: F.round(F.when(F.size(side) > 0, both / F.size(side)), 6)
    return sides.select("l_orderkey", share("given").alias("recall"), share("found").alias("precision_"))


@query("visit_deltas", f"""
WITH x AS ({ITEMS_AT}), y AS (
  SELECT o_custkey, pos, p_type, row_number() OVER (PARTITION BY o_custkey, p_type ORDER BY pos) = 1 AS is_new, lead(pos) OVER (PARTITION BY o_custkey, p_type ORDER BY pos) AS again, max(pos) OVER (PARTITION BY o_custkey) AS last FROM x)
SELECT o_custkey, count_if(is_new AND pos > 0)::BIGINT AS n_new, count_if(pos < last AND coalesce(again, -1) <> pos + 1)::BIGINT AS n_resolved, count(*) AS n_items FROM y GROUP BY o_custkey""")
def visit_deltas(t):
    states = timeline.item_states(items_at(t), "o_custkey", "p_type", "pos")
    return states.groupBy("o_custkey").agg(F.count_if(F.col("is_new") & (F.col("pos") > 0)).alias("n_new"), F.count_if("resolved_next").alias("n_resolved"), F.count("*").alias("n_items"))


@query("example_selection", """
SELECT l_partkey, count_if(l_returnflag = 'R')::BIGINT AS n_agree FROM lineitem GROUP BY l_partkey HAVING count_if(l_returnflag = 'R') >= 2 ORDER BY n_agree DESC, l_partkey LIMIT 5""")
def example_selection(t):
    """The five items on which most raters agree: a top-k report, so no task sorts all rows."""
    agreed = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_agree")).where("n_agree >= 2")
    return agreed.orderBy(F.desc("n_agree"), "l_partkey").limit(5)


@query("label_centroids", """
WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(avg(v::DOUBLE), 6) AS mean, count(*) AS n FROM e GROUP BY label, pos""")
def label_centroids(t):
    values = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    return values.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"), F.count("*").alias("n"))


sql("vector_norms", """
SELECT vec_id, round(sqrt(aggregate(embedding, 0.0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm FROM {embeddings}""",
    "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")

sql("instance_listing", """
SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'flagged' ELSE 'plain' END AS variant, least(greatest(n_chars / 4000.0D, 0.0D), 1.0D) AS reward
FROM {documents} LEFT JOIN {labels} USING (doc_id)""",
    """SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'flagged' ELSE 'plain' END AS variant, least(greatest(n_chars / 4000.0::DOUBLE, 0.0), 1.0) AS reward
FROM documents LEFT JOIN labels USING (doc_id)""")

sql("first_action_share", """
SELECT event_type, count(*) AS n_first, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM (
  SELECT user_id, min_by(event_type, struct(ts, event_id)) AS event_type FROM {events} GROUP BY user_id) x GROUP BY event_type""",
    """SELECT event_type, count(*) AS n_first, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM (
  SELECT user_id, min_by(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY user_id) x GROUP BY event_type""")

sql("recall_by_weight", """
SELECT o_orderpriority, round(sum(CASE WHEN l_returnflag = 'R' THEN p_size ELSE 0 END) / CAST(sum(p_size) AS DOUBLE), 6) AS weighted_recall, count(*) AS n
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey GROUP BY o_orderpriority""")
