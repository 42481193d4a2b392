"""Queries on traces: a user's events are a trace. Purchases submit, errors are messages, all else are actions on a section and an encounter that the event's number names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import traces

from .registry import query

SECTIONS = [*traces.USUAL_ORDER, "handover", "billing"]


def steps(t):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    return t.events.select(
        F.col("user_id").alias("item"), "ts", "event_id", F.when(kind == "purchase", "submit").when(kind == "error", "message").otherwise("tool").alias("kind"),
        F.when(kind == "signup", "open_chart").when(kind == "view", "view_section").otherwise(kind).alias("name"),
        F.when(k % 7 > 0, F.floor(k / 10)).alias("encounter"), F.get(F.lit(SECTIONS), k % len(SECTIONS)).alias("section"), F.col("props").alias("args"), (F.floor("value") % 4).alias("output_length"),
    )


STEPS = f"""SELECT user_id AS item, ts, event_id, CASE event_type WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'message' ELSE 'tool' END AS kind,
  CASE event_type WHEN 'signup' THEN 'open_chart' WHEN 'view' THEN 'view_section' ELSE event_type END AS name, CASE WHEN k % 7 > 0 THEN k // 10 END AS encounter, k % {len(SECTIONS)} AS rank, props AS args, floor(value) % 4 AS size
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)"""


@query("trace_efficiency", """
WITH r AS (SELECT user_id % 7 AS arm, user_id, count(*) AS turns, bool_or(event_type = 'purchase') AS submitted, CASE WHEN user_id % 2 = 0 THEN 60 END AS budget, sum(event_id % 100) AS i, max(event_id) % 50 AS o, sum(event_id % 1000) AS ms FROM events GROUP BY user_id)
SELECT arm, count(*) AS n, round(avg(turns), 6) AS mean_actions, median(turns)::DOUBLE AS median_actions, round(avg(submitted::INT), 6) AS submission_rate, round(avg(turns / coalesce(budget, 40)), 6) AS budget_use,
  round(avg(i + o), 6) AS mean_tokens, round(avg(ms), 6) AS mean_ms FROM r GROUP BY arm""")
def trace_efficiency(t):
    """Users of one remainder are an arm, even ones have a budget of their own."""
    runs = t.events.groupBy("user_id").agg(
        F.count("*").alias("turns"), F.bool_or(F.col("event_type") == "purchase").alias("submitted"), F.sum(F.col("event_id") % 100).alias("tokens_in"), (F.max("event_id") % 50).alias("tokens_out"), F.sum(F.col("event_id") % 1000).alias("latency_ms"),
    ).withColumns({"arm": F.col("user_id") % 7, "budget": F.when(F.col("user_id") % 2 == 0, 60)})
    found = traces.efficiency(runs, ["arm"])
    return found.select("arm", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query("trace_gathering", f"""
WITH s AS ({STEPS}), a AS (SELECT *, CASE WHEN encounter IS NOT NULL AND rank IS NOT NULL THEN encounter || ':' || rank END AS place FROM s WHERE kind = 'tool'),
b AS (SELECT *, place IS NOT NULL AND row_number() OVER (PARTITION BY item, place ORDER BY ts, event_id) > 1 AS again, row_number() OVER (PARTITION BY item, args ORDER BY ts, event_id) > 1 AS same FROM a)
SELECT item, count(b.event_id) AS n_actions, count(DISTINCT place) AS n_sections, round(count(*) FILTER (size = 0) / nullif(count(b.event_id), 0), 6) AS failure_rate,
  round((sum(again::INT) + sum(same::INT)) / nullif(count(b.event_id), 0), 6) AS repeat_rate FROM (SELECT DISTINCT item FROM s) LEFT JOIN b USING (item) GROUP BY item""")
def trace_gathering(t):
    found = traces.gathering(steps(t))
    return found.select("item", "n_actions", "n_sections", F.round("failure_rate", 6).alias("failure_rate"), F.round("repeat_rate", 6).alias("repeat_rate"))


WORKFLOW = f"""s AS ({STEPS}), a AS (SELECT * FROM s WHERE kind = 'tool'),
o AS (SELECT item, rank, row_number() OVER (PARTITION BY item ORDER BY ts, event_id) AS place, row_number() OVER (PARTITION BY item ORDER BY rank) AS sorted FROM a WHERE rank < {len(traces.USUAL_ORDER)}),
x AS (SELECT p.item, p.place, p.rank AS x, q.rank AS y FROM o p JOIN o q ON p.item = q.item AND p.place = q.sorted),
k AS (SELECT u.item, sum(sign(u.x - v.x) * sign(u.y - v.y)) AS s, sum((u.x <> v.x)::INT) AS nx, sum((u.y <> v.y)::INT) AS ny FROM x u JOIN x v ON u.item = v.item AND u.place < v.place GROUP BY u.item),
e AS (SELECT item, count(*) / max(n) AS breadth_depth FROM (SELECT item, encounter, count(*) AS n FROM a WHERE encounter IS NOT NULL GROUP BY ALL) GROUP BY item),
f AS (SELECT item, CASE WHEN kind = 'tool' THEN CASE name WHEN 'open_chart' THEN 'overview' WHEN 'view_section' THEN 'specific' ELSE 'other' END END AS first FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts, event_id) = 1),
w AS (SELECT item, CASE WHEN nx > 0 THEN s / sqrt(nx::DOUBLE * ny) END AS tau, breadth_depth, first FROM f LEFT JOIN k USING (item) LEFT JOIN e USING (item))"""


@query("trace_workflow", f"WITH {WORKFLOW} SELECT item, round(tau, 6) AS tau, round(breadth_depth, 6) AS breadth_depth, first FROM w")
def trace_workflow(t):
    return traces.workflow(steps(t), ["ts", "event_id"]).select("item", F.round("tau", 6).alias("tau"), F.round("breadth_depth", 6).alias("breadth_depth"), "first")


@query("trace_workflow_means", f"""
WITH {WORKFLOW} SELECT round(avg(tau), 6) AS tau, round(avg(breadth_depth), 6) AS breadth_depth, round(count(*) FILTER (first = 'overview') / greatest(count(first), 1), 6) AS overview,
  round(count(*) FILTER (first = 'specific') / greatest(count(first), 1), 6) AS specific, round(count(*) FILTER (first = 'other') / greatest(count(first), 1), 6) AS other FROM w""")
def trace_workflow_means(t):
    found = traces.workflow_means(traces.workflow(steps(t), ["ts", "event_id"]))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])
