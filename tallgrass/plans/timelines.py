"""Ordered records: customers' orders, users' events, conversations' turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import dedup, timeline
from tallgrass.streaming import limits

from .registry import query, sql

ORDERS_AT = "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders"
ITEMS_AT = f"SELECT DISTINCT o_custkey, pos, p_type FROM ({ORDERS_AT}) o JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"


def orders_at(t):
    return timeline.position(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "pos")


def items_at(t):
    """The part types of each customer's orders, by the order's position."""
    types = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return orders_at(t).join(types, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "pos", "p_type").distinct()


@query("new_resolved_future", f"""
WITH x AS ({ITEMS_AT}), y AS (
  SELECT o_custkey, pos, p_type, row_number() OVER (PARTITION BY o_custkey, p_type ORDER BY pos) = 1 AS is_new,
         lead(pos) OVER (PARTITION BY o_custkey, p_type ORDER BY pos) AS again, max(pos) OVER (PARTITION BY o_custkey) AS last FROM x)
SELECT o_custkey, CAST(pos AS INT) AS pos, p_type, is_new, pos < last AND coalesce(again, -1) <> pos + 1 AS resolved_next FROM y""")
def new_resolved_future(t):
    return timeline.item_states(items_at(t), "o_custkey", "p_type", "pos")


@query("cumulative_history", f"""
WITH x AS ({ITEMS_AT}), f AS (SELECT o_custkey, p_type, min(pos) AS pos FROM x GROUP BY ALL), p AS (SELECT DISTINCT o_custkey, pos FROM x),
n AS (SELECT p.o_custkey, p.pos, count(f.p_type) AS n_new FROM p LEFT JOIN f ON p.o_custkey = f.o_custkey AND p.pos = f.pos GROUP BY ALL)
SELECT o_custkey, CAST(pos AS INT) AS pos, n_new, CAST(sum(n_new) OVER w AS BIGINT) AS n_known, CAST(sum(n_new) OVER w - n_new AS BIGINT) AS n_before FROM n WINDOW w AS (PARTITION BY o_custkey ORDER BY pos)""")
def cumulative_history(t):
    return timeline.running_distinct(items_at(t), "o_custkey", "p_type", "pos")


@query("forward_fill", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def forward_fill(t):
    return timeline.forward_fill(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "user_id", "last_purchase")


@query("lookback14", """
SELECT event_id, last_value(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS recent_high FROM events""")
def lookback14(t):
    return timeline.forward_fill(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("value") > 90, F.col("event_id")), "recent_high", back=14).select("event_id", "recent_high")


@query("islands", """
WITH x AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(ts) AS begins, max(ts) AS ends FROM x GROUP BY user_id, island""")
def islands(t):
    runs = timeline.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click")
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


@query("page_ranges", """
WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS rn, lead(l_linenumber) OVER w AS nxt FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, greatest(l_linenumber, coalesce(nxt - 1, 9)) AS ends FROM x""")
def page_ranges(t):
    starts = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    return timeline.spans(starts, ["l_orderkey"], ["l_linenumber"], "l_linenumber", F.lit(9), "ends")


@query("chunk_batches", """
WITH x AS (SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS chunk FROM part)
SELECT p_brand, CAST(chunk AS INT) AS chunk, count(*) AS n, min(p_partkey) AS least, max(p_partkey) AS most FROM x GROUP BY p_brand, chunk""")
def chunk_batches(t):
    cut = timeline.chunks(t.part, ["p_brand"], ["p_partkey"], 20)
    return cut.groupBy("p_brand", "chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("least"), F.max("p_partkey").alias("most"))


@query("index_positions", f"""
WITH x AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM ({ORDERS_AT}))
SELECT o_custkey, o_orderkey, CAST(pos AS INT) AS position FROM x WHERE n >= 2 AND pos IN (1, 1 + (n - 1) // 2, n - 1)""")
def index_positions(t):
    return timeline.anchors(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "position")


@query("header_on_change", """
SELECT o_orderkey, coalesce(lag(o_orderstatus) OVER w <> o_orderstatus, true) AS new_header FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def header_on_change(t):
    return timeline.changed(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus"), "new_header").select("o_orderkey", "new_header")


@query("monotonicity", """
WITH x AS (SELECT o_custkey, o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS down FROM orders)
SELECT o_custkey, NOT coalesce(bool_or(down), false) AS ascending, count(*) AS n FROM x GROUP BY o_custkey""")
def monotonicity(t):
    before = F.lag("o_totalprice").over(timeline._w(["o_custkey"], ["o_orderdate", "o_orderkey"]))
    steps = t.orders.select("o_custkey", (F.col("o_totalprice") < before).alias("down"))
    return steps.groupBy("o_custkey").agg((~F.coalesce(F.bool_or("down"), F.lit(False))).alias("ascending"), F.count("*").alias("n"))


@query("latest_run", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_run(t):
    return dedup.pick_first(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


sql("redundant_access", """
SELECT user_id, count(*) AS n_actions, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated, count(DISTINCT props) AS n_distinct
FROM (SELECT user_id, props, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS k FROM {events}) x GROUP BY user_id""")

sql("rate_limit", """
SELECT event_id, user_id, call_number <= 50 AS allowed FROM (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS call_number FROM {events}) x""")

@query("session_rate_limit", """
WITH s AS (SELECT *, epoch_ms(ts::TIMESTAMP) AS ms FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL),
o AS (SELECT event_id, user_id, event_type, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id) <= 86400000 THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT event_id, user_id, event_type, number, number <= 2 AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, session ORDER BY ms, event_id) AS number FROM g)""")
def session_rate_limit(t):
    """Two events a session of a user and kind are allowed; a day without one ends a session."""
    return limits.session_limit_table(t.events, limit=2, idle_seconds=86_400)


sql("idle_sessions", """
SELECT user_id, session, count(*) AS n, min(ts) AS begins, max(ts) AS ends FROM (
  SELECT user_id, ts, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
    SELECT user_id, event_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM {events}) x) y
GROUP BY user_id, session""")

sql("tumbling_counts", """
SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY date_trunc('HOUR', ts), event_type""",
    "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")

sql("month_parts", """
SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1995 * 12 - 1 AS month_offset, 2024 - year(o_orderdate) AS age FROM {orders}""",
    "SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1995 * 12 - 1 AS INT) AS month_offset, CAST(2024 - year(o_orderdate) AS INT) AS age FROM orders")

sql("turn_transcript", """
SELECT conv_id, count(*) AS n_turns, sha2(array_join(transform(sort_array(collect_list(struct(turn, role, text))), x -> concat('[', x.role, '] ', x.text)), '\n'), 256) AS transcript_sha256
FROM {conversations} GROUP BY conv_id""",
    "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat('[', role, '] ', text), '\n' ORDER BY turn)) AS transcript_sha256 FROM conversations GROUP BY conv_id")


@query("insert_ignore", """
SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_returnflag = 'N') n
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'R' AND e.l_partkey = n.l_partkey AND e.l_suppkey = n.l_suppkey)""")
def insert_ignore(t):
    lines = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    added = dedup.insert_ignore(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'N'"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])
    return added.select("l_partkey", "l_suppkey", "l_orderkey")


@query("upsert_last", """
WITH o AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE value < 50) WHERE k = 1),
     n AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value >= 50) WHERE k = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""")
def upsert_last(t):
    old = dedup.pick_first(t.events.where("value < 50"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
    return dedup.upsert(old, t.events.where("value >= 50"), ["user_id", "event_type"], ["ts", "event_id"])


@query("best_by_priority", """
SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def best_by_priority(t):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return dedup.pick_first(t.orders, ["o_custkey"], [rank.desc(), "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")
