"""Queries on episodes: sign-ups open one, purchases submit, errors are submissions of another task."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import access
from tallgrass.operators import episodes
from tallgrass.sources import decks

from .registry import query

TTL, BUDGET = 36 * 3600, 2


def steps(events):
    is_type = lambda name: F.col("event_type") == name
    return episodes.episode_steps(events, ["user_id"], ["ts", "event_id"], "ts", starts=is_type("signup"), submits=is_type("purchase"), wrong=is_type("error"), budget=BUDGET, ttl_seconds=TTL)


@query("episode_steps", f"""
WITH e AS (SELECT event_id, user_id, event_type, ts, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS episode FROM events),
k AS (SELECT *, row_number() OVER w AS k, epoch_us(ts) - epoch_us(lag(ts) OVER w) > {TTL * 1_000_000} AS gap, sum((event_type IN ('view', 'click'))::INT) OVER w AS used FROM e WINDOW w AS (PARTITION BY user_id, episode ORDER BY ts, event_id)),
b AS (SELECT user_id, episode, min(k) FILTER (gap) AS broke FROM k GROUP BY ALL),
s AS (SELECT user_id, episode, min(k) AS sub, min(ts) AS sub_ts FROM k JOIN b USING (user_id, episode) WHERE event_type = 'purchase' AND (broke IS NULL OR k < broke) GROUP BY ALL),
x AS (SELECT *, CASE WHEN episode = 0 THEN 'gone' WHEN event_type = 'signup' THEN 'started' WHEN k > sub THEN CASE WHEN epoch_us(ts) - epoch_us(sub_ts) > {TTL * 1_000_000} THEN 'gone' ELSE 'finished' END WHEN k >= broke THEN 'gone'
  WHEN event_type = 'purchase' THEN CASE WHEN used >= {BUDGET} THEN 'forced' ELSE 'submitted' END WHEN event_type = 'error' THEN 'wrong_tool' WHEN used <= {BUDGET} THEN 'run' ELSE 'spent' END AS status
  FROM k JOIN b USING (user_id, episode) LEFT JOIN s USING (user_id, episode))
SELECT event_id, user_id, status, CASE WHEN status NOT IN ('gone', 'finished') THEN greatest({BUDGET} - used - (status = 'submitted')::INT, 0)::INT END AS remaining FROM x""")
def episode_steps(t):
    return steps(t.events).select("event_id", "user_id", "status", "remaining")


@query("resume_run", "SELECT o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A')")
def resume_run(t):
    """Orders that an interrupted run has stored nothing for: none of their lines was accepted."""
    stored = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return episodes.unfinished(t.orders.select("o_orderkey", "o_orderpriority"), stored, ["o_orderkey"])


#: Roles and what each may read, in the manner of a clinic.
GRANTS = {"1-URGENT": ["O", "F", "P"], "2-HIGH": ["O", "F"], "3-MEDIUM": ["O"]}


@query("scope_check", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_orderstatus IN ('O', 'F') WHEN '3-MEDIUM' THEN o_orderstatus = 'O' ELSE false END AS allowed FROM orders""")
def scope_check(t):
    return t.orders.select("o_orderkey", access.has_scope(F.col("o_orderpriority"), F.col("o_orderstatus"), GRANTS).alias("allowed"))


#: Profiles of the files below: the more specific one has the smaller priority.
PROFILES = [
    {"name": "any", "role": "fact", "priority": 50, "globs": ["*.apkg"]}, {"name": "small", "role": "board", "priority": 10, "globs": ["* [1-9].apkg"]}, {"name": "tens", "role": "board", "priority": 20, "globs": ["* [!5]?.apkg", "* 55.apkg"]},
]


@query("deck_discovery", """
SELECT f AS filename, CASE WHEN f LIKE '%.zip' THEN NULL WHEN size < 10 THEN 'small' WHEN size // 10 <> 5 OR size = 55 THEN 'tens' ELSE 'any' END AS profile, CASE WHEN f LIKE '%.zip' THEN NULL WHEN size // 10 <> 5 OR size = 55 THEN 'board' ELSE 'fact' END AS role
FROM (SELECT DISTINCT p_brand || ' ' || p_size || CASE WHEN p_size % 7 = 0 THEN '.zip' ELSE '.apkg' END AS f, p_size AS size FROM part)""")
def deck_discovery(t):
    files = t.part.select(F.concat("p_brand", F.lit(" "), "p_size", F.when(F.col("p_size") % 7 == 0, ".zip").otherwise(".apkg")).alias("filename")).distinct()
    return decks.discovered(files, PROFILES).select("filename", "profile.name", "profile.role").withColumnRenamed("name", "profile")


@query("primary_deck", """
SELECT p_brand, coalesce((min((n, name)) FILTER (name <> 'Default'))[2], 'Default') AS deck FROM (
  SELECT p_brand, name, (length(name) - length(replace(name, '::', ''))) // 2 AS n FROM (SELECT p_brand, CASE WHEN p_size > 40 OR p_brand LIKE '%1' THEN 'Default' WHEN p_size > 20 THEN p_type ELSE p_type || '::' || p_name END AS name FROM part)) GROUP BY p_brand""")
def primary_deck(t):
    name = F.when((F.col("p_size") > 40) | F.col("p_brand").endswith("1"), "Default").when(F.col("p_size") > 20, F.col("p_type")).otherwise(F.concat("p_type", F.lit("::"), "p_name"))
    return decks.primary_deck(t.part.select("p_brand", name.alias("deck")), "p_brand", "deck")
