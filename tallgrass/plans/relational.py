"""Filters, joins, aggregates, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import dedup
from tallgrass.sources import sinks

from .registry import query, sql


@query("problem_list", """
SELECT o_custkey, l_partkey, o_orderdate AS first_date, o_orderkey AS first_order FROM (
  SELECT o_custkey, l_partkey, o_orderdate, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate, o_orderkey) AS k
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE k = 1""")
def problem_list(t):
    """Each customer's distinct parts with the first order that has them."""
    lines = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    found = lines.groupBy("o_custkey", "l_partkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return found.select("o_custkey", "l_partkey", F.col("first.o_orderdate").alias("first_date"), F.col("first.o_orderkey").alias("first_order"))


@query("array_items", """
SELECT l_partkey, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_partkey""")
def array_items(t):
    """Parts with their customers, through orders that carry their parts as a JSON array."""
    carried = t.lineitem.groupBy("l_orderkey").agg(F.to_json(F.collect_set("l_partkey")).alias("parts"))
    records = t.orders.join(carried, F.col("o_orderkey") == F.col("l_orderkey"))
    items = records.select("o_custkey", "o_orderdate", F.explode(F.from_json("parts", "array<bigint>")).alias("l_partkey"))
    return items.groupBy("l_partkey").agg(F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first_date"))


sql("layer_views", """
SELECT DISTINCT n_name, p_type, l_returnflag FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey WHERE l_returnflag IN ('A', 'R')""")

sql("completed_anti", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")

sql("semi_present", "SELECT p_partkey, p_brand FROM {part} LEFT SEMI JOIN {lineitem} ON p_partkey = l_partkey AND l_discount > 0.05",
    "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")

sql("orders_has_item_flag", """
SELECT o_orderkey, n_items IS NOT NULL AS has_items, coalesce(n_items, 0) AS n_items
FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM {lineitem} GROUP BY l_orderkey) x ON o_orderkey = l_orderkey""")

sql("left_join_fanout", """
SELECT c_custkey, count(o_orderkey) AS n_orders, count(*) AS n_rows
FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey""")


@query("coalesce_enrich", """
WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer),
     m AS (SELECT c_nationkey, round(avg(balance), 4) AS b FROM a GROUP BY 1)
SELECT c_custkey, c_nationkey, round(coalesce(balance, b), 2) AS balance, balance IS NULL AND b IS NOT NULL AS filled FROM a LEFT JOIN m USING (c_nationkey)""")
def coalesce_enrich(t):
    """Balances below zero count as missing and are filled with the nation's mean."""
    known = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    means = known.groupBy("c_nationkey").agg(F.round(F.avg("balance"), 4).alias("balance"))
    return dedup.fill_missing(known, means, ["c_nationkey"], ["balance"], "filled").withColumn("balance", F.round("balance", 2))


#: Which line flags a role may see; a role without an entry sees all. Fixed values of the query.
ROLE_FLAGS = {"packer": ["N"], "claims": ["R", "A"]}


@query("role_filtered_lines", """
SELECT r.role, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem
JOIN (VALUES ('packer', 'N'), ('claims', 'R'), ('claims', 'A')) r(role, flag) ON l_returnflag = r.flag""")
def role_filtered_lines(t):
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(f).alias("l_returnflag")) for r, fs in ROLE_FLAGS.items() for f in fs]))
    allowed = t.spark.range(1).select(rows.alias("x")).select("x.*")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").join(F.broadcast(allowed), "l_returnflag").select("role", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


def token_predicate(token: str, systems: dict[str, str]):
    """system|code searches one column, a bare code all of them; an unknown system filters nothing."""
    system, bar, code = token.partition("|")
    if not bar:
        found = F.lit(False)
        for c in systems.values():
            found = found | (F.col(c) == token)
        return found
    return F.col(systems[system]) == code if system in systems else F.lit(True)


@query("token_search", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand = 'Brand#12' OR p_type = (SELECT max(p_type) FROM part)")
def token_search(t):
    top = t.part.agg(F.max("p_type")).first()[0] or ""
    systems = {"brand": "p_brand", "type": "p_type"}
    return t.part.where(token_predicate("brand|Brand#12", systems) | token_predicate(top, systems)).select("p_partkey", "p_brand", "p_type")


sql("category_types", """
SELECT p_partkey, p_type, CASE WHEN p_type IN ('STANDARD', 'SMALL', 'MEDIUM') THEN 'plain' WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'offer' ELSE 'other' END AS category
FROM {part} WHERE p_size BETWEEN 5 AND 40 AND p_type NOT IN ('LARGE')""")

sql("date_prefix", """
SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1997-07-01'""",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-02' AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-06-30'")

sql("json_variant_filter", """
SELECT event_id, coalesce(get_json_object(props, '$.k'), 'none') AS variant FROM {events} WHERE coalesce(get_json_object(props, '$.variant'), 'plain') = 'plain' AND event_type <> 'view'""",
    "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS variant FROM events WHERE coalesce(json_extract_string(props, '$.variant'), 'plain') = 'plain' AND event_type <> 'view'")

sql("ilike_search", "SELECT c_custkey, c_name FROM {customer} WHERE c_name ILIKE '%customer#%1_' AND c_mktsegment IS NOT NULL")

sql("stage_verify_counts", """
SELECT 'orders' AS stage, o_orderstatus AS label, count(*) AS n FROM {orders} GROUP BY o_orderstatus
UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM {lineitem} GROUP BY l_returnflag
UNION ALL SELECT 'events', event_type, count(*) FROM {events} GROUP BY event_type
UNION ALL SELECT 'documents', lang, count(*) FROM {documents} GROUP BY lang""")

sql("call_stats", """
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high, round(avg(value), 4) AS mean_value,
       min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type""")

sql("having_min_sections", "SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey HAVING count(*) >= 12")

sql("sections_histogram", "SELECT n_lines, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n_lines FROM {lineitem} GROUP BY l_orderkey) x GROUP BY n_lines")

sql("timeline_span", """
SELECT o_custkey, CAST(datediff(max(o_orderdate), min(o_orderdate)) AS BIGINT) AS span_days, count(*) AS n FROM {orders} GROUP BY o_custkey""",
    "SELECT o_custkey, CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS span_days, count(*) AS n FROM orders GROUP BY o_custkey")

sql("coverage_pct", """
SELECT n_name, count(c_custkey) AS n_customers, count(has) AS n_with, CASE WHEN count(c_custkey) > 0 THEN round(100.0D * count(has) / count(c_custkey), 1) END AS pct
FROM {nation} LEFT JOIN {customer} ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS has FROM {orders}) o ON c_custkey = has GROUP BY n_name""",
    """SELECT n_name, count(c_custkey) AS n_customers, count(has) AS n_with, CASE WHEN count(c_custkey) > 0 THEN round(CAST(100.0 * count(has) / count(c_custkey) AS DOUBLE), 1) END AS pct
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS has FROM orders) o ON c_custkey = has GROUP BY n_name""")


@query("page_bundle", """
SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, 40 AS next_offset, 0 AS previous_offset
FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20""")
def page_bundle(t):
    """One page of a search result, with the total and the offsets of its neighbours."""
    return page(t.orders.where("o_orderstatus = 'F'"), [F.desc("o_orderdate"), "o_orderkey"], 20, 20).select("o_orderkey", "o_orderdate", "total", "next_offset", "previous_offset")


def page(df, order: list, size: int, offset: int):
    """The rows of one page in an order that tells all rows apart; next_offset is null on the last page, previous_offset on the first."""
    total = df.count()
    later, earlier = (offset + size if offset + size < total else None), (max(0, offset - size) if offset else None)
    marks = {"total": F.lit(total).cast("long"), "next_offset": F.lit(later).cast("int"), "previous_offset": F.lit(earlier).cast("int")}
    return df.orderBy(*order).offset(offset).limit(size).withColumns(marks)


sql("topk_recent", """
SELECT o_custkey, o_orderkey, o_orderdate, k FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM {orders}) x WHERE k <= 5""",
    """SELECT o_custkey, o_orderkey, o_orderdate, CAST(k AS INT) AS k FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) x WHERE k <= 5""")

sql("split_overlap", """
SELECT l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
INTERSECT SELECT l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'""")

sql("split_difference", """
SELECT DISTINCT c_nationkey AS nationkey FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 0""")

sql("edge_union", "SELECT l_partkey AS a, l_suppkey AS b FROM {lineitem} UNION SELECT l_suppkey, l_partkey FROM {lineitem}")

sql("count_reconcile", """
SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, 0) AS n_source, coalesce(y.n, 0) AS n_target, coalesce(x.n, 0) = coalesce(y.n, 0) AS equal
FROM (SELECT o_orderkey AS k, CAST(1 AS BIGINT) AS n FROM {orders}) x FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) y ON x.k = y.k""",
    """SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, 0)::BIGINT AS n_source, coalesce(y.n, 0) AS n_target, coalesce(x.n, 0) = coalesce(y.n, 0) AS equal
FROM (SELECT o_orderkey AS k, 1 AS n FROM orders) x FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey) y ON x.k = y.k""")

sql("cascade_delete_counts", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines
FROM {nation} JOIN {customer} ON n_nationkey = c_nationkey LEFT JOIN {orders} ON c_custkey = o_custkey LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY n_name""")

@query("cascade_delete", """
WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM o))
SELECT 'customer' AS name, (SELECT count(*) FROM c) AS n_gone, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS n_left
UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l)""")
def cascade_delete(t):
    """Rows that go from each table with the customers of every fifth nation, and rows that stay."""
    links = [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    tables = {n: t[n] for n in ("customer", "orders", "lineitem")}
    left, gone = sinks.cascade_delete(tables, links, t.customer.where("c_nationkey % 5 = 0").select("c_custkey"))
    counts = [df.agg(F.count("*").alias("n_left")).select(F.lit(n).alias("name"), F.lit(gone[n]).cast("long").alias("n_gone"), "n_left") for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


sql("truncate_marker", """
SELECT doc_id, CASE WHEN length(text) > 800 THEN concat(substring(text, 1, 800), ' [cut]') ELSE text END AS observation, length(text) AS n FROM {documents}""",
    "SELECT doc_id, CASE WHEN length(text) > 800 THEN concat(substring(text, 1, 800), ' [cut]') ELSE text END AS observation, CAST(length(text) AS INT) AS n FROM documents")

sql("prior_orders", """
SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) - 1 AS BIGINT) AS n_prior FROM {orders}""",
    """SELECT o.o_orderkey, count(p.o_orderkey) AS n_prior FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey""")

sql("nested_export", """
SELECT o_custkey, count(*) AS n_orders, array_join(transform(sort_array(collect_list(struct(o_orderdate, o_orderkey, o_orderstatus))), x -> concat(x.o_orderkey, ':', x.o_orderstatus)), ' ') AS orders
FROM {orders} GROUP BY o_custkey""",
    "SELECT o_custkey, count(*) AS n_orders, string_agg(concat(o_orderkey, ':', o_orderstatus), ' ' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY o_custkey")

sql("rollup_totals", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP(o_orderstatus, o_orderpriority)""")

sql("median_and_mode", """
SELECT p_type, CAST(median(p_size) AS INT) AS median_size, min_by(p_brand, struct(-n, p_brand)) AS dominant_brand
FROM (SELECT p_type, p_size, p_brand, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM {part}) x GROUP BY p_type""",
    """SELECT p_type, CAST(trunc(median(p_size)) AS INT) AS median_size, min_by(p_brand, {'a': -n, 'b': p_brand}) AS dominant_brand
FROM (SELECT p_type, p_size, p_brand, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part) x GROUP BY p_type""")

sql("grouping_distinct_sets", """
SELECT p_type, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_type""")
