"""Chart-service queries: searches over customers (patients), orders (encounters), lines (observations) and documents (reports)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import clinical, text
from tallgrass.operators import dedup, resolve, retrieval
from tallgrass.sources.tables import checkpoint_folder

from .registry import query, sql

#: Rows that one task of condition_search groups.
ROWS = 500_000


def search(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """The rows that meet all conditions that are given."""
    return reduce(lambda d, c: d if c is None else d.where(c), conditions, df)


def date_condition(column: Column, value: str | None) -> Column | None:
    """ge2024-01-01, le2024-01-01 or an exact day, compared as text."""
    if not value:
        return None
    text = F.date_format(column, "yyyy-MM-dd")
    return {"ge": text >= value[2:], "le": text <= value[2:]}.get(value[:2], text == value)


@query("patient_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%9%' AND c_mktsegment = 'BUILDING'")
def patient_search(t):
    return search(t.customer, F.col("c_name").ilike("%9%"), F.col("c_mktsegment") == "BUILDING", None).select("c_custkey", "c_name", "c_mktsegment")


@query("encounter_search", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30' AND o_orderstatus = 'F'")
def encounter_search(t):
    day = F.col("o_orderdate")
    return search(t.orders, date_condition(day, "ge1995-01-01"), date_condition(day, "le1996-06-30"), date_condition(day, None), F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_orderdate")


@query("condition_search", """
SELECT o_custkey, l_partkey, min(o_orderkey) AS first_order, CASE WHEN bool_or(l_returnflag = 'R') THEN 'active' ELSE 'resolved' END AS status, count(DISTINCT o_orderkey) AS n_orders
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 2""")
def condition_search(t):
    """Parts that a customer ordered at least twice, with a status."""
    both = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    # the groups' rows meet before any hash table is made, in tasks of about ROWS rows at any size of the table
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.lineitem.count() // ROWS + 1)
    found = both.repartition(tasks, "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("first_order"), F.when(F.bool_or(F.col("l_returnflag") == "R"), "active").otherwise("resolved").alias("status"), F.count_distinct("o_orderkey").alias("n_orders"))
    return found.where("n_orders >= 2")


sql("observation_search", """
SELECT l_orderkey, p_partkey, p_type, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'laboratory' ELSE 'exam' END AS category, round(sum(l_quantity), 2) AS value
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE') GROUP BY l_orderkey, p_partkey, p_type""")

sql("report_documents", "SELECT doc_id, source, lang, sha2(text, 256) AS content FROM {documents} WHERE lang IN ('en', 'fr') AND n_chars >= 200",
    "SELECT doc_id, source, lang, sha256(text) AS content FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 200")

sql("service_requests", """
SELECT o_orderkey, c_custkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'stat' WHEN '2' THEN 'urgent' ELSE 'routine' END AS priority, s_name
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_linenumber = 1""")


@query("section_by_role", """
SELECT conv_id, turn, role, length(text)::INT AS n FROM conversations WHERE role <> 'system'""")
def section_by_role(t):
    """Turns that a reader without full access may see."""
    allowed = t.spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    return t.conversations.join(F.broadcast(allowed), "role", "left_semi").select("conv_id", "turn", "role", F.length("text").alias("n"))


sql("lab_results", """
SELECT o_custkey, l_orderkey, round(max(l_extendedprice), 2) AS highest, bool_or(l_discount > 0.08) AS flagged FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey AND l_returnflag <> 'N' GROUP BY o_custkey, l_orderkey""")


@query("preread_context", """
SELECT o_orderkey, CAST(k AS INT) AS k, l_partkey, l_shipdate FROM (
  SELECT o_orderkey, l_partkey, l_shipdate, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P') WHERE k <= 3""")
def preread_context(t):
    lines = t.orders.where("o_orderstatus = 'P'").select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.row_number().over(Window.partitionBy("o_orderkey").orderBy(F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_linenumber"))
    return lines.withColumn("k", k).where("k <= 3").select("o_orderkey", "k", "l_partkey", "l_shipdate")


@query("submission_upsert", """
SELECT user_id, event_id, value, k = 1 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1""")
def submission_upsert(t):
    """The first submission of each user counts, later ones change nothing."""
    return dedup.pick_first(t.events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value", F.lit(True).alias("accepted"))


@query("hybrid_search")
def hybrid_search(t):
    """Documents for each benchmark item: the best by words, ranked again by the Jaccard similarity of their tokens, both rankings fused by reciprocal ranks."""
    checkpoint_folder(t.spark)
    lexical = retrieval.bm25_topk(t.documents, "doc_id", t.benchmark, "item_id", k=50).checkpoint()
    known = lambda c: F.array_distinct(text.tokens(F.col(c)))
    # sets of tokens are made once for each text that was found, then compared
    texts = t.documents.join(lexical.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", known("text").alias("held"))
    found = lexical.select("item_id", "doc_id").join(texts, "doc_id").join(t.benchmark.select("item_id", known("text").alias("asked")), "item_id")
    grams = found.select("item_id", "doc_id", F.round(text.jaccard(F.col("asked"), F.col("held")), 6).alias("score"))
    return retrieval.fuse({"words": lexical.select("item_id", "doc_id", "k"), "tokens": retrieval._top(grams, "item_id", "doc_id", 50).select("item_id", "doc_id", "k")}, "item_id", "doc_id").where("k <= 10")


sql("terminology_lookup", """
SELECT p_partkey, p_brand AS system, p_name AS display, p_size > 3 AS is_active FROM {part} WHERE p_name ILIKE '%ring%'""")

sql("preferred_term", """
SELECT p_brand, min_by(p_name, struct(length(p_name), p_name)) AS preferred, count(*) AS n_terms FROM {part} GROUP BY p_brand""",
    "SELECT p_brand, min_by(p_name, {'a': length(p_name), 'b': p_name}) AS preferred, count(*) AS n_terms FROM part GROUP BY p_brand")

sql("stage_durations", """
SELECT event_type AS stage, sum(gap) div count(*) AS mean_gap, max(gap) AS longest FROM (
  SELECT event_type, unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS TIMESTAMP)) AS gap FROM {events}) x WHERE gap IS NOT NULL GROUP BY event_type""",
    """SELECT event_type AS stage, CAST(sum(gap) // count(*) AS BIGINT) AS mean_gap, max(gap) AS longest FROM (
  SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) x WHERE gap IS NOT NULL GROUP BY event_type""")

sql("patient_selection", """
SELECT c_custkey FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(DISTINCT o_orderstatus) >= 2 AND count(*) >= 3""")

sql("overlap_report", """
SELECT r_name, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN l_partkey END) AS parts_f, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN l_partkey END) AS parts_o, count(DISTINCT l_partkey) AS parts_all
FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY r_name""")

sql("passage_norm", """
SELECT e.event_id, coalesce(a.event_id, b.event_id) AS passage FROM {events} e LEFT JOIN {events} a ON a.event_id = e.event_id AND a.value > 50 LEFT JOIN {events} b ON b.event_id = e.event_id + 1 AND b.value > 50""")

sql("nearest_valid_prefix", """
SELECT p_partkey, max_by(valid, length(valid)) AS nearest FROM (SELECT p_partkey, explode(transform(sequence(4, greatest(4, length(p_name))), i -> substring(p_name, 1, i))) AS valid FROM {part}) x
LEFT SEMI JOIN (SELECT DISTINCT substring(p_name, 1, 6) AS v FROM {part} UNION SELECT DISTINCT substring(p_name, 1, 4) FROM {part}) y ON valid = v GROUP BY p_partkey""",
    """SELECT p_partkey, max_by(valid, length(valid)) AS nearest FROM (SELECT p_partkey, unnest(list_transform(range(4, greatest(4, length(p_name)) + 1), lambda i: substring(p_name, 1, i))) AS valid FROM part) x
WHERE valid IN (SELECT substring(p_name, 1, 6) FROM part UNION SELECT substring(p_name, 1, 4) FROM part) GROUP BY p_partkey""")

sql("resolve_cascade", """
SELECT l_partkey, coalesce(a.p_brand, b.n_name, 'none') AS resolved, CASE WHEN a.p_brand IS NOT NULL THEN 'brand' WHEN b.n_name IS NOT NULL THEN 'nation' ELSE 'none' END AS method, count(*) AS n
FROM {lineitem} LEFT JOIN {part} a ON l_partkey = p_partkey AND p_size <= 20 LEFT JOIN {supplier} ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN {nation} b ON s_nationkey = n_nationkey
GROUP BY l_partkey, coalesce(a.p_brand, b.n_name, 'none'), CASE WHEN a.p_brand IS NOT NULL THEN 'brand' WHEN b.n_name IS NOT NULL THEN 'nation' ELSE 'none' END""")


@query("nearest_codes", """
WITH v AS (SELECT 'E' || (o_orderkey // 10) AS code, (o_orderkey // 10) % 3 = 0 AS h FROM orders UNION SELECT 'E' || left(o_orderkey::VARCHAR, 2), true FROM orders), k AS (SELECT code, min(h) AS h FROM v GROUP BY 1),
a AS (SELECT DISTINCT 'E' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '7' ELSE '' END AS code FROM orders), p AS (SELECT code, unnest(range(3, greatest(length(code) - 1, 3) + 1)) AS n FROM a WHERE length(code) >= 3)
SELECT a.code, max_by(left(p.code, n), n) FILTER (k.code IS NOT NULL AND (n = 3 OR NOT h)) AS nearest FROM a LEFT JOIN p ON a.code = p.code LEFT JOIN k ON k.code = left(p.code, n) GROUP BY a.code""")
def nearest_codes(t):
    """Codes that no list has, with the nearest that it has."""
    key = F.col("o_orderkey").cast("string")
    asked = t.orders.select(F.concat(F.lit("E"), key, F.when(F.col("o_orderkey") % 2 == 0, "7").otherwise("")).alias("code"))
    tens = F.expr("o_orderkey div 10")
    valid = t.orders.select(F.concat(F.lit("E"), tens.cast("string")).alias("code"), (tens % 3 == 0).alias("is_header")).union(t.orders.select(F.concat(F.lit("E"), F.left(key, F.lit(2))), F.lit(True)))
    return resolve.nearest_codes(asked, "code", valid)


@query("known_ids", """
WITH k AS (SELECT CASE event_id % 4 WHEN 0 THEN 'ees_' || event_id WHEN 1 THEN 'fc_' || event_id ELSE event_id::VARCHAR END AS id FROM events WHERE event_id % 5 <> 0),
a AS (SELECT DISTINCT CASE WHEN event_id % 4 = 3 THEN 'x_' || event_id WHEN event_id % 8 = 1 THEN 'fc_' || event_id ELSE event_id::VARCHAR END AS asked FROM events)
SELECT asked, CASE WHEN asked IN (FROM k) THEN asked WHEN 'ees_' || asked IN (FROM k) THEN 'ees_' || asked WHEN 'fc_' || asked IN (FROM k) THEN 'fc_' || asked
  WHEN contains(asked, '_') AND regexp_replace(asked, '^[^_]*_', '') IN (FROM k) THEN regexp_replace(asked, '^[^_]*_', '') ELSE asked END AS known_id FROM a""")
def known_ids(t):
    """Ids as they are submitted, and as the judgements have them."""
    e, own = F.col("event_id"), F.col("event_id").cast("string")
    known = t.events.where(e % 5 != 0).select(F.when(e % 4 == 0, F.concat(F.lit("ees_"), own)).when(e % 4 == 1, F.concat(F.lit("fc_"), own)).otherwise(own).alias("id"))
    asked = t.events.select(F.when(e % 4 == 3, F.concat(F.lit("x_"), own)).when(e % 8 == 1, F.concat(F.lit("fc_"), own)).otherwise(own).alias("asked"))
    return resolve.known_ids(asked, "asked", known)


@query("category_events", """
SELECT asked, count(*) FILTER (asked NOT IN ('sales', 'looks') OR (asked = 'sales' AND event_type IN ('purchase', 'refund')) OR (asked = 'looks' AND event_type IN ('view', 'click'))) AS n
FROM events, (VALUES ('sales'), ('looks'), ('other')) a(asked) GROUP BY asked""")
def category_events(t):
    """Events of a category; one that isn't known filters nothing."""
    kinds = {"sales": ("purchase", "refund"), "looks": ("view", "click")}
    one = lambda asked: t.events.where(clinical.of_category(F.col("event_type"), asked, kinds)).agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "n")
    return one("sales").union(one("looks")).union(one("other"))


@query("first_seen", """
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY d, k) AS seen FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d, k) AS r FROM (SELECT o_custkey, o_orderpriority, min((o_orderdate, o_orderkey))[1] AS d, min((o_orderdate, o_orderkey))[2] AS k FROM orders GROUP BY ALL)) WHERE r <= 3 GROUP BY o_custkey""")
def first_seen(t):
    """The first three priorities of each customer's orders, as they are first seen."""
    return dedup.first_seen(t.orders, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], most=3).select("o_custkey", F.array_join("values", "|").alias("seen"))


@query("habits", r"""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'former' WHEN 2 THEN 'current' END AS smoking, CASE c_custkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'heavy' END AS drinking,
  CASE c_custkey % 5 WHEN 0 THEN 'African-American' WHEN 1 THEN 'asian' WHEN 2 THEN 'Pacific Islander' END AS origin, CASE WHEN floor(abs(c_acctbal) / 150) > 0 THEN 2024 - floor(abs(c_acctbal) / 150)::INT END AS born FROM customer""")
def habits(t):
    """What a customer's social history, written from several shapes of sentences, says of smoking, drinking, origin and age."""
    k = F.col("c_custkey")
    smokes = F.when(k % 4 == 0, F.when(k % 8 == 0, "Denies any tobacco use").otherwise("a non-smoker")).when(k % 4 == 1, F.when(k % 8 == 1, "quit smoking in May; 10 pack-years").otherwise("Ex smoker")).when(k % 4 == 2, F.when(k % 8 == 2, "smokes 2 cigars").otherwise("one pack a day, two packs per day before")).otherwise("no information")
    drinks = F.when(k % 3 == 0, F.when(k % 6 == 0, "does not drink alcohol").otherwise("Teetotal")).when(k % 3 == 1, F.when(k % 6 == 1, "drinks 4 beers a day").otherwise("known alcoholism")).otherwise("drinks wine")
    comes = F.when(k % 5 == 0, "African-American").when(k % 5 == 1, "asian").when(k % 5 == 2, "Pacific Islander").otherwise("tall")
    note = F.concat_ws(". ", F.concat(F.lit("A "), comes, F.lit(" customer")), smokes, drinks)
    age = F.floor(F.abs("c_acctbal") / 150).cast("int")
    return t.customer.select("c_custkey", clinical.status(note, clinical.SMOKING).alias("smoking"), clinical.status(note, clinical.DRINKING).alias("drinking"), clinical.origin(note).alias("origin"), clinical.birth_year(age).alias("born"))
