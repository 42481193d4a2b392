"""Co-occurrence, typed edges, overlap, tiers and grades over parts, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import ordered, pairs, stats, tiers

from .registry import query, sql

sql("cooccurrence", """
SELECT p_type, l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY p_type, l_suppkey""")


@query("shared_order_pairs", """
WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), g AS (SELECT l_orderkey FROM r GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30), k AS (SELECT r.* FROM r JOIN g USING (l_orderkey))
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n_shared FROM k x JOIN k y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL""")
def shared_order_pairs(t):
    return pairs.item_pairs(t.lineitem, "l_orderkey", "l_partkey", most=30)


@query("weighted_overlap", """
WITH w AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS w FROM lineitem GROUP BY ALL), tt AS (SELECT l_suppkey, sum(w) AS t FROM w GROUP BY 1),
r AS (SELECT l_partkey FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), k AS (SELECT w.* FROM w JOIN r USING (l_partkey)),
s AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, sum(least(x.w, y.w)) AS s FROM k x JOIN k y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)
SELECT a, b, round(s / (p.t + q.t - s), 6) AS score FROM s JOIN tt p ON a = p.l_suppkey JOIN tt q ON b = q.l_suppkey WHERE s / (p.t + q.t - s) >= 0.05""")
def weighted_overlap(t):
    return pairs.weighted_overlap(t.lineitem, "l_suppkey", "l_partkey", F.col("l_quantity"), least_score=0.05).withColumn("score", F.round("score", 6))


@query("best_edge", """
WITH e AS (SELECT l_partkey AS a, l_suppkey AS b, l_returnflag AS kind, CASE WHEN l_discount > 0.05 THEN 1 ELSE 2 END AS class, l_orderkey AS source FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT a, b, kind, class, source FROM (SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY class, source) AS k FROM e) WHERE k = 1""")
def best_edge(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_discount") > 0.05, 1).otherwise(2).alias("class"), F.col("l_orderkey").alias("source"))
    return pairs.best_edges(edges)


#: Prefix rules of the query: fixed values.
BRAND_RULES = [("Brand#1", "first"), ("Brand#12", "override"), ("Brand#3", "third"), ("Brand#", "any")]


@query("prefix_edges", """
SELECT p_partkey, prefix, edge FROM part JOIN (VALUES ('Brand#1', 'first'), ('Brand#12', 'override'), ('Brand#3', 'third'), ('Brand#', 'any')) r(prefix, edge) ON starts_with(p_brand, prefix)""")
def prefix_edges(t):
    rules = t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(e).alias("edge")) for p, e in BRAND_RULES])))
    return pairs.prefix_matches(t.part.select("p_partkey", "p_brand"), "p_brand", rules, "prefix").select("p_partkey", "prefix", "edge")


sql("longest_prefix", """
SELECT p_partkey, max_by(edge, length(prefix)) AS edge FROM {part} JOIN (VALUES ('Brand#1', 'first'), ('Brand#12', 'override'), ('Brand#3', 'third'), ('Brand#', 'any')) r(prefix, edge)
ON p_brand LIKE concat(prefix, '%') GROUP BY p_partkey""")

sql("range_lookup", """
SELECT p_partkey, min_by(band, k) AS band FROM {part} JOIN (VALUES (1, 1, 10, 'small'), (2, 8, 25, 'middle'), (3, 20, 60, 'large')) r(k, lo, hi, band) ON p_size BETWEEN lo AND hi GROUP BY p_partkey""")

sql("map_normalize", """
SELECT o_orderkey, coalesce(map('F', 'final', 'O', 'open')[o_orderstatus], 'pending') AS state, coalesce(try_cast(substring(o_orderpriority, 1, 1) AS INT), 0) AS urgency FROM {orders}""",
    "SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END, 'pending') AS state, coalesce(try_cast(substring(o_orderpriority, 1, 1) AS INT), 0) AS urgency FROM orders")

sql("subsume_hub_drop", """
SELECT r_name, s.s_suppkey AS source, t.s_suppkey AS target FROM {supplier} s JOIN {nation} a ON s.s_nationkey = a.n_nationkey JOIN {region} ON a.n_regionkey = r_regionkey
JOIN {nation} b ON b.n_regionkey = r_regionkey AND b.n_nationkey > a.n_nationkey
JOIN (SELECT s_nationkey FROM {supplier} GROUP BY s_nationkey HAVING count(*) <= 100) h ON h.s_nationkey = b.n_nationkey
JOIN {supplier} t ON t.s_nationkey = b.n_nationkey WHERE s.s_acctbal > 5000 AND t.s_acctbal > 5000""")

sql("mediated_edges", """
SELECT DISTINCT s_nationkey AS source, c_nationkey AS target FROM {supplier} JOIN {lineitem} ON s_suppkey = l_suppkey JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey""")

@query("compat_pairs", """
SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey AND abs(x.s_acctbal - y.s_acctbal) <= 1500""")
def compat_pairs(t):
    """Suppliers of one nation whose balances differ by 1,500 at most: balances are dealt into bands of that width, and a supplier meets those of its own band and of both beside it."""
    return pairs.near_pairs(t.supplier, ["s_nationkey"], "s_suppkey", "s_acctbal", 1500)


sql("tiering", """
SELECT c_custkey, p_type, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 2 THEN 'primary'
       WHEN max(CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 'relevant' ELSE 'neutral' END AS tier, count(*) AS n
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey GROUP BY c_custkey, p_type""")

sql("grade_sections", """
SELECT o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 0) AS grade
FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey""")

sql("grade_distribution", """
SELECT o_custkey, count_if(g = 0) AS g0, count_if(g = 1) AS g1, count_if(g = 2) AS g2, count_if(g = 3) AS g3 FROM (
  SELECT o_custkey, o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 0) AS g
  FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey) x GROUP BY o_custkey""",
    """SELECT o_custkey, count_if(g = 0)::BIGINT AS g0, count_if(g = 1)::BIGINT AS g1, count_if(g = 2)::BIGINT AS g2, count_if(g = 3)::BIGINT AS g3 FROM (
  SELECT o_custkey, o_orderkey, coalesce(max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN 3 WHEN l_returnflag = 'R' THEN 2 WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 0) AS g
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey) x GROUP BY o_custkey""")

sql("difficulty", """
SELECT o_custkey, CASE WHEN points >= 5 THEN 'hard' WHEN points >= 3 THEN 'medium' ELSE 'easy' END AS difficulty, points FROM (
  SELECT o_custkey, CASE WHEN count(*) >= 15 THEN 3 WHEN count(*) >= 8 THEN 2 ELSE 1 END + CASE WHEN count(DISTINCT o_orderpriority) >= 4 THEN 2 ELSE 0 END + CASE WHEN max(o_totalprice) > 400000 THEN 1 ELSE 0 END AS points
  FROM {orders} GROUP BY o_custkey) x""")


@query("stratified_split", """SELECT doc_id, CASE WHEN rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'dev' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat('7:', doc_id)), doc_id) AS rn, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) x""")
def stratified_split(t):
    """A fifth of each language and source, one document at least, in the order of a salted hash."""
    docs = t.documents.select("doc_id", "lang", "source")
    return stats.quota_split(docs, ["lang", "source"], [F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256), "doc_id"], {"dev": 0.2, "train": 0.8}, least=1).select("doc_id", "split")


@query("nested_tiers", """SELECT doc_id, CASE WHEN pr <= 0.1 THEN 'small' WHEN pr <= 0.4 THEN 'medium' ELSE 'large' END AS tier FROM (
  SELECT doc_id, percent_rank() OVER (PARTITION BY lang, source ORDER BY sha256(concat('3:', doc_id)), doc_id) AS pr FROM documents) x""")
def nested_tiers(t):
    """Tiers that hold each other, by the place of a document among those of its language and source."""
    docs = t.documents.select("doc_id", "lang", "source", F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")), 256).alias("h"))
    placed = ordered.numbered(docs, ["lang", "source"], ["h", "doc_id"], number="k", size="n")
    share = F.when(F.col("n") > 1, (F.col("k") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return placed.select("doc_id", F.when(share <= 0.1, "small").when(share <= 0.4, "medium").otherwise("large").alias("tier"))


@query("field_tiers", """
WITH o AS (SELECT DISTINCT o_custkey AS entity, l_suppkey AS finding, CAST(replace(p_brand, 'Brand#', '') AS INT) AS condition FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
h AS (SELECT condition, field FROM (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS condition, p_type AS field, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY p_brand, p_type) WHERE k = 1),
f AS (SELECT DISTINCT p_type AS field FROM part), c AS (SELECT DISTINCT condition FROM h), g AS (SELECT x.condition AS a, y.condition AS b, (x.condition + y.condition) % 17 AS m FROM c x JOIN c y ON x.condition <> y.condition WHERE (x.condition + y.condition) % 17 IN (0, 1)),
p AS (SELECT DISTINCT entity, condition FROM o), i AS (SELECT DISTINCT entity, field FROM p JOIN h USING (condition)),
l AS (SELECT o.entity, h.field, o.finding, 0 AS tier FROM o JOIN h USING (condition) UNION ALL SELECT o.entity, h.field, o.finding, 1 + m FROM o JOIN g ON o.condition = a JOIN p ON p.entity = o.entity AND p.condition = b JOIN h ON h.condition = b),
n AS (SELECT DISTINCT entity, finding FROM o),
b AS (SELECT i.entity, i.field, n.finding, coalesce(min(l.tier), 3) AS tier FROM i JOIN n USING (entity) LEFT JOIN l ON l.entity = i.entity AND l.field = i.field AND l.finding = n.finding GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, field, tier ORDER BY finding) AS rank FROM b),
s AS (SELECT entity, field, row_number() OVER (PARTITION BY entity ORDER BY field) AS j FROM (SELECT DISTINCT entity FROM o) CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.entity = o.entity AND i.field = f.field)),
a AS (SELECT s.entity, s.field, n.finding, row_number() OVER (PARTITION BY s.entity, s.field ORDER BY finding) AS rank FROM s JOIN n USING (entity) WHERE j <= 2)
SELECT entity, field, 'involved' AS involvement, ['primary', 'relevant', 'neutral', 'excluded'][tier + 1] AS tier, rank, finding FROM r WHERE rank <= CASE tier WHEN 3 THEN 15 ELSE 20 END
UNION ALL SELECT entity, field, 'absent', 'excluded', rank, finding FROM a WHERE rank <= 15""".replace("FROM (SELECT DISTINCT entity FROM o) CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.entity = o.entity AND i.field = f.field)", "FROM (SELECT DISTINCT entity FROM o) e CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.entity = e.entity AND i.field = f.field)"))
def field_tiers(t):
    """For each customer and type of parts, the suppliers by tier: brands are the conditions, at home in their most frequent type, and linked where their numbers add up to a multiple of 17 (gold) or one more (neutral)."""
    number = F.regexp_replace("p_brand", "Brand#", "").cast("int")
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    owners = lines.select(F.col("o_custkey").alias("entity"), F.col("l_suppkey").alias("finding"), number.alias("condition"))
    home = t.part.groupBy(number.alias("condition"), F.col("p_type").alias("field")).agg(F.count("*").alias("n")).groupBy("condition").agg(F.min_by("field", F.struct((-F.col("n")).alias("n"), F.col("field"))).alias("field"))
    brands = home.select("condition").distinct()
    rest = brands.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("r", F.pmod(F.col("m") - F.col("condition"), F.lit(17)))
    links = rest.join(brands.select(F.col("condition").alias("b"), F.pmod("condition", F.lit(17)).alias("r")), "r").where("condition <> b").select(F.col("condition").alias("a"), "b", "m")
    return tiers.tiers(owners, home, links.where("m = 0"), links.where("m = 1"), t.part.select(F.col("p_type").alias("field")))
