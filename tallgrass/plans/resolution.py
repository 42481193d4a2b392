"""Names and codes, hierarchies, nested records, corrections and conditioned metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import clinical, nested
from tallgrass.operators import graph, hierarchy, metrics, phrases, resolve
from tallgrass.sources.tables import tasks_for

from .registry import query
from .texts import FORMS, GRAMS

WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("concept_match", f"""
WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), i AS (
  SELECT 3 * item_id AS concept, w[1] || ' ' || w[2] AS name FROM b UNION ALL SELECT 3 * item_id + 1, w[1] FROM b UNION ALL SELECT 3 * item_id + 2, w[2] || ' ' || w[5] FROM b),
c AS (SELECT concept, {WORDS.format(c="name")} AS k FROM i), n AS (SELECT concept, len(k) AS need, unnest(k) AS w FROM c), e AS (SELECT concept, need, w AS word, unnest({FORMS}) AS form FROM n),
t AS (SELECT DISTINCT conv_id || '-' || turn AS id, unnest({WORDS.format(c="text")}) AS w FROM conversations), d AS (SELECT id, unnest({FORMS}) AS form FROM t),
f AS (SELECT id, concept, need FROM d JOIN e USING (form) GROUP BY ALL HAVING count(DISTINCT word) = need),
s AS (SELECT x.concept, y.concept AS over FROM e x JOIN e y ON x.form = y.form AND x.need < y.need GROUP BY x.concept, y.concept, x.need HAVING count(DISTINCT x.word) = x.need)
SELECT id, concept FROM f WHERE NOT EXISTS (SELECT 1 FROM s JOIN f g ON g.concept = s.over WHERE s.concept = f.concept AND g.id = f.id)""")
def concept_match(t):
    """The concepts of an inventory, here of words of the benchmark, that each turn of a conversation holds."""
    w = F.split("text", " ")
    name = lambda *at: F.concat_ws(" ", *[F.get(w, F.lit(i)) for i in at])
    kinds = [name(0, 1), name(0), name(1, 4)]
    inventory = t.benchmark.select("item_id", F.posexplode(F.array(*kinds)).alias("i", "name")).select((3 * F.col("item_id") + F.col("i")).alias("concept"), "name")
    turns = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return resolve.concepts(turns, "id", "text", inventory)


def _phrase_tables(t):
    """An inventory of names of one to three words of the benchmark, and patterns of which some parts are prefixes."""
    w = F.split("text", " ")
    name = lambda *at: F.concat_ws(" ", *[F.get(w, F.lit(i)) for i in at])
    names = F.array(name(0), name(1, 2), name(3, 4, 5))
    inventory = t.benchmark.select("item_id", F.posexplode(names).alias("i", "name")).select(F.concat_ws("-", "item_id", "i").alias("concept"), "name")
    part = lambda at: F.concat(F.left(F.get(w, F.lit(at)), F.lit(4)), F.lit("*"))
    patterns = t.benchmark.select("item_id", F.posexplode(F.array(part(6), F.concat_ws(" ", part(7), F.get(w, F.lit(8))))).alias("i", "pattern"))
    return inventory, patterns.select(F.col("item_id").cast("string").alias("concept"), (2 * F.col("item_id") + F.col("i")).alias("number"), F.lower(F.regexp_replace("pattern", "[^A-Za-z0-9* ]", "")).alias("pattern"))


@query("phrase_concepts")
def phrase_concepts(t):
    """What each turn of a conversation names by phrases and patterns."""
    return phrases.concepts(t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", "text", *_phrase_tables(t))


@query("concept_agreement")
def concept_agreement(t):
    """Precision, recall and F1 of the concepts of each assistant's turn against those of the user's turn before it."""
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("predicted"), "reference")
    tables = _phrase_tables(t)
    return phrases.agreement(pairs, "id", "predicted", "reference", lambda d, i, c: phrases.concepts(d, i, c, *tables))


@query("name_cascade", f"""
WITH k AS (SELECT p_name AS name, min(p_brand) AS code FROM part WHERE p_size <= 25 GROUP BY 1), a AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' ELSE 'qqq' || p_partkey END AS name FROM part),
x AS (SELECT a.name, k1.code AS c1, k2.code AS c2 FROM a LEFT JOIN k k1 ON a.name = k1.name LEFT JOIN k k2 ON a.name = upper(k2.name)),
g AS (SELECT name, {GRAMS.format(c='name')} AS g FROM x WHERE c1 IS NULL AND c2 IS NULL), h AS (SELECT name, code, {GRAMS.format(c='name')} AS g FROM k),
p AS (SELECT g.name, h.code, row_number() OVER (PARTITION BY g.name ORDER BY len(list_intersect(g.g, h.g)) / (len(g.g) + len(h.g) - len(list_intersect(g.g, h.g))) DESC, h.name) AS k
      FROM g, h WHERE len(list_intersect(g.g, h.g)) / (len(g.g) + len(h.g) - len(list_intersect(g.g, h.g))) >= 0.7)
SELECT x.name, coalesce(c1, c2, p.code) AS code, CASE WHEN c1 IS NOT NULL THEN 'exact' WHEN c2 IS NOT NULL THEN 'folded' WHEN p.code IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method
FROM x LEFT JOIN p ON x.name = p.name AND p.k = 1""")
def name_cascade(t):
    """Written names of parts to brands: as they are, in capitals, else by the most similar name."""
    k = F.col("p_partkey") % 4
    names = t.part.select(F.when(k == 0, F.col("p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.concat("p_name", F.lit("s"))).otherwise(F.concat(F.lit("qqq"), "p_partkey")).alias("name"))
    known = t.part.where("p_size <= 25").select(F.col("p_name").alias("name"), F.col("p_brand").alias("code"))
    return resolve.cascade(names, "name", {"exact": known, "folded": known.withColumn("name", F.upper("name"))}, fuzzy=known)


@query("subsumed_items", """
WITH RECURSIVE e AS (SELECT c_custkey AS node, c_custkey // 10 AS ancestor FROM customer WHERE c_custkey > 0), c AS (SELECT node, ancestor FROM e UNION SELECT c.node, e.ancestor FROM c JOIN e ON c.ancestor = e.node),
u AS (SELECT DISTINCT ancestor, c_custkey FROM c JOIN customer ON node = c_custkey WHERE c_acctbal > 5000)
SELECT ancestor, c_custkey FROM u WHERE ancestor IN (SELECT ancestor FROM u GROUP BY 1 HAVING count(*) <= 100)""")
def subsumed_items(t):
    """Customers with high balances under each ancestor of a tree, in which a key's parent is the key without its last digit."""
    edges = t.customer.where("c_custkey > 0").select("c_custkey", F.expr("c_custkey div 10").alias("parent"))
    return graph.subsumed(t.customer.where("c_acctbal > 5000"), graph.ancestors(edges, "c_custkey", "parent"), "c_custkey")


@query("interval_under", """
WITH e AS (SELECT 'part ' || p_partkey AS item, [p_brand, p_type, 'group ' || left(p_brand, 7), 'price ' || CAST(floor(p_retailprice / 200) AS INT), 'all'] AS tops FROM part) SELECT unnest(tops) AS top, item FROM e""")
def interval_under(t):
    """Parts under each node of a hierarchy of several parents: a part lies below its brand, its type and its band of prices, a brand below its group, and groups, types and bands below one root."""
    name = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    group, band = F.concat(F.lit("group "), F.left("p_brand", F.lit(7))), F.concat(F.lit("price "), F.floor(F.col("p_retailprice") / 200).cast("int").cast("string"))
    edges = [(name, F.col("p_brand")), (name, F.col("p_type")), (name, band), (F.col("p_brand"), group), (group, F.lit("all")), (F.col("p_type"), F.lit("all")), (band, F.lit("all"))]
    table = t.part.select(F.explode(F.array(*[F.struct(c.alias("child"), p.alias("parent")) for c, p in edges])).alias("e")).select("e.*").distinct()
    tree = hierarchy.Hierarchy(table, "child", "parent")
    return tree.under(t.part.select(name.alias("item")), "item", table.select(F.col("parent").alias("top")), "top")


@query("build_order", """
SELECT a, b, kind, min(source)::INT AS source FROM (SELECT l_partkey AS a, l_suppkey AS b, 'supplies' AS kind, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS source FROM lineitem) WHERE a <> b GROUP BY ALL""")
def build_order(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("supplies").alias("kind"), "l_returnflag")
    return graph.build_in_order([edges.where(F.col("l_returnflag") == f) for f in ("R", "A", "N")])


@query("restricted_neighbours", """
WITH l AS (SELECT o_custkey, l_partkey, l_suppkey, o_orderstatus, o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT DISTINCT s.o_custkey, b.b AS node FROM (SELECT DISTINCT o_custkey, l_partkey FROM l WHERE o_orderpriority LIKE '1%') s JOIN b ON b.a = s.l_partkey
WHERE (s.o_custkey, b.b) IN (SELECT o_custkey, l_suppkey FROM l WHERE o_orderstatus = 'O')""")
def restricted_neighbours(t):
    """Suppliers beside the parts of a customer's urgent orders, of those that the customer's open orders name."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    edges = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    seeds = lines.where("o_orderpriority LIKE '1%'").select("o_custkey", F.col("l_partkey").alias("node"))
    return graph.neighbours(edges, seeds, lines.where("o_orderstatus = 'O'").select("o_custkey", F.col("l_suppkey").alias("node")), group="o_custkey")


@query("apply_corrections", """
WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') ELSE 'New#' || (c_custkey // 20) END AS new FROM customer WHERE c_custkey % 5 = 0),
w AS (SELECT f.c_custkey, f.new, f.new IN (SELECT c_name FROM customer) AS held, min(f.c_custkey) OVER (PARTITION BY f.new) AS first FROM f JOIN customer c ON c.c_custkey = f.c_custkey AND c.c_name <> f.new)
SELECT c.c_custkey, CASE WHEN NOT held AND first = c.c_custkey THEN new ELSE c_name END AS c_name, CASE WHEN held IS NULL THEN 'kept' WHEN NOT held AND first = c.c_custkey THEN 'applied' ELSE 'conflict' END AS status
FROM customer c LEFT JOIN w USING (c_custkey)""")
def apply_corrections(t):
    fixes = t.customer.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("New#"), F.expr("c_custkey div 20"))).alias("c_name"))
    return resolve.corrected(t.customer.select("c_custkey", "c_name"), fixes, "c_custkey", "c_name")


@query("crosswalk_audit", f"""
WITH w AS (SELECT p_name, list(DISTINCT p_type) AS kinds FROM part WHERE p_size <= 20 GROUP BY 1), x AS (SELECT p_partkey, p_name, p_type, {GRAMS.format(c='p_name')} AS a, {GRAMS.format(c='p_type')} AS b FROM part)
SELECT p_partkey, p_type FROM x JOIN w USING (p_name) WHERE NOT list_contains(kinds, p_type) AND len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) < 0.15""")
def crosswalk_audit(t):
    """Parts whose type isn't among those that a reference list gives for their name, and whose type isn't alike the name either."""
    from tallgrass.functions import text

    listed = t.part.where("p_size <= 20").groupBy("p_name").agg(F.collect_set("p_type").alias("kinds"))
    alike = text.jaccard(text.char_ngrams(F.col("p_name")), text.char_ngrams(F.col("p_type")))
    return t.part.join(listed, "p_name").where(~F.array_contains("kinds", F.col("p_type")) & (alike < 0.15)).select("p_partkey", "p_type")


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(t):
    return resolve.seeded_sample(t.documents, "doc_id", 100, 7).select("doc_id", "lang")


@query("sorted_search", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def sorted_search(t):
    return resolve.ordered_by(t.orders.where("o_orderstatus = 'O'"), {"date": "o_orderdate"}, "-date", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


@query("loose_lists", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '|' || o_orderstatus WHEN 1 THEN o_custkey || '|' || o_orderstatus WHEN 2 THEN o_orderstatus ELSE '' END AS items FROM orders""")
def loose_lists(t):
    """Lists in JSON, with commas, as one value and missing, read alike."""
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.concat(F.lit("["), "o_custkey", F.lit(', "'), "o_orderstatus", F.lit('"]'))).when(k == 1, F.concat("o_custkey", F.lit(" ,  "), "o_orderstatus", F.lit(","))).when(k == 2, F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    return t.orders.select("o_orderkey", F.array_join(nested.loose_list(written), "|").alias("items"))


@query("leakage_guard", """
WITH i AS (SELECT o_custkey, list_sort(list(o_orderdate))[(count(*) + 1) // 2] AS middle FROM orders GROUP BY 1)
SELECT o_custkey, count(*) FILTER (o_orderdate <= middle AND o_orderstatus <> 'P') AS n_kept, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_orderdate <= middle AND o_orderstatus <> 'P'), '') AS kept FROM orders JOIN i USING (o_custkey) GROUP BY 1""")
def leakage_guard(t):
    """Each customer's nested orders without those after the middle one and without pending ones."""
    each = t.orders.select("o_custkey", "o_orderdate", F.struct("o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").alias("pending")).alias("o"))
    records = each.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("orders"), F.sort_array(F.collect_list("o_orderdate")).alias("dates"))
    records = records.withColumn("at", F.get("dates", F.floor((F.size("dates") - 1) / 2).cast("int")))
    allowed = F.transform(F.filter("orders", lambda o: o["o_orderdate"] <= F.col("at")), lambda o: o["o_orderkey"])
    kept = nested.without_flagged(nested.allowed_only(F.col("orders"), "o_orderkey", allowed), "pending")
    return records.select("o_custkey", F.size(kept).cast("long").alias("n_kept"), F.array_join(F.transform(kept, lambda o: o["o_orderkey"].cast("string")), ",").alias("kept"))


@query("nan_to_null", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events")
def nan_to_null(t):
    k = F.col("event_id") % 3
    return t.events.select("event_id", nested.nan_to_null(F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value"))).alias("value"))


@query("tag_levels", "SELECT p_partkey, p_type AS kind, replace(p_brand, '#', ' ') AS brand, CAST(NULL AS VARCHAR) AS other FROM part")
def tag_levels(t):
    tags = F.array(F.lit("misc"), F.concat(F.lit("#Deck::Kinds::"), "p_type", F.lit("::"), F.replace("p_brand", F.lit("#"), F.lit("_"))))
    return t.part.select("p_partkey", nested.tag_value(tags, "#deck::kinds").alias("kind"), nested.tag_value(tags, "#Deck::Kinds", 2).alias("brand"), nested.tag_value(tags, "#Other").alias("other"))


@query("card_fields", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'cloze' WHEN p_size > 10 THEN 'vignette' ELSE CASE WHEN p_type = 'PROMO' THEN 'occlusion' ELSE 'basic' END END AS kind,
       CASE WHEN p_size % 2 = 0 THEN 'Text' WHEN length(p_name) >= 10 THEN 'Front' ELSE 'Original' END AS field FROM part""")
def card_fields(t):
    """Kinds of cards by model and text, and the first field that says enough."""
    body = F.when(F.col("p_size") > 25, F.concat(F.lit("{{c1::"), "p_name", F.lit("}}"))).when(F.col("p_size") > 10, F.concat(F.lit("A "), "p_size", F.lit("-year-old "), "p_name")).otherwise(F.col("p_name"))
    model = F.when((F.col("p_type") == "PROMO") & (F.col("p_size") <= 10), "Image Occlusion").otherwise("Plain")
    field = nested.first_field({"Text": F.when(F.col("p_size") % 2 == 0, F.lit("long enough a text")), "Front": F.col("p_name"), "Original": F.concat("p_name", F.lit(" as it was"))}, least=10)
    return t.part.select("p_partkey", nested.card_kind(model, body, {"overhaul": "cloze"}).alias("kind"), field["name"].alias("field"))


@query("demographics", """
SELECT c_custkey, (c_custkey % 90)::DOUBLE AS age, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, DATE '2020-01-15' + to_months((c_custkey % 40)::INT) AS planned FROM customer""")
def demographics(t):
    note = F.concat(F.lit("A "), F.col("c_custkey") % 90, F.lit("-year-old "), F.when(F.col("c_nationkey") % 2 == 0, "woman").otherwise("man"), F.lit(" with a cough"))
    return t.customer.select("c_custkey", clinical.age_years(note).alias("age"), clinical.sex(note).alias("sex"), clinical.planned_date(F.col("c_custkey") % 40).cast("timestamp").alias("planned"))


@query("conditioned_metrics", """
WITH g AS (SELECT DISTINCT l_orderkey AS item, CASE WHEN l_returnflag = 'R' THEN 'primary' WHEN l_returnflag = 'A' THEN 'relevant' WHEN l_discount > 0.05 THEN 'excluded' ELSE 'neutral' END AS tier, l_quantity > 25 AS critical, l_partkey AS finding FROM lineitem),
f AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS finding FROM lineitem WHERE l_discount >= 0.04),
h AS (SELECT g.*, (f.item IS NOT NULL)::INT AS hit FROM g LEFT JOIN f USING (item, finding)),
s AS (SELECT item, sum(hit) FILTER (tier = 'primary' AND critical) / count(*) FILTER (tier = 'primary' AND critical) AS pc, sum(hit) FILTER (tier = 'primary') / count(*) FILTER (tier = 'primary') AS p,
  sum(hit) FILTER (tier = 'relevant' AND critical) / count(*) FILTER (tier = 'relevant' AND critical) AS rc, sum(hit) FILTER (tier = 'relevant') / count(*) FILTER (tier = 'relevant') AS r,
  sum(hit) FILTER (tier IN ('primary', 'relevant') AND critical) / count(*) FILTER (tier IN ('primary', 'relevant') AND critical) AS ac, sum(hit) FILTER (tier IN ('primary', 'relevant')) / count(*) FILTER (tier IN ('primary', 'relevant')) AS a,
  sum(hit) FILTER (tier = 'excluded') / count(*) FILTER (tier = 'excluded') AS x, sum(hit) FILTER (tier IN ('excluded', 'neutral')) / count(*) FILTER (tier IN ('excluded', 'neutral')) AS xs, count(*) FILTER (tier IN ('primary', 'relevant')) AS n FROM h GROUP BY item),
e AS (SELECT o_orderkey, o_orderstatus = 'P' OR coalesce(n, 0) > 0 AS yes, o_totalprice < 100000 AS abstained, s.* FROM orders LEFT JOIN s ON item = o_orderkey),
m AS (SELECT count(*) FILTER (yes) AS n_involved, count(*) FILTER (NOT yes) AS n_absent, coalesce(avg(pc) FILTER (yes), 0) AS pc, coalesce(avg(p) FILTER (yes), 0) AS p, coalesce(avg(rc) FILTER (yes), 0) AS rc, coalesce(avg(r) FILTER (yes), 0) AS r,
  coalesce(avg(ac) FILTER (yes), 0) AS ac, coalesce(avg(a) FILTER (yes), 0) AS a, coalesce(avg(x) FILTER (yes), 0) AS x, coalesce(avg(xs) FILTER (yes), 0) AS xs, avg(abstained::INT) FILTER (NOT yes) AS abst, coalesce(avg(x) FILTER (NOT yes), 0) AS al FROM e)
SELECT n_involved, n_absent, round(pc, 6) AS primary_recall_critical, round(p, 6) AS primary_recall_complete, round(rc, 6) AS relevant_recall_critical, round(r, 6) AS relevant_recall_complete, round(x, 6) AS leakage_rate, round(xs, 6) AS leakage_rate_strict,
  round(2 * ac * (1 - x) / (ac + 1 - x), 6) AS conditioned_f1, round(2 * a * (1 - x) / (a + 1 - x), 6) AS conditioned_f1_complete, round(1 - p, 6) AS omission_rate, round(abst, 6) AS abstention_accuracy, round(al, 6) AS absent_leakage_rate FROM m""")
def conditioned_metrics(t):
    """Lines of orders as findings: returned ones are primary, accepted ones relevant, others excluded or neutral; discounted ones are found."""
    tier = F.when(F.col("l_returnflag") == "R", "primary").when(F.col("l_returnflag") == "A", "relevant").when(F.col("l_discount") > 0.05, "excluded").otherwise("neutral")
    gold = t.lineitem.select(F.col("l_orderkey").alias("item"), tier.alias("tier"), (F.col("l_quantity") > 25).alias("critical"), F.col("l_partkey").alias("finding"))
    found = t.lineitem.where("l_discount >= 0.04").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("finding"))
    items = t.orders.select(F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") == "P").alias("involved"), (F.col("o_totalprice") < 100000).alias("abstained"))
    out = metrics.conditioned(items, gold, found, tasks=tasks_for(t.lineitem))
    return out.select(*[c if c.startswith("n_") else F.round(c, 6).alias(c) for c in out.columns])
