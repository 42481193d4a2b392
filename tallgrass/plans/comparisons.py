"""Pair comparisons by Arrow-batched functions, statistics, clusters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import similarity, stemming, text, values
from tallgrass.operators import cluster, containment, dedup, graph, selection, stats
from tallgrass.sources.tables import checkpoint_folder

from .registry import query


@query("fuzzy_match")
def fuzzy_match(t):
    """Each part's most similar other part of its brand and size: names that share a token are candidates, the ratio decides. Distinct names are compared, and each stands for its two smallest parts, so that parts of one name never meet."""
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    key = ["p_brand", "p_size", "p_name"]
    first = part.groupBy(*key).agg(F.min("p_partkey").alias("first"))
    second = part.join(first, key).where("p_partkey <> first").groupBy(*key).agg(F.min("p_partkey").alias("second"))
    named = first.join(second, key, "left")
    tokens = first.withColumn("token", F.explode(F.array_distinct(text.tokens(F.col("p_name")))))
    pairs = tokens.drop("first").join(tokens.select("p_brand", "p_size", "token", F.col("p_name").alias("b_name"), F.col("first").alias("b")), ["p_brand", "p_size", "token"]).where("p_name <> b_name").drop("token").distinct()
    scored = pairs.withColumn("ratio", F.round(similarity.column(similarity.ratio, "double")("p_name", "b_name"), 6)).where("ratio >= 0.7")
    near = dedup.pick_first(scored, key, [F.desc("ratio"), "b"])
    same = part.join(named, key).withColumn("b", F.when(F.col("p_partkey") == F.col("first"), F.col("second")).otherwise(F.col("first"))).select("p_partkey", *key, "b")
    own = same.where((F.col("b").isNotNull()) & (F.size(text.tokens(F.col("p_name"))) > 0)).select("p_partkey", "p_name", "b", F.col("p_name").alias("b_name"), F.lit(1.0).alias("ratio"))
    other = part.join(own.select("p_partkey"), "p_partkey", "left_anti").join(near, key).select("p_partkey", "p_name", "b", "b_name", "ratio")
    return own.union(other)


@query("rouge_l")
def rouge(t):
    """Each assistant turn against the user's turn before it."""
    turn = t.conversations.select("conv_id", "turn", "role", text.words(F.lower("text")).alias("w"))
    asked = turn.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("asked"))
    both = turn.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(similarity.column(similarity.rouge_l, "double")("asked", "w"), 6).alias("rouge_l"))


WORDS = ("the", "und", "de", "que")


@query("negation", r"""
WITH p AS (SELECT doc_id, phrase, string_split(lower(text), phrase) AS parts FROM documents, (VALUES ('the'), ('und'), ('de'), ('que')) w(phrase) WHERE contains(text, phrase))
SELECT doc_id, phrase, len(list_filter(parts[:len(parts) - 1], lambda x: NOT regexp_matches(right(x, 50), '(^|[^0-9A-Za-z_])(CUES)\b[^.;:,]{0,30}$'))) = 0 AS denied FROM p""".replace("CUES", "|".join(text.DENYING)))
def negation(t):
    """Documents that hold a word of a list, and whether every occurrence is denied."""
    word = F.explode(F.array(*[F.lit(w) for w in WORDS]))
    return t.documents.select("doc_id", "text", word.alias("phrase")).where(F.contains("text", "phrase")).select("doc_id", "phrase", text.denied(F.col("phrase"), F.col("text")).alias("denied"))


@query("greedy_matching", """
WITH c AS (SELECT l_orderkey, p_brand, count(*) FILTER (l_discount >= 0.05) AS p, count(*) FILTER (l_discount < 0.05) AS g FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l_orderkey, CAST(sum(least(p, g)) AS INT) AS n_pairs FROM c GROUP BY l_orderkey HAVING sum(p) > 0 AND sum(g) > 0""")
def greedy_matching(t):
    """Lines of an order with a discount against those without, matched by brand, every line once: the pairs are as many as the smaller side of each brand."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    sides = lines.groupBy("l_orderkey", "p_brand").agg(F.count_if(F.col("l_discount") >= 0.05).alias("p"), F.count_if(F.col("l_discount") < 0.05).alias("g"))
    return sides.groupBy("l_orderkey").agg(F.sum(F.least("p", "g")).cast("int").alias("n_pairs"), F.sum("p").alias("_p"), F.sum("g").alias("_g")).where("_p > 0 AND _g > 0").select("l_orderkey", "n_pairs")


TAIL = "exp(-z * z / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
SIGNED_RANKS = """
WITH RECURSIVE m AS (SELECT o_custkey, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS a, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS b FROM orders GROUP BY 1),
x AS (SELECT GROUP AS grp, round(a - b, ROUND) AS d FROM customer JOIN m ON c_custkey = o_custkey WHERE a IS NOT NULL AND b IS NOT NULL),
z AS (SELECT grp, abs(d) AS m, count(*) AS n, sum((d > 0)::INT) AS up FROM x WHERE d <> 0 GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY m) - n + (n + 1) / 2.0 AS rank FROM z),
s AS (SELECT grp, sum(n)::BIGINT AS n, sum(rank * up)::DOUBLE AS w_plus, sum(rank * (n - up))::DOUBLE AS w_minus, sum(n ** 3 - n)::DOUBLE AS ties FROM r GROUP BY 1),
e AS (SELECT grp, (2 * rank)::INT AS r, row_number() OVER (PARTITION BY grp ORDER BY rank) AS k FROM (SELECT grp, rank, unnest(range(n::BIGINT)) FROM r) JOIN s USING (grp) WHERE s.n <= EXACT),
w AS (SELECT grp, 0::BIGINT AS k, 0 AS total, 1.0::DOUBLE AS ways FROM s WHERE n <= EXACT
  UNION ALL SELECT grp, k, total, sum(ways) FROM (SELECT w.grp, w.k + 1 AS k, unnest([w.total, w.total + e.r]) AS total, w.ways FROM w JOIN e ON e.grp = w.grp AND e.k = w.k + 1) GROUP BY ALL),
q AS (SELECT w.grp, sum(ways) / 2.0 ** any_value(s.n) AS tail FROM w JOIN s ON s.grp = w.grp AND w.k = s.n WHERE total <= (2 * least(w_plus, w_minus))::INT GROUP BY w.grp),
d AS (SELECT grp, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM x GROUP BY 1),
y AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48), 0) AS zz FROM s JOIN d USING (grp)),
v AS (SELECT *, abs(zz) AS z, 1 / (1 + 0.2316419 * abs(zz)) AS t FROM y)
SELECT v.grp AS GROUP, n, w_plus, w_minus, round(zz, 6) AS z, round(least(1.0, 2 * CASE WHEN n <= EXACT THEN tail ELSE TAIL END), 7) AS p, round(mean_diff, 1) AS mean_diff, round(mean_diff / nullif(sd, 0), 6) AS cohen_d FROM v LEFT JOIN q ON q.grp = v.grp""".replace("TAIL", TAIL)


def _signed_ranks(t, group: str, digits: int, exact: int):
    """Order prices of two statuses, paired by customer, in groups of customers."""
    means = t.orders.groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("a"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("b"))
    pairs = t.customer.select("c_custkey", group).join(means, F.col("c_custkey") == F.col("o_custkey"))
    found = stats.wilcoxon(pairs.withColumn("a", F.round(F.col("a") - F.col("b"), digits)).withColumn("b", F.when(F.col("b").isNotNull(), F.lit(0.0))), group, "a", "b", exact=exact)
    return found.withColumns({"z": F.round("z", 6), "p": F.round("p", 7), "mean_diff": F.round("mean_diff", 1), "cohen_d": F.round("cohen_d", 6)})


@query("wilcoxon", SIGNED_RANKS.replace("GROUP AS", "c_mktsegment AS").replace("AS GROUP", "AS c_mktsegment").replace("ROUND)", "2)").replace("EXACT", "0"))
def wilcoxon(t):
    return _signed_ranks(t, "c_mktsegment", 2, 0)


@query("wilcoxon_exact", SIGNED_RANKS.replace("GROUP AS", "c_nationkey AS").replace("AS GROUP", "AS c_nationkey").replace("ROUND)", "-4)").replace("EXACT", "50"))
def wilcoxon_exact(t):
    """By nation, with prices rounded so that differences tie; nations of at most fifty customers get exact p-values."""
    return _signed_ranks(t, "c_nationkey", -4, 50)


@query("bootstrap_ci")
def bootstrap_ci(t):
    return stats.bootstrap_mean(t.events, "event_type", "event_id", "value")


@query("hallucination_rate", r"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS said, u.text AS source FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' AND a.role = 'assistant'),
s AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(trim(said), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 10) AS sent, SETS(source) AS own FROM p)
SELECT conv_id, turn, round(CASE WHEN len(sent) > 0 THEN len(list_filter(list_transform(sent, lambda x: SETS(x)), lambda k: len(list_intersect(k, own)) < 0.15 * len(k))) / len(sent) ELSE 0.0 END, 6) AS rate FROM s""".replace("SETS(source)", "list_distinct(list_filter(regexp_split_to_array(lower(source), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))").replace("SETS(x)", "list_distinct(list_filter(regexp_split_to_array(lower(x), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"))
def hallucination_rate(t):
    """The share of each assistant's turn whose sentences have hardly a word of the user's turn before it."""
    turns = t.conversations
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", F.round(containment.ungrounded_rate(F.col("text"), F.col("source")), 6).alias("rate"))


SETS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"


@query("contained_passages", f"""
WITH b AS (SELECT item_id, unnest({SETS}) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1), d AS (SELECT doc_id, unnest({SETS}) AS w FROM documents)
SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS share FROM b JOIN d USING (w) JOIN n USING (item_id) GROUP BY item_id, doc_id HAVING count(*) >= 0.6 * any_value(n) - 1e-9""")
def contained_passages(t):
    """Documents that have three of five words of a benchmark passage at least."""
    sets = lambda df, key: df.select(key, containment.word_set(F.col("text")).alias("words"))
    return containment.containment_join(sets(t.benchmark, "item_id"), "item_id", sets(t.documents, "doc_id"), "doc_id", "words", least=0.6).withColumn("share", F.round("share", 6))


@query("omission_rate", """
WITH w AS (SELECT DISTINCT item_id % 50 AS k, split_part(text, ' ', 3) AS f FROM benchmark), d AS (SELECT doc_id, doc_id % 50 AS k, lower(text) AS text FROM documents)
SELECT doc_id, count(f) AS n_wanted, round(CASE WHEN count(f) > 0 THEN 1 - avg(contains(text, lower(f))::INT) END, 6) AS omitted FROM d LEFT JOIN w USING (k) GROUP BY doc_id""")
def omission_rate(t):
    """The share of the words that documents of a group should name, and don't."""
    wanted = t.benchmark.select((F.col("item_id") % 50).alias("k"), F.get(F.split("text", " "), F.lit(2)).alias("f")).distinct()
    due = t.documents.select("doc_id", (F.col("doc_id") % 50).alias("k")).join(wanted, "k").select("doc_id", "f")
    return containment.omission_rates(t.documents.select("doc_id", "text"), due, "doc_id", "text", "f").withColumn("omitted", F.round("omitted", 6))


@query("rouge_l_stemmed")
def rouge_l_stemmed(t):
    """Each assistant turn against the user's turn before it, on stems."""
    turn = t.conversations.select("conv_id", "turn", "role", stemming.summary_words(F.col("text")).alias("w"))
    asked = turn.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("asked"))
    both = turn.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(similarity.column(similarity.rouge_l, "double")("asked", "w"), 6).alias("rouge_l"))


@query("value_links", """
WITH n AS (SELECT c_custkey, c_acctbal, floor(abs(c_acctbal) / 100)::INT AS v, c_custkey % 5 AS kind FROM customer)
SELECT c_custkey, CASE kind WHEN 0 THEN v > 55 WHEN 1 THEN v > 55 WHEN 2 THEN true WHEN 3 THEN false ELSE v < 20 END AS agrees FROM n""")
def value_links(t):
    """Whether a customer's note, of five shapes, reports what a finding says: by a range after or before the value, by a word, denied, or under another name."""
    v, kind = F.floor(F.abs("c_acctbal") / 100).cast("int").cast("string"), F.col("c_custkey") % 5
    note = F.when(kind == 0, F.concat(F.lit("Albumin 41 g/L. Sodium "), v, F.lit(" mmol/L (ref 20 - 55), stable"))).when(kind == 1, F.concat(F.lit("na+ (20 to 55): "), v)).when(kind == 2, F.concat(F.lit("known hypertension; raised SODIUM? sodium was elevated at "), v))
    note = note.when(kind == 3, F.concat(F.lit("no elevated sodium, ferritin high "), v)).otherwise(F.concat(F.lit("Labs: Ferritin "), v, F.lit(" ug/L, normal 20–55")))
    finding = F.when(kind == 2, "Hypernatremia").when(kind == 4, "Decreased ferritin").otherwise("Elevated serum sodium")
    return t.customer.select("c_custkey", values.value_agrees(finding, note).alias("agrees"))


@query("covering_selection", """
WITH o AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1), e AS (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount >= 0.09 GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 7)
SELECT o_custkey, n FROM o WHERE n BETWEEN 5 AND 30 AND k = (SELECT count(DISTINCT o_orderpriority) FROM orders) AND o_custkey NOT IN (SELECT o_custkey FROM e)""")
def covering_selection(t):
    """Customers with 5 to 30 orders of every priority there is, but for those whom seven suppliers or more have given the highest discounts."""
    sizes = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    fit = selection.selected(sizes, "o_custkey", "n", t.orders, "o_orderpriority", t.orders.select("o_orderpriority"), least=5, most=30)
    results = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", "l_discount")
    return selection.below_ceiling(fit, "o_custkey", results, "l_suppkey", "l_discount", least=0.09, solvers=7)


@query("quota_carry", """
SELECT doc_id, CASE WHEN r <= round_even(n * 0.1, 0) THEN 'dev' WHEN r <= round_even(n * 0.3, 0) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)""")
def quota_carry(t):
    split = stats.quota_split(t.documents, ["lang", "source"], [F.sha2(F.col("doc_id").cast("string"), 256), "doc_id"], {"dev": 0.1, "test": 0.2, "train": 0.7})
    return split.select("doc_id", "split")


@query("greedy_cluster")
def greedy_cluster(t):
    """Customers of one nation and segment that share parts, in clusters of five at most."""
    items = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    people = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(items, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    checkpoint_folder(t.spark)
    people = people.checkpoint()
    key = ["c_nationkey", "c_mktsegment", "l_partkey"]
    pairs = people.select(*key, F.col("c_custkey").alias("a")).join(people.select(*key, F.col("c_custkey").alias("b")), key).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))
    return graph.greedy_clusters(people, pairs, "c_custkey")


#: Widths of balance by band of balances, and order priorities that contradict each other: parameters of the queries below.
WIDTHS, URGENCY = {0: 300.0, 1: 700.0, 2: 1500.0, 3: 400.0}, {"urgency": [("1-URGENT", "5-LOW"), ("1-URGENT", "4-NOT SPECIFIED")]}


def people(t, *, distractors: bool):
    """Customers with their band of balances (a key), its width, the priority of their most urgent large order, and the parts of which they returned many; with distractors also the parts of which they kept very many."""
    orders = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)
    held = orders.where(wanted | ((F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 48)) if distractors else wanted).select(F.col("o_custkey").alias("c_custkey"), F.col("l_partkey").alias("feature")).distinct()
    urgent = t.orders.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("urgency"))
    band = F.least(F.floor(F.greatest("c_acctbal", F.lit(0.0)) / 2500), F.lit(3)).cast("int")
    width = F.coalesce(*[F.when(F.col("band") == b, w) for b, w in WIDTHS.items()])
    nodes = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", band.alias("band")).withColumn("width", width).join(urgent, "c_custkey", "left")
    return nodes, held


def fit(x, y):
    return (x["c_mktsegment"] == y["c_mktsegment"]) & (x["band"] == y["band"]) & cluster.fits(x, y, value="c_acctbal", width="width", contradictions=URGENCY)


def _clusters(t, *, distractors: bool):
    """Clusters of customers of one segment and band; a cluster with an urgent member takes five, any other three."""
    nodes, held = people(t, distractors=distractors)
    pairs = cluster.range_pairs(nodes, ["c_mktsegment", "band"], "c_custkey", "c_acctbal", "width", contradictions=URGENCY, shared=held)
    about = nodes.select("c_custkey", F.struct("c_mktsegment", "band", "c_acctbal", "width", "urgency").alias("about"))
    cap = lambda members: F.when(F.exists(members, lambda m: F.coalesce(m["urgency"] == "1-URGENT", F.lit(False))), 5).otherwise(3)
    return about, pairs, cluster.clique_clusters(about, pairs, "c_custkey", fit=fit, cap=cap)


@query("range_pairs", """
WITH h AS (SELECT DISTINCT o_custkey AS c, l_partkey AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 40),
u AS (SELECT o_custkey AS c, min(o_orderpriority) AS u FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
n AS (SELECT c_custkey, c_mktsegment AS s, c_acctbal AS v, least(floor(greatest(c_acctbal, 0) / 2500), 3) AS b, u FROM customer LEFT JOIN u ON c = c_custkey),
p AS (SELECT x.c_custkey AS a, y.c_custkey AS b FROM n x JOIN n y ON x.s = y.s AND x.b = y.b AND x.c_custkey < y.c_custkey AND abs(x.v - y.v) <= CASE x.b WHEN 0 THEN 300 WHEN 1 THEN 700 WHEN 2 THEN 1500 ELSE 400 END
  WHERE NOT coalesce(least(x.u, y.u) = '1-URGENT' AND greatest(x.u, y.u) IN ('5-LOW', '4-NOT SPECIFIED') AND x.u IS NOT NULL AND y.u IS NOT NULL, false))
SELECT a, b, count(*) AS n_shared FROM p JOIN h ha ON ha.c = a JOIN h hb ON hb.c = b AND ha.f = hb.f GROUP BY ALL""")
def range_pairs(t):
    """Customers of one segment and band whose balances differ by the band's width at most, who share a part and whose urgencies don't contradict each other."""
    nodes, held = people(t, distractors=False)
    return cluster.range_pairs(nodes, ["c_mktsegment", "band"], "c_custkey", "c_acctbal", "width", contradictions=URGENCY, shared=held)


@query("clique_clusters")
def clique_clusters(t):
    return _clusters(t, distractors=False)[2]


@query("clique_clusters_distractors")
def clique_clusters_distractors(t):
    """The same people with more links: what they hold besides makes larger and noisier clusters."""
    return _clusters(t, distractors=True)[2]


@query("cluster_faults", "SELECT 0 AS n_repeated, 0 AS n_unfit, 0 AS n_unlinked, 0 AS n_single FROM (SELECT count(*) FROM customer)")
def cluster_faults(t):
    """What both kinds of clusters must not have; every count is 0."""
    about, pairs, found = _clusters(t, distractors=True)
    return cluster.faults(found, about, pairs, "c_custkey", fit=fit)
