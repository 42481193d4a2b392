"""Rankings, agreement and other metrics, each an aggregate over items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import errors, metrics, problems, retrieval, search
from tallgrass.sources.tables import tasks_for

from .registry import query, sql

#: Parts ranked for each customer by quantity; a part's grade is its best return flag.
RANKED = """SELECT o_custkey AS item, l_partkey AS passage, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank,
  max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 1 ELSE 0 END) AS grade FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey"""


def ranked(t):
    # a customer's rows meet once, before any hash table is made: groups and ranks need no further shuffle
    tasks = tasks_for(t.lineitem)
    orders = t.orders.select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    lines = orders.join(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    scored = lines.drop("o_orderkey", "l_orderkey").repartition(tasks, "o_custkey").groupBy(F.col("o_custkey").alias("item"), F.col("l_partkey").alias("passage")).agg(
        F.sum("l_quantity").alias("score"), F.max(F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("grade"))
    return metrics.rank_by_score(scored, "item", "score", "passage")


@query("ranking_metrics", f"""
WITH r AS ({RANKED}), i AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY grade DESC, passage) AS best FROM r),
c AS (SELECT *, sum((grade >= 2)::INT) OVER (PARTITION BY item ORDER BY rank) AS hits FROM i),
m AS (SELECT item, count(*) AS n, sum((grade >= 2)::INT) AS n_rel, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (2 ** grade - 1) / log2(best + 1) ELSE 0 END) AS ideal,
      sum(CASE WHEN rank <= 10 AND grade >= 2 THEN 1 ELSE 0 END) AS hit10, sum(CASE WHEN rank <= 10 AND grade >= 2 THEN hits / rank ELSE 0 END) AS ap, min(CASE WHEN grade >= 2 THEN rank END) AS first FROM c GROUP BY item)
SELECT item, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg10, round(CASE WHEN n_rel > 0 THEN ap / least(n_rel, 10) ELSE 0 END, 6) AS map10,
       round(CASE WHEN n_rel > 0 THEN hit10 / n_rel ELSE 0 END, 6) AS recall10, round(hit10 / least(10, n), 6) AS precision10, round(coalesce(1 / first, 0), 6) AS mrr FROM m""")
def ranking_metrics(t):
    return metrics.ranking_metrics(ranked(t), "item", k=10)


sql("topk_accuracy", """
SELECT o_custkey, max(CASE WHEN k <= 1 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS top1, max(CASE WHEN k <= 5 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS top5 FROM (
  SELECT o_custkey, l_returnflag, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k
  FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) x GROUP BY o_custkey""")

#: Predicted codes are an order's parts sent by N lines, true codes those of the others; brands are the chapters.
CODES = """SELECT l_orderkey AS item, p_partkey AS code, p_brand AS chapter, max(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS predicted, max(CASE WHEN l_quantity <= 25 THEN 1 ELSE 0 END) AS given,
  max(p_size) AS weight FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey, p_partkey, p_brand"""

sql("hier_f1", f"""
SELECT chapter, CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, CASE WHEN np + ng > 0 THEN round(2.0D * tp / (np + ng), 6) ELSE 0.0D END AS f1 FROM (
  SELECT chapter, sum(predicted * given) AS tp, sum(predicted) AS np, sum(given) AS ng FROM (
    SELECT item, chapter, max(predicted) AS predicted, max(given) AS given FROM ({CODES}) c GROUP BY item, chapter) d GROUP BY chapter) e""",
    f"""SELECT chapter, CAST(tp AS BIGINT) AS tp, CAST(np - tp AS BIGINT) AS fp, CAST(ng - tp AS BIGINT) AS fn, CASE WHEN np + ng > 0 THEN round(2.0::DOUBLE * tp / (np + ng), 6) ELSE 0.0::DOUBLE END AS f1 FROM (
  SELECT chapter, sum(predicted * given) AS tp, sum(predicted) AS np, sum(given) AS ng FROM (
    SELECT item, chapter, max(predicted) AS predicted, max(given) AS given FROM ({CODES}) c GROUP BY item, chapter) d GROUP BY chapter) e""")

sql("problem_list_pr", f"""
SELECT count(*) AS n_items, round(avg(recall), 6) AS recall, round(avg(prec), 6) AS precision_, round(2 * avg(recall) * avg(prec) / (avg(recall) + avg(prec)), 6) AS f1, round(avg(weighted), 6) AS weighted_recall FROM (
  SELECT item, CASE WHEN sum(given) > 0 THEN sum(hit) / CAST(sum(given) AS DOUBLE) END AS recall, CASE WHEN sum(predicted) > 0 THEN sum(hit) / CAST(sum(predicted) AS DOUBLE) END AS prec,
         CASE WHEN sum(given * weight) > 0 THEN sum(hit * weight) / CAST(sum(given * weight) AS DOUBLE) END AS weighted FROM (
    SELECT item, chapter, sum(predicted) AS predicted, sum(given) AS given, least(sum(predicted), sum(given)) AS hit, max(weight) AS weight FROM ({CODES}) c GROUP BY item, chapter) d GROUP BY item) e""")

sql("acuity_confusion", """
SELECT concat(quality, ':', CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END) AS cell, count(*) AS n FROM {labels} JOIN {documents} USING (doc_id) GROUP BY concat(quality, ':', CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END)""")

sql("kappa_matrix", """
SELECT a, b, n, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM (
  SELECT a, b, n, po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (
    SELECT x.rater AS a, y.rater AS b, count(*) AS n, avg(CASE WHEN x.v = y.v THEN 1.0D ELSE 0.0D END) AS po, avg(CAST(x.v AS DOUBLE)) AS pa, avg(CAST(y.v AS DOUBLE)) AS pb
    FROM votes x JOIN votes y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY x.rater, y.rater) s) p""".replace("votes", "(SELECT doc_id, 'quality' AS rater, quality AS v FROM {labels} UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels} UNION ALL SELECT doc_id, 'long', CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END FROM {documents})"),
    """WITH votes AS (SELECT doc_id, 'quality' AS rater, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels UNION ALL SELECT doc_id, 'long', CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END FROM documents)
SELECT a, b, n, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM (
  SELECT a, b, n, po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM (
    SELECT x.rater AS a, y.rater AS b, count(*) AS n, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END) AS po, avg(CAST(x.v AS DOUBLE)) AS pa, avg(CAST(y.v AS DOUBLE)) AS pb
    FROM votes x JOIN votes y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY x.rater, y.rater) s) p""")

sql("leaderboard_pivot", """
SELECT *, round(`F` - `O`, 4) AS delta FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM {orders}) x PIVOT (round(avg(o_totalprice), 4) FOR o_orderstatus IN ('F', 'O', 'P'))""",
    """SELECT o_orderpriority, f AS "F", o AS "O", p AS "P", round(f - o, 4) AS delta FROM (SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS o,
 round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY 1)""")

sql("cost_norm", """
SELECT event_type, n, round(value / (n * rate), 6) AS per_cost FROM (SELECT event_type, count(*) AS n, sum(value) AS value FROM {events} GROUP BY event_type) x
JOIN (VALUES ('click', 0.5D), ('view', 0.25D), ('purchase', 3.0D), ('error', 1.0D)) r(kind, rate) ON event_type = kind""",
    """SELECT event_type, n, round(value / (n * rate), 6) AS per_cost FROM (SELECT event_type, count(*) AS n, sum(value) AS value FROM events GROUP BY event_type) x
JOIN (VALUES ('click', 0.5::DOUBLE), ('view', 0.25), ('purchase', 3.0), ('error', 1.0)) r(kind, rate) ON event_type = kind""")

sql("efficiency", """
SELECT round(avg(n), 4) AS mean_actions, CAST(median(n) AS DOUBLE) AS median_actions, round(avg(CAST(submitted AS DOUBLE)), 4) AS submission_rate, round(avg(n / 40.0D), 4) AS budget_use
FROM (SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS submitted FROM {events} GROUP BY user_id) x""",
    """SELECT round(avg(n), 4) AS mean_actions, CAST(median(n) AS DOUBLE) AS median_actions, round(avg(CAST(submitted AS DOUBLE)), 4) AS submission_rate, round(avg(n / 40.0::DOUBLE), 4) AS budget_use
FROM (SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS submitted FROM events GROUP BY user_id) x""")

sql("kendall_tau", """
SELECT o_custkey, round((c - d) / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau FROM (
  SELECT x.o_custkey, CAST(sum(CASE WHEN (x.o_totalprice - y.o_totalprice) * (x.p - y.p) > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS c, CAST(sum(CASE WHEN (x.o_totalprice - y.o_totalprice) * (x.p - y.p) < 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d,
         CAST(count(*) AS DOUBLE) AS n0, CAST(sum(CASE WHEN x.o_totalprice = y.o_totalprice THEN 1 ELSE 0 END) AS DOUBLE) AS tx, CAST(sum(CASE WHEN x.p = y.p THEN 1 ELSE 0 END) AS DOUBLE) AS ty
  FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey GROUP BY x.o_custkey) s WHERE n0 > tx AND n0 > ty""".replace(" o x", " (SELECT o_custkey, o_orderkey, o_totalprice, CAST(substring(o_orderpriority, 1, 1) AS INT) AS p FROM {orders}) x").replace(" o y", " (SELECT o_custkey, o_orderkey, o_totalprice, CAST(substring(o_orderpriority, 1, 1) AS INT) AS p FROM {orders}) y"))

sql("error_taxonomy", """
SELECT l_orderkey, count_if(l_quantity > 45) AS n_large, count_if(l_discount = 0) AS n_plain, array_join(slice(sort_array(collect_set(CASE WHEN l_tax > 0.06 THEN l_partkey END)), 1, 5), ',') AS taxed FROM {lineitem} GROUP BY l_orderkey""",
    """SELECT l_orderkey, count_if(l_quantity > 45)::BIGINT AS n_large, count_if(l_discount = 0)::BIGINT AS n_plain,
 array_to_string(coalesce(list_sort(list(DISTINCT l_partkey) FILTER (l_tax > 0.06))[1:5], []), ',') AS taxed FROM lineitem GROUP BY l_orderkey""")

sql("gt_validation", """
SELECT 'no lines' AS issue, count(*) AS n FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey
UNION ALL SELECT 'price below zero', count(*) FROM {orders} WHERE o_totalprice < 0
UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x
UNION ALL SELECT 'shipped before order', count(*) FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""",
    """SELECT 'no lines' AS issue, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'price below zero', count(*) FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'repeated line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) x
UNION ALL SELECT 'shipped before order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")

sql("chart_summary", """
SELECT c_custkey, c_name, n_orders, latest, coalesce(n_parts, 0) AS n_parts FROM {customer}
JOIN (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey) o ON c_custkey = o_custkey
LEFT JOIN (SELECT o_custkey AS k, count(DISTINCT l_partkey) AS n_parts FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey) p ON c_custkey = k""")

sql("worklist", """
SELECT o_orderkey, c_name, n_name, o_orderpriority, o_orderdate FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%'""")

sql("token_f1", r"""
SELECT conv_id, turn, round(2.0D * size(array_intersect(a, b)) / greatest(size(a) + size(b), 1), 6) AS f1 FROM (
  SELECT x.conv_id, x.turn, array_distinct(split(lower(x.text), '[^a-z0-9]+')) AS a, array_distinct(split(lower(y.text), '[^a-z0-9]+')) AS b
  FROM {conversations} x JOIN {conversations} y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1 WHERE x.role = 'assistant' AND y.role = 'user') z""",
    """SELECT conv_id, turn, round(2.0::DOUBLE * len(list_intersect(a, b)) / greatest(len(a) + len(b), 1), 6) AS f1 FROM (
  SELECT x.conv_id, x.turn, list_distinct(regexp_split_to_array(lower(x.text), '[^a-z0-9]+')) AS a, list_distinct(regexp_split_to_array(lower(y.text), '[^a-z0-9]+')) AS b
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1 WHERE x.role = 'assistant' AND y.role = 'user') z""")

sql("rrf", """
SELECT lang, doc_id, round(sum(1.0D / (60 + k)), 8) AS score FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM {documents}
  UNION ALL SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha2(text, 256), doc_id) FROM {documents}) x WHERE k <= 50 GROUP BY lang, doc_id""",
    """SELECT lang, doc_id, round(sum(1.0::DOUBLE / (60 + k)), 8) AS score FROM (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents
  UNION ALL SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) FROM documents) x WHERE k <= 50 GROUP BY lang, doc_id""")


@query("bm25_topk", r"""
WITH t AS (SELECT doc_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[\x09-\x0D]', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1), s AS (SELECT count(*) AS d, avg(n) AS mean FROM len),
q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[\x09-\x0D]', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM benchmark),
df AS (SELECT w, count(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY 1),
r AS (SELECT item_id, doc_id, round(sum(ln(1 + (d - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))), 4) AS score
      FROM q JOIN df USING (w) JOIN tf USING (w) JOIN len USING (doc_id), s GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM r) WHERE k <= 10""")
def bm25_topk(t):
    return retrieval.bm25_topk(t.documents, "doc_id", t.benchmark, "item_id", k=10)


LEXICAL = """WITH t AS (SELECT doc_id, 0 AS field, 1.0::DOUBLE AS weight, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents UNION ALL SELECT doc_id, 1, 2.0, regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9]+') FROM documents),
m AS (SELECT doc_id, field, weight, unnest(w) AS word, unnest(range(len(w))) + field * 4294967296 AS pos FROM t),
q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(list_aggregate(string_split(text, ' ')[2:3], 'string_agg', ' ')), '[a-z0-9]+'))) AS word FROM benchmark), n AS (SELECT item_id, count(*) AS need FROM q GROUP BY 1),
p AS (SELECT item_id, doc_id, field, weight, word, pos FROM q JOIN m USING (word)),
s AS (SELECT item_id, doc_id, sum(part) AS score, count(DISTINCT word) AS have FROM (SELECT item_id, doc_id, word, field, any_value(weight) * (1 + ln(count(*))) AS part FROM p GROUP BY item_id, doc_id, word, field) GROUP BY ALL),
f AS (SELECT item_id, doc_id, score, need FROM s JOIN n USING (item_id) WHERE have = need),
l AS (SELECT p.item_id, p.doc_id, p.pos AS r, o.word, max(o.pos) AS pos FROM f JOIN p USING (item_id, doc_id) JOIN p o ON o.item_id = p.item_id AND o.doc_id = p.doc_id AND o.pos <= p.pos GROUP BY ALL),
w AS (SELECT item_id, doc_id, min(len) AS len FROM (SELECT item_id, doc_id, r, r - min(pos) AS len, count(*) AS c FROM l GROUP BY item_id, doc_id, r) JOIN n USING (item_id) WHERE c = need GROUP BY ALL),
a AS (SELECT item_id, doc_id, round(score * (1 + 1 / (1 + greatest(len - need + 1, 0))), 6) AS rank FROM f JOIN w USING (item_id, doc_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, doc_id)::INT AS k FROM a)
"""


def _lexical(t, k: int):
    """Documents that have two words of each benchmark item, by text and source."""
    return _matched(t, t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("asked")), k, stems=False)


def _matched(t, asked, k: int, *, stems: bool):
    """Only postings of words that are asked for are made, once."""
    only = search.asked_words(asked, "item_id", "asked", stems=stems)
    post = search.postings(t.documents, "doc_id", {"text": 1.0, "source": 2.0}, stems=stems, only=only).persist()
    return search.match_all(post, asked, "item_id", "asked", k=k, stems=stems).withColumnRenamed("doc", "doc_id")


@query("fulltext_search", LEXICAL + "SELECT item_id, doc_id, rank, k FROM x WHERE k <= 50")
def fulltext_search(t):
    return _lexical(t, 50)


@query("fulltext_stems")
def fulltext_stems(t):
    """The same on stems."""
    return _matched(t, t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("asked")), 20, stems=True)


@query("hybrid_ranking", LEXICAL + """,
d AS (SELECT q.vec_id AS item_id, e.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q JOIN benchmark ON q.vec_id = item_id JOIN embeddings e ON q.vec_id <> e.vec_id),
e AS (SELECT item_id, doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM d) WHERE k <= 20),
u AS (SELECT item_id, doc_id, k FROM x WHERE k <= 20 UNION ALL SELECT item_id, doc_id, k FROM e),
z AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + k)), 8) AS score FROM u GROUP BY ALL)
SELECT item_id, doc_id, score, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM z) WHERE k <= 10""")
def hybrid_ranking(t):
    """The ten best documents of each benchmark item by two legs of their own: words that must all occur, and the dot product of the item's vector with all others; both rankings are fused by reciprocal ranks."""
    asked = t.benchmark.select(F.col("item_id").alias("vec_id"), F.lit(True).alias("asked"))
    vectors = t.embeddings.select("vec_id", "embedding").join(asked, "vec_id", "left")
    dense = retrieval.dense_topk(vectors, "vec_id", "embedding", F.coalesce("asked", F.lit(False)), k=20).select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "k")
    return retrieval.fuse({"words": _lexical(t, 20).select("item_id", "doc_id", "k"), "vectors": dense}, "item_id", "doc_id").where("k <= 10")


@query("dense_topk", """
WITH r AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM r) WHERE k <= 5""")
def dense_topk(t):
    return retrieval.dense_topk(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=5)


def _lists(t):
    """Codes of the parts that a customer returned (right) and of those that were accepted (given), with courses by quantity."""
    code = F.concat(F.element_at(F.array(*[F.lit(x) for x in "AEIKST"]), (F.col("l_partkey") % 6 + 1).cast("int")), F.lpad((F.col("l_partkey") % 47).cast("string"), 2, "0"), F.lit("."), (F.col("l_partkey") % 10).cast("string"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("item"), place.alias("place"), code.alias("code"), F.when(F.col("l_quantity") > 25, "acute").otherwise("stable").alias("course"), "l_returnflag")
    return lines.where("l_returnflag = 'R'").drop("l_returnflag"), lines.where("l_returnflag = 'A'").drop("l_returnflag")


PROBLEMS = """
WITH l AS (SELECT o_custkey AS item, l_returnflag AS f, ['A', 'E', 'I', 'K', 'S', 'T'][l_partkey % 6 + 1] || lpad((l_partkey % 47)::VARCHAR, 2, '0') || (l_partkey % 10) AS code FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
x AS (SELECT item, code, count(*) FILTER (f = 'R') AS t, count(*) FILTER (f = 'A') AS g FROM l GROUP BY ALL),
y AS (SELECT item, CASE WHEN left(code, 1) IN ('S', 'T') THEN code ELSE left(code, 3) END AS key, left(code, 3) AS category, sum(t) AS t, sum(g) AS g FROM x GROUP BY ALL),
m AS (SELECT item, sum(t) AS n_true, sum(g) AS n_given, sum(least(t, g)) AS n_matched, sum(CASE WHEN category IN ('K05', 'E11', 'S04') THEN greatest(g - t, 0) ELSE 0 END) AS n_neutral FROM y GROUP BY 1 HAVING sum(g) > 0)
"""


@query("problem_list_scores", PROBLEMS + """SELECT item, n_true::BIGINT AS n_true, n_given::BIGINT AS n_given, n_matched::BIGINT AS n_matched, round(CASE WHEN n_true > 0 THEN n_matched / n_true ELSE 1.0 END, 6) AS recall, round(n_matched / n_given, 6) AS precision_,
  n_neutral::BIGINT AS n_neutral, round(n_matched / nullif(n_given - n_neutral, 0), 6) AS precision_neutral FROM m""")
def problem_list_scores(t):
    """Each customer's codes against the right ones, with three categories that are no mistake."""
    right, given = _lists(t)
    neutral = given.select("item").distinct().withColumn("category", F.explode(F.array(F.lit("K05"), F.lit("E11"), F.lit("S04"))))
    each = problems.scores(right, given, "item", neutral=neutral)
    return each.select("item", "n_true", "n_given", "n_matched", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision_"), "n_neutral", F.round("precision_neutral", 6).alias("precision_neutral"))


@query("problem_list_summary")
def problem_list_summary(t):
    """One row of all means, severity-weighted and by course."""
    return problems.summary(problems.scores(*_lists(t), "item"))


@query("grade_errors", """
WITH r AS (SELECT o_custkey AS item, l_orderkey * 8 + l_linenumber AS place, l_partkey AS passage, l_linenumber % 5 AS grade FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
j AS (SELECT o_custkey AS item, l_partkey AS passage, max(CASE WHEN l_discount > 0.07 THEN 3 WHEN l_discount > 0.04 THEN 1 ELSE 0 END) AS worth FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' GROUP BY ALL),
x AS (SELECT r.*, worth FROM r LEFT JOIN j USING (item, passage) WHERE item IN (SELECT item FROM j)),
e AS (SELECT item, place, 'schema_mismatch' AS category, 'wrong_key_name' AS subtype, passage FROM x WHERE worth IS NULL UNION ALL
  SELECT item, place, 'reasoning_error', CASE WHEN grade >= 3 THEN 'grade_inflation' ELSE 'grade_deflation' END, passage FROM x WHERE (grade >= 3 AND coalesce(worth, 0) <= 0) OR (grade <= 0 AND worth >= 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY item, subtype ORDER BY place, passage::VARCHAR) AS number, count(*) OVER (PARTITION BY item, subtype) AS n_all FROM e)
SELECT item, category, subtype, number::INT AS number, passage::VARCHAR AS detail, n_all FROM n WHERE number <= CASE subtype WHEN 'wrong_key_name' THEN 3 ELSE 5 END""")
def grade_errors(t):
    """Lines of a customer's orders as graded passages, against grades by discount of those that were returned or accepted."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("item"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), F.col("l_partkey").alias("passage"), "l_linenumber", "l_discount", "l_returnflag")
    worth = F.when(F.col("l_discount") > 0.07, 3).when(F.col("l_discount") > 0.04, 1).otherwise(0)
    return errors.grades(lines.select("item", "place", "passage", (F.col("l_linenumber") % 5).alias("grade")), lines.where("l_returnflag <> 'N'").select("item", "passage", worth.alias("grade")))


@query("problem_list_errors")
def problem_list_errors(t):
    """What is wrong with each customer's codes; only codes of even parts exist."""
    right, given = _lists(t)
    valid = right.union(given).where(F.substring("code", 5, 1).isin("0", "2", "4", "6", "8")).select("code", F.lower("code").alias("name")).distinct()
    texts = t.customer.select(F.col("c_custkey").alias("item"), F.concat_ws(" ", "c_name", F.lit("e11.2 k05.4")).alias("text"))
    return errors.problem_lists(given, right, valid, texts)
