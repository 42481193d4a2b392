"""Text operators over documents, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import clinical, text

from .registry import query, sql

TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: length(t) >= 3)"
GRAMS = "list_distinct(list_transform(range(1, greatest(length('  ' || lower({c}) || ' ') - 1, 2)), lambda i: substr('  ' || lower({c}) || ' ', i, 3)))"


@query("strip_html", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]*>', '', 'g') AS c FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\[sound:[^\]]*\]', '', 'g') AS c FROM a)
SELECT page_id, trim(regexp_replace(array_to_string(list_transform(string_split(c, chr(10)), lambda x: trim(x, ' ')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS body FROM b""")
def strip_html(t):
    return t.pages.select("page_id", text.strip_html(F.col("html")).alias("body"))


sql("media_refs", r"""
SELECT page_id, size(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS n_links, array_join(regexp_extract_all(html, '<img[^>]*src="([^"]+)"', 1), ' ') AS images FROM {pages}""",
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS INT) AS n_links, array_to_string(regexp_extract_all(html, '<img[^>]*src="([^"]+)"', 1), ' ') AS images FROM pages""")


@query("cloze", "SELECT p_partkey, p_name || ' is ' || p_brand AS resolved FROM part")
def cloze(t):
    carded = F.concat(F.lit("{{c1::"), "p_name", F.lit("::hint}} is {{c2::"), "p_brand", F.lit("}}"))
    return t.part.select("p_partkey", text.cloze_text(carded).alias("resolved"))


@query("tokenize", f"""
WITH x AS (SELECT unnest({TOKENS.format(c='text')}) AS token FROM documents) SELECT token, count(*) AS n FROM x GROUP BY token""")
def tokenize(t):
    return t.documents.select(F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("inverted_index", f"""
WITH x AS (SELECT DISTINCT p_partkey, unnest({TOKENS.format(c='p_name')}) AS token FROM part) SELECT token, count(*) AS df, min(p_partkey) AS first_part FROM x GROUP BY token""")
def inverted_index(t):
    postings = t.part.select("p_partkey", F.explode(F.array_distinct(text.tokens(F.col("p_name")))).alias("token"))
    return postings.groupBy("token").agg(F.count("*").alias("df"), F.min("p_partkey").alias("first_part"))


#: Pairs of distinct names that are broadcast with their similarity; with more of them both sides are shuffled.
BROADCAST_NAMES = 100_000


@query("similarity_pairs", f"""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, p_name, list_distinct({TOKENS.format(c='p_name')}) AS k, {GRAMS.format(c='p_name')} AS g FROM part),
j AS (SELECT x.p_partkey AS a, y.p_partkey AS b, len(list_intersect(x.k, y.k)) AS i, len(x.k) AS nx, len(y.k) AS ny, len(list_intersect(x.g, y.g)) AS gi, len(x.g) AS gx, len(y.g) AS gy,
      contains(lower(x.p_name), lower(y.p_name)) OR contains(lower(y.p_name), lower(x.p_name)) AS h
      FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey)
SELECT a, b, round(least(1.0, 0.55 * CASE WHEN nx + ny - i > 0 THEN i / (nx + ny - i) ELSE 0 END + 0.30 * CASE WHEN least(nx, ny) > 0 THEN i / least(nx, ny) ELSE 0 END
       + 0.15 * gi / (gx + gy - gi) + CASE WHEN h THEN 0.10 ELSE 0 END), 6) AS similarity FROM j""")
def similarity_pairs(t):
    """Pairs of parts of one brand, type and size. Every two names that meet are compared once, however many parts have them, and pairs of parts take the result."""
    key = ["p_brand", "p_type", "p_size"]
    named = t.part.groupBy(*key, F.struct("p_name").alias("n")).agg(F.collect_list("p_partkey").alias("parts"))  # in a struct, as then a null equals another
    side = lambda n, parts: named.select(*key, F.col("n").alias(n), F.col("parts").alias(parts))
    both = side("n", "xs").join(side("m", "ys"), key).where("n <= m")
    scored = both.select("n", "m").distinct().withColumn("similarity", F.round(text.similarity(F.col("n.p_name"), F.col("m.p_name")), 6)).persist()
    met = both.join(F.broadcast(scored) if scored.count() <= BROADCAST_NAMES else scored, ["n", "m"])
    pairs = met.withColumn("x", F.explode("xs")).select("n", "m", "x", "similarity", F.explode("ys").alias("y")).where("n < m OR x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


sql("sentence_split", r"""
SELECT doc_id, size(s) AS n_sentences, coalesce(array_max(transform(s, x -> length(x))), 0) AS longest
FROM (SELECT doc_id, filter(split(trim(text), '(?<=[.!?])\\s+'), x -> length(x) > 10) AS s FROM {documents}) x""",
    r"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 10) AS s FROM documents)
SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS longest FROM d""")


@query("abstention", r"""
SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) <= 12 OR regexp_matches(lower(text), 'no active|not applicable|no relevant|none identified|no involvement|no significant|no specialty|no findings') AS abstains
FROM conversations WHERE role = 'assistant'""")
def abstention(t):
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", text.abstains(F.col("text")).alias("abstains"))


#: Distinct n-grams that are broadcast, of 8 bytes each; with more of them both sides are shuffled.
BROADCAST_GRAMS = 500_000


@query("ngram_leakage", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
bg AS (SELECT DISTINCT array_to_string(w[i:i+11], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 10)) AS i FROM b))
SELECT doc_id, count(*) AS n_grams, count(bg.g) AS n_shared, count(bg.g) / count(*) >= 0.02 AS flagged FROM dg LEFT JOIN bg USING (g) GROUP BY doc_id""")
def ngram_leakage(t):
    """Share of each document's distinct 12-grams that occur in the benchmark. Only hashes of the n-grams travel."""
    grams = lambda df, *keys: df.select(*keys, F.explode(F.array_distinct(F.transform(text.ngrams(text.words(F.lower("text")), 12), lambda g: F.xxhash64(g)))).alias("g"))
    source = grams(t.benchmark).distinct().withColumn("hit", F.lit(1)).persist()
    source = F.broadcast(source) if source.count() <= BROADCAST_GRAMS else source  # then no n-gram of a document leaves its task
    counted = grams(t.documents, "doc_id").join(source, "g", "left").groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_shared"))
    return counted.withColumn("flagged", F.col("n_shared") / F.col("n_grams") >= 0.02)


sql("input_hash", "SELECT o_custkey, sha2(array_join(sort_array(collect_list(o_orderkey)), ','), 256) AS cache_key FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, sha256(string_agg(o_orderkey, ',' ORDER BY o_orderkey)) AS cache_key FROM orders GROUP BY o_custkey")

sql("title_case", "SELECT p_partkey, initcap(p_name) AS title FROM {part}",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part")


@query("trigram_search", f"""
WITH p AS (SELECT p_partkey, p_name, {GRAMS.format(c='p_name')} AS g FROM part), q AS (SELECT {GRAMS.format(c="'red widgets'")} AS g)
SELECT p_partkey, p_name, round(len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g))), 6) AS score FROM p, q
WHERE len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g) - len(list_intersect(p.g, q.g))) >= 0.3""")
def trigram_search(t):
    score = text.jaccard(text.char_ngrams(F.col("p_name")), text.char_ngrams(F.lit("red widgets")))
    return t.part.select("p_partkey", "p_name", F.round(score, 6).alias("score")).where(score >= 0.3)


@query("phrase_in_text", f"""
WITH d AS (SELECT doc_id, text, {TOKENS.format(c='text')} AS k FROM documents), n AS (SELECT DISTINCT p_name, list_distinct({TOKENS.format(c='p_name')}) AS k FROM part WHERE p_size = 1)
SELECT doc_id, count_if(contains(lower(text), lower(p_name)) OR (len(n.k) > 0 AND len(list_intersect(n.k, d.k)) >= 0.7 * len(n.k)))::BIGINT AS n_phrases FROM d, n GROUP BY doc_id""")
def phrase_in_text(t):
    """How many of a stated list of phrases, here the distinct names of the smallest parts, each document holds. The list comes in blocks of about 500, which every document meets in turn."""
    phrases = t.part.where("p_size = 1").select("p_name").distinct()
    return text.phrase_counts(t.documents, "doc_id", "text", phrases, "p_name").select("doc_id", F.col("n").alias("n_phrases"))


@query("glob_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%r_ng'")
def glob_filter(t):
    return t.part.where(clinical.glob_like(F.col("p_name"), ["red*", "*r?ng"])).select("p_partkey", "p_name")


@query("code_forms", "SELECT o_orderkey, CASE WHEN length(c) > 3 THEN substr(c, 1, 3) || '.' || substr(c, 4) ELSE c END AS code, substr(c, 1, 3) AS category FROM (SELECT o_orderkey, 'E' || o_orderkey AS c FROM orders)")
def code_forms(t):
    code = F.concat(F.lit("e. "), F.col("o_orderkey").cast("string"))
    return t.orders.select("o_orderkey", clinical.dotted(code).alias("code"), clinical.category(code).alias("category"))


#: The singular forms of a word w in DuckDB's words, and the shortest of them.
FORMS = "list_filter([w, CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' END, CASE WHEN length(w) > 4 AND ends_with(w, 'ses') THEN left(w, length(w) - 3) || 'sis' END, CASE WHEN length(w) > 4 AND ends_with(w, 'es') THEN left(w, length(w) - 2) END, CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN left(w, length(w) - 1) END], lambda f: f IS NOT NULL)"
STEM = "list_sort(list_transform(" + FORMS + ", lambda f: {'n': length(f), 'f': f}))[1].f"


@query("plural_stems", f"""
WITH x AS (SELECT unnest({TOKENS.format(c='text')}) AS w FROM documents), y AS (SELECT w, count(*) AS n FROM x GROUP BY 1) SELECT {STEM} AS stem, sum(n)::BIGINT AS n FROM y GROUP BY 1""")
def plural_stems(t):
    token = t.documents.select(F.explode(text.tokens(F.col("text"))).alias("w"))
    return token.groupBy("w").agg(F.count("*").alias("n")).groupBy(clinical.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


sql("numeric_parse", r"""SELECT event_id, try_cast(regexp_substr(props, '[-+]?\\d*\\.?\\d+') AS DOUBLE) AS number FROM {events}""",
    r"""SELECT event_id, try_cast(regexp_extract(props, '[-+]?\d*\.?\d+') AS DOUBLE) AS number FROM events""")

@query("json_salvage", r"""
SELECT event_id, coalesce(json_extract_string(nullif(regexp_extract(concat('Answer: ', props, ' done.'), '(?s)\{.*\}', 0), ''), '$.k'), 'none') AS k FROM events""")
def json_salvage(t):
    """A field of the JSON object that stands somewhere in a text."""
    answer = F.concat(F.lit("Answer: "), "props", F.lit(" done."))
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return t.events.select("event_id", F.coalesce(F.get_json_object(F.nullif(found, F.lit("")), "$.k"), F.lit("none")).alias("k"))
