"""Notes: rewrites, assembly, filling from a profile, line cleaning, category sets, snapped words and small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import clinical, notes, similarity
from tallgrass.operators import notes as rows
from tallgrass.operators import resolve

from .registry import query


@query("note_repair", r"""
WITH x AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' ') AS x, CASE WHEN conv_id % 2 = 0 THEN 'He' ELSE 'She' END AS who FROM conversations)
SELECT conv_id, turn, trim(CASE turn % 4 WHEN 0 THEN who || ' has been ' || x WHEN 1 THEN 'Q' || x WHEN 2 THEN who || ' complains of ' || x ELSE 'Well. ' || x END, ' ') AS note FROM x""")
def note_repair(t):
    """Turns that begin in the middle of a sentence get their subject or capital back."""
    x, k = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " ")), F.col("turn") % 4
    cut = F.concat(F.when(k == 0, "over the past months. and has been ").when(k == 1, "and then so q").when(k == 2, "but complains of ").otherwise("  Well. "), x)
    sex = F.when(F.col("conv_id") % 2 == 0, "M").otherwise("F")
    return t.conversations.select("conv_id", "turn", notes.repaired_fragment(cut, sex).alias("note"))


@query("medication_reconcile", r"""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || E' is well.\n\nHome Medications:\n- ' || c_mktsegment WHEN 1 THEN c_name || ' is well. The patient denies any home medications.' ELSE c_name || E' is well.\nHome Medications:\n- ' || c_mktsegment END AS note FROM customer""")
def medication_reconcile(t):
    """A claim of no medications goes where a list of medications follows it, and only there."""
    claim, items = F.lit(" is well. The patient denies any home medications."), F.concat(F.lit("\nHome Medications:\n- "), "c_mktsegment")
    k = F.col("c_custkey") % 3
    written = F.when(k == 0, F.concat("c_name", claim, items)).when(k == 1, F.concat("c_name", claim)).otherwise(F.concat("c_name", F.lit(" is well."), items))
    return t.customer.select("c_custkey", notes.reconciled_medications(written).alias("note"))


@query("history_cleanup", r"""
SELECT p_partkey, E'Active Problem List:\n- ' || p_name || CASE p_partkey % 3 WHEN 0 THEN E'\n\nShe had ' || p_type || '. She was treated.' WHEN 1 THEN '' ELSE E'\n\nBrand is ' || p_brand || '.' END AS note FROM part""")
def history_cleanup(t):
    """Remnants and claims of no history behind a problem list go, other sentences stay."""
    k = F.col("p_partkey") % 3
    tail = F.when(k == 0, F.concat(F.lit("Her past medical history is unremarkable, and she had "), "p_type", F.lit(". of the left leg. She was treated"))).when(k == 1, "No known medical problems.").otherwise(F.concat(F.lit("and so on. Brand is "), "p_brand"))
    return t.part.select("p_partkey", notes.cleaned_history(F.concat(F.lit("Active Problem List:\n- "), "p_name", F.lit("\n\n"), tail)).alias("note"))


@query("whitespace_repair", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS digest FROM documents""")
def whitespace_repair(t):
    return t.documents.select("doc_id", F.sha2(notes.tidy(F.col("text")), 256).alias("digest"))


@query("note_assembly", r"""
WITH s AS (SELECT l_orderkey, min('line ' || l_linenumber) FILTER (l_returnflag = 'N') AS h, min('part ' || l_partkey) FILTER (l_returnflag = 'A') AS a, min('by ' || l_suppkey) FILTER (l_returnflag = 'R') AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(chr(10) || chr(10), 'HPI:' || chr(10) || h, CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN 'ASSESSMENT AND PLAN:' || chr(10) || a || chr(10) || chr(10) || p WHEN a IS NOT NULL THEN 'ASSESSMENT:' || chr(10) || a END,
  CASE WHEN a IS NULL THEN 'PLAN:' || chr(10) || p END) AS note FROM s""")
def note_assembly(t):
    """Lines of an order as the sections of a note."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "N", "hpi").when(flag == "A", "assessment").otherwise("plan")
    body = F.when(flag == "N", F.concat(F.lit("line "), "l_linenumber")).when(flag == "A", F.concat(F.lit("part "), "l_partkey")).otherwise(F.concat(F.lit("by "), "l_suppkey"))
    sections = t.lineitem.select("l_orderkey", kind.alias("section"), body.alias("text"))
    return rows.assembled(sections, "l_orderkey", "section", "text", {"hpi": "HPI", "assessment": "ASSESSMENT", "plan": "PLAN"}, merged=("assessment", "plan"), merged_header="ASSESSMENT AND PLAN")


@query("history_with_problems", """
WITH f AS (SELECT o_custkey, o_orderpriority AS name, min(o_orderdate) AS d FROM orders GROUP BY ALL), g AS (SELECT o_custkey, string_agg('- ' || name || ' (diagnosed ' || strftime(d, '%Y-%m-%d') || ')', chr(10) ORDER BY d, name) AS lines FROM f GROUP BY 1)
SELECT o_custkey, 'Active Problem List:' || chr(10) || lines || chr(10) || '- ' || c_mktsegment || chr(10) || chr(10) || c_name AS note FROM g JOIN customer ON o_custkey = c_custkey""")
def history_with_problems(t):
    """Each customer's kinds of orders, by their first dates, as prior diagnoses above the history."""
    first = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("d"))
    prior = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("d", "o_orderpriority"))).alias("p"))
    listed = F.transform("p", lambda x: F.struct(x["o_orderpriority"].alias("name"), F.date_format(x["d"], "yyyy-MM-dd").alias("date")))
    both = prior.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    chronic = F.array(F.lower(F.get("p", F.lit(0))["o_orderpriority"]), "c_mktsegment")
    return both.select("o_custkey", notes.cumulative_history(F.col("c_name"), listed, chronic).alias("note"))


@query("profile_fill", r"""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || E'\n\nHome Medications:\n- ' || c_mktsegment || ' 5 mg' ELSE 'on ' || c_mktsegment END AS meds,
  CASE c_custkey % 3 WHEN 0 THEN 'Smoking: never. Occupation: ' || c_mktsegment || '.' WHEN 1 THEN c_name END AS social, CASE WHEN c_custkey % 2 = 0 THEN 'No known drug allergies (NKDA)' ELSE 'nuts, ' || c_mktsegment END AS allergies,
  'A ' || CASE WHEN c_custkey % 30 > 0 THEN 40 + (c_custkey % 30) // 12 ELSE 40 END || '-year-old' AS who FROM customer""")
def profile_fill(t):
    """Sections filled from a profile, home medications merged, ages moved on."""
    even, k = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3
    meds = F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("5 mg").alias("dose")))
    return t.customer.select(
        "c_custkey",
        notes.merged_medications(F.when(even, F.col("c_name")).otherwise(F.concat(F.lit("on "), "c_mktsegment")), meds).alias("meds"),
        notes.social_history(F.when(k == 1, F.col("c_name")).otherwise(""), F.when(k == 0, "never"), F.lit(None).cast("string"), F.when(k == 0, F.col("c_mktsegment"))).alias("social"),
        notes.allergies(F.lit(""), F.when(~even, F.array(F.lit("nuts"), "c_mktsegment"))).alias("allergies"),
        notes.aged(F.lit("A 40-year-old"), F.lit(40), F.col("c_custkey") % 30).alias("who"),
    )


@query("page_lines", r"""
WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = 'the' OR NOT regexp_full_match(trim(x, ' '), '(pg\.\s*\d+|\d{1,4}|[A-Za-z]+\.?|)')) AS k FROM documents)
SELECT doc_id, CAST(len(k) AS INT) AS n_lines, sha256(array_to_string(k, chr(10))) AS digest FROM d WHERE k IS NOT NULL""")
def page_lines(t):
    """Documents without lines that are page numbers, single words or empty."""
    kept = notes.without_lines(F.col("text"), [r"pg\.\s*\d+", r"\d{1,4}", r"[A-Za-z]+\.?", ""], ["the"])
    n = F.when(kept == "", 0).otherwise(F.size(F.split(kept, "\n")))
    return t.documents.where("text IS NOT NULL").select("doc_id", n.alias("n_lines"), F.sha2(kept, 256).alias("digest"))


@query("character_lines", "SELECT p_partkey, trim(p_name) AS text FROM part")
def character_lines(t):
    """Names from their characters and places; blanks come back from the gaps."""
    each = t.part.select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "c")).where("c NOT IN ('', ' ')")
    return rows.joined_characters(each.select("p_partkey", (F.col("i") * 5.0).alias("x0"), (F.col("i") * 5.0 + 4).alias("x1"), "c"), ["p_partkey"], "x0", "x1", "c")


@query("neutral_sets", r"""
WITH c AS (SELECT p_brand, p_name AS plain, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS k, lower(p_name) LIKE '%cold%' AS a, lower(p_name) LIKE '%widget%' AS b FROM part),
n AS (SELECT DISTINCT p_name AS name, p_type AS category FROM part WHERE p_size <= 10), f AS (SELECT name, min(category) AS category FROM n GROUP BY 1)
SELECT DISTINCT p_brand, category, method FROM (
  SELECT p_brand, unnest(CASE WHEN a AND b THEN ['J00', 'K00', 'W00'] WHEN a THEN ['J00', 'K00'] ELSE ['W00'] END) AS category, 'alias' AS method FROM c WHERE a OR b
  UNION ALL SELECT p_brand, n.category, 'exact' FROM c JOIN n ON c.plain = n.name WHERE NOT a AND NOT b AND k = 0
  UNION ALL SELECT p_brand, f.category, 'fuzzy' FROM c JOIN f ON c.plain = f.name WHERE NOT a AND NOT b AND k = 1)""")
def neutral_sets(t):
    """Each brand's categories by its parts' names, written with qualifiers, with a further word, or with two."""
    k = F.col("p_partkey") % 4
    written = F.when(k == 0, F.concat(F.lit("History of "), "p_name")).when(k == 1, F.concat(F.upper("p_name"), F.lit(" (mild)"))).when(k == 2, F.concat("p_name", F.lit(", extra"))).otherwise(F.concat("p_name", F.lit(" with more")))
    known = t.part.where("p_size <= 10").select(F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    return resolve.category_sets(t.part.select("p_brand", written.alias("condition")), "p_brand", "condition", [(r"\bcold\b", ["J00", "K00"]), ("widget", ["W00"])], known)


@query("word_snap")
def word_snap(t):
    """Words of the documents that are near to a word of the benchmark."""
    letters = lambda df: df.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != ""))).alias("word")).distinct()
    return resolve.snapped(letters(t.documents), letters(t.benchmark), "word")


@query("json_repair", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_repair(t):
    """A field of a JSON object inside a text: whole, with a comma too many, cut off, or without the key."""
    salvaged = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else similarity.salvage_json(x, ["k"])), "string")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("So {this} is it: "), "props", F.lit(" done."))).when(k == 1, F.replace("props", F.lit("}"), F.lit(", }"))).when(k == 2, F.concat(F.lit("Answer: "), F.replace("props", F.lit("}"), F.lit("")))).otherwise(F.replace("props", F.lit('"k"'), F.lit('"j"')))
    return t.events.select("event_id", F.get_json_object(salvaged(said), "$.k").alias("k"))


@query("choice_split", """
SELECT p_partkey, 'A=' || p_name || ';B=' || p_type || ';C=' || p_brand AS choices, p_name || '|' || p_type AS problems, 'history of ' || lower(p_name) || '|' || lower(p_name) AS forms FROM part""")
def choice_split(t):
    """Answer choices, problem lists and name variants of parts' names."""
    asked = F.concat(F.lit("Which is it?\nA. "), "p_name", F.lit(" B) "), "p_type", F.lit("\nC. "), "p_brand")
    note = F.concat(F.lit("NOTE\nPROBLEM LIST:\n- "), "p_name", F.lit("\n* "), "p_type", F.lit("\n- "), F.upper("p_name"), F.lit("\n\nPLAN: none"))
    choices = F.transform(clinical.answer_choices(asked), lambda x: F.concat_ws("=", x["letter"], x["text"]))
    return t.part.select(
        "p_partkey", F.array_join(choices, ";").alias("choices"), F.array_join(clinical.problem_lines(note), "|").alias("problems"), F.array_join(clinical.name_variants(F.concat(F.lit("History of "), "p_name")), "|").alias("forms"),
    )


@query("short_forms", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'history of hypertension with ' WHEN 1 THEN 'rule out congestive heart failure ' WHEN 2 THEN 'follow up post void residual nausea vomiting ' ELSE 'status post myocardial infarction concern for right lower extremity ' END || lower(c_mktsegment) AS words, c_custkey % 2 = 0 AS safe FROM customer""")
def short_forms(t):
    """Short and slashed forms written out, and commands against a list of allowed programs."""
    k = F.col("c_custkey") % 4
    said = F.concat(F.when(k == 0, "h/o HTN, w/").when(k == 1, "(R/O CHF); cnh ").when(k == 2, "f/u PVR n/v: ").otherwise("s/p MI c/f RLE-"), "c_mktsegment")
    command = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("grep '"), "c_name", F.lit("' notes | sort"))).otherwise(F.concat(F.lit("grep x | rm "), "c_name"))
    return t.customer.select("c_custkey", F.array_join(clinical.expanded_tokens(said), " ").alias("words"), clinical.safe_command(command, ["grep", "sort"]).alias("safe"))


@query("pruned_sections", """
SELECT l_orderkey, count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('R', 'A')) AS n_kept, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('R', 'A')), '') AS kept FROM lineitem GROUP BY 1""")
def pruned_sections(t):
    """Nested lines of an order without those whose flag is hidden."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    kept = clinical.prune_sections(F.col("s"), "l_returnflag", ["R", "A"])
    return nested.select("l_orderkey", F.size(kept).cast("long").alias("n_kept"), F.array_join(F.transform(kept, lambda x: x["l_linenumber"].cast("string")), ",").alias("kept"))
