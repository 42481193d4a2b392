"""Queries on whole charts: customers are patients, orders encounters, and lines sections, of a kind by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import access, clinical
from tallgrass.operators import chart
from tallgrass.sources.tables import tasks_for

from .registry import query

KINDS = ["notes", "medications", "allergies", "labs", "imaging", "pathology"]
ACCESS = {"nurse": ("medications", "allergies"), "radiologist": ("medications", "imaging", "labs"), "attending": None}


def encounters(t):
    return t.orders.select(F.col("o_orderkey").alias("encounter"), F.col("o_custkey").alias("patient"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"))


def sections(t, lines=None):
    """Lines of an order, parts of one number being one section; lines are those of lineitem, dealt out in some way (None: as they are)."""
    text = F.concat(F.lit(" part "), F.min("l_partkey").cast("string"), F.lit("\n\n"), F.count("*").cast("string"), F.lit(" in all \n"))
    return (t.lineitem if lines is None else lines).groupBy(F.col("l_orderkey").alias("encounter"), F.col("l_linenumber").alias("place")).agg(text.alias("text")).select(
        (F.col("encounter") * 8 + F.col("place")).alias("section"), "encounter", F.get(F.lit(KINDS), F.col("place") % len(KINDS)).alias("kind"), "place", "text")


CHART = f"""e AS (SELECT o_orderkey AS encounter, o_custkey AS patient, o_orderdate AS date, o_orderstatus AS status FROM orders),
s AS (SELECT l_orderkey * 8 + l_linenumber AS section, l_orderkey AS encounter, {KINDS}[l_linenumber % {len(KINDS)} + 1] AS kind, l_linenumber AS place, min(l_partkey) AS part, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
LINES = "'part ' || part || '|' || n || ' in all'"


@query("chart_snapshot", f"""
WITH {CHART}, r AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY date DESC, encounter DESC) AS k FROM e),
m AS (SELECT patient, kind, arg_max({LINES}, place) AS lines FROM r JOIN s USING (encounter) WHERE k = 1 AND kind IN ('medications', 'allergies') GROUP BY ALL),
p AS (SELECT o_custkey AS patient, string_agg(DISTINCT l_partkey::VARCHAR, ',') AS x, count(DISTINCT l_partkey) AS n_problems, sum(DISTINCT l_partkey)::BIGINT AS problem_sum FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c_custkey AS patient, coalesce((SELECT string_agg(encounter || ':' || status, ',' ORDER BY k) FROM r WHERE r.patient = c_custkey AND k <= 5), '') AS recent, coalesce((SELECT lines FROM m WHERE m.patient = c_custkey AND kind = 'medications'), '') AS medications,
  coalesce((SELECT lines FROM m WHERE m.patient = c_custkey AND kind = 'allergies'), '') AS allergies, coalesce(n_problems, 0)::INT AS n_problems, coalesce(problem_sum, 0)::BIGINT AS problem_sum FROM customer LEFT JOIN p ON p.patient = c_custkey""")
def chart_snapshot(t):
    """Every customer's five latest orders, the medications and allergies of the latest, and returned parts as problems."""
    problems = t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("patient"), F.col("l_partkey").alias("problem"))
    found = chart.summary(t.customer.select(F.col("c_custkey").alias("patient")), encounters(t), sections(t), problems, may=access.may_read("nurse", F.col("kind"), ACCESS), details=("status",))
    told = F.array_join(F.transform("recent", lambda r: F.concat(r["encounter"].cast("string"), F.lit(":"), r["status"])), ",")
    return found.select("patient", told.alias("recent"), *[F.array_join(c, "|").alias(c) for c in ("medications", "allergies")], F.size("problems").alias("n_problems"), F.aggregate("problems", F.lit(0).cast("long"), lambda a, x: a + x).alias("problem_sum"))


@query("encounter_details", f"""
WITH {CHART} SELECT encounter, patient, date, status, coalesce((SELECT string_agg(kind || ':' || section, ',' ORDER BY place, section) FROM s WHERE s.encounter = e.encounter AND kind IN ('medications', 'imaging', 'labs')), '') AS shown,
  (SELECT count(*) FROM s WHERE s.encounter = e.encounter AND kind NOT IN ('medications', 'imaging', 'labs')) AS n_hidden FROM e""")
def encounter_details(t):
    """Every order with the sections that a radiologist may read."""
    found = chart.detail(encounters(t), sections(t), may=access.may_read("radiologist", F.col("kind"), ACCESS))
    return found.withColumn("shown", F.array_join(F.transform("sections", lambda s: F.concat(s["kind"], F.lit(":"), s["section"].cast("string"))), ",")).drop("sections")


@query("imaging_results", f"""
WITH {CHART} SELECT encounter, patient, date, section, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = encounter AND l_returnflag = 'R') AS has_order FROM e JOIN s USING (encounter) WHERE kind = 'imaging'""")
def imaging_results(t):
    orders = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("encounter"))
    return chart.results(encounters(t), sections(t), "imaging", orders=orders).drop("text")


@query("report_pages", f"""
WITH {CHART}, r AS (SELECT 'DiagnosticReport' AS resource, e.*, section, kind FROM e JOIN s USING (encounter) WHERE kind = 'labs' UNION ALL SELECT 'DocumentReference', e.*, section, kind FROM e JOIN s USING (encounter) WHERE kind IN ('medications', 'imaging', 'labs')
  UNION ALL SELECT 'MedicationRequest', e.*, section, kind FROM e JOIN s USING (encounter) WHERE kind = 'medications' UNION ALL SELECT 'AllergyIntolerance', e.*, section, kind FROM e JOIN s USING (encounter) WHERE kind = 'allergies'),
n AS (SELECT resource, patient, section, kind, row_number() OVER (PARTITION BY resource, patient ORDER BY section)::INT AS number, count(*) OVER (PARTITION BY resource, patient) AS total FROM r) SELECT * FROM n WHERE number BETWEEN 3 AND 6""")
def report_pages(t):
    """The second page, of four rows after the first two, of each customer's resources of every kind, as a radiologist sees them; of reports only those from the laboratory."""
    # an order's lines meet once, before any hash table is made
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").repartition(tasks_for(t.lineitem), "l_orderkey")
    every = chart.all_resources(encounters(t), sections(t, lines), may=access.may_read("radiologist", F.col("kind"), ACCESS), categories={"DiagnosticReport": "LAB"}).select("resource", "patient", "section", "kind")
    return chart.page(every, ["resource", "patient"], ["section"], offset=2, count=4)


@query("patient_observations", """
WITH m AS (SELECT o_custkey AS patient, l_partkey AS finding, min(l_orderkey * 8 + l_linenumber) AS mention FROM orders JOIN lineitem ON l_orderkey IN (o_orderkey, o_orderkey + 1) GROUP BY ALL)
SELECT patient, finding, mention, p_type AS kind, p_brand AS brand FROM m JOIN part ON finding = p_partkey WHERE p_type IN ('SMALL', 'LARGE')""")
def patient_observations(t):
    """Parts as findings, mentioned by the lines of an order and of the next order: what each customer's questions say, of two kinds."""
    asked = t.orders.select(F.col("o_custkey").alias("patient"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("questions"))
    mentions = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("mention"), F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("finding"))
    parts = t.part.select(F.col("p_partkey").alias("finding"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"))
    return chart.observations(asked, mentions, parts, kinds=clinical.of_category(F.col("kind"), "exam", {"exam": ("SMALL", "LARGE")}))
