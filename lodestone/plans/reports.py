"""More of the library's queries over the driver's tables, with their DuckDB SQL: governed views, profiles, the catalogue, relationships, logs, landing.

``registry`` imports this module last, so one dictionary holds all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean, lexical, udtf, vectors
from ..operators import aliases, catalog, governed, joins, relations, rollups, scoring, search, similar, store, trace
from ..sources import landing
from . import lexical_sql, registry
from .registry import FACTS, LOG, ORDER_TEXTS, TASKS, event_agents, event_log, event_tasks, facts, order_texts, query, t

# --- complaints, recalls and investigations as all-text tables ---------------------------------------------------------


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as a complaint file has them: all text, blanks and sentinels included."""
    f = facts(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    return f.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cmplid"), text("l_orderkey").alias("odino"), F.when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("make")).alias("maketxt"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("component")).alias("modeltxt"), F.when(F.col("l_orderkey") % 5 == 0, "9999").otherwise(F.col("yr")).alias("yeartxt"), F.when(F.col("l_linenumber") == 6, " ").otherwise(F.col("component")).alias("compdesc"),
        F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(F.col("faildate")).alias("faildate"), F.concat("yr", F.lit("0131")).alias("datea"), F.concat("yr", F.lit("1301")).alias("ldate"),
        F.when(F.col("fire"), "Y").when(F.col("l_linenumber") % 2 == 0, "N").alias("fire"), F.when(F.col("crash"), "Y").otherwise("").alias("crash"), "injured", "deaths", F.when(F.col("l_linenumber") % 3 != 0, F.concat_ws(" ", "make", "component")).alias("cdescr"),
    )


COMPLAINTS = FACTS + """, complaints AS (SELECT l_orderkey || '-' || l_linenumber AS cmplid, CAST(l_orderkey AS VARCHAR) AS odino, CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE make END AS maketxt,
 CASE WHEN l_linenumber = 7 THEN '' ELSE component END AS modeltxt, CASE WHEN l_orderkey % 5 = 0 THEN '9999' ELSE yr END AS yeartxt, CASE WHEN l_linenumber = 6 THEN ' ' ELSE component END AS compdesc,
 CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE faildate END AS faildate, yr || '0131' AS datea, yr || '1301' AS ldate,
 CASE WHEN fire THEN 'Y' WHEN l_linenumber % 2 = 0 THEN 'N' END AS fire, CASE WHEN crash THEN 'Y' ELSE '' END AS crash, injured, deaths, CASE WHEN l_linenumber % 3 <> 0 THEN make || ' ' || component END AS cdescr FROM facts)"""
_DAY = "CAST(try_strptime(nullif({0}, ''), '%Y%m%d') AS DATE)"
_COUNT = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN CAST({0} AS BIGINT) ELSE 0 END"
SAFE = COMPLAINTS + f""", safe AS (SELECT nullif(trim(maketxt), '') AS make, nullif(trim(modeltxt), '') AS model, nullif(nullif(trim(yeartxt), ''), '9999') AS model_year, nullif(trim(compdesc), '') AS component,
 {_DAY.format("faildate")} AS failed_on, {_DAY.format("datea")} AS added_on, {_DAY.format("ldate")} AS received_on, coalesce(fire = 'Y', false) AS fire, coalesce(crash = 'Y', false) AS crash,
 {_COUNT.format("injured")} AS injured, {_COUNT.format("deaths")} AS killed, length(coalesce(cdescr, '')) AS narrative_length, cmplid AS complaint_id FROM complaints)"""


def safe_facts(spark, sf_dir) -> DataFrame:
    return governed.complaint_facts(complaints(spark, sf_dir), {"complaint_id": "cmplid"})


@query(f"WITH {COMPLAINTS} SELECT TRY_CAST(nullif(trim(odino), '') AS BIGINT) AS odi_id, {_COUNT.format('injured')} AS people_hurt, {_COUNT.format('deaths')} AS people_killed, {_DAY.format('faildate')} AS failed_on, {_DAY.format('datea')} AS added_on, {_DAY.format('ldate')} AS received_on, nullif(trim(fire), '') = 'Y' AS was_fire, nullif(trim(crash), '') = 'Y' AS was_crash, nullif(trim(maketxt), '') AS make FROM complaints")
def typed_complaints(spark, sf_dir):
    return clean.typed_complaints(complaints(spark, sf_dir), {"odi_id": "odino"}, {"people_hurt": "injured", "people_killed": "deaths"}, {"failed_on": "faildate", "added_on": "datea", "received_on": "ldate"}, {"was_fire": "fire", "was_crash": "crash"}, {"make": "maketxt"})


@query(f"WITH {SAFE} SELECT * FROM safe")
def complaint_facts(spark, sf_dir):
    return safe_facts(spark, sf_dir)


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recalls: a campaign is a remainder of the key, so that one has many rows."""
    return t(spark, sf_dir, "part").select((F.col("p_partkey") % 97).cast("string").alias("campno"), F.col("p_brand").alias("maketxt"), F.col("p_type").alias("compname"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("1995"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("15"))).alias("odate"), F.concat(F.lit("19950"), F.lit("132")).alias("rcdate"), F.col("p_name").alias("desc_defect"))


RECALLS = "recalls AS (SELECT CAST(p_partkey % 97 AS VARCHAR) AS campno, p_brand AS maketxt, p_type AS compname, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '1995' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '15' END AS odate, '19950132' AS rcdate, p_name AS desc_defect FROM part)"


@query(f"WITH {RECALLS} SELECT {_DAY.format('odate')} AS notified_on, {_DAY.format('rcdate')} AS reported_on, campno AS campaign, maketxt AS make, compname AS component, desc_defect AS defect FROM recalls")
def recall_summary(spark, sf_dir):
    return governed.recall_summary(recalls(spark, sf_dir), {"campaign": "campno", "make": "maketxt", "component": "compname", "defect": "desc_defect"})


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as investigations, some without a campaign, some open."""
    return t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("action_number"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise((F.col("c_custkey") % 120).cast("string")).alias("campno"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") % 25 + 1).cast("string")).alias("make"), F.when(F.col("c_custkey") % 2 == 0, "ECONOMY").otherwise("SMALL").alias("model"), F.when(F.col("c_custkey") % 11 == 0, "").otherwise((F.col("c_custkey") % 7 + 1992).cast("string")).alias("year"), F.col("c_mktsegment").alias("subject"), F.lit("19960301").alias("odate"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("19970401").alias("cdate"))


INVESTIGATIONS = "investigations AS (SELECT CAST(c_custkey AS VARCHAR) AS action_number, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE CAST(c_custkey % 120 AS VARCHAR) END AS campno, 'Brand#' || (c_nationkey % 25 + 1) AS make, CASE WHEN c_custkey % 2 = 0 THEN 'ECONOMY' ELSE 'SMALL' END AS model, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE CAST(c_custkey % 7 + 1992 AS VARCHAR) END AS year, c_mktsegment AS subject, '19960301' AS odate, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '19970401' END AS cdate FROM customer)"


@query(f"WITH {INVESTIGATIONS} SELECT {_DAY.format('odate')} AS opened_on, {_DAY.format('cdate')} AS closed_on, action_number, make, subject, cdate = '' AS is_open FROM investigations")
def investigation_summary(spark, sf_dir):
    return governed.investigation_summary(investigations(spark, sf_dir), {"action_number": "action_number", "make": "make", "subject": "subject"})


@query(f"WITH {SAFE} SELECT component, model_year, count(*) AS n, count(*) FILTER (fire) AS fires, count(*) FILTER (crash) AS crashes, sum(injured)::BIGINT AS injured, sum(killed)::BIGINT AS killed FROM safe WHERE component IS NOT NULL GROUP BY 1, 2")
def safe_by_component_year(spark, sf_dir):
    return rollups.by_component_year(safe_facts(spark, sf_dir))


@query(f"WITH {SAFE} SELECT make, model_year, count(*) AS n, count(*) FILTER (fire) AS fires, count(*) FILTER (crash) AS crashes, min(failed_on) AS first_failure, max(failed_on) AS last_failure FROM safe WHERE make IS NOT NULL GROUP BY 1, 2")
def safe_by_make_year(spark, sf_dir):
    return rollups.by_make_year(safe_facts(spark, sf_dir))


@query(f"WITH {SAFE} SELECT make, model_year, component, count(*) AS n, count(*) FILTER (fire) AS fires, round(100.0::DOUBLE * count(*) FILTER (fire) / count(*), 2) AS fire_rate_pct FROM safe WHERE make IS NOT NULL AND component IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def safe_kpi(spark, sf_dir):
    return rollups.kpi_k_anon(safe_facts(spark, sf_dir).where("make IS NOT NULL AND component IS NOT NULL"), ["make", "model_year", "component"], F.col("fire"))


@query(f"WITH {RECALLS}, {INVESTIGATIONS} SELECT compname AS component, count(*) AS n_rows, count(DISTINCT i.campno) AS n_campaigns FROM investigations i JOIN recalls r ON nullif(trim(i.campno), '') = nullif(trim(r.campno), '') GROUP BY 1 ORDER BY n_rows DESC, component LIMIT 25")
def recalls_by_component(spark, sf_dir):
    return rollups.recalls_by_component(investigations(spark, sf_dir), recalls(spark, sf_dir), ("campno", "campno"), "compname")


@query(f"""WITH {COMPLAINTS}, {INVESTIGATIONS}, c AS (SELECT maketxt, modeltxt, yeartxt, count(*) AS n_complaints FROM complaints WHERE maketxt = 'Brand#7' GROUP BY 1, 2, 3)
 SELECT maketxt, modeltxt, yeartxt, n_complaints, subject FROM c JOIN (SELECT DISTINCT make, model, year, subject FROM investigations) i ON nullif(trim(maketxt), '') = nullif(trim(make), '') AND nullif(trim(modeltxt), '') = nullif(trim(model), '') AND nullif(trim(yeartxt), '') = nullif(trim(year), '')""")
def complaints_under_investigation(spark, sf_dir):
    return rollups.complaints_under_investigation(complaints(spark, sf_dir), investigations(spark, sf_dir), "maketxt", "Brand#7", [("maketxt", "make"), ("modeltxt", "model"), ("yeartxt", "year")], "subject")


@query(f"WITH {COMPLAINTS}, {INVESTIGATIONS} SELECT subject, count(*) AS n FROM complaints JOIN investigations ON nullif(trim(maketxt), '') = make AND nullif(trim(modeltxt), '') = model AND nullif(trim(yeartxt), '') = nullif(trim(year), '') GROUP BY 1")
def join_vehicle(spark, sf_dir):
    """Three keys that have other names on the right; the right side is counted by vehicle first."""
    keys = [("maketxt", "make"), ("modeltxt", "model"), ("yeartxt", "year")]
    left = complaints(spark, sf_dir).groupBy(*[a for a, _ in keys]).agg(F.count("*").alias("l"))
    right = investigations(spark, sf_dir).groupBy(*[b for _, b in keys], "subject").agg(F.count("*").alias("r"))
    return joins.join_nonblank(left, right, keys).groupBy("subject").agg(F.sum(F.col("l") * F.col("r")).alias("n"))


# --- profiles and assertions -------------------------------------------------------------------------------------------


@query(f"WITH {COMPLAINTS}, v AS (SELECT 'faildate' AS column_name, faildate AS x FROM complaints UNION ALL SELECT 'ldate', ldate FROM complaints) SELECT column_name, count(*) AS n_rows, min({_DAY.format('x')}) AS first_date, max({_DAY.format('x')}) AS last_date, count(*) FILTER (nullif(trim(x), '') IS NULL) AS n_blank, count(*) FILTER (nullif(trim(x), '') IS NOT NULL AND {_DAY.format('x')} IS NULL) AS n_malformed FROM v GROUP BY 1")
def profile_dates(spark, sf_dir):
    return rollups.profile_dates(complaints(spark, sf_dir), ["faildate", "ldate"])


@query("SELECT count(*) AS n_rows, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type FROM part")
def distinct_counts(spark, sf_dir):
    return rollups.distinct_counts(t(spark, sf_dir, "part"), ["p_brand", "p_type"])


_TRUTHS = {"nations": (25, "SELECT count(*) FROM nation"), "regions": (5, "SELECT count(*) FROM region"), "nations of no region": (0, "SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"), "orders of no customer": (0, "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"), "lines of no order": (0, "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"), "parts of line numbers": (7, "SELECT max(l_linenumber) FROM lineitem"), "regions, stated wrongly": (6, "SELECT count(*) FROM region")}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, '{n}' AS expected, CAST(({sql}) AS VARCHAR) AS found, ({sql}) = {n} AS holds" for name, (n, sql) in _TRUTHS.items()))
def fixture_integrity(spark, sf_dir):
    """Figures of the tables against literal ground truth; the last is stated wrongly and must not hold."""
    nation, region, customer, orders, lines = (t(spark, sf_dir, x) for x in ("nation", "region", "customer", "orders", "lineitem"))
    lost = lambda a, b, c, d: a.join(b.select(F.col(d).alias(c)), c, "left_anti")
    found = {"nations": (nation, F.count("*")), "regions": (region, F.count("*")), "nations of no region": (lost(nation, region, "n_regionkey", "r_regionkey"), F.count("*")), "orders of no customer": (lost(orders, customer, "o_custkey", "c_custkey"), F.count("*")), "lines of no order": (lost(lines, orders, "l_orderkey", "o_orderkey"), F.count("*")), "parts of line numbers": (lines, F.max("l_linenumber")), "regions, stated wrongly": (region, F.count("*"))}
    return rollups.assert_scalars({name: (*found[name], n) for name, (n, _) in _TRUTHS.items()})


@query("SELECT (SELECT count(*) FROM lineitem) >= (SELECT count(*) FROM orders) AND (SELECT count(DISTINCT n_nationkey) FROM nation) = 25 AS holds")
def assert_scalar(spark, sf_dir):
    n = t(spark, sf_dir, "orders").count()
    return rollups.assert_scalar({"lines": (t(spark, sf_dir, "lineitem"), F.count("*") >= n, "true"), "nations": (t(spark, sf_dir, "nation"), F.count_distinct("n_nationkey"), 25)})


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def exclude_columns(spark, sf_dir):
    return clean.exclude_columns(t(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


@query("SELECT DISTINCT event_type AS value FROM events WHERE event_type LIKE '%\\_%' ESCAPE '\\' OR event_type ILIKE '%ER%' ORDER BY value LIMIT 20")
def literal_wildcards(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return clean.distinct_literals(e, "event_type", "_").union(clean.distinct_literals(e, "event_type", "ER")).distinct().orderBy("value").limit(20)


@query("SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer GROUP BY 1")
def exists_and_not(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    there = c.join(o, "c_custkey", "left_semi").withColumn("has", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has", F.lit(False)))
    return there.groupBy("c_mktsegment").agg(F.count_if("has").alias("with_orders"), F.count_if(~F.col("has")).alias("without"))


@query("SELECT o_custkey, sum(CAST(o_orderkey AS BIGINT))::BIGINT AS total FROM orders GROUP BY 1 ORDER BY CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_custkey DESC LIMIT 1000")
def nulls_last(spark, sf_dir):
    odd = F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey"))
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("total")).orderBy(odd.asc_nulls_last(), F.desc("o_custkey")).limit(1000)


# --- search ------------------------------------------------------------------------------------------------------------


@query(f"WITH {registry._LEX}, vx AS (SELECT vec_id AS doc_id FROM embeddings ORDER BY {registry._COS} DESC, vec_id LIMIT 100) SELECT doc_id FROM vx UNION SELECT doc_id FROM lx WHERE lexical_rank <= 100")
def candidate_ids(spark, sf_dir):
    v = search.knn_cosine(t(spark, sf_dir, "embeddings"), "embedding", registry.query_vector(spark, sf_dir), 100, "vec_id").withColumnRenamed("vec_id", "doc_id")
    w = search.lexical_search(t(spark, sf_dir, "documents"), lexical.candidates("text", registry.WEB_QUERY), registry.WEB_QUERY, 100, "doc_id", F.col("lang") == "en")
    return search.candidate_ids([v, w], "doc_id")


@query("WITH r AS (SELECT user_id, rank() OVER (ORDER BY count(*) DESC) AS a, rank() OVER (ORDER BY round(sum(value), 2) DESC) AS b FROM events GROUP BY 1) SELECT user_id, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 10) AS rrf_score FROM r")
def rrf(spark, sf_dir):
    """Users by two rankings, by number and by value of their events; equal ones share a rank, and no task has all users."""
    by_user = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.round(F.sum("value"), 2).alias("v"))
    arms = [search.tied_ranks(by_user.select("user_id", c), c, "rank").select("user_id", "rank") for c in ("n", "v")]
    return search.rrf(arms, "user_id").withColumn("rrf_score", F.round("rrf_score", 10))


@query("SELECT vec_id, len(embedding)::INTEGER AS n_numbers FROM embeddings WHERE len(embedding) = 64")
def check_dimension(spark, sf_dir):
    return vectors.check_dimension(t(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", F.size("embedding").alias("n_numbers"))


# --- catalogue ---------------------------------------------------------------------------------------------------------


def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary files, one a brand: a preamble, then fields in three layouts with code lists."""
    p = t(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "VARCHAR2(30)").when(F.col("p_partkey") % 3 == 1, "NUMBER(5,2)").otherwise("CHAR (8)")
    name = F.upper(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "_")))
    head = F.concat((F.col("p_partkey") % 900 + 1).cast("string"), F.lit("        "), name, F.lit("      "), kind, F.lit("       "), F.col("p_type"))
    texts = F.array(head, F.concat(F.lit("\t  are of   size "), F.col("p_size").cast("string"), F.lit(":")), F.lit("          cag  =CONSUMER ACTION  GROUP"), F.concat(F.lit("          K2 = "), F.col("p_brand")))
    body = p.select(F.col("p_brand").alias("file"), F.posexplode(texts).alias("i", "line"), "p_partkey").select("file", (F.col("p_partkey") * 4 + F.col("i")).alias("line_no"), "line")
    brands = p.select(F.col("p_brand").alias("file")).distinct()
    top = brands.select("file", F.posexplode(F.array(F.lit("1        NOT A FIELD      CHAR(1)       of the preamble"), F.lit("FIELDS:"), F.lit("-----"))).alias("i", "line")).select("file", (F.col("i") - 10).cast("bigint").alias("line_no"), "line")
    return top.unionByName(body)


_RECORDS = """records AS (SELECT p_brand AS file, CAST(p_partkey % 900 + 1 AS INTEGER) AS field_no, replace(p_name, ' ', '_') AS name, CASE p_partkey % 3 WHEN 0 THEN 'VARCHAR2(30)' WHEN 1 THEN 'NUMBER(5,2)' ELSE 'CHAR(8)' END AS type,
 p_type || ' are of size ' || p_size || ': CAG = CONSUMER ACTION GROUP; K2 = ' || p_brand AS description FROM part)"""


@query(f"WITH {_RECORDS} SELECT * FROM records")
def assemble_records(spark, sf_dir):
    return catalog.assemble_records(dictionary_lines(spark, sf_dir))


@query("""WITH r AS (SELECT CAST(p_partkey AS INTEGER) AS field_no, replace(p_name, ' ', '_') AS name, 'CHAR(' || p_size || ')' AS type, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS description FROM part),
 c AS (SELECT CAST(p_partkey + 3 AS INTEGER) AS position, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE upper(replace(p_name, ' ', '_')) END AS column_name FROM part)
 SELECT coalesce(position, field_no) AS position, column_name, CASE WHEN description <> '' THEN description || ' [' || type || ']' END AS comment,
 CASE WHEN position IS NULL THEN 'no such column' WHEN field_no IS NULL OR coalesce(description, '') = '' THEN 'no description' WHEN lower(column_name) <> name THEN 'name differs' ELSE 'ok' END AS status FROM c FULL JOIN r ON position = field_no""")
def attach_comments(spark, sf_dir):
    """Parts as records, and as columns that begin three places later."""
    p = t(spark, sf_dir, "part")
    records = p.select(F.col("p_partkey").cast("int").alias("field_no"), F.regexp_replace("p_name", " ", "_").alias("name"), F.concat(F.lit("CHAR("), F.col("p_size").cast("string"), F.lit(")")).alias("type"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_type")).alias("description"))
    columns = p.select((F.col("p_partkey") + 3).cast("int").alias("position"), F.upper(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "_"))).alias("column_name"))
    return catalog.attach_comments(records, columns)


def part_catalogue(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """Parts as catalogue rows; ``later`` some have another name, which is one gone and one new, some another comment."""
    p, key = t(spark, sf_dir, "part"), F.col("p_partkey")
    ref = F.when(key % 10 == 3, -1 - key).otherwise(key) if later else key
    comment = F.when(key % 10 == 5, F.concat("p_type", F.lit(" changed"))).otherwise(F.col("p_type")) if later else F.col("p_type")
    kind = F.when(key % 50 == 0, "table").when(key % 50 == 1, "view").otherwise("column")
    return p.select(F.lit("schema").alias("source_type"), kind.alias("entity_type"), F.col("p_brand").alias("relation_name"), F.col("p_name").alias("column_name"), ref.cast("string").alias("object_ref"), F.col("p_name").alias("definition"), comment.alias("comment"))


def _stored_catalogue(spark, sf_dir) -> DataFrame:
    vec = F.when(F.col("object_ref").cast("long") % 100 != 7, F.array(F.lit(1.0)))
    return part_catalogue(spark, sf_dir, False).withColumn("hash", catalog.definition_hash()).withColumn("definition_vec", vec)


@query("SELECT CAST(p_partkey AS VARCHAR) AS object_ref, CASE p_partkey % 10 WHEN 3 THEN 'delete' ELSE 'update' END AS change FROM part WHERE p_partkey % 10 IN (3, 5) UNION ALL SELECT CAST(-1 - p_partkey AS VARCHAR), 'insert' FROM part WHERE p_partkey % 10 = 3")
def catalogue_changes(spark, sf_dir):
    return catalog.changes(_stored_catalogue(spark, sf_dir), part_catalogue(spark, sf_dir, True))


@query("SELECT count(*) AS total, count(*) FILTER (p_partkey % 50 = 0) AS tables, count(*) FILTER (p_partkey % 50 = 1) AS views, count(*) FILTER (p_partkey % 50 > 1) AS columns, 0::BIGINT AS queries, 0::BIGINT AS relationships, count(*) FILTER (p_partkey % 100 = 7) AS pending, count(*) FILTER (p_partkey % 10 IN (3, 5)) AS drifted FROM part")
def kb_stats(spark, sf_dir):
    return catalog.stats(_stored_catalogue(spark, sf_dir), part_catalogue(spark, sf_dir, True))


@query("SELECT CASE WHEN count(*) = 0 THEN 'FAIL: empty' WHEN count(*) FILTER (p_partkey % 50 > 1) < 85 THEN 'FAIL: columns' WHEN count(*) FILTER (p_partkey % 100 = 7) > 0 THEN 'PARTIAL' ELSE 'PASS' END AS verdict FROM part")
def kb_check(spark, sf_dir):
    return catalog.check(_stored_catalogue(spark, sf_dir), 85)


@query("SELECT stem, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM (SELECT replace(p_name, ' ', '_') AS stem, replace(p_name, ' ', '_') || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_old' WHEN 2 THEN '_v2' ELSE '_bak' END AS name FROM part) GROUP BY 1 HAVING count(DISTINCT name) > 1")
def name_variants(spark, sf_dir):
    ending = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "_old").when(F.col("p_partkey") % 4 == 2, "_v2").otherwise("_bak")
    return catalog.name_variants(t(spark, sf_dir, "part").select(F.concat(F.regexp_replace("p_name", " ", "_"), ending).alias("name"))).withColumn("names", F.array_join("names", ","))


@query(f"WITH {LOG} SELECT 'SELECT ' || id AS definition, 'run 1 times' AS comment, 'history' AS source_type FROM elog WHERE action_type = 'tool_call' AND tool = 'tool1'")
def history_rows(spark, sf_dir):
    issued = trace.issued_statements(event_log(spark, sf_dir), "tool1").withColumn("status", F.lit("done"))
    return aliases.history_rows(issued).select("definition", "comment", "source_type")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def run_alias_lateral(spark, sf_dir):
    """A saved query with a parameter, called for every customer."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("alias_orders")
    t(spark, sf_dir, "customer").createOrReplaceTempView("alias_customers")
    saved = aliases.Aliases(spark)
    saved.save("orders_of", "number of orders of a customer", "SELECT count(*) AS n, coalesce(sum(o_orderkey), 0) AS keys FROM alias_orders WHERE CAST(o_custkey AS STRING) = ${customer}", [("customer", "bigint", "key of a customer")])
    saved.as_function("orders_of")
    return spark.sql("SELECT c_custkey, o.n, o.keys FROM alias_customers, LATERAL orders_of(CAST(c_custkey AS STRING)) o")


@query(f"WITH {lexical_sql.TOKENS} SELECT doc_id, pos::INTEGER AS pos, lexeme FROM toks JOIN stems USING (word) WHERE lang = 'en'")
def lexeme_positions(spark, sf_dir):
    """The table function of a text's lexemes, called laterally."""
    udtf.register(spark)
    t(spark, sf_dir, "documents").createOrReplaceTempView("lexeme_documents")
    return spark.sql("SELECT doc_id, p.pos, p.lexeme FROM lexeme_documents, LATERAL lexeme_positions(text) p WHERE lang = 'en'")


@query("SELECT doc_id, 128 AS n_numbers, regexp_matches(coalesce(text, ''), '[A-Za-z0-9\\x{80}-\\x{10FFFF}]') AS has_words, CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9\\x{80}-\\x{10FFFF}]') THEN 1.0::DOUBLE ELSE 0 END AS norm FROM documents")
def embedding_norms(spark, sf_dir):
    """Vectors of whole texts by the table function: their length is 1 if the text has a word."""
    udtf.register(spark)
    t(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("encode_documents")
    rows = spark.sql("SELECT doc_id, vec FROM encode_batch(TABLE(encode_documents), 'text', 128, 64)")
    norm = F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4)
    return rows.select("doc_id", F.size("vec").alias("n_numbers"), norm.alias("norm")).withColumn("has_words", F.col("norm") > 0)


# --- relationships -----------------------------------------------------------------------------------------------------


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as objects, each related to two others by rule."""
    n = t(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    each = n.select("n_nationkey", F.explode(F.array(F.lit(1), F.lit(7))).alias("step"))
    return each.select((F.col("n_nationkey") * 10 + F.col("step")).cast("long").alias("id"), name(F.col("n_nationkey")).alias("left_object"), F.array(F.lit("k")).alias("left_columns"), name((F.col("n_nationkey") + F.col("step")) % 25).alias("right_object"), F.array(F.concat(F.lit("k"), F.col("step").cast("string"))).alias("right_columns"), F.when(F.col("step") == 1, "near").otherwise("far").alias("kind"), F.when(F.col("step") == 1, 0.5).otherwise(0.25).cast("double").alias("confidence"), F.when(F.col("n_nationkey") % 2 == 0, "manual").otherwise("agent").alias("source"))


_NEDGES = """e AS (SELECT n_nationkey * 10 + s AS id, 'n' || n_nationkey AS l, 'n' || ((n_nationkey + s) % 25) AS r, s, CASE WHEN s = 1 THEN 'near' ELSE 'far' END AS kind, CASE WHEN s = 1 THEN 0.5::DOUBLE ELSE 0.25 END AS confidence,
 'n' || n_nationkey || '.k = n' || ((n_nationkey + s) % 25) || '.k' || s AS onc, n_nationkey % 2 = 0 AS manual FROM nation, (SELECT unnest([1, 7]) AS s)), w AS (SELECT l AS a, r AS b, onc, kind, confidence FROM e UNION ALL SELECT r, l, onc, kind, confidence FROM e)"""


@query(f"WITH {_NEDGES} SELECT id, l AS left_object, onc AS \"on\" FROM e WHERE manual AND id <> 1")
def list_relationships(spark, sf_dir):
    return relations.listed(relations.deleted(edges(spark, sf_dir), [1]), "manual").select("id", "left_object", "on")


@query(f"""WITH RECURSIVE {_NEDGES}, p AS (SELECT [a, b] AS route, [onc] AS ons, [kind] AS kinds, confidence AS weight, b AS pos FROM w WHERE a = 'n0'
 UNION ALL SELECT list_append(route, w.b), list_append(ons, w.onc), list_append(kinds, w.kind), p.weight * w.confidence, w.b FROM p JOIN w ON p.pos = w.a WHERE p.pos <> 'n9' AND NOT list_contains(route, w.b) AND len(route) <= 4)
 SELECT CAST(len(route) - 1 AS INTEGER) AS hops, array_to_string(route, ' -> ') AS route, array_to_string(kinds, ', ') AS kinds, weight, array_to_string(ons, ' ; ') AS on_clauses, row_number() OVER (ORDER BY len(route), weight DESC, array_to_string(route, ' -> '), array_to_string(ons, ' ; ')) AS rank FROM p WHERE pos = 'n9'""")
def find_join_path(spark, sf_dir):
    return relations.find_join_path(edges(spark, sf_dir), "n0", "n9")


@query(f"WITH {_NEDGES} SELECT a, b, onc AS \"on\", kind, confidence FROM w WHERE a IN ('n3', 'n8')")
def suggest_joins(spark, sf_dir):
    return relations.suggest_joins(edges(spark, sf_dir), ["n3", "n8"])


@query(f"WITH {_NEDGES} SELECT a, b, onc AS \"on\", kind, confidence FROM w WHERE a = 'n3' OR a IN (SELECT b FROM w WHERE a = 'n3')")
def subgraph(spark, sf_dir):
    return relations.subgraph(edges(spark, sf_dir), spark.createDataFrame([("n3",)], "object string"), 2)


@query("SELECT n_nationkey AS n, CASE WHEN n_regionkey = 1 THEN 'inserted' ELSE 'updated' END AS action FROM nation")
def upsert_relationship(spark, sf_dir):
    """Edges of all nations over stored ones, in which those of one region have another column."""
    n = t(spark, sf_dir, "nation")
    rows = lambda column: n.select("n_nationkey", F.lit("a").alias("left_object"), F.array(column).alias("left_columns"), F.lit("b").alias("right_object"), F.array(F.lit("k")).alias("right_columns"), F.lit("key").alias("kind"), F.lit(1.0).alias("confidence")).withColumn("id", F.xxhash64(*relations.IDENTITY))
    new, old = rows(F.col("n_name")), rows(F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit(" of old"))).otherwise(F.col("n_name")))
    _, action = relations.upsert(old.drop("n_nationkey"), new.drop("n_nationkey"))
    return action.join(new.select("id", F.col("n_nationkey").alias("n")), "id").select("n", "action")


@query("SELECT 'r' || n_regionkey AS left_object, 'target' AS right_object, count(*) AS n_columns, string_agg(n_name, ',' ORDER BY n_nationkey) AS columns FROM nation GROUP BY 1")
def crawl_foreign_keys(spark, sf_dir):
    """Nations as the columns of one declared key a region."""
    keys = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("constraint"), F.col("n_nationkey").alias("position"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("left_object"), F.col("n_name").alias("left_column"), F.lit("target").alias("right_object"), F.col("n_name").alias("right_column"))
    return relations.crawl_foreign_keys(keys).select("left_object", "right_object", F.size("left_columns").cast("bigint").alias("n_columns"), F.array_join("left_columns", ",").alias("columns"))


@query("SELECT round(count(*) FILTER (k IS NULL) / count(*), 6) AS blank_share, round(count(*) FILTER (k IS NOT NULL AND k NOT IN (SELECT c_custkey * 2 FROM customer)) / count(*), 6) AS unmatched_share FROM (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS k FROM orders)")
def relationship_shares(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("k"))
    return relations.verify(o, t(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("c_custkey")), "k", "c_custkey").select("blank_share", "unmatched_share")


_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
_VALUES = "u AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT DISTINCT '{x}' AS o, '{c}' AS c, CAST({c} AS BIGINT) AS v FROM {x} WHERE {c} IS NOT NULL" for x, columns in _KEYS.items() for c in columns) + "), n AS (SELECT o, c, count(*) AS k FROM u GROUP BY 1, 2), p AS (SELECT a.o AS lo, a.c AS lc, b.o AS ro, b.c AS rc, count(*) AS m FROM u a JOIN u b ON a.v = b.v AND (a.o, a.c) <> (b.o, b.c) GROUP BY 1, 2, 3, 4)"


def _key_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {name: t(spark, sf_dir, name).select(*columns) for name, columns in _KEYS.items()}


@query(f"WITH {_VALUES} SELECT lo AS left_object, lc AS left_column, ro AS right_object, rc AS right_column, a.k AS left_keys, b.k AS right_keys, m AS matched_keys, round(m / a.k, 6) AS containment FROM p JOIN n a ON a.o = lo AND a.c = lc JOIN n b ON b.o = ro AND b.c = rc")
def column_inclusions(spark, sf_dir):
    """Every pair of key-like columns of the star schema, in one pass."""
    return relations.inclusions(_key_tables(spark, sf_dir))


_COUNTS = "z AS (" + " UNION ALL ".join(f"SELECT '{x}' AS o, count(*) AS n_rows FROM {x}" for x in _KEYS) + ")"


@query(f"WITH {_VALUES}, {_COUNTS} SELECT lo AS left_object, lc AS left_column, ro AS right_object, rc AS right_column, round(m / a.k, 6) AS confidence FROM p JOIN n a ON a.o = lo AND a.c = lc JOIN n b ON b.o = ro AND b.c = rc JOIN z ON z.o = ro WHERE lo <> ro AND b.k = n_rows AND m = a.k")
def candidate_keys(spark, sf_dir):
    """Foreign keys that nothing declares, found by containment in a unique column."""
    found = relations.candidate_keys(_key_tables(spark, sf_dir))
    return found.select("left_object", F.col("left_columns")[0].alias("left_column"), "right_object", F.col("right_columns")[0].alias("right_column"), "confidence")


@query("WITH w AS (SELECT DISTINCT lower(c_name) AS w FROM customer) SELECT a.w AS a, b.w AS b, CAST(levenshtein(a.w, b.w) AS INTEGER) AS edits FROM w a JOIN w b ON a.w < b.w WHERE levenshtein(a.w, b.w) <= 1")
def near_names(spark, sf_dir):
    """Customers' names at one edit from each other."""
    return catalog.near_words(t(spark, sf_dir, "customer").select(F.lower("c_name").alias("w")), "w", 1)


@query("""WITH r AS (SELECT text, min(conv_id || '-' || turn) AS id FROM conversations GROUP BY 1), c AS MATERIALIZED (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS word FROM r) GROUP BY 1, 2),
 t AS (SELECT id, sum(n * n) AS t FROM c GROUP BY 1), d AS (SELECT x.id AS a, y.id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.word = y.word AND x.id < y.id GROUP BY 1, 2)
 SELECT a, b, round(dot::DOUBLE / (sqrt(ta.t::DOUBLE) * sqrt(tb.t::DOUBLE)), 9) AS similarity FROM d JOIN t ta ON ta.id = a JOIN t tb ON tb.id = b WHERE round(dot::DOUBLE / (sqrt(ta.t::DOUBLE) * sqrt(tb.t::DOUBLE)), 9) >= 0.8""")
def similar_texts(spark, sf_dir):
    """Distinct turns whose word counts have a cosine of 0.8 or more."""
    turns = t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return similar.similar_pairs(turns, "id", "text", 0.8)


# --- governed checks ---------------------------------------------------------------------------------------------------


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "select").when(F.col("c_custkey") % 3 == 1, "insert").otherwise("update")
    return t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("object"), kind.alias("privilege")).distinct()


@query("SELECT DISTINCT c_mktsegment AS role, 'nation' || c_nationkey AS object, 'update' AS privilege FROM customer WHERE c_custkey % 3 = 2")
def negative_assertions(spark, sf_dir):
    held = grants(spark, sf_dir)
    must_not = held.select("role", "object").distinct().withColumn("privilege", F.lit("update"))
    return governed.negative_assertions(must_not, held)


@query("SELECT 'alias_of_name' AS view_column, 'c_name' AS denied_column, count(DISTINCT c_name) AS n FROM customer WHERE length(c_name) >= 6")
def leaked_values(spark, sf_dir):
    """A view that renames a denied column is found by its values."""
    c = t(spark, sf_dir, "customer")
    return governed.leaked_values(c.select("c_custkey", F.col("c_name").alias("alias_of_name")), c, ["c_name"])


@query("SELECT n_name, n_regionkey FROM nation")
def purpose_catalog(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    views = governed.PurposeCatalog({"names": governed.safe_projection(n, {"n_name": "n_name", "n_regionkey": "n_regionkey"}), "keys": n}, {"reporting": ["names"], "admin": ["keys"]})
    return views.frame("reporting", "names")


# --- logs --------------------------------------------------------------------------------------------------------------


@query("SELECT user_id AS conversation_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, 'get_metadata' AS tool, 'what is ' || event_type AS asked_for, left('k is ' || json_extract_string(props, '$.k'), 130) AS retrieved FROM events WHERE event_id % 3 = 0 AND event_type <> 'error'")
def grounding_calls(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "error", "query").otherwise("get_metadata")
    log = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "tool_call").otherwise("answer").alias("action_type"), F.to_json(F.struct(tool.alias("tool_name"), F.struct(F.concat(F.lit("what  is "), F.col("event_type")).alias("query_text")).alias("arguments"))).alias("request_payload"), F.to_json(F.struct(F.concat(F.lit("k is "), F.get_json_object("props", "$.k")).alias("contents"))).alias("response_payload"))
    return trace.grounding_calls(log)


def registry_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    params = F.when(F.col("p_partkey") % 3 == 0, "[1, 2]").when(F.col("p_partkey") % 3 == 1, '{"required": ["a"]}')
    return p.select(F.col("p_type").alias("tool_type"), F.concat(F.lit("tool"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") > 25).alias("read_only"), params.alias("params"), F.col("p_name").alias("description"))


@query("SELECT p_type AS tool_type, 'tool' || p_partkey AS name, p_size > 25 AS read_only, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_params, CASE p_partkey % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'object' END AS params_shape, left(p_name, 58) AS description FROM part ORDER BY tool_type, name LIMIT 40")
def tool_registry(spark, sf_dir):
    return trace.tool_registry(registry_tools(spark, sf_dir))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_params, count(*) AS n FROM part GROUP BY 1")
def param_count(spark, sf_dir):
    return registry_tools(spark, sf_dir).groupBy(trace.param_count("params").alias("n_params")).agg(F.count("*").alias("n"))


@query("SELECT s_name AS name, 'model' || s_nationkey AS model, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 4 END AS n_tools, 0 AS n_delegates, s_nationkey AS max_iterations, s_suppkey % 2 = 0 AS structured_output, CASE WHEN s_suppkey % 3 = 0 THEN '(caller)' ELSE 'analyst' END AS runs_as FROM supplier")
def agent_registry(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    tools = F.when(F.col("s_suppkey") % 4 != 0, F.sequence(F.lit(1), (F.col("s_suppkey") % 4).cast("int")))
    return trace.agent_registry(s.select(F.col("s_name").alias("name"), F.concat(F.lit("model"), F.col("s_nationkey").cast("string")).alias("model"), tools.alias("tools"), F.lit(None).cast("array<int>").alias("delegates"), F.col("s_nationkey").alias("max_iterations"), F.when(F.col("s_suppkey") % 2 == 0, "json").alias("output_type"), F.when(F.col("s_suppkey") % 3 != 0, "analyst").alias("role")))


@query("SELECT user_id AS conversation_id, 'agent' || (user_id % 5) AS agent, 'open' AS status, count(*) AS message_count, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id ORDER BY created_at DESC, conversation_id LIMIT 15")
def conversation_list(spark, sf_dir):
    c = t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("conversation_id"), (F.col("user_id") % 5).alias("agent_id")).agg(F.lit("open").alias("status"), F.count("*").alias("message_count"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return trace.conversation_list(c, event_agents(spark, sf_dir))


@query(f"WITH {TASKS} SELECT id AS task_id, 'agent' || agent_id AS agent, role, 'done' AS status, strftime(created_at, '%H:%M:%S.%g') AS created, strftime(completed_at, '%H:%M:%S.%g') AS completed, CASE WHEN role = 'error' THEN 'failed' ELSE '(none)' END AS error FROM tasks ORDER BY created_at DESC, id LIMIT 15")
def task_list(spark, sf_dir):
    tasks = event_tasks(spark, sf_dir).withColumn("status", F.lit("done")).withColumn("error", F.when(F.col("role") == "error", "failed"))
    return trace.task_list(tasks, event_agents(spark, sf_dir))


@query(f"WITH {LOG} SELECT id, action_type, sequence_id = 'error' AS in_flight FROM elog")
def live_trace(spark, sf_dir):
    """All actions are queued, and all but errors are in the log, which counts for those."""
    log = event_log(spark, sf_dir)
    return trace.live_trace(log, log.where("sequence_id <> 'error'")).select("id", "action_type", "in_flight")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    app = F.when(F.col("event_id") % 3 == 0, "spark").otherwise(F.concat(F.lit("spark:"), F.col("event_type")))
    return e.select(F.col("event_id").alias("pid"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("usename"), app.alias("application_name"), F.when(F.col("value") > 10, "active").otherwise("idle").alias("state"), F.col("ts").alias("backend_start"))


@query("SELECT 'u' || (user_id % 4) AS usename, CASE WHEN event_id % 3 = 0 THEN 'spark' ELSE 'spark:' || event_type END AS application_name, CASE WHEN value > 10 THEN 'active' ELSE 'idle' END AS state, count(*) AS n FROM events GROUP BY 1, 2, 3")
def session_counts(spark, sf_dir):
    return trace.session_counts(sessions(spark, sf_dir))


@query("SELECT 'spark' AS runtime, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS purpose, count(*) AS n, true AS aged FROM events GROUP BY 1, 2")
def session_purpose(spark, sf_dir):
    return trace.session_purpose(sessions(spark, sf_dir)).groupBy("runtime", "purpose").agg(F.count("*").alias("n"), F.bool_and(F.col("age_s") > 0).alias("aged"))


@query("SELECT event_type || '-' || (user_id % 3) AS test, count(DISTINCT event_id % 2) AS has, count(DISTINCT CAST(value > 0 AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN CAST(event_id % 2 AS VARCHAR) ELSE '' END) AS definitions FROM events GROUP BY event_type, user_id % 3 HAVING count(DISTINCT event_id % 2) < 2 OR count(DISTINCT CAST(value > 0 AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN CAST(event_id % 2 AS VARCHAR) ELSE '' END) > 1")
def arms_comparable(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    arm = (F.col("event_id") % 2).cast("string")
    return scoring.arms_comparable(e.select(arm.alias("arm"), F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")).alias("test"), F.concat((F.col("value") > 0).cast("string"), F.when(F.col("user_id") % 3 == 0, arm).otherwise("")).alias("definition")))


@query("SELECT event_type, round(avg(CASE WHEN event_id % 2 = 0 THEN (user_id % 3) / 2.0 END)::DOUBLE - avg(CASE WHEN event_id % 2 = 1 THEN (user_id % 3) / 2.0 END)::DOUBLE, 6) AS delta FROM events GROUP BY 1")
def arm_delta_by_model(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 2 == 0, "full").otherwise("plain").alias("arm"), ((F.col("user_id") % 3) / 2).alias("score"))
    return scoring.arm_delta(e, "full", "plain", ["event_type"])


# --- landing -----------------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    return store.new_folder(spark, "landing")


def _delimited(spark, sf_dir, invalid: bool = False) -> str:
    """Orders as tab-separated text with CRs, blank lines and quotes; ``invalid``: every eleventh ends with a byte that is no UTF-8."""
    path = scratch(spark)
    line = F.concat_ws("\t", "o_orderkey", "ymd", F.concat(F.lit('"'), F.col("num"), F.lit('" ')), F.coalesce("flag", F.lit("")))
    if invalid:
        line = F.concat(line.cast("binary"), F.when(F.col("o_orderkey") % 11 == 0, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit("")))).cast("string")
    rows = order_texts(spark, sf_dir).select(F.explode(F.when(F.col("o_orderkey") % 9 == 0, F.array(F.concat(line, F.lit("\r")), F.lit("  \r"))).otherwise(F.array(line))).alias("value"))
    rows.write.text(path)
    return path


@query(f"WITH {ORDER_TEXTS} SELECT CAST(o_orderkey AS VARCHAR) AS a, ymd AS b, '\"' || num || '\" ' AS c, coalesce(flag, '') AS d FROM ot")
def land_delimited(spark, sf_dir):
    return landing.land_delimited(spark, [_delimited(spark, sf_dir)], T.StructType([T.StructField(n, T.StringType()) for n in "abcd"]))


@query("SELECT count(*) + count(*) FILTER (o_orderkey % 9 = 0) AS lines, count(*) FILTER (o_orderkey % 9 = 0) AS blank_lines, count(*) FILTER (o_orderkey % 11 = 0) AS fallback_lines FROM orders")
def line_report(spark, sf_dir):
    r = landing.line_report(landing.read_lines(spark, [_delimited(spark, sf_dir, True)]))
    return r.agg(*[F.sum(c).alias(c) for c in ("lines", "blank_lines", "fallback_lines")])


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') AS text FROM documents WHERE text IS NOT NULL")
def decode_fallback(spark, sf_dir):
    """Texts as latin-1 bytes, which are mostly no UTF-8."""
    raw = F.encode("text", "ISO-8859-1").cast("string")
    return t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", landing.decode_fallback(raw)[0].alias("text"))


@query("SELECT 'safety' AS purpose, p_type AS title, count(*)::VARCHAR AS findings FROM part GROUP BY p_type")
def append_report(spark, sf_dir):
    path = scratch(spark)
    rows = t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("title")).agg(F.count("*").cast("string").alias("findings")).withColumn("purpose", F.lit("safety"))
    landing.append_report(rows, path, ["safety"])
    return spark.read.parquet(path).where("written_by IS NOT NULL AND written_at IS NOT NULL").select("purpose", "title", "findings")


@query("SELECT count(*) AS n_rows, count(DISTINCT (o_orderkey, o_custkey)) AS n_ids FROM orders")
def with_identity(spark, sf_dir):
    return landing.with_identity(t(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]).agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def overwrite_table(spark, sf_dir):
    """Written twice, partitioned and sorted; read once."""
    path, rows = scratch(spark), t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    for _ in range(2):
        landing.overwrite_table(rows, path, ["l_returnflag"], ["l_orderkey"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"))
