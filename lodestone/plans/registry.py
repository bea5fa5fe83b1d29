"""All queries of the library by name over the driver's tables, with their DuckDB SQL.

The star schema stands in for the complaint files: ``p_type`` is a component,
``p_brand`` a make, the order's year a model year, ``l_returnflag = 'R'`` fire,
``l_linestatus = 'O'`` crash. Dates become yyyyMMdd text, blank at a fixed modulus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, lexical, stemmer, vectors
from ..operators import catalog, governed, joins, relations, rollups, scoring, search, trace
from ..sources import landing
from . import lexical_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    ymd = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", "o_custkey", ymd.alias("ymd"), F.when(F.col("o_orderkey") % 5 == 0, "9999").otherwise(F.date_format("o_orderdate", "yyyy")).alias("yr"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" -3 ")).otherwise(F.col("o_custkey").cast("string")).alias("num"), F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "N").alias("flag"))


ORDER_TEXTS = """ot AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS ymd,
 CASE WHEN o_orderkey % 5 = 0 THEN '9999' ELSE strftime(o_orderdate, '%Y') END AS yr,
 CASE WHEN o_orderkey % 3 = 0 THEN ' -3 ' ELSE CAST(o_custkey AS VARCHAR) END AS num,
 CASE WHEN o_orderstatus = 'F' THEN 'Y' WHEN o_orderstatus = 'O' THEN 'N' END AS flag FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, o = (t(spark, sf_dir, x) for x in ("lineitem", "part", "orders"))  # noqa: E741
    j = l.join(p, l.l_partkey == p.p_partkey).join(o, l.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", F.col("p_brand").alias("make"), F.col("p_type").alias("component"), F.date_format("o_orderdate", "yyyy").alias("yr"), F.date_format("l_shipdate", "yyyyMMdd").alias("faildate"), (F.col("l_returnflag") == "R").alias("fire"), (F.col("l_linestatus") == "O").alias("crash"), F.col("l_quantity").cast("long").cast("string").alias("injured"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linenumber").cast("string")).alias("deaths"))


FACTS = """facts AS (SELECT l_orderkey, l_linenumber, p_brand AS make, p_type AS component, strftime(o_orderdate, '%Y') AS yr, strftime(l_shipdate, '%Y%m%d') AS faildate,
 l_returnflag = 'R' AS fire, l_linestatus = 'O' AS crash, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS injured, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS deaths
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {ORDER_TEXTS} SELECT o_orderkey, nullif(trim(ymd), '') AS ymd_or_null, nullif(yr, '9999') AS model_year, CASE WHEN regexp_matches(num, '^[0-9]+$') THEN CAST(num AS BIGINT) ELSE 0 END AS num,
 CAST(try_strptime(nullif(ymd, ''), '%Y%m%d') AS DATE) AS on_date, regexp_matches(ymd, '^[0-9]{{8}}$') AS valid, ymd BETWEEN '19950101' AND '19961231' AND regexp_matches(ymd, '^[0-9]{{8}}$') AS in_period, flag = 'Y' AS flagged, coalesce(flag, 'N') <> 'Y' AS not_flagged FROM ot""")
def clean_columns(spark, sf_dir):
    c = order_texts(spark, sf_dir)
    return c.select("o_orderkey", clean.blank_to_null("ymd").alias("ymd_or_null"), clean.sentinel_to_null("yr").alias("model_year"), clean.digits_or("num").alias("num"), clean.ymd_to_date("ymd").alias("on_date"), clean.ymd_valid("ymd").alias("valid"), clean.ymd_between("ymd", "19950101", "19961231").alias("in_period"), clean.flag_true("flag").alias("flagged"), clean.not_flagged("flag").alias("not_flagged"))


@query(r"""SELECT doc_id, length(coalesce(text, '')) AS n_text, left(regexp_replace(text, '\s+', ' ', 'g'), 60) AS beginning FROM documents""")
def excerpts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", clean.text_length("text").alias("n_text"), clean.excerpt("text", 60).alias("beginning"))


@query(f"""WITH {ORDER_TEXTS} SELECT o_orderkey, ymd FROM (SELECT *, row_number() OVER (ORDER BY ymd DESC, o_orderkey) AS r FROM ot WHERE regexp_matches(ymd, '^[0-9]{{8}}$')) WHERE r <= 1000""")
def most_recent_orders(spark, sf_dir):
    return landing.most_recent_n(order_texts(spark, sf_dir).select("o_orderkey", "ymd"), "ymd", 1000, ["o_orderkey"])


@query(f"""WITH {ORDER_TEXTS} SELECT 'orders' AS table_name, count(*) AS n_rows, min(nullif(ymd, '')) AS first_date, max(nullif(ymd, '')) AS last_date FROM ot
 UNION ALL SELECT 'lineitem', count(*), min(strftime(l_shipdate, '%Y%m%d')), max(strftime(l_shipdate, '%Y%m%d')) FROM lineitem""")
def load_summary(spark, sf_dir):
    return landing.load_summary({"orders": (order_texts(spark, sf_dir), "ymd"), "lineitem": (t(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyyMMdd").alias("d")), "d")})


@query(f"WITH {FACTS} SELECT component, count(*) AS n FROM facts WHERE yr = '1996' AND nullif(trim(component), '') IS NOT NULL GROUP BY 1 ORDER BY n DESC, component LIMIT 25")
def complaints_by_component_year(spark, sf_dir):
    return rollups.complaints_by_component_year(facts(spark, sf_dir), "component", "yr", "1996")


@query(f"""WITH {FACTS} SELECT make, count(*) AS n, count(*) FILTER (fire) AS fires, count(*) FILTER (crash) AS crashes FROM facts
 WHERE regexp_matches(faildate, '^[0-9]{{8}}$') AND substring(faildate, 1, 4) >= '1995' GROUP BY 1 HAVING count(*) FILTER (fire) > 0 ORDER BY fires DESC, n DESC, make LIMIT 25""")
def fire_crash_by_make(spark, sf_dir):
    return rollups.fire_crash_by_make(facts(spark, sf_dir), "make", "faildate", F.col("fire"), F.col("crash"), "1995")


@query(f"""WITH {FACTS}, m AS (SELECT min(upper(make)) AS m FROM facts) SELECT component, count(*) AS n, sum(CASE WHEN regexp_matches(deaths, '^[0-9]+$') THEN CAST(deaths AS BIGINT) ELSE 0 END)::BIGINT AS deaths, sum(CAST(injured AS BIGINT))::BIGINT AS injured
 FROM facts, m WHERE upper(make) = m GROUP BY 1 ORDER BY deaths DESC, injured DESC, n DESC, component LIMIT 25""")
def harm_components(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("make", F.upper("make"))
    make = t(spark, sf_dir, "part").agg(F.min(F.upper("p_brand"))).first()[0]
    return rollups.harm_components(f, "make", make, "component", "deaths", "injured")


@query(f"WITH {FACTS} SELECT component, yr, count(*) AS n, count(*) FILTER (fire) AS fires, count(*) FILTER (crash) AS crashes, sum(CAST(injured AS BIGINT))::BIGINT AS injured FROM facts GROUP BY 1, 2")
def by_component_year(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("component", "yr").agg(F.count("*").alias("n"), F.count_if("fire").alias("fires"), F.count_if("crash").alias("crashes"), F.sum(clean.digits_or("injured")).alias("injured"))


@query(f"WITH {FACTS} SELECT make, yr, count(*) AS n, min(CAST(strptime(faildate, '%Y%m%d') AS DATE)) AS first_failure, max(CAST(strptime(faildate, '%Y%m%d') AS DATE)) AS last_failure FROM facts GROUP BY 1, 2")
def by_make_year(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("make", "yr").agg(F.count("*").alias("n"), F.min(clean.ymd_to_date("faildate")).alias("first_failure"), F.max(clean.ymd_to_date("faildate")).alias("last_failure"))


@query(f"WITH {FACTS} SELECT make, yr, component, count(*) AS n, count(*) FILTER (fire) AS fires, round(100.0::DOUBLE * count(*) FILTER (fire) / count(*), 2) AS fire_rate_pct FROM facts GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def kpi_k_anon(spark, sf_dir):
    return rollups.kpi_k_anon(facts(spark, sf_dir), ["make", "yr", "component"], F.col("fire"))


@query(f"WITH {ORDER_TEXTS} SELECT count(*) FILTER (ymd BETWEEN '19960101' AND '19961231') AS ymd_in_period, count(*) FILTER (nullif(ymd, '') IS NULL) AS ymd_blank, count(*) FILTER (yr BETWEEN '19960101' AND '19961231') AS yr_in_period, count(*) FILTER (nullif(yr, '') IS NULL) AS yr_blank FROM ot")
def counts_by_each_date(spark, sf_dir):
    return rollups.counts_by_each_date(order_texts(spark, sf_dir), ["ymd", "yr"], "19960101", "19961231")


@query("SELECT 'l_orderkey' AS candidate, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) = count(DISTINCT l_orderkey) AS is_key FROM lineitem UNION ALL SELECT 'l_orderkey+l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem")
def detect_grain(spark, sf_dir):
    return rollups.detect_grain(t(spark, sf_dir, "lineitem"), [["l_orderkey"], ["l_orderkey", "l_linenumber"]])


@query(f"WITH {ORDER_TEXTS} SELECT 'ymd' AS column_name, count(*) AS n_rows, count(*) FILTER (ymd = '') AS n_blank FROM ot UNION ALL SELECT 'flag', count(*), count(*) FILTER (flag IS NULL) FROM ot")
def completeness(spark, sf_dir):
    return rollups.completeness(order_texts(spark, sf_dir), ["ymd", "flag"])


@query(f"WITH {ORDER_TEXTS}, n AS (SELECT *, CASE WHEN regexp_matches(num, '^[0-9]+$') THEN CAST(num AS BIGINT) END AS v FROM ot) SELECT min(v) AS num_min, max(v) AS num_max, round(avg(v), 6) AS num_mean, count(DISTINCT num) AS num_distinct, count(*) FILTER (nullif(trim(num), '') IS NULL) AS num_blank FROM n")
def profile_numeric(spark, sf_dir):
    return rollups.profile_numeric(order_texts(spark, sf_dir), ["num"])


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_values(spark, sf_dir):
    return rollups.top_values(t(spark, sf_dir, "events"), "event_type")


@query(f"WITH {ORDER_TEXTS} SELECT ymd, count(*) AS n FROM ot WHERE regexp_matches(ymd, '^[0-9]{{8}}$') GROUP BY 1")
def date_histogram(spark, sf_dir):
    return rollups.date_histogram(order_texts(spark, sf_dir), "ymd")


@query(f"WITH {ORDER_TEXTS} SELECT c_mktsegment, count(*) AS n FROM ot JOIN customer ON nullif(trim(num), '') = CAST(c_custkey AS VARCHAR) GROUP BY 1")
def join_nonblank(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    return joins.join_nonblank(order_texts(spark, sf_dir), c, [("num", "k")]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, o AS (SELECT DISTINCT make, component, yr FROM facts WHERE fire), c AS (SELECT make, component, yr FROM facts WHERE crash) SELECT count(DISTINCT c.make) AS makes, count(*) AS n FROM c JOIN o USING (make, component, yr)")
def join_vehicle_component(spark, sf_dir):
    f = facts(spark, sf_dir)
    keys = ["make", "component", "yr"]
    return f.where("crash").select(*keys).join(f.where("fire").select(*keys).distinct(), keys).agg(F.count_distinct("make").alias("makes"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate, count(l_orderkey) AS n_complaints, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 30 DAY) AS n_after, sum(CAST(l_quantity AS BIGINT))::BIGINT AS sum_l_quantity FROM (SELECT * FROM orders WHERE o_orderkey % 4 < 3) LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber > 1 GROUP BY 1, 2")
def recall_to_complaint_link(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderkey % 4 < 3").select(F.col("o_orderkey").alias("k"), "o_orderdate", F.expr("o_orderdate + interval 30 days").alias("notified"))
    l = t(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("k"), "l_shipdate", F.col("l_quantity").cast("long").alias("l_quantity"))  # noqa: E741
    return joins.recall_link(o, l, ["k"], "notified", "l_shipdate", ["l_quantity"]).select(F.col("k").alias("o_orderkey"), "o_orderdate", "n_complaints", "n_after", "sum_l_quantity")


@query("SELECT o_orderkey, o_orderdate, count(l_orderkey) AS n_complaints, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 30 DAY) AS n_after, sum(CAST(l_quantity AS BIGINT))::BIGINT AS sum_l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def recall_to_complaint_link_whole(spark, sf_dir):
    """Every recall and every complaint; ``recall_to_complaint_link`` reads the part that its SQL names."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", F.expr("o_orderdate + interval 30 days").alias("notified"))
    l = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate", F.col("l_quantity").cast("long").alias("l_quantity"))  # noqa: E741
    return joins.recall_link(o, l, ["k"], "notified", "l_shipdate", ["l_quantity"]).select(F.col("k").alias("o_orderkey"), "o_orderdate", "n_complaints", "n_after", "sum_l_quantity")


_SANITY = "a AS (SELECT o_custkey AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS r FROM customer GROUP BY 1), j AS (SELECT * FROM a FULL JOIN b USING (k))"


@query(f"WITH {_SANITY} SELECT sum(l)::BIGINT AS left_rows, sum(r)::BIGINT AS right_rows, count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS matched_keys, sum(l * r)::BIGINT AS joined_rows, max(l) AS left_fan_out, max(r) AS right_fan_out FROM j")
def join_sanity(spark, sf_dir):
    return joins.join_sanity(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), "o_custkey", "c_custkey").drop("left_matched")


@query(f"WITH {_SANITY}, s AS (SELECT count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS matched_keys FROM j) SELECT *, round(matched_keys / left_keys, 6) AS left_contained, round(matched_keys / right_keys, 6) AS right_contained FROM s")
def key_overlap(spark, sf_dir):
    return joins.key_overlap(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


@query("SELECT CASE WHEN max(l) > 1 THEN 'n' ELSE '1' END || '-' || CASE WHEN max(r) > 1 THEN 'n' ELSE '1' END AS cardinality, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS matched_keys, count(l) AS left_keys, count(r) AS right_keys, sum(l * r)::BIGINT AS joined_rows FROM (WITH " + _SANITY + " SELECT * FROM j)")
def verify_relationship(spark, sf_dir):
    return relations.verify(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), "o_custkey", "c_custkey").drop("blank_share", "unmatched_share")


@query("SELECT conv_id, role, round, first_turn FROM (SELECT conv_id, role, min(turn) AS first_turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn), role) AS round FROM conversations GROUP BY 1, 2)")
def sequence_rank(spark, sf_dir):
    return trace.sequence_rank(t(spark, sf_dir, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "round", F.col("first_at").alias("first_turn"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS at_seconds FROM events")
def steps_by_user(spark, sf_dir):
    return trace.elapsed_steps(t(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def newest_per_user(spark, sf_dir):
    return rollups.newest_per_key(t(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("SELECT event_type AS action, count(*) AS n, round(avg(CAST(user_id % 7 AS DOUBLE)) * 1000, 3) AS avg_ms, round(sum(CAST(user_id % 7 AS DOUBLE)), 3) AS total_s, repeat('#', CAST(least(count(*), 40) AS INTEGER)) AS bar FROM events GROUP BY 1")
def action_histogram(spark, sf_dir):
    log = t(spark, sf_dir, "events").select("event_type", F.col("ts").alias("created_at"), F.expr("ts + make_interval(0,0,0,0,0,0,user_id % 7)").alias("completed_at"))
    return trace.action_histogram(log, F.col("event_type"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def json_counts(spark, sf_dir):
    return rollups.counts_by_json(t(spark, sf_dir, "events"), "props", "$.k", ["event_type"])


@query("WITH b AS (SELECT conv_id, role, count(*) AS n, count(*) FILTER (length(text) > 100) AS long FROM conversations GROUP BY 1, 2) SELECT role, count(*) AS tasks, round(avg(n), 6) AS avg_actions, round(avg(long), 6) AS avg_tool_calls FROM b GROUP BY 1")
def compare_agents(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumn("task_id", F.concat_ws(":", "conv_id", "role"))
    log = c.select("task_id", F.when(F.length("text") > 100, "tool_call").otherwise("answer").alias("action_type"))
    tasks = c.select(F.col("task_id").alias("id"), F.col("role").alias("agent_id")).distinct()
    return trace.compare_agents(log, tasks).withColumnRenamed("agent_id", "role")


@query("SELECT conv_id, turn, role, left(regexp_replace(text, '\\s+', ' ', 'g'), 80) AS text FROM conversations WHERE role IN ('user', 'assistant')")
def transcript(spark, sf_dir):
    return trace.transcript(t(spark, sf_dir, "conversations"), "role", ("user", "assistant"), "text", ["conv_id", "turn"], 80)


@query("SELECT DISTINCT 'customer' AS src, c_nationkey AS nationkey FROM customer UNION ALL SELECT DISTINCT 'supplier', s_nationkey FROM supplier")
def actors_union(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_nationkey").alias("nationkey"))
    s = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.col("s_nationkey").alias("nationkey"))
    return trace.actors_union(c, s, ["src", "nationkey"])


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT vec_id, {_COS} AS s FROM embeddings WHERE label <> 3)) WHERE rank <= 50")
def knn_cosine(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    return search.knn_cosine(e, "embedding", query_vector(spark, sf_dir), 50, "vec_id", F.col("label") != 3).withColumn("similarity", F.round("similarity", 6))


#: A web query over words that the invented prose has.
WEB_QUERY = lexical.parse_web_query("thention OR ershan OR theing ereding -worthless")
_LX = " lx AS (SELECT doc_id, CAST(round(score, 6) AS DOUBLE) AS lexical_score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS lexical_rank FROM m WHERE lang = 'en' QUALIFY lexical_rank <= 300)"
_LEX = lexical_sql.covers(WEB_QUERY) + ",\n" + _LX


@query(f"WITH {_LEX} SELECT doc_id, lexical_score, lexical_rank AS rank FROM lx WHERE lexical_rank <= 20")
def lexical_only(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return search.lexical_search(d, lexical.candidates("text", WEB_QUERY), WEB_QUERY, 20, "doc_id", F.col("lang") == "en")


#: Three words in one place, two phrases, and what must be absent.
PHRASE_QUERY = lexical.parse_web_query('theing ereding OR "anea eriner" OR "ereden ereden" thanea OR "onre of enat" OR rerendsh stanin orantion -worthlessly')


@query(f"WITH {lexical_sql.covers(PHRASE_QUERY)} SELECT doc_id, round(score, 6) AS score FROM m")
def cover_density(spark, sf_dir):
    """Every document that satisfies the query, by its minimal covers."""
    found = search.matched(t(spark, sf_dir, "documents"), lexical.candidates("text", PHRASE_QUERY), PHRASE_QUERY, "doc_id")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {lexical_sql.TOKENS} SELECT word, lexeme FROM stems")
def word_stems(spark, sf_dir):
    """The stem of every distinct word of the documents."""
    words = t(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(lexical.WORD))).alias("word"))
    return stemmer.stems(words.where(~F.col("word").isin(lexical.STOP_WORDS)))


@query(f"WITH {lexical_sql.TOKENS} SELECT lexeme, count(DISTINCT doc_id) AS n_documents, count(*) AS n, min(pos) AS first_pos FROM toks JOIN stems USING (word) GROUP BY 1")
def postings(spark, sf_dir):
    """Documents and occurrences of every lexeme, from the positional postings."""
    p = lexical.postings(t(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("lexeme").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


def _documents_with_vectors(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return t(spark, sf_dir, "documents").join(e, "doc_id", "left")


_VEC = f"vx AS (SELECT vec_id AS doc_id, {_COS} AS s, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS vector_rank FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en' QUALIFY vector_rank <= 300)"


@query(f"""WITH {_LEX}, {_VEC}, f AS (SELECT coalesce(lx.doc_id, vx.doc_id) AS doc_id, round(s, 6) AS similarity, vector_rank, lexical_score, lexical_rank,
 round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 8) AS rrf_score FROM lx FULL JOIN vx ON lx.doc_id = vx.doc_id)
 SELECT f.*, source FROM f JOIN documents USING (doc_id) ORDER BY rrf_score DESC, doc_id LIMIT 20""")
def hybrid_search(spark, sf_dir):
    d = _documents_with_vectors(spark, sf_dir)
    found = search.hybrid_search(d, "embedding", query_vector(spark, sf_dir), lexical.candidates("text", WEB_QUERY), WEB_QUERY, "doc_id", F.col("lang") == "en", show=["source"], base=t(spark, sf_dir, "documents"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_LEX} SELECT doc_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT vec_id AS doc_id, {_COS} AS s FROM embeddings JOIN documents ON doc_id = vec_id WHERE doc_id NOT IN (SELECT doc_id FROM m)) ORDER BY s DESC, doc_id LIMIT 10")
def semantic_only(spark, sf_dir):
    d = _documents_with_vectors(spark, sf_dir)
    return search.semantic_only(d, "embedding", query_vector(spark, sf_dir), lexical.candidates("text", WEB_QUERY), WEB_QUERY, "doc_id").withColumn("similarity", F.round("similarity", 6))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches' queries: every row whose id is divisible by 50."""
    return t(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_ALL = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_QUERIES = "q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0)"
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id)"


@query(f"WITH {_QUERIES}, c AS (SELECT query_id, vec_id, {_ALL} AS s FROM embeddings e, q) SELECT query_id, vec_id, round(s, 6) AS similarity, {_BEST} AS rank FROM c QUALIFY rank <= 50")
def knn_cosine_every(spark, sf_dir):
    found = search.knn_every(t(spark, sf_dir, "embeddings"), "embedding", query_vectors(spark, sf_dir), 50, "vec_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_LEX}, {_QUERIES}, c AS (SELECT query_id, vec_id, {_ALL} AS s FROM embeddings e JOIN documents ON doc_id = vec_id, q WHERE doc_id NOT IN (SELECT doc_id FROM m)) SELECT query_id, vec_id AS doc_id, round(s, 6) AS similarity, {_BEST} AS rank FROM c QUALIFY rank <= 10")
def semantic_only_every(spark, sf_dir):
    matched = search.matched(t(spark, sf_dir, "documents"), lexical.candidates("text", WEB_QUERY), WEB_QUERY, "doc_id")
    others = _documents_with_vectors(spark, sf_dir).select("doc_id", "embedding").join(matched, "doc_id", "left_anti")
    found = search.knn_every(others, "embedding", query_vectors(spark, sf_dir), 10, "doc_id")
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_LEX}, {_QUERIES}, c AS (SELECT query_id, vec_id, {_ALL} AS s FROM embeddings e JOIN documents ON doc_id = vec_id, q WHERE lang = 'en'), vx AS (SELECT query_id, vec_id AS doc_id, s, {_BEST} AS vector_rank FROM c QUALIFY vector_rank <= 300),
 lq AS (SELECT query_id, lx.* FROM lx, q), f AS (SELECT query_id, doc_id, round(s, 6) AS similarity, vector_rank, lexical_score, lexical_rank,
 round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 8) AS rrf_score FROM lq FULL JOIN vx USING (query_id, doc_id))
 SELECT f.*, source, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, doc_id) AS rank FROM f JOIN documents USING (doc_id) QUALIFY rank <= 20""")
def hybrid_search_every(spark, sf_dir):
    d = _documents_with_vectors(spark, sf_dir)
    found = search.hybrid_every(d, "embedding", query_vectors(spark, sf_dir), lexical.candidates("text", WEB_QUERY), WEB_QUERY, "doc_id", F.col("lang") == "en", show=["source"], base=t(spark, sf_dir, "documents"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def knn_approx(spark, sf_dir):
    return search.knn_approx(t(spark, sf_dir, "embeddings"), "embedding", query_vectors(spark, sf_dir), 20, "vec_id", reports.scratch(spark))


@query()
def embed_documents(spark, sf_dir):
    d = vectors.embed_batch(t(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return vectors.check_dimension(d, "vec", 128).select("doc_id", "vec")


@query("SELECT count(*) AS total, count(embedding) AS embedded, count(*) - count(embedding) AS missing FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def embedding_coverage(spark, sf_dir):
    return _documents_with_vectors(spark, sf_dir).agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("missing"))


@query()
def catalogue_search(spark, sf_dir):
    """Documents as catalogue entries, their source as the comment."""
    model = vectors.HashingEmbedder()
    rows = t(spark, sf_dir, "documents").select(F.lit("schema").alias("source_type"), F.lit("column").alias("entity_type"), F.col("source").alias("relation_name"), F.col("lang").alias("column_name"), F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("object_ref"), F.col("text").alias("definition"), F.concat_ws(" ", "source", "lang").alias("comment"))
    return catalog.search(catalog.embed_catalog(rows, model), "thention ershan theing", model)


_EDGES = [("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_partkey"], "part", ["p_partkey"]), ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("supplier", ["s_nationkey"], "nation", ["n_nationkey"])]


def measured_edges(spark, sf_dir) -> DataFrame:
    """Edges whose confidence is the share of left keys that the data finds on the right."""
    parts = None
    for left, lc, right, rc in _EDGES:
        overlap = joins.key_overlap(t(spark, sf_dir, left), t(spark, sf_dir, right), lc[0], rc[0])
        row = overlap.select(F.xxhash64(F.lit(left), F.lit(lc[0]), F.lit(right)).alias("id"), F.lit(left).alias("left_object"), F.array(F.lit(lc[0])).alias("left_columns"), F.lit(right).alias("right_object"), F.array(F.lit(rc[0])).alias("right_columns"), F.lit("key").alias("kind"), F.col("left_contained").alias("confidence"))
        parts = row if parts is None else parts.unionByName(row)
    return spark.createDataFrame(parts.collect(), parts.schema)  # a row an edge, counted once and not at every hop


def _contained(left: str, lc: str, right: str, rc: str) -> str:
    return f"SELECT '{left}' AS l, '{right}' AS r, round((SELECT count(DISTINCT {lc}) FROM {left} WHERE {lc} IN (SELECT {rc} FROM {right})) / (SELECT count(DISTINCT {lc}) FROM {left}), 6) AS c"


_MEASURED = "e AS (" + " UNION ALL ".join(_contained(left, lc[0], right, rc[0]) for left, lc, right, rc in _EDGES) + "), w AS (SELECT l AS a, r AS b, c FROM e UNION ALL SELECT r, l, c FROM e)"


@query(f"""WITH RECURSIVE {_MEASURED}, p AS (SELECT [a, b] AS route, c AS weight, b AS pos FROM w WHERE a = 'part'
 UNION ALL SELECT list_append(route, b), weight * c, b FROM p JOIN w ON pos = a WHERE pos <> 'nation' AND NOT list_contains(route, b) AND len(route) <= 4)
 SELECT CAST(len(route) - 1 AS INTEGER) AS hops, array_to_string(route, ' -> ') AS route, round(weight, 6) AS weight FROM p WHERE pos = 'nation'""")
def join_paths(spark, sf_dir):
    return relations.find_join_path(measured_edges(spark, sf_dir), "part", "nation").select("hops", "route", F.round("weight", 6).alias("weight"))


@query("""WITH s AS (SELECT arm, CASE WHEN NOT valid THEN 0.0 WHEN v = 'Yes' THEN 1.0 WHEN v = 'Maybe' THEN 0.5 ELSE 0.0 END AS score FROM
 (SELECT CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'plain' END AS arm, CASE WHEN user_id % 3 = 0 THEN 'Yes' WHEN user_id % 3 = 1 THEN 'Maybe' ELSE 'No' END AS v, event_id % 11 > 0 AS valid FROM events))
 SELECT round(CAST(avg(CAST(score AS DOUBLE)) FILTER (arm = 'full') - avg(CAST(score AS DOUBLE)) FILTER (arm = 'plain') AS DOUBLE), 6) AS delta FROM s""")
def arm_delta(spark, sf_dir):
    v = t(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "full").otherwise("plain").alias("arm"), F.when(F.col("user_id") % 3 == 0, "Yes").when(F.col("user_id") % 3 == 1, "Maybe").otherwise("No").alias("verdict"), (F.col("event_id") % 11 > 0).alias("valid"), F.lit(False).alias("error"))
    return scoring.arm_delta(scoring.verdict_score(v), "full", "plain")


@query(r"SELECT conv_id AS conversation_id, 'words' AS test, bool_or(regexp_matches(lower(text), '\bthe\b')) AND NOT bool_or(regexp_matches(lower(text), '\bidiot\b')) AS passed FROM conversations GROUP BY 1")
def column_choice(spark, sf_dir):
    s = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.coalesce("text", F.lit("")).alias("statement"))
    rules = spark.createDataFrame([("words", "the", True), ("words", "idiot", False)], "test string, word string, required boolean")
    return scoring.column_choice(s, rules)


@query("SELECT c_mktsegment AS segment, c_nationkey AS nation, round(c_acctbal, 0) AS balance FROM customer")
def safe_projection(spark, sf_dir):
    return governed.safe_projection(t(spark, sf_dir, "customer"), {"segment": "c_mktsegment", "nation": "c_nationkey", "balance": F.round("c_acctbal", 0)})


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an action log: a user is a conversation, an event type a sequence, k of the payload a tool."""
    tool = F.concat(F.lit("tool"), F.get_json_object("props", "$.k"))
    action = F.when(F.col("event_id") % 3 == 0, "tool_call").when(F.col("event_id") % 3 == 1, "answer").otherwise("model_request")
    request = F.to_json(F.struct(tool.alias("tool_name"), F.struct(F.concat(F.lit("SELECT "), F.col("event_id").cast("string")).alias("query")).alias("arguments")))
    response = F.to_json(F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("answer"), (F.col("event_id") % 4 / 4).alias("confidence")))
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws("-", "user_id", "event_type").alias("task_id"), F.col("user_id").alias("conversation_id"), F.col("event_type").alias("sequence_id"), action.alias("action_type"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), request.alias("request_payload"), response.alias("response_payload"), F.col("ts").alias("created_at"), F.expr("ts + make_interval(0,0,0,0,0,0,event_id % 5)").alias("completed_at"))


LOG = """elog AS (SELECT event_id AS id, user_id || '-' || event_type AS task_id, user_id AS conversation_id, event_type AS sequence_id,
 CASE event_id % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'answer' ELSE 'model_request' END AS action_type, 'tool' || json_extract_string(props, '$.k') AS tool,
 ts AS created_at, event_id % 5 AS s FROM events)"""


@query(f"""WITH {LOG}, r AS (SELECT conversation_id, sequence_id, dense_rank() OVER (PARTITION BY conversation_id ORDER BY min(created_at), sequence_id) AS round FROM elog GROUP BY 1, 2)
 SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS step, round, task_id, action_type, tool, s * 1000.0::DOUBLE AS ms, status,
 CASE action_type WHEN 'tool_call' THEN '{{"query":"SELECT ' || id || '"}}' ELSE '{{"answer":"a' || id || '","confidence":' || CAST((id % 4) / 4.0::DOUBLE AS VARCHAR) || '}}' END AS text FROM (SELECT *, 'done' AS status FROM elog) JOIN r USING (conversation_id, sequence_id)""")
def full_trace(spark, sf_dir):
    return trace.full_trace(event_log(spark, sf_dir))


def event_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each user and event type; its agent is the user's remainder by 5."""
    by_task = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("created_at"), F.max("ts").alias("completed_at"), F.count("*").alias("budget_consumed"))
    return by_task.select(F.concat_ws("-", "user_id", "event_type").alias("id"), (F.col("user_id") % 5).alias("agent_id"), F.col("event_type").alias("role"), "created_at", "completed_at", "budget_consumed")


def event_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("id")).distinct()
    return ids.select("id", F.concat(F.lit("agent"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") > 0, F.col("id") + 10).alias("max_iterations"), F.lit(1000).alias("input_token_budget"), F.lit(60).alias("timeout_seconds"))


TASKS = LOG + """, tasks AS (SELECT user_id || '-' || event_type AS id, user_id % 5 AS agent_id, event_type AS role, min(ts) AS created_at, max(ts) AS completed_at, count(*) AS budget_consumed FROM events GROUP BY user_id, event_type)"""


@query(f"""WITH {TASKS} SELECT l.task_id, 'agent' || agent_id AS agent, role, action_type, row_number() OVER (PARTITION BY l.task_id ORDER BY l.created_at, l.id) AS step,
 (epoch_us(l.created_at) - epoch_us(k.created_at)) / 1e6 AS at_seconds FROM elog l JOIN tasks k ON l.task_id = k.id""")
def trace_with_owner(spark, sf_dir):
    return trace.trace_with_owner(event_log(spark, sf_dir), event_tasks(spark, sf_dir), event_agents(spark, sf_dir))


@query(f"WITH {LOG} SELECT id, conversation_id, created_at, 'SELECT ' || id AS statement FROM elog WHERE action_type = 'tool_call' AND tool = 'tool1' ORDER BY created_at DESC, id DESC LIMIT 25")
def issued_statements(spark, sf_dir):
    return trace.issued_statements(event_log(spark, sf_dir), "tool1", 25)


@query(f"WITH {LOG} SELECT tool AS action, count(*) AS n, round(avg(s) * 1000, 3) AS avg_ms, round(sum(s)::DOUBLE, 3) AS total_s, repeat('#', CAST(least(count(*), 40) AS INTEGER)) AS bar FROM elog WHERE action_type = 'tool_call' GROUP BY 1")
def tool_histogram(spark, sf_dir):
    log = event_log(spark, sf_dir).where("action_type = 'tool_call'")
    return trace.action_histogram(log, F.get_json_object("request_payload", "$.tool_name"))


@query(f"""WITH {TASKS}, u AS (SELECT k.id, k.agent_id, k.budget_consumed, count(l.id) AS iterations FROM tasks k LEFT JOIN elog l ON l.task_id = k.id AND action_type = 'model_request' GROUP BY 1, 2, 3)
 SELECT agent_id, 'agent' || agent_id AS name, CASE WHEN agent_id > 0 THEN agent_id + 10 ELSE 21 END AS cap, agent_id = 0 AS implicit, max(iterations) AS worst, round(avg(iterations), 6) AS mean, max(budget_consumed) AS worst_tokens,
 CASE WHEN agent_id > 0 THEN agent_id + 10 ELSE 21 END - max(iterations) AS headroom FROM u GROUP BY agent_id""")
def budget_headroom(spark, sf_dir):
    return trace.budget_headroom(event_log(spark, sf_dir), event_tasks(spark, sf_dir), event_agents(spark, sf_dir))


@query(f"""WITH {TASKS} SELECT k.id AS task_id, 'agent' || agent_id AS agent, budget_consumed, 1000 AS input_token_budget, count(l.id) AS iterations, (epoch_us(completed_at) - epoch_us(k.created_at)) / 1e6 AS wall_s, 60 AS timeout_seconds, k.created_at
 FROM tasks k LEFT JOIN elog l ON l.task_id = k.id AND action_type = 'model_request' GROUP BY 1, 2, 3, 4, 6, 7, 8 ORDER BY k.created_at DESC, task_id LIMIT 20""")
def run_costs(spark, sf_dir):
    return trace.run_costs(event_log(spark, sf_dir), event_tasks(spark, sf_dir), event_agents(spark, sf_dir))


@query(f"WITH {LOG} SELECT id, conversation_id, 'a' || id AS answer, CASE WHEN id % 5 > 0 THEN 'SELECT ' || id END AS sql, CASE WHEN id % 7 > 0 THEN 'c1,c' || (id % 7) END AS columns, (id % 4) / 4.0::DOUBLE AS confidence FROM elog WHERE action_type = 'answer'")
def parse_answers(spark, sf_dir):
    """Typed answers, some without a statement or columns."""
    id_text = F.col("id").cast("string")
    columns = F.when(F.col("id") % 7 > 0, F.array(F.lit("c1"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))))
    answer = F.to_json(F.struct(F.concat(F.lit("a"), id_text).alias("answer"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("SELECT "), id_text)).alias("sql"), columns.alias("columns"), (F.col("id") % 4 / 4).alias("confidence")))
    return trace.parse_answers(event_log(spark, sf_dir).withColumn("response_payload", answer)).withColumn("columns", F.array_join("columns", ","))


@query(f"WITH {TASKS}, n AS (SELECT arg_max(conversation_id, (created_at, id)) AS conversation_id FROM elog) SELECT id, action_type FROM elog JOIN n USING (conversation_id)")
def latest_conversation(spark, sf_dir):
    return trace.latest_conversation(event_log(spark, sf_dir)).select("id", "action_type")


@query("SELECT c_mktsegment AS role, 'nation' || c_nationkey AS object, string_agg(DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'insert' ELSE 'update' END, ',' ORDER BY CASE c_custkey % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'insert' ELSE 'update' END) AS privileges FROM customer GROUP BY 1, 2")
def effective_privileges(spark, sf_dir):
    kind = F.when(F.col("c_custkey") % 3 == 0, "select").when(F.col("c_custkey") % 3 == 1, "insert").otherwise("update")
    return governed.effective_privileges(t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("object"), kind.alias("privilege")))


@query("SELECT arm, count(*) AS n, round(avg(score), 6) AS mean_score, 0.4::DOUBLE AS threshold, round(avg(score), 6) >= 0.4 AS passed FROM (SELECT event_type AS arm, CASE user_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END AS score FROM events) GROUP BY 1")
def aggregate_score(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    v = e.select(F.col("event_type").alias("arm"), F.when(F.col("user_id") % 3 == 0, "Yes").when(F.col("user_id") % 3 == 1, "Maybe").otherwise("No").alias("verdict"), F.lit(True).alias("valid"), F.lit(False).alias("error"))
    return scoring.aggregate_score(scoring.verdict_score(v), e.select(F.col("event_type").alias("arm"), F.lit(0.4).cast("double").alias("threshold")).distinct())


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type ILIKE '%ec%' ORDER BY value LIMIT 20")
def distinct_literals(spark, sf_dir):
    return clean.distinct_literals(t(spark, sf_dir, "part"), "p_type", "ec")


from . import finding, reports  # noqa: E402, F401  register their queries here
