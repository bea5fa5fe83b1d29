import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import clean, lexical, vectors
from lodestone.operators import aliases, catalog, governed, joins, relations, rollups, scoring, search, trace
from lodestone.sources import landing, schemas
from lodestone.streaming import upkeep

#: Own complaint fixture: id, make, model, year, component, failed, received, added, occurrences.
COMPLAINTS = [
    ("c1", "ALDER", "ONE", "2001", "LAMPS", "20221105", "20230104", "20230201", "1"),
    ("c2", "BIRCH", "TWO", "2002", "LAMPS", "20230510", "20230601", "20240103", "4"),
    ("c3", "CEDAR", "SIX", "2003", "LAMPS", "20231120", "20231201", "20240110", "1"),
    ("c4", "BIRCH", "TWO", "2003", "LAMPS", "20231230", "20240102", "20240105", "x"),
    ("c5", "ALDER", "ONE", "2001", "LAMPS", "20220101", "20220301", "20230102", "1"),
    ("c6", "ELDER", "", "2004", "LAMPS", "20230801", "20240201", "20240202", "1"),
    ("c7", "FIR", "TEN", "2005", "STEERING", "20230301", "20230302", "20230303", "2"),
    ("c8", "CEDAR", "SIX", "2002", "STEERING", "20230401", "20230402", "20230403", "5"),
]
RECALLS = [("ALDER", "ONE", "2001", "LAMPS"), ("BIRCH", "TWO", "2002", "LAMPS AND WIRES"), ("FIR", "TEN", "2005", "STEERING"), ("ELDER", "", "2004", "LAMPS"), ("CEDAR", "SIX", "2001", "LAMPS")]


@pytest.fixture(scope="module")
def complaints(spark):
    return spark.createDataFrame(COMPLAINTS, "cmplid string, maketxt string, modeltxt string, yeartxt string, compdesc string, faildate string, ldate string, datea string, occurences string")


def test_three_dates_give_three_answers(complaints):
    lamps = complaints.where("compdesc = 'LAMPS'")
    r = rollups.counts_by_each_date(lamps, ["ldate", "faildate", "datea"], "20230101", "20231231").first()
    assert (r.ldate_in_period, r.faildate_in_period, r.datea_in_period) == (3, 4, 2)


def test_sum_is_not_count_and_component_joins(spark, complaints):
    assert complaints.where("compdesc = 'STEERING'").agg(F.sum(clean.digits_or("occurences"))).first()[0] == 7
    recalls = spark.createDataFrame(RECALLS, "maketxt string, modeltxt string, yeartxt string, compname string")
    keys = [("maketxt", "maketxt"), ("modeltxt", "modeltxt"), ("yeartxt", "yeartxt")]
    four = joins.join_nonblank(complaints, recalls, [*keys, ("compdesc", "compname")]).select(complaints.maketxt).distinct()
    assert {r[0] for r in four.collect()} == {"ALDER", "FIR"}
    three = joins.join_nonblank(complaints, recalls, keys).select(complaints.maketxt).distinct()  # blank models match nothing
    assert {r[0] for r in three.collect()} == {"ALDER", "BIRCH", "FIR"}


def test_landing_keeps_bytes_and_refuses_shifts(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    good = b'a\t"b\t\r\n\r\n\xe9\t\x93x\x94\t\n\x81\t\t1\nz\xc3\xa9\t\t\n'
    open(f"{d}/good.txt", "wb").write(good)
    got = landing.land_delimited(spark, [f"{d}/good.txt", f"{d}/missing.txt"], schemas.text_schema("x y z"))
    assert [tuple(r) for r in got.collect()] == [("a", '"b', ""), ("é", "“x”", ""), ("\x81", "", "1"), ("zé", "", "")]
    report = landing.line_report(landing.read_lines(spark, [f"{d}/good.txt"])).first()
    assert (report.lines, report.blank_lines, report.fallback_lines) == (5, 1, 2)
    open(f"{d}/short.txt", "w").write("a\tb\n")
    with pytest.raises(landing.FieldCountError):
        landing.land_delimited(spark, [f"{d}/short.txt"], schemas.text_schema("x y z"))
    with pytest.raises(FileNotFoundError):
        landing.resolve_parts(spark, [f"{d}/none.txt"])
    assert [len(schemas.text_schema(s)) for s in (schemas.COMPLAINTS, schemas.RECALLS, schemas.INVESTIGATIONS)] == [51, 29, 11]


@pytest.mark.parametrize("n,expect", [(2, ["20230103", "20230102"]), (3, ["20230103", "20230102", "20230102"]), (9, ["20230103", "20230102", "20230102", "20230101"])])
def test_most_recent(spark, n, expect):
    df = spark.createDataFrame([(1, "20230101"), (2, "20230102"), (3, "20230102"), (4, "20230103"), (5, ""), (6, "2019")], "id int, d string")
    got = [r.d for r in landing.most_recent_n(df, "d", n, ["id"]).orderBy(F.desc("d")).collect()]
    assert got == expect


def test_reports_sinks_and_samples(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    r = spark.createDataFrame([("safety", "t", "f")], "purpose string, title string, findings string")
    landing.append_report(r, f"{d}/r", ["safety"])
    landing.append_report(r, f"{d}/r", ["safety"])
    assert spark.read.parquet(f"{d}/r").count() == 2
    with pytest.raises(Exception, match="not allowed"):
        landing.append_report(r.withColumn("purpose", F.lit("other")), f"{d}/r", ["safety"])
    for _ in range(2):
        landing.overwrite_table(r, f"{d}/o", sort_by=["title"])
    assert spark.read.parquet(f"{d}/o").count() == 1
    texts = spark.createDataFrame([("x" * 40,), ("x" * 41,)], "c string")
    assert landing.sample_narratives(texts, "c", 5, 2).count() == 1
    assert landing.with_identity(r, ["title"]).first().id == landing.with_identity(r, ["title"]).first().id


def test_lexical_and_rrf(spark):
    df = spark.createDataFrame([(1, "brakes failed, BRAKES!"), (2, "engine fire"), (3, None)], "id int, c string")
    q = lexical.parse_web_query("brake OR fire -engine")
    found = df.where(lexical.matches(lexical.lexemes("c"), q)).select("id", lexical.cover_rank(lexical.lexemes("c"), q).alias("s")).collect()
    assert [(r.id, round(r.s, 6)) for r in found] == [(1, 0.2)]
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1)], "id int, rank int")
    one, two = ({r.id: round(r.rrf_score, 12) for r in search.rrf(x, "id").collect()} for x in ([a, b], [b, a]))
    assert one == two and one[2] == round(1 / 62 + 1 / 61, 12)


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c", [1.0, 0.0])], "id int, c string, vec array<float>")
    got = {r.id: r.vec for r in vectors.embed_batch(df, "c", embedder=vectors.HashingEmbedder(2)).collect()}
    assert got[2] == [1.0, 0.0] and len(got[1]) == 2
    with pytest.raises(Exception, match="must have 3"):
        vectors.check_dimension(df, "vec", 3).collect()


def test_embedding_reads_whole_texts(spark):
    texts = ["", "x_y Z-\u00c9t\u00e9 " * 3, " ".join(f"w{i % 977}" for i in range(30_000)), "a " * 4000 + "first", "a " * 4000 + "second"]
    want = []
    for text in texts:
        words = "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()
        v = np.zeros(128)
        for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            h = zlib.crc32(f.encode())
            v[(h >> 1) % 128] += 1 if h & 1 else -1
        want.append(v / (np.linalg.norm(v) or 1))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    got = {r.id: r.vec for r in vectors.embed_batch(df, "c").collect()}
    for i, v in enumerate(want):
        assert np.allclose(got[i], v, atol=1e-6), i
    assert got[3] != got[4]
    window = vectors.HashingEmbedder()
    window.max_chars = 4000
    cut = {r.id: r.vec for r in vectors.embed_batch(df, "c", embedder=window).collect()}
    assert cut[3] == cut[4]


def test_trace(spark):
    log = spark.sql("""SELECT * FROM VALUES
      (1L,'t1','c','s2','user_prompt','ok',NULL,'{"prompt":"hi"}',NULL,TIMESTAMP'2024-01-01 00:00:00',TIMESTAMP'2024-01-01 00:00:01'),
      (2L,'t1','c','s1','tool_call','ok',NULL,'{"tool_name":"query","arguments":{"query":"SELECT faildate"}}',NULL,TIMESTAMP'2024-01-01 00:00:00',NULL),
      (3L,'t2','c','s1','model_request','ok',NULL,'{}',NULL,TIMESTAMP'2024-01-01 00:00:02',TIMESTAMP'2024-01-01 00:00:03')
      AS t(id,task_id,conversation_id,sequence_id,action_type,status,error,request_payload,response_payload,created_at,completed_at)""")
    assert [(r.step, r.round, r.action_type) for r in trace.full_trace(log).orderBy("step").collect()] == [(1, 2, "user_prompt"), (2, 1, "tool_call"), (3, 1, "model_request")]
    assert trace.issued_statements(log).first().statement == "SELECT faildate"
    tasks = spark.sql("SELECT * FROM VALUES ('t1',1,10L,TIMESTAMP'2024-01-01 00:00:00',CAST(NULL AS TIMESTAMP),'r'),('t2',1,20L,TIMESTAMP'2024-01-01 00:00:00',NULL,'r') AS t(id,agent_id,budget_consumed,created_at,completed_at,role)")
    agents = spark.sql("SELECT * FROM VALUES (1,'a',CAST(NULL AS INT),5L,60) AS t(id,name,max_iterations,input_token_budget,timeout_seconds)")
    r = trace.budget_headroom(log, tasks, agents).first()
    assert (r.cap, r.implicit, r.worst, r.headroom) == (21, True, 1, 20)
    assert trace.compare_agents(log, tasks).first().avg_actions == 1.5
    assert trace.run_costs(log, tasks, agents).count() == 2 and trace.trace_with_owner(log, tasks, agents).count() == 3
    p = spark.createDataFrame([("[1,2]",), ('{"required":["a"]}',), ("{}",), (None,)], "p string")
    assert [r[0] for r in p.select(trace.param_count("p")).collect()] == [2, 1, 0, 0]


def test_scoring(spark):
    s = spark.createDataFrame([("c1", "SELECT faildate"), ("c2", "SELECT ldate")], "conversation_id string, statement string")
    rules = spark.createDataFrame([("q", "ldate", True), ("q", "faildate", False)], "test string, word string, required boolean")
    assert {r.conversation_id: r.passed for r in scoring.column_choice(s, rules).collect()} == {"c1": False, "c2": True}
    v = spark.createDataFrame([("a", "Yes", True, False), ("a", "Yes", False, False), ("b", "Maybe", True, False)], "arm string, verdict string, valid boolean, error boolean")
    scored = scoring.verdict_score(v)
    t = spark.createDataFrame([("a", 0.75), ("b", 0.0)], "arm string, threshold double")
    assert {r.arm: (r.mean_score, r.passed) for r in scoring.aggregate_score(scored, t).collect()} == {"a": (0.5, False), "b": (0.5, True)}
    assert scoring.arm_delta(scored, "a", "b").first().delta == 0.0
    tests = spark.createDataFrame([("a", "t1", "x"), ("b", "t1", "y"), ("a", "t2", "z")], "arm string, test string, definition string")
    assert {r.test for r in scoring.arms_comparable(tests).collect()} == {"t1", "t2"}


def test_governed(spark):
    v = spark.createDataFrame([("x", "vin")], "make string, vin string")
    c = governed.PurposeCatalog({"facts": governed.safe_projection(v, {"make": "make"}), "raw": v}, {"safety": ["facts"], "admin": ["raw"]})
    assert c.frame("safety", "facts").columns == ["make"]
    with pytest.raises(PermissionError):
        c.frame("safety", "raw")
    assert c.reachable(["vin"]) == [("admin", "raw", "vin")]
    g = spark.createDataFrame([("r", "o", "update"), ("r", "o", "select")], "role string, object string, privilege string")
    assert governed.effective_privileges(g).first().privileges == "select,update"
    assert governed.negative_assertions(g.limit(1), g).count() == 1


def test_catalogue(spark):
    lines = ["preamble", "1  CMPLID      CHAR(9)   Unique id", "2  MAKE NAME   CHAR(25)  Make of", "      the car", "      A = one", "      B = two", "3  MODEL       CHAR(9)"]
    records = catalog.assemble_records(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string"))
    got = {r.field_no: (r["name"], r.description) for r in records.collect()}
    assert {r.type for r in records.collect()} == {"CHAR(9)", "CHAR(25)"}
    assert got == {1: ("cmplid", "Unique id"), 2: ("make_name", "Make of the car; A = one; B = two"), 3: ("model", "")}
    columns = spark.createDataFrame([(1, "cmplid"), (2, "maketxt"), (3, "model"), (4, "extra")], "position int, column_name string")
    assert {r.position: r.status for r in catalog.attach_comments(records, columns).collect()} == {1: "ok", 2: "name differs", 3: "no description", 4: "no description"}
    columns.createOrReplaceTempView("positions_old")
    model = vectors.HashingEmbedder(16)
    rows = catalog.objects(spark, ["positions_old"])
    kb = catalog.embed_catalog(rows, model)
    assert catalog.check(kb, 2).first().verdict == "PASS" and catalog.check(kb, 85).first().verdict == "FAIL: columns"
    assert catalog.search(kb, "column name", model, 2).count() == 2
    after, changes = catalog.sync(kb, rows.where("entity_type = 'table'"), model)
    assert after.count() == 1 and {r.change for r in changes.collect()} == {"delete"}
    assert catalog.name_variants(spark.createDataFrame([("a",), ("a_old",), ("b",)], "name string")).first().names == ["a", "a_old"]


def test_catalogue_search_against_brute_force(spark):
    """400 rows share a comment; the best definitions among them have the last ids."""
    model = vectors.HashingEmbedder(32)
    rows = [(f"t.c{i:03}", f"text {i % 23} of {'brake' if i % 5 else 'fire'} {'engine fire ' * (i // 150)}", "engine data" if i < 400 else f"other {i % 7}" if i % 3 else None) for i in range(500)]
    frame = spark.createDataFrame([("schema", "column", "t", r[0], *r) for r in rows], catalog.COLUMNS)
    ask = "engine fire"
    q = np.array(model.encode_query(ask))

    def near(text):
        v = np.array(model.encode([text])[0])
        s = round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q))), 12) if text is not None and v.any() else None
        return s if s is not None and s >= 0 else None

    def words(r):
        own = [lexical.stem_word(w) for w in re.findall("[a-z0-9]+", f"{r[0].replace('.', ' ')} {r[1]} {r[2] or ''}") if w not in lexical.STOP_WORDS]
        return round(0.1 * sum(w in map(lexical.stem_word, ("engine", "fire")) for w in own), 6) or None

    total = dict.fromkeys((r[0] for r in rows), 0.0)
    for arm in ([near(r[1]) for r in rows], [near(r[2]) for r in rows], [words(r) for r in rows]):
        for r, s in zip(rows, arm, strict=True):
            if s is not None:
                total[r[0]] += 1 / (60 + 1 + sum(x is not None and x > s for x in arm))
    want = sorted(total.items(), key=lambda x: (-round(x[1], 12), x[0]))
    kb = catalog.embed_catalog(frame, model)
    for offset in (0, 7):
        got = sorted(((r.object_ref, r.rrf_score) for r in catalog.search(kb, ask, model, 10, offset=offset).collect()), key=lambda x: (-round(x[1], 12), x[0]))
        assert [g[0] for g in got] == [w[0] for w in want[offset : offset + 10]]
        assert np.allclose([g[1] for g in got], [w[1] for w in want[offset : offset + 10]])


def test_relations(spark):
    e = spark.createDataFrame([(1, "inv", ["campno"], "rcl", ["campno"], "key", 0.9), (2, "cmpl", ["make"], "rcl", ["maketxt"], "key", 0.8), (3, "cmpl", ["make"], "inv", ["make"], "key", 0.5)], "id long, left_object string, left_columns array<string>, right_object string, right_columns array<string>, kind string, confidence double")
    paths = relations.find_join_path(e, "inv", "cmpl").collect()
    assert [(r.hops, r.route) for r in paths] == [(1, "inv -> cmpl"), (2, "inv -> rcl -> cmpl")]
    assert paths[0].on_clauses == "cmpl.make = inv.make"
    after, action = relations.upsert(e.where("id < 0"), e.limit(1))
    again, action2 = relations.upsert(after, e.limit(1))
    assert (action.first().action, action2.first().action, again.count()) == ("inserted", "updated", 1)
    assert relations.suggest_joins(e, ["rcl"]).count() == 2
    assert relations.subgraph(e, spark.createDataFrame([("inv",)], "object string"), 1).count() == 2


def test_aliases(spark):
    spark.range(3).createOrReplaceTempView("three")
    a = aliases.Aliases(spark)
    a.save("some", "ids from", "SELECT id FROM three WHERE id >= CAST(${least} AS INT)", [("least", "int", "")])
    assert a.run("some", {"least": "1"}).count() == 2 and a.list("so").first().n_params == 1
    for bad in ("SELECT 1;", "SELECT 1; SELECT 2", "INSERT INTO three VALUES (1)", "SELECT id FROM three LIMIT ${n}"):
        with pytest.raises(aliases.AliasError):
            a.save("bad", "", bad, [("n", "text", "")])
    with pytest.raises(aliases.AliasError):
        a.save("some", "", "SELECT 1")


def test_upkeep_replays_do_not_double(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    for k, text in enumerate(("one", "two")):
        spark.createDataFrame([(1, text)], "id int, c string").write.mode("append").parquet(f"{d}/in")
        stream = spark.readStream.schema("id int, c string").parquet(f"{d}/in")
        upkeep.maintain_embeddings(spark, stream, f"{d}/out", f"{d}/cp", "c", "id").awaitTermination()
        assert [r.c for r in upkeep.current(spark, f"{d}/out", "id").collect()] == [text], k


def test_equal_recalls_are_linked_each(spark):
    recalls = spark.createDataFrame([("a", "20230101"), ("a", "20230101"), ("b", "20230101")], "k string, told string")
    failures = spark.createDataFrame([("a", "20230102", 1), ("a", "20220102", 2)], "k string, failed string, hurt int")
    got = sorted(tuple(r) for r in joins.recall_link(recalls, failures, ["k"], "told", "failed", ["hurt"]).collect())
    assert got == [("a", "20230101", 2, 1, 3), ("a", "20230101", 2, 1, 3), ("b", "20230101", 0, 0, None)]


def test_newest_rows_of_any_table(spark):
    """Exactly n rows, none older than any valid row that is left out; blanks about a date don't count."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 50):
        rows = [(int(i), f" {20230100 + int(d)} " if d < 30 else "bad") for i, d in enumerate(rng.integers(1, 32, 40))]
        got = landing.most_recent_n(spark.createDataFrame(rows, "id int, d string"), "d", n, ["id"]).collect()
        valid = sorted(((d.strip(), -i) for i, d in rows if d != "bad"), reverse=True)
        assert sorted(r.id for r in got) == sorted(-i for _, i in valid[:n])


def test_no_small_group_is_shown(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{int(k)}", bool(f)) for k, f in zip(rng.zipf(1.4, 400) % 40, rng.integers(0, 2, 400), strict=True)]
    got = {r.k: (r.n, r.fires) for r in rollups.kpi_k_anon(spark.createDataFrame(rows, "k string, f boolean"), ["k"], F.col("f")).collect()}
    sizes = {k: sum(x == k for x, _ in rows) for k, _ in rows}
    assert set(got) == {k for k, n in sizes.items() if n >= 5} and all(got[k][0] == sizes[k] for k in got)


def test_routes_are_simple_and_whole(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"n{a}", ["x"], f"n{b}", ["y"], "key", 0.5) for i, (a, b) in enumerate(rng.integers(0, 7, (14, 2)).tolist()) if a != b]
    e = spark.createDataFrame(rows, "id long, left_object string, left_columns array<string>, right_object string, right_columns array<string>, kind string, confidence double")
    pairs = {frozenset((r[1], r[3])) for r in rows}
    found = relations.find_join_path(e, "n0", "n1").collect()
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
    for r in found:
        route = r.route.split(" -> ")
        assert len(set(route)) == len(route) == r.hops + 1 and all(frozenset(p) in pairs for p in zip(route, route[1:], strict=False))


def test_code_lists_in_the_forms_they_have(spark):
    lines = ["1  NOTHING YET   CHAR(1)   of the preamble", "Field#   Name   Type   Description", "-----", "1   RESULT CODE      VARCHAR2(30)   What came of it:", "\t  CAG  =CONSUMER ACTION GROUP", "          B7= second  one", "2   COST   NUMBER(5,2)     In money;", "      a = b", "      and more", "3   PLAIN        CHAR (8)", "      told below"]
    got = {r.field_no: (r["name"], r.type, r.description) for r in catalog.assemble_records(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")).collect()}
    assert got == {1: ("result_code", "VARCHAR2(30)", "What came of it: CAG = CONSUMER ACTION GROUP; B7 = second one"), 2: ("cost", "NUMBER(5,2)", "In money; A = b and more"), 3: ("plain", "CHAR(8)", "told below")}


def _small_kb(spark, model):
    rows = [("schema", "table", "orders", None, "orders", "orders(id, total)", "what customers bought"), ("schema", "column", "orders", "total", "orders.total", "orders.total double", "money of an order"), ("schema", "column", "engine", "heat", "engine.heat", "engine.heat double", "engine fire reports"), ("alias", "alias", None, None, "fires", "SELECT count(*) FROM engine", "engine fire reports by year")]
    return spark.createDataFrame(rows, catalog.COLUMNS), model


def test_narrow_searches(spark):
    rows, model = _small_kb(spark, vectors.HashingEmbedder(64))
    kb = catalog.embed_catalog(rows, model)
    found = catalog.column_definitions(kb, "engine heat", model, 0.1)
    assert found.columns == ["object_ref", "definition"] and found.first().object_ref == "engine.heat"
    assert {r.object_ref for r in catalog.search_by_comment(kb, "engine fire reports", model, 0.5).collect()} == {"engine.heat", "fires"}
    assert {r.object_ref for r in catalog.entity_definitions(kb, "what customers bought", model).collect()} == {"orders"}
    assert catalog.metadata(kb, "engine heat", model, 0.1).first().relation_name == "engine"
    assert {(r.part, r.object_ref) for r in catalog.discover_context(kb, "engine fire reports", model).collect()} >= {("schema", "engine.heat"), ("alias", "fires")}
    assert catalog.search_by_comment(kb, "zebra quantum", model, 0.3).count() == 0


def test_catalogue_upkeep(spark):
    rows, model = _small_kb(spark, vectors.HashingEmbedder(16))
    kb = catalog.embed_catalog(rows, model)
    later = catalog.set_comment(rows, "orders.total", "amount due")
    after, changed = catalog.sync(kb, later, model)
    assert [tuple(r) for r in changed.collect()] == [("orders.total", "update")] and after.where("comment = 'amount due'").count() == 1
    assert catalog.stats(kb, catalog.remove_comment(rows, "orders")).first().drifted == 1
    kept = catalog.Catalogues(spark)
    kept.add("one", kb, model, ["orders"])
    assert kept.get().count() == 4 and kept.list().first().dimension == 16
    with pytest.raises(ValueError, match="already in one"):
        kept.add("two", kb, model, ["orders", "engine"])
    kept.add("two", kb, model, ["engine"])
    with pytest.raises(ValueError, match="name one of"):
        kept.get()
    kept.drop("two")
    spark.range(2).createOrReplaceTempView("bare_view")
    with pytest.raises(catalog.NoComments):
        catalog.build_kb(spark, ["bare_view"], model)
    assert [(r.column_name, r.status) for r in catalog.object_details(spark, ["bare_view", "no_such"]).collect()] == [("id", "ok"), (None, "no such object")]
    assert "bare_view" in {r["name"] for r in catalog.list_objects(spark, "bare").collect()}
    names = spark.createDataFrame([("orders",), ("ordars",), ("orders_old",), ("parts",)], "name string")
    assert {tuple(r.names) for r in catalog.name_variants(names, 1).collect()} == {("orders", "orders_old"), ("ordars", "orders", "orders_old")}


def test_saved_queries_are_found(spark):
    a = aliases.Aliases(spark, vectors.HashingEmbedder(64))
    a.save("fires", "engine fire reports by year", "SELECT 1 AS n")
    a.save("sales", "money of all orders", "SELECT 2 AS n")
    assert a.find("engine fire reports", 1).first().object_ref == "fires"
    assert [r.object_ref for r in a.near_duplicates("engine fire reports by the year", 0.7).collect()] == ["fires"]
    h = aliases.history_rows(spark.createDataFrame([("SELECT  1", "done"), ("SELECT 1", "done"), ("SELECT 2", "failed"), (None, "done")], "statement string, status string")).collect()
    assert [(r.definition, r.comment) for r in h] == [("SELECT 1", "run 2 times")]


def test_relationships_by_description(spark):
    e = spark.createDataFrame([(1, "inv", ["c"], "rcl", ["c"], "key", 0.9, "manual", "investigations that led to a recall"), (2, "a", ["k"], "b", ["k"], "key", 0.8, "agent", "other things")], "id long, left_object string, left_columns array<string>, right_object string, right_columns array<string>, kind string, confidence double, source string, description string")
    assert relations.search(e, "investigations recall", vectors.HashingEmbedder(64), 1).first().object_ref == "inv -> rcl [key]"
    assert relations.listed(e, "agent").first().on == "a.k = b.k" and relations.deleted(e, [1]).count() == 1


def test_patience_with_a_limited_model():
    waits, calls = [], []

    def encode(n):
        calls.append(n)
        if len(calls) < 4:
            raise vectors.RateLimited
        return n

    assert vectors.with_retry(encode, longest=3.0, sleep=waits.append)(5) == 5 and waits == [1.0, 2.0, 3.0]
    calls.clear()
    with pytest.raises(vectors.RateLimited):
        vectors.with_retry(encode, attempts=2, sleep=waits.append)(5)


def test_words_are_extracted_once(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = search.lexical_search(df, lexical.lexemes("text", stemming=False), lexical.parse_web_query("thention OR ershan OR theing ereding", stemming=False), 20, "doc_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_streams_and_compaction(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    schema = "id long, conversation_id string, action_type string, status string, request_payload string, response_payload string, created_at timestamp, completed_at timestamp"
    for k in (1, 2):
        spark.sql(f"""SELECT {k}L, 'c', 'tool_call', 'done', '{{"tool_name":"query"}}', '{{"text":"a  b{k}"}}', TIMESTAMP'2024-01-01 00:00:00', TIMESTAMP'2024-01-01 00:00:0{k}'""").toDF(*[c.split()[0] for c in schema.split(", ")]).write.mode("append").parquet(f"{d}/log")
        upkeep.stream_log(spark.readStream.schema(schema).parquet(f"{d}/log"), f"{d}/flat", f"{d}/cp").awaitTermination()
    assert sorted((r.id, r.tool, r.ms, r.text) for r in spark.read.parquet(f"{d}/flat").collect()) == [(1, "query", 1000.0, "a b1"), (2, "query", 2000.0, "a b2")]
    for version, text in ((1, "old"), (2, "new")):
        upkeep.upsert_versions(spark, spark.createDataFrame([(1, text)], "id int, c string"), f"{d}/v", "id", version)
    upkeep.compact(spark, f"{d}/v", "id", f"{d}/w")
    assert [r.c for r in upkeep.current(spark, f"{d}/w", "id").collect()] == ["new"]
    batch = spark.createDataFrame([(1, 5, "late"), (1, 9, "latest"), (2, 1, "x")], "id int, at int, c string")
    assert {r.c for r in upkeep.newest_of_batch(batch, "id", "at").collect()} == {"latest", "x"}


def test_awkward_rows_of_joins_and_rollups(spark):
    df = spark.createDataFrame([(None, None), ("", "x"), ("a", " "), ("a", "7")], "k string, v string")
    other = df.toDF("k2", "v2")
    assert joins.join_nonblank(df, other, [("k", "k2")]).count() == 4
    p = rollups.profile_numeric(df, ["v"]).first()
    assert (p.v_min, p.v_mean, p.v_blank) == (7, 7.0, 2)
    empty = df.limit(0)
    assert joins.join_nonblank(empty, other, [("k", "k2")]).count() == 0 and rollups.kpi_k_anon(empty, ["k"], F.lit(True)).count() == 0
    assert rollups.profile_dates(empty, ["k"]).count() == 0 and landing.most_recent_n(empty, "k", 3, ["v"]).count() == 0
    assert rollups.assert_scalar({"rows": (df, F.count("*"), 4), "none": (empty, F.count("*"), 0)}).first().holds
    assert landing.sample_report(df, 9).first().too_few and not landing.sample_report(df, 8).first().too_few
    with pytest.raises(ValueError, match="no such columns"):
        clean.exclude_columns(df, ["vinn"])
    assert rollups.text_samples(df, "v", "k", 3).count() == 2


def test_a_block_of_queries_sends_its_best_of_all_row_blocks():
    import numpy as np
    import pyarrow as pa

    from lodestone.operators.search import _block_best

    random = np.random.default_rng(3)
    q, rows = random.normal(size=(7, 8)), random.normal(size=(90, 8))
    rows[40:60] = rows[10]  # ties go by id
    ids = random.permutation(90)
    block = lambda k, v: (k.astype(np.int64).tobytes(), v.tobytes())
    pairs = [(*block(at, q[at]), *block(ids[i : i + 25], rows[i : i + 25])) for at in (np.arange(4), np.arange(4, 7)) for i in range(0, 90, 25)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("qi", "qx", "ri", "rx"), x)) for x in part]) for part in (pairs[:3], pairs[3:])]
    got = [r for b in _block_best(12)(iter(batches)) for r in b.to_pylist()]
    score = (q @ rows.T).round(12)
    want = {(k, int(ids[c])) for k in range(7) for c in np.lexsort((ids, -score[k]))[:12]}
    assert len(got) == 7 * 12 and {(r["query_id"], r["id"]) for r in got} == want
