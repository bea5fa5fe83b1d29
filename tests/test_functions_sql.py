import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stemmer, udtf, vectors
from lodestone.operators import aliases
from lodestone.sources import landing


def plain_encode(text, dimension):
    """The embedder word by word."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out = np.zeros(dimension)
    for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
        h = zlib.crc32(f.encode())
        out[(h >> 1) % dimension] += 1 if h & 1 else -1
    length = np.linalg.norm(out)
    return out / length if length else out


TEXTS = ["", None, "one", "One  two\nthree", "two one", "é ß Ünïcode, word-word", "a" * 500, "x\0y", "  . ", "the the the the", "“quoted” – dash…ß", "b" * 64 + " " + "c" * 65 + " d"]


def test_vectorised_encoder_equals_plain_code(monkeypatch):
    random.seed(1)
    texts = TEXTS + [" ".join(random.choices(["ab", "cd", "é", "f-g"], k=random.randint(0, 60))) for _ in range(40)]
    model = vectors.HashingEmbedder(32)
    want = np.stack([plain_encode(t or "", 32) for t in texts])
    assert np.allclose(model.matrix(texts), want, atol=1e-6)
    monkeypatch.setattr(vectors, "SLICE", 100)
    assert np.allclose(model.matrix(texts), want, atol=1e-6)
    assert model.encode([]) == [] and model.encode_query("one") == model.encode(["one"])[0]


def test_embed_batch_keeps_vectors_that_are_there(spark):
    df = spark.createDataFrame([(k, t, [1.0, 0.0] if k == 2 else None) for k, t in enumerate(TEXTS)], "id int, c string, vec array<float>").repartition(3)
    model = vectors.HashingEmbedder(2)
    got = {r.id: r.vec for r in vectors.embed_batch(df, "c", "vec", model, batch_size=3).collect()}
    assert got[2] == [1.0, 0.0] and all(np.allclose(got[k], plain_encode(t or "", 2), atol=1e-6) for k, t in enumerate(TEXTS) if k != 2)


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(TEXTS)], "id int, c string, part int").createOrReplaceTempView("udtf_texts")
    got = spark.sql("SELECT id, p.pos, p.lexeme FROM udtf_texts, LATERAL lexeme_positions(c) p WHERE id = 3").collect()
    assert sorted((r.pos, r.lexeme) for r in got) == [(1, "one"), (2, "two"), (3, "three")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM lexeme_positions('the Burning fires', false)").collect()] == [(2, "burning"), (3, "fires")]
    for how in ("", " PARTITION BY (part)", " WITH SINGLE PARTITION"):
        rows = {r.id: r.vec for r in spark.sql(f"SELECT * FROM encode_batch(TABLE(udtf_texts){how}, 'c', 16, 2)").collect()}
        assert len(rows) == len(TEXTS) and all(np.allclose(rows[k], plain_encode(t or "", 16), atol=1e-6) for k, t in enumerate(TEXTS))
    with pytest.raises(Exception, match="table with the column"):
        spark.sql("SELECT * FROM encode_batch(TABLE(udtf_texts), 'missing')").collect()
    assert stemmer.stem_word("burning") == "burn"


def test_lexemes_are_made_of_filtered_rows_and_each_word_once(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, "burning fires", "en"), (2, "le feu", "fr")], "id int, c string, lang string").createOrReplaceTempView("udtf_langs")
    df = spark.sql("SELECT id, p.lexeme FROM udtf_langs, LATERAL lexeme_positions(c) p WHERE lang = 'en'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("BatchEvalPythonUDTF") < plan.index("Filter")
    assert sorted((r.id, r.lexeme) for r in df.collect()) == [(1, "burn"), (1, "fire")]
    before = stemmer.remembered_stem.cache_info().hits
    assert [*udtf.LexemePositions().eval("repeated repeated")] == [(1, "repeat"), (2, "repeat")]
    assert stemmer.remembered_stem.cache_info().hits > before


def test_saved_queries_as_table_functions(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string").createOrReplaceTempView("function_rows")
    saved = aliases.Aliases(spark)
    saved.save("rows_of", "rows of a kind", "SELECT id, kind FROM function_rows WHERE kind = ${kind}", [("kind", "text", "")])
    saved.as_function("rows_of")
    assert sorted(r.id for r in spark.sql("SELECT * FROM rows_of('a')").collect()) == [1, 3]
    assert spark.sql("SELECT * FROM rows_of('x'' OR ''1'' = ''1')").collect() == []
    each = spark.sql("SELECT k, r.id FROM VALUES ('a'), ('b'), ('c') AS v(k), LATERAL rows_of(k) r").collect()
    assert sorted((r.k, r.id) for r in each) == [("a", 1), ("a", 3), ("b", 2)]
    saved.save("rows_of", "rows of a kind", "SELECT count(*) AS n FROM function_rows WHERE kind = ${kind}", [("kind", "text", "")], replace=True)
    saved.as_function("rows_of")
    assert spark.sql("SELECT n FROM rows_of('a')").first().n == 2


def scanned(df):
    """(files, rows) that a filtered read of a table opened and took, by the scan's own counts."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    parts = leaf.inputRDD().filePartitions()
    files = {f.toPath().toString() for i in range(parts.size()) for f in parts.apply(i).files()}
    return len(files), leaf.metrics().get("numOutputRows").get().value()


def test_layout_lets_reads_skip_files_and_row_groups(spark, tmp_path):
    n = 60_000
    rows = spark.range(n, numPartitions=4).select((1990 + F.col("id") % 4).alias("year"), F.format_string("make%03d", F.pmod(F.xxhash64("id"), F.lit(200))).alias("make"), F.sha2(F.col("id").cast("string"), 256).alias("campaign"), F.col("id").alias("n"))
    path = f"file://{tmp_path}/t"
    landing.write_layout(rows, path, ["make"], ["year"], ["campaign"], row_group_bytes=64 << 10)
    table = spark.read.parquet(path)
    files, every = scanned(table)
    assert every == n == table.count() and files >= 4
    one_year = scanned(table.where("year = 1991"))
    assert one_year[0] < files and one_year[1] == n // 4
    one_make = scanned(table.where("make = 'make077'"))
    assert one_make[1] < n / 4  # most row groups are left out by their smallest and largest make
    both = scanned(table.where("year = 1992 AND make = 'make077'"))
    assert both[0] <= one_year[0] and both[1] <= one_make[1]
    key = rows.where("n = 4242").first().campaign
    one_campaign = scanned(table.where(F.col("campaign") == key))
    print("of", (files, every), "year", one_year, "make", one_make, "year and make", both, "campaign", one_campaign)
    assert table.where(F.col("campaign") == key).count() == 1 and one_campaign[1] < n / 3  # by bloom filters: campaigns are not sorted
