"""A searchable catalogue of tables, columns, saved queries and relationships, and the records that document them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexical import candidates, parse_web_query
from ..functions.vectors import HashingEmbedder, cosine, embed_batch
from . import store
from .search import matched, tied_ranks

COLUMNS = "source_type string, entity_type string, relation_name string, column_name string, object_ref string, definition string, comment string"


def assemble_records(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) to (file, field_no, name, type, description), files in parallel.

    What stands before a file's field heading, if it has one, is skipped. A field begins with a number, a name
    and a type, of which the last two are set off by two blanks or more; the type keeps its whole bracket. Other lines go on with the field.
    """
    line = F.regexp_replace("line", "\t", " " * 8)
    heading = F.upper(F.btrim(line)).rlike(r"^(FIELDS\s*:?|FIELD\s*#.*)$")
    in_file = Window.partitionBy("file")
    order = in_file.orderBy("line_no")
    numbered = F.regexp_extract(line, r"^\s*(\d{1,3})\s", 1)
    pieces = F.split(F.btrim(F.regexp_replace(line, r"^\s*\d{1,3}\s+", "")), r"\s{2,}")
    name, tail = pieces[0], F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), " ")
    kind = F.regexp_extract(tail, r"^([A-Za-z][A-Za-z0-9]*(\s*\([^)]*\))?)(\s|$)", 1)
    begins = (numbered != "") & (F.size(pieces) > 1) & name.rlike("^[A-Za-z_][A-Za-z0-9_ ]*$") & (kind != "")
    marked = lines.select("file", "line_no", line.alias("line"), heading.alias("_h"), begins.alias("_s"), numbered.alias("_no"), name.alias("_name"), kind.alias("_type"), F.btrim(F.substr(tail, F.length(kind) + 1)).alias("_text"))
    marked = marked.withColumn("_from", F.coalesce(F.min(F.when(F.col("_h"), F.col("line_no"))).over(in_file), F.lit(-1))).where("line_no > _from AND NOT _h")
    own = marked.where(~F.btrim("line").rlike("^[-=]{3,}$")).withColumn("_r", F.sum(F.col("_s").cast("int")).over(order)).where("_r > 0")
    part = F.when(F.col("_s"), F.col("_text")).otherwise(F.btrim("line"))
    rows = own.groupBy("file", "_r").agg(F.min(F.struct("line_no", "_no", "_name", "_type")).alias("head"), F.sort_array(F.collect_list(F.struct("line_no", part.alias("part")))).alias("parts"))
    return rows.select("file", F.col("head._no").cast("int").alias("field_no"), F.lower(F.regexp_replace("head._name", r"\s+", "_")).alias("name"), F.regexp_replace("head._type", r"\s+", "").alias("type"), join_description(F.transform("parts", lambda p: p["part"])).alias("description"))


def join_description(parts):
    """Prose is joined by a space; entries of a code list become `CODE = meaning` and are set off by `; `, or a space behind `:` and `;`."""
    some = F.filter(F.transform(parts, lambda p: F.btrim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")

    def join(so_far, p):
        code, meaning = F.btrim(F.substring_index(p, "=", 1)), F.btrim(F.substr(p, F.instr(p, "=") + 1))
        entry = p.contains("=") & code.rlike("^[A-Za-z0-9]{1,8}$") & (meaning != "")
        gap = F.when(so_far == "", "").when(entry & ~so_far.rlike("[:;]$"), "; ").otherwise(" ")
        return F.concat(so_far, gap, F.when(entry, F.concat(F.upper(code), F.lit(" = "), meaning)).otherwise(p))

    return F.aggregate(some, F.lit(""), join)


def attach_comments(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Record i to physical column (position, name) i: comment with type, and a status; a missing text is reported, never invented."""
    j = columns.join(records, columns.position == records.field_no, "full")
    status = F.when(columns.position.isNull(), "no such column").when(records.field_no.isNull() | (F.coalesce("description", F.lit("")) == ""), "no description").when(F.lower(columns.column_name) != records.name, "name differs").otherwise("ok")
    comment = F.when(F.col("description") != "", F.concat("description", F.lit(" ["), "type", F.lit("]")))
    return j.select(F.coalesce("position", "field_no").alias("position"), "column_name", comment.alias("comment"), status.alias("status"))


def objects(spark: SparkSession, tables: list[str]) -> DataFrame:
    """One row for each table and column of the session's catalogue."""
    rows = []
    for t in tables:
        cols = spark.catalog.listColumns(t)
        kind = "view" if spark.catalog.getTable(t).tableType == "VIEW" else "table"
        rows.append(("schema", kind, t, None, t, f"{t}({', '.join(c.name for c in cols)})", spark.catalog.getTable(t).description))
        rows += [("schema", "column", t, c.name, f"{t}.{c.name}", f"{t}.{c.name} {c.dataType}", c.description) for c in cols]
    return spark.createDataFrame(rows, COLUMNS)


def definition_hash():
    return F.sha2(F.concat_ws("\u0001", "definition", F.coalesce("comment", F.lit(""))), 256)


class NoComments(ValueError):
    """A catalogue is built from objects without a single comment."""


def build_kb(spark: SparkSession, tables: list[str], embedder: HashingEmbedder) -> DataFrame:
    """The searchable catalogue of tables; comments come first, so that they are what is found."""
    rows = objects(spark, tables)
    if not rows.where("comment IS NOT NULL").head(1):
        raise NoComments("write the comments before the catalogue is built")
    return embed_catalog(rows, embedder)


def refresh_kb(spark: SparkSession, tables: list[str], embedder: HashingEmbedder, path: str) -> DataFrame:
    """Build again from scratch and replace what is stored."""
    build_kb(spark, tables, embedder).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def embed_catalog(rows: DataFrame, embedder: HashingEmbedder) -> DataFrame:
    return embed_batch(embed_batch(rows.withColumn("hash", definition_hash()), "definition", "definition_vec", embedder), "comment", "comment_vec", embedder)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(object_ref, change): insert, delete or update, by the hash of definition and comment."""
    n = new.select("object_ref", definition_hash().alias("h_new"))
    both = n.join(old.select("object_ref", F.col("hash").alias("h_old")), "object_ref", "full")
    change = F.when(F.col("h_old").isNull(), "insert").when(F.col("h_new").isNull(), "delete").when(F.col("h_new") != F.col("h_old"), "update")
    return both.select("object_ref", change.alias("change")).where("change is not null")


def sync(old: DataFrame, new: DataFrame, embedder: HashingEmbedder) -> tuple[DataFrame, DataFrame]:
    """The catalogue that ``new`` rows make of ``old``, with only changed rows embedded again; and (object_ref, change)."""
    found = changes(old, new)
    kept = old.join(found, "object_ref", "left_anti")
    fresh = embed_catalog(new.join(found.where("change <> 'delete'"), "object_ref", "left_semi"), embedder)
    return kept.unionByName(fresh), found


def stats(catalog: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """Counts by kind, rows without a vector, and against the objects as they are ``now`` the rows that drifted: changed or gone."""
    kind = lambda k: F.count_if(F.col("entity_type") == k)
    rows = catalog
    if now is not None:
        rows = catalog.join(changes(catalog, now).where("change <> 'insert'").withColumnRenamed("change", "_change"), "object_ref", "left")
    drifted = F.count("_change") if now is not None else F.lit(0).cast("bigint")
    return rows.agg(F.count("*").alias("total"), kind("table").alias("tables"), kind("view").alias("views"), kind("column").alias("columns"), kind("alias").alias("queries"), kind("relationship").alias("relationships"), F.count_if(F.col("definition_vec").isNull()).alias("pending"), drifted.alias("drifted"))


def check(catalog: DataFrame, least_columns: int) -> DataFrame:
    s = stats(catalog)
    return s.select(F.when(F.col("total") == 0, "FAIL: empty").when(F.col("columns") < least_columns, "FAIL: columns").when(F.col("pending") > 0, "PARTIAL").otherwise("PASS").alias("verdict"))


def _checkpoint(df: DataFrame) -> DataFrame:
    """In the folder that all executors share. Where that is unset a local master, as in tests, gets one; a cluster gets an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def search(catalog: DataFrame, query: str, embedder: HashingEmbedder, top_k: int = 10, entity_types: list[str] | None = None, min_similarity: float = 0.0, rrf_k: int = 60, arms: tuple = ("definition", "comment", "words"), offset: int = 0) -> DataFrame:
    """Definition, comment and word arms, each floored before fusion by reciprocal rank.

    Every row that an arm finds has a rank in it, tied rows the same one, and only the fused rows are cut.
    """
    some = catalog if entity_types is None else catalog.where(F.col("entity_type").isin(entity_types))
    vector, asked = embedder.encode_query(query), parse_web_query(" OR ".join(query.split()))
    text = F.concat_ws(" ", F.regexp_replace("object_ref", "[._]", " "), "definition", "comment")
    words = matched(some, candidates(text, asked), asked, "object_ref").select("object_ref", F.round("score", 6).alias("_words"))

    def near(c: str):
        similarity = F.round(cosine(c, vector), 12)
        return F.when(similarity >= min_similarity, similarity)

    score = {"definition": near("definition_vec"), "comment": F.when(F.col("comment").isNotNull(), near("comment_vec")), "words": F.col("_words")}
    # embedded and read once: each arm counts the scores and joins them with their ranks
    scored = _checkpoint(some.join(words, "object_ref", "left").select("object_ref", *[score[a].alias(a) for a in arms]))
    found = reduce(DataFrame.unionByName, [tied_ranks(scored.select("object_ref", F.col(a).alias("score")), "score", "rank").select("object_ref", F.lit(a).alias("arm"), "rank") for a in arms])
    ranks = found.groupBy("object_ref").agg(*[F.max(F.when(F.col("arm") == a, F.col("rank"))).alias(f"{a}_rank") for a in arms])
    part = [F.coalesce(1.0 / (rrf_k + F.col(f"{a}_rank")), F.lit(0.0)) for a in arms]
    best = ranks.withColumn("rrf_score", reduce(lambda x, y: x + y, part)).orderBy(F.desc("rrf_score"), "object_ref").offset(offset).limit(top_k)
    return some.drop("definition_vec", "comment_vec", "hash").join(F.broadcast(best), "object_ref")


def column_definitions(catalog: DataFrame, query: str, embedder: HashingEmbedder, min_similarity: float = 0.3, top_k: int = 10, offset: int = 0) -> DataFrame:
    """The definitions of the columns that a question means, and nothing else of them."""
    found = search(catalog, query, embedder, top_k, ["column"], min_similarity, arms=("definition", "words"), offset=offset)
    return found.orderBy(F.desc("rrf_score"), "object_ref").select("object_ref", "definition")


def entity_definitions(catalog: DataFrame, query: str, embedder: HashingEmbedder, min_similarity: float = 0.3, top_k: int = 10, offset: int = 0) -> DataFrame:
    """Tables and views with definition and comment."""
    return search(catalog, query, embedder, top_k, ["table", "view"], min_similarity, offset=offset).select("object_ref", "entity_type", "definition", "comment", "rrf_score")


def search_by_comment(catalog: DataFrame, query: str, embedder: HashingEmbedder, min_similarity: float = 0.3, top_k: int = 10, offset: int = 0) -> DataFrame:
    """By what comments say; names count for nothing."""
    return search(catalog, query, embedder, top_k, None, min_similarity, arms=("comment",), offset=offset).select("object_ref", "entity_type", "comment", "rrf_score")


def metadata(catalog: DataFrame, query: str, embedder: HashingEmbedder, min_similarity: float = 0.3, top_k: int = 10, offset: int = 0) -> DataFrame:
    """What is known of the objects that a question means: where from, kind, table and column."""
    return search(catalog, query, embedder, top_k, None, min_similarity, arms=("definition",), offset=offset).select("object_ref", "source_type", "entity_type", "relation_name", "column_name", "rrf_score")


def discover_context(catalog: DataFrame, question: str, embedder: HashingEmbedder, min_similarity: float = 0.3, top_k: int = 10) -> DataFrame:
    """Two ranked lists from one call, told apart by ``part``: matches in the schema, and saved queries."""
    lists = (("schema", catalog.where("source_type = 'schema'")), ("alias", catalog.where("source_type = 'alias'")))
    return reduce(DataFrame.unionByName, [search(rows, question, embedder, top_k, None, min_similarity).select(F.lit(part).alias("part"), "object_ref", "entity_type", "definition", "comment", "rrf_score") for part, rows in lists])


class Catalogues:
    """Catalogues by name, in a folder that sessions share; a name may be left out while there is one, and one object is in one catalogue.

    Rows of dropped and replaced catalogues stay in the folder, for those that read them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or store.new_folder(spark, "catalogues")
        self._none = spark.createDataFrame([], "name string, embedder string, dimension int, tables array<string>, location string")
        self._kept = store.Records(spark, f"{self.path}/names", self._none.schema)

    def add(self, name: str, rows: DataFrame, embedder: HashingEmbedder, tables: list[str]) -> None:
        wanted = F.array(*[F.lit(x) for x in tables]).cast("array<string>")
        both = self._kept.rows().where(F.col("name") != name).select("name", F.array_sort(F.array_intersect("tables", wanted)).alias("both"))
        shared = both.where(F.size("both") > 0).orderBy("name").collect()
        if shared:
            raise ValueError("; ".join(f"{', '.join(r['both'])} already in {r['name']}" for r in shared))
        location = f"{self.path}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(location)
        self._kept.put(self.spark.createDataFrame([(name, embedder.name, embedder.dimension, sorted(tables), location)], self._none.schema))

    def get(self, name: str | None = None) -> DataFrame:
        found = self._kept.rows(name).orderBy("name").collect()  # one short row a catalogue
        if name is None and len(found) != 1:
            raise ValueError(f"name one of {', '.join(r['name'] for r in found) or 'no catalogues'}")
        if not found:
            raise KeyError(name)
        return self.spark.read.parquet(found[0]["location"])

    def list(self) -> DataFrame:
        return self._kept.rows().select("name", "embedder", "dimension", "tables").orderBy("name")

    def drop(self, name: str) -> None:
        self._kept.drop(name)


def list_objects(spark: SparkSession, prefix: str = "") -> DataFrame:
    rows = [(t.name, t.tableType, t.description) for t in spark.catalog.listTables() if t.name.startswith(prefix)]
    return spark.createDataFrame(rows, "name string, kind string, comment string")


def object_details(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns of named objects, looked up and not searched; an unknown name has a row that says so."""
    rows = []
    for name in names:
        if not spark.catalog.tableExists(name):
            rows.append((name, None, None, None, None, "no such object"))
            continue
        rows += [(name, i, c.name, c.dataType, c.description, "ok") for i, c in enumerate(spark.catalog.listColumns(name), 1)]
    return spark.createDataFrame(rows, "object_name string, position int, column_name string, data_type string, comment string, status string")


def set_comment(rows: DataFrame, object_ref: str, comment: str | None) -> DataFrame:
    """Catalogue rows with one comment set, or removed; ``sync`` then embeds that row alone."""
    return rows.withColumn("comment", F.when(F.col("object_ref") == object_ref, F.lit(comment).cast("string")).otherwise(F.col("comment")))


def remove_comment(rows: DataFrame, object_ref: str) -> DataFrame:
    return set_comment(rows, object_ref, None)


def deletions(word: Column, distance: int) -> Column:
    """What is left of a word when up to ``distance`` letters go. Two words at so many edits have one of these in common."""
    def one(w: Column) -> Column:
        without = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, without).otherwise(F.array().cast("array<string>"))

    out = F.array(word)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def near_words(words: DataFrame, word: str, distance: int = 1) -> DataFrame:
    """(a, b, edits) of distinct words at up to ``distance`` edits, a before b; words meet only where a deletion of both is equal."""
    each = words.select(word).distinct().select(F.col(word).alias("w"), F.explode(deletions(F.col(word), distance)).alias("d"))
    # merged, never broadcast: the planner reckons the deletions as large as the names they are made of
    both = each.withColumnRenamed("w", "a").hint("merge").join(each.withColumnRenamed("w", "b").hint("merge"), "d").where("a < b")
    return both.select("a", "b", F.levenshtein("a", "b", distance).alias("edits")).where("edits >= 0").distinct()


def name_variants(names: DataFrame, distance: int = 0) -> DataFrame:
    """Names that look like copies of one object: equal once endings such as _old, _bak or _v1 are gone, or then at most ``distance`` edits apart."""
    stripped = F.regexp_replace(F.lower("name"), r"(_(deprecated|old|archive|bak|tmp|v\d+))+$", "")
    stems = names.withColumn("stem", stripped).groupBy("stem").agg(F.sort_array(F.collect_set("name")).alias("names"))
    if not distance:
        return stems.where(F.size("names") > 1)
    a, b = (stems.select(F.col("stem").alias(x), F.col("names").alias(f"{x}_names")) for x in "ab")
    near = near_words(stems, "stem", distance).join(a, "a").join(b, "b")
    return stems.where(F.size("names") > 1).unionByName(near.select(F.col("a").alias("stem"), F.sort_array(F.array_union("a_names", "b_names")).alias("names")))
