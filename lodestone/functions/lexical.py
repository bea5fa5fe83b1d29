"""Lexical search: lexemes with their positions, web-style queries, matching and cover density, all as column expressions.

A table is searched through its ``entries``, the positions of a query's lexemes: only words that begin like one of them
leave a row (``candidates``), are stemmed, and are swept for covers by document (``cover_densities``). Ids are unique.
``matches`` and ``cover_rank`` do the same for an array of words in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stemmer import first_letters, stem, stem_word, with_stem

#: Words that carry no meaning of their own (fixed values).
STOP_WORDS = "a an and are as at be but by for from had has have he her his i if in into is it its no not of on or our she so such that the their then there these they this to was we were which will with you".split()

def lexemes(c: str | Column, stemming: bool = True) -> Column:
    """Words in order, repeats kept, without stop words."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([a-z0-9]+)")), lambda w: ~w.isin(STOP_WORDS))
    return F.transform(words, stem) if stemming else words


WORD = r"([a-z0-9]+)"


@dataclass
class WebQuery:
    """Alternatives of required words or phrases, and words that must be absent.

    A phrase is its lexemes with blanks between, ``*`` for a stop word. ``stemming`` says what the words are compared with.
    """

    alternatives: list[list[str]] = field(default_factory=list)
    absent: list[str] = field(default_factory=list)
    stemming: bool = True

    @property
    def words(self) -> list[str]:
        return sorted({w for a in self.alternatives for item in a for w in item.split() if w != "*"})

    @property
    def every_word(self) -> list[str]:
        return sorted({*self.words, *self.absent})


def parse_web_query(query: str, stemming: bool = True) -> WebQuery:
    out, current = WebQuery(stemming=stemming), []
    shown = lambda w: stem_word(w) if stemming else w
    for sign, phrase, word in re.findall(r"(-?)(?:\"([^\"]*)\"|([A-Za-z0-9]+))", query):
        if word == "OR" and not sign:
            out.alternatives.append(current)
            current = []
            continue
        words = ["*" if w in STOP_WORDS else shown(w) for w in re.findall("[a-z0-9]+", (phrase or word).lower())]
        item = " ".join(words).strip("* ")
        if item and sign:
            out.absent += [w for w in item.split() if w != "*"]
        elif item:
            current.append(item)
    out.alternatives = [a for a in [*out.alternatives, current] if a]
    return out


def matches(words: Column, query: WebQuery) -> Column:
    """Whether the words, in order and without stop words, satisfy the query."""
    return satisfies(numbered(words, query), query)


def cover_rank(words: Column, query: WebQuery) -> Column:
    """Cover density of words in order, as ``lexemes`` gives them; 0 if there is no cover."""
    return F.coalesce(cover_density(numbered(words, query), query), F.lit(0.0)) if query.words else F.lit(0.0)


def numbered(words: Column, query: WebQuery) -> Column:
    """The entries of a query in an array of its own kind of words."""
    each = F.transform(words, lambda w, i: F.when(w.isin(query.every_word), F.struct((i + 1).alias("pos"), w.alias("lexeme"))))
    return F.filter(each, lambda e: e.isNotNull())


def candidates(c: str | Column, query: WebQuery) -> Column:
    """array<struct<pos, word>>: a text's words that may be the query's, in order; stop words count as positions."""
    text = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    begins = {b for w in query.every_word for b in (first_letters(w) if query.stemming else [w])}
    begins = sorted(b for b in begins if not any(b != a and b.startswith(a) for a in begins))
    pattern = F.lit("^(?:" + "|".join(begins or ["$."]) + ")")
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD)), lambda w, i: F.when(F.regexp_like(w, pattern), F.struct((i + 1).alias("pos"), w.alias("word"))))
    return F.filter(found, lambda e: e.isNotNull() & ~e["word"].isin(STOP_WORDS))


def entries(df: DataFrame, id_col: str, words: Column, query: WebQuery) -> DataFrame:
    """(id, pos, lexeme) of the query's lexemes. ``words``: ``candidates``, or all words of a row as the query has them (``lexemes``, or a stored column)."""
    if df.select(words.alias("w")).schema["w"].dataType.elementType.typeName() == "string":
        own = df.select(id_col, F.posexplode(words).alias("pos", "lexeme")).where(F.col("lexeme").isin(query.every_word))
        return own.withColumn("pos", F.col("pos") + 1)
    own = df.select(id_col, F.explode(words).alias("e")).select(id_col, "e.pos", "e.word")
    shown = with_stem(own, "word") if query.stemming else own.withColumn("lexeme", F.col("word"))
    return shown.where(F.col("lexeme").isin(query.every_word)).select(id_col, "pos", "lexeme")


def cover_densities(rows: DataFrame, id_col: str, query: WebQuery) -> DataFrame:
    """(id, score) of the documents that satisfy a query, from its entries (id, pos, lexeme).

    The score is the sum over minimal covers of 0.1 / (1 + words in between that are no entries). An entry ends at most one
    minimal cover: the tightest interval that ends there, if it begins behind all before it. It begins at the least of the
    latest occurrences of an alternative's items, and the best alternative counts. Entries meet by document.
    """
    by = Window.partitionBy(id_col).orderBy("pos")
    so_far, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda pos, i: F.struct(pos.cast("int").alias("pos"), i.cast("int").alias("i"))
    none = at(F.lit(0), F.lit(0))
    if not query.alternatives:
        return rows.where(F.lit(False)).select(id_col, F.lit(0.0).alias("score"))
    items = sorted({item for a in query.alternatives for item in a})
    ends = []
    for item in items:  # a position has one entry at most
        parts = _phrase(item)
        whole, first = F.col("lexeme") == parts[-1][1], F.col("i")
        for back, w in parts[:-1]:
            whole = whole & F.coalesce(F.max("lexeme").over(by.rangeBetween(-back, -back)) == w, F.lit(False))
        if len(parts) > 1:
            first = F.max("i").over(by.rangeBetween(-parts[0][0], -parts[0][0]))
        ends.append(F.when(whole, at(F.col("pos") - parts[0][0], first)))
    numbered_rows = rows.withColumn("i", F.row_number().over(by))
    ended = numbered_rows.select(id_col, "pos", "lexeme", "i", *[e.alias(f"e{k}") for k, e in enumerate(ends)])
    latest = ended.select(id_col, "pos", "lexeme", "i", *[F.coalesce(F.max(f"e{k}").over(so_far), none).alias(f"l{k}") for k in range(len(items))])
    tight = [F.least(*[f"l{items.index(x)}" for x in a]) if len(a) > 1 else F.col(f"l{items.index(a[0])}") for a in query.alternatives]
    begun = latest.select(id_col, "pos", "lexeme", "i", (F.greatest(*tight) if len(tight) > 1 else tight[0]).alias("b"))
    swept = begun.withColumn("earlier", F.coalesce(F.max("b.pos").over(before), F.lit(0)))
    cover = F.when(F.col("b.pos") > F.col("earlier"), F.lit(0.1) / (F.col("pos") - F.col("b.pos") - F.col("i") + F.col("b.i") + 1))
    absent = F.col("lexeme").isin(query.absent) if query.absent else F.lit(False)
    return swept.groupBy(id_col).agg(F.sum(cover).alias("score"), F.bool_or(absent).alias("_absent")).where("score is not null and not _absent").select(id_col, "score")


def _phrase(item: str) -> list[tuple[int, str]]:
    """(how far before the phrase's last word, lexeme) of its words."""
    words = item.split()
    return [(len(words) - 1 - k, w) for k, w in enumerate(words) if w != "*"]


def _sweep(entries: Column, query: WebQuery) -> Column:
    """struct(score, found): the sum over minimal covers of 0.1 / (1 + words in between that are no entries), and where the last cover begins.

    An entry ends at most one minimal cover: the tightest interval that ends there, if it begins behind the last one. It begins
    at the least of the latest occurrences of an alternative's items, and the best alternative counts.
    """
    items = sorted({item for a in query.alternatives for item in a})
    place = {item: k for k, item in enumerate(items)}
    at = lambda pos, i: F.struct(pos.cast("int").alias("pos"), i.cast("int").alias("i"))
    none = at(F.lit(0), F.lit(0))

    def latest(item: str, old: Column, x: Column, i: Column) -> Column:
        parts = _phrase(item)
        if len(parts) == 1:
            return F.when(x["lexeme"] == parts[0][1], at(x["pos"], i)).otherwise(old)
        reach = parts[0][0]
        near = F.slice(entries, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + 1)
        whole = F.lit(True)
        for back, w in parts:
            whole = whole & F.array_contains(near, F.struct((x["pos"] - back).alias("pos"), F.lit(w).alias("lexeme")))
        inside = F.size(F.filter(near, lambda e: e["pos"] >= x["pos"] - reach))
        return F.when((x["lexeme"] == parts[-1][1]) & whole, at(x["pos"] - reach, i - inside + 1)).otherwise(old)

    def move(state: Column, i: Column) -> Column:
        x = entries[i]
        last = F.array(*[latest(item, state["last"].getItem(k), x, i) for k, item in enumerate(items)])

        def after(held: Column) -> Column:
            each = [F.least(*[held.getItem(place[item]) for item in a]) if len(a) > 1 else held.getItem(place[a[0]]) for a in query.alternatives]
            begin = F.greatest(*each) if len(each) > 1 else each[0]
            between = (x["pos"] - begin["pos"]) - (i - begin["i"])
            more = begin["pos"] > state["found"]
            return F.struct(F.when(more, begin["pos"]).otherwise(state["found"]).alias("found"), (state["score"] + F.when(more, F.lit(0.1) / (between + 1)).otherwise(0.0)).alias("score"), held.alias("last"))

        return F.transform(F.array(last), after).getItem(0)

    zero = F.struct(F.lit(0).alias("found"), F.lit(0.0).alias("score"), F.array(*[none] * len(items)).alias("last"))
    numbers = F.when(F.size(entries) > 0, F.sequence(F.lit(0), F.size(entries) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, zero, move)


def cover_density(entries: Column, query: WebQuery) -> Column:
    """The rank of a document by its minimal covers of the query; null where nothing covers it or an absent word is there."""
    if not query.alternatives:
        return F.lit(None).cast("double")
    absent = F.exists(entries, lambda e: e["lexeme"].isin(query.absent)) if query.absent else F.lit(False)
    state = _sweep(entries, query)
    score = F.transform(F.array(state), lambda s: F.when(s["found"] > 0, s["score"])).getItem(0)
    return F.when((F.size(entries) > 0) & ~absent, score)


def satisfies(entries: Column, query: WebQuery) -> Column:
    return cover_density(entries, query).isNotNull()


def postings(df: DataFrame, id_col: str, text_col: str, stemming: bool = True) -> DataFrame:
    """(id, pos, lexeme) of all of a table's words without stop words, which count as positions."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(WORD))).alias("pos", "word")).where(~F.col("word").isin(STOP_WORDS))
    words = words.select(id_col, (F.col("pos") + 1).alias("pos"), "word")
    return (with_stem(words, "word") if stemming else words.withColumn("lexeme", F.col("word"))).select(id_col, "pos", "lexeme")
