"""Governed outputs: allow-listed projections, purposes, privileges and reachability of denied columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import blank_to_null, digits_or, flag_true, sentinel_to_null, text_length, ymd_to_date


def safe_projection(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Only what the list names, renamed by meaning."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


class PurposeCatalog:
    """Each purpose names its own views; anything else is an error. It isolates data products and is no authentication."""

    def __init__(self, views: dict[str, DataFrame], allowed: dict[str, list[str]]):
        self._views, self._allowed = views, allowed

    def frames(self, purpose: str) -> dict[str, DataFrame]:
        if purpose not in self._allowed:
            raise PermissionError(f"unknown purpose {purpose}")
        return {name: self._views[name] for name in self._allowed[purpose]}

    def frame(self, purpose: str, name: str) -> DataFrame:
        found = self.frames(purpose)
        if name not in found:
            raise PermissionError(f"{purpose} cannot read {name}")
        return found[name]

    def reachable(self, denied: list[str]) -> list[tuple[str, str, str]]:
        """(purpose, view, column) of denied columns that some view exposes."""
        return [(p, v, c) for p, names in sorted(self._allowed.items()) for v in names for c in self._views[v].columns if c in set(denied)]


def _named(df: DataFrame, columns: dict[str, Column], names: dict[str, str]) -> DataFrame:
    """The columns whose sources the table has, and plain renames."""
    return df.select(*[c.alias(n) for n, c in columns.items()], *[F.col(c).alias(n) for n, c in names.items()])


def complaint_facts(df: DataFrame, names: dict[str, str] | None = None, make: str = "maketxt", model: str = "modeltxt", year: str = "yeartxt", component: str = "compdesc", failed: str = "faildate", added: str = "datea", received: str = "ldate", fire: str = "fire", crash: str = "crash", injured: str = "injured", deaths: str = "deaths", narrative: str = "cdescr") -> DataFrame:
    """De-identified complaints: dates by what they mean, flags, counts, and of the narrative its length alone. ``names``: further columns, new name -> source."""
    year_of = sentinel_to_null(blank_to_null(year))
    return _named(df, {
        "make": blank_to_null(make), "model": blank_to_null(model), "model_year": year_of, "component": blank_to_null(component),
        "failed_on": ymd_to_date(failed), "added_on": ymd_to_date(added), "received_on": ymd_to_date(received),
        "fire": F.coalesce(flag_true(fire), F.lit(False)), "crash": F.coalesce(flag_true(crash), F.lit(False)),
        "injured": digits_or(injured), "killed": digits_or(deaths), "narrative_length": text_length(narrative),
    }, names or {})


def recall_summary(df: DataFrame, names: dict[str, str], notified: str = "odate", reported: str = "rcdate") -> DataFrame:
    """Recalls, renamed and dated; their texts are the maker's own and no personal data."""
    return _named(df, {"notified_on": ymd_to_date(notified), "reported_on": ymd_to_date(reported)}, names)


def investigation_summary(df: DataFrame, names: dict[str, str], opened: str = "odate", closed: str = "cdate") -> DataFrame:
    """Investigations, renamed and dated; open ones have no closing date."""
    return _named(df, {"opened_on": ymd_to_date(opened), "closed_on": ymd_to_date(closed)}, names).withColumn("is_open", F.col("closed_on").isNull())


def lineage(df: DataFrame) -> dict[str, set[tuple[str, str]]]:
    """Of each output column the source columns (source, column) that its values come from, by the expression ids of the analysed plan.

    Renames, functions, aggregates, windows, generators, joins, unions and scalar subqueries are followed; Python functions over
    whole tables are opaque, so all that goes in counts. A source is a file table by its folder's name, or any other leaf.
    """
    comes_from: dict[int, set[int]] = {}
    sources: dict[int, tuple[str, str]] = {}
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    key = lambda attribute: attribute.exprId().id()

    def uses(expression) -> set[int]:
        kind = expression.getClass().getSimpleName()
        own = {key(expression)} if kind == "AttributeReference" else set()
        if kind in ("ScalarSubquery", "LateralSubquery", "ListQuery", "Exists"):
            inner = expression.plan()
            walk(inner)
            own |= {key(a) for a in each(inner.output())} if kind != "Exists" else set()
        parts = [expression.windowFunction()] if kind == "WindowExpression" else each(expression.children())  # its order decides which value, and is none
        return own.union(*[uses(c) for c in parts])

    def note(expression) -> None:
        if expression.getClass().getSimpleName() == "Alias":
            comes_from.setdefault(key(expression), set()).update(uses(expression.child()))
        for c in each(expression.children()):
            note(c)

    def walk(plan) -> None:
        kind, children = plan.getClass().getSimpleName(), each(plan.children())
        for c in children:
            walk(c)
        outputs = each(plan.output())
        if not children:
            name = plan.relation().location().rootPaths().head().getName() if kind == "LogicalRelation" and hasattr(plan.relation(), "location") else kind
            for a in outputs:
                sources[key(a)] = (name.removesuffix(".parquet"), a.name())
        elif kind == "Union":
            for c in children:
                for a, b in zip(outputs, each(c.output()), strict=True):
                    comes_from.setdefault(key(a), set()).add(key(b))
        elif kind == "Generate":
            for a in each(plan.generatorOutput()):
                comes_from.setdefault(key(a), set()).update(uses(plan.generator()))
        for e in each(plan.expressions()):
            note(e)
        known = {key(a) for c in children for a in each(c.output())}
        for a in outputs:
            if children and key(a) not in known and key(a) not in comes_from and key(a) not in sources:
                comes_from[key(a)] = set(known)

    def trace(i: int, seen: set[int]) -> set[tuple[str, str]]:
        if i in seen:
            return set()
        seen.add(i)
        own = {sources[i]} if i in sources else set()
        return own.union(*[trace(j, seen) for j in comes_from.get(i, ())])

    analysed = df._jdf.queryExecution().analyzed()
    walk(analysed)
    return {a.name(): trace(key(a), set()) for a in each(analysed.output())}


def reachable_columns(views: dict[str, DataFrame], denied: list[str]) -> list[tuple[str, str, str, str]]:
    """(view, view_column, source, denied_column) of all view columns whose values come from a denied column, under whatever name."""
    return sorted((view, column, source, name) for view, df in views.items() for column, origin in lineage(df).items() for source, name in origin if name in set(denied))


def leaked_values(view: DataFrame, base: DataFrame, denied: list[str], least: int = 6) -> DataFrame:
    """(view_column, denied_column, n) where text of a view equals values of a denied column, whatever the view calls it.

    Values shorter than ``least`` characters, which are equal by chance, are left out. Distinct values meet, by a join.
    """
    texts = [f.name for f in view.schema if f.dataType.typeName() == "string"]
    stack = lambda df, columns, name: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where(F.length("value") >= least).distinct()
    if not texts or not denied:
        return view.sparkSession.createDataFrame([], "view_column string, denied_column string, n long")
    return stack(view, texts, "view_column").join(stack(base, denied, "denied_column"), "value").groupBy("view_column", "denied_column").agg(F.count("*").alias("n"))


def effective_privileges(grants: DataFrame) -> DataFrame:
    return grants.distinct().groupBy("role", "object").agg(F.array_join(F.sort_array(F.collect_set("privilege")), ",").alias("privileges"))


def negative_assertions(must_not: DataFrame, grants: DataFrame) -> DataFrame:
    """Violations: (role, object, privilege) rows that must not be held but are."""
    return must_not.join(grants, ["role", "object", "privilege"], "left_semi")
