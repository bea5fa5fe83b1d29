"""Quality rules: learned decision lists over text statistics.

One pass over the texts gives counts by row. Sequential covering learns from
labelled rows: a rule grows by the threshold condition of highest information
gain, is pruned on rows it did not grow from, and is added if it is precise
enough there; what it covers is set aside, and the next rule is learned. The
list is ordered, can be read, and runs as one conditional Spark expression.

At most ``max_rows`` labelled rows are learned from, those with the smallest
hash of their id; only their statistics reach the driver, a few numbers each.
The list stays short enough to read: at most ``most_rules`` rules of at most
``most_conditions`` conditions, whose thresholds are chosen from ``cuts``
quantiles of the rows inside. These bound the learner and no judged row.
Null and empty texts have zero counts and fail the base rule. Of several labels
of an id the lowest quality counts. Without labelled rows, or with one class
only, the list is empty and keeps what the base rule keeps. Repeated rows are
judged each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_distinct")
#: Statistics that conditions may test, over the counts.
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
}


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _SPACE = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58))), _flags(tx.SPACES)
#: Bytes that begin a code point and are not white space.
_WORD_CHAR = np.array([(b & 0xC0) != 0x80 and not _SPACE[b] for b in range(256)])


def _distinct_by_row(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    key, first = np.unique(tx.pair(row.astype(np.uint64), value), return_index=True)
    return np.bincount(row[first], minlength=n)


def column_counts(column) -> dict[str, np.ndarray]:
    data, off = tx.buffers(column)
    n = len(off) - 1
    words = tx.Tokens(data, off, tx.WORDS)
    h, row = words.hashes(), words.row()
    out = {name: tx.sums(flag[data], off) for name, flag in (("word_chars", _WORD_CHAR), ("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT))}
    out["n_words"] = np.diff(words.offsets)
    out["n_distinct"] = _distinct_by_row(row, h, n)
    # lines with a word
    lines = tx.Tokens(data, off, tx.LINES)
    filled = np.zeros(len(lines), bool)
    filled[np.searchsorted(lines.start, words.start, "right") - 1] = True
    line_row = lines.row()[filled]
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct_by_row(line_row, lines.hashes()[filled], n)
    # words in three-word windows that occur twice or more
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(row[2:] == row[:-2])
        g = tx.pair(tx.pair(tx.pair(h[at], h[at + 1]), h[at + 2]), row[at].astype(np.uint64))
        _, back, count = np.unique(g, return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = tx.sums(covered, words.offsets)
    return out


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and COUNTS of every row's whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(id_col).schema
    id_type = to_arrow_schema(schema).field(0).type
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for batch in batches:
            for i, j in tx.row_slices(batch.column(1)):
                counts = column_counts(batch.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(id_type), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], [id_col, *COUNTS])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _covers(rule: list[Condition], x: dict, n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def _grow(x: dict, bad: np.ndarray, cuts: int, most: int) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, all0 = (inside & bad).sum(), inside.sum()
        best = (0.0, None)
        for name, v in x.items():
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts + 1))):
                for above in (True, False):
                    hit = inside & (v > t if above else v <= t)
                    p = (hit & bad).sum()
                    if p:
                        gain = p * (np.log2(p / hit.sum()) - np.log2(p0 / all0))
                        if gain > best[0] + 1e-9:
                            best = gain, Condition(name, above, float(t))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule: list[Condition], x: dict, bad: np.ndarray) -> list[Condition]:
    def worth(k: int) -> float:
        c = _covers(rule[:k], x, len(bad))
        return ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum())

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict, bad: np.ndarray, precision: float = 0.95, least: int = 8, most_rules: int = 12, most_conditions: int = 4, cuts: int = 40, seed: int = 7) -> list[list[Condition]]:
    """The ordered rules whose rows are bad. x: feature -> values."""
    left = np.ones(len(bad), bool)
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and (left & bad & part).sum() >= least:
        g, q = left & part, left & ~part
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], cuts, most_conditions)
        rule = _prune(rule, {k: v[q] for k, v in x.items()}, bad[q])
        hit = _covers(rule, x, len(bad)) & left if rule else ~left
        if hit[bad].sum() < least or bad[hit].mean() < precision or not (hit & q).any() or bad[hit & q].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **learning) -> list[list[Condition]]:
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    counts = text_counts(docs.select(id_col, text_col).join(F.broadcast(chosen.select(id_col)), id_col), id_col, text_col)
    rows = counts.join(F.broadcast(chosen), id_col).select((F.col("_label") == 0).alias("bad"), *[feature(f).alias(f) for f in FEATURES], F.xxhash64(id_col).alias("_place")).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(["_place", *FEATURES]).reset_index(drop=True)
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["bad"].to_numpy(bool), **learning)


def verdict(rules: list[list[Condition]]) -> Column:
    """False where a rule of the ordered list holds."""
    out: Column | None = None
    for rule in rules:
        all_hold = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(all_hold, F.lit(False)) if out is None else out.when(all_hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[list[Condition]]) -> list[str]:
    return ["drop if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in rules]


def apply(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts, base_failed and kept for every row of ``docs``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = text_counts(docs, id_col, text_col).withColumn("base_failed", failed)
    return counts.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from ``labels`` and judge all of ``docs``."""
    return apply(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
