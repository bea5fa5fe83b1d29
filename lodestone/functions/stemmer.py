"""English stems by ordered suffix rules over regions of a word (the published "Porter2" algorithm), in three readings of one table.

``stem_word`` does one word, ``with_stem`` a column of words by it, each distinct word of an Arrow batch once, and ``stem`` is
a column expression of the JVM for words in an array of a short text, slower by far on whole tables. A rule is (suffix, replacement, region, pattern, otherwise): the first suffix of a step that a word has
decides; it is replaced if it lies in the region (1 and 2: behind the first and the second vowel-consonant pair; -1: the
rest has no region 1) and the word matches the pattern ("!" in front: does not match), else by ``otherwise``, if that is
given. ``#`` and ``!`` mark a word between two steps. Words are lower-case letters and digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What follows up to ``STEPS`` is the algorithm's own tables (fixed values).
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
#: Words that stay as they are once their plural ending is gone.
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = "^(gener|commun|arsen)"
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])"


def _same(suffixes: str, replacement: str, region: int) -> list[tuple]:
    return [(s, replacement, region, None, None) for s in suffixes.split()]


PLURAL = [("sses", "ss", 0, None, None), ("ied", "i", 0, "..ied$", "ie"), ("ies", "i", 0, "..ies$", "ie"), ("us", "us", 0, None, None), ("ss", "ss", 0, None, None), ("s", "", 0, "[aeiouy].+s$", None)]
STEPS = [
    [*_same("eedly eed", "ee", 1), *[(s, "#", 0, f"[aeiouy].*{s}$", None) for s in ("ingly", "edly", "ing", "ed")]],
    [("at#", "ate", 0, None, None), ("bl#", "ble", 0, None, None), ("iz#", "ize", 0, None, None), *[(f"{c}{c}#", c, 0, None, None) for c in "bdfgmnprt"], ("#", "e", -1, f"{_SHORT}#$", "")],
    [("y", "i", 0, "^.+[^aeiouy]y$", None), ("Y", "i", 0, "^.+[^aeiouy]Y$", None)],
    [
        *_same("ization", "ize", 1), *_same("ational", "ate", 1), *_same("fulness", "ful", 1), *_same("ousness", "ous", 1), *_same("iveness", "ive", 1), *_same("tional", "tion", 1), *_same("biliti", "ble", 1),
        *_same("lessli", "less", 1), *_same("entli", "ent", 1), *_same("ation", "ate", 1), *_same("alism", "al", 1), *_same("aliti", "al", 1), *_same("ousli", "ous", 1), *_same("iviti", "ive", 1), *_same("fulli", "ful", 1),
        *_same("enci", "ence", 1), *_same("anci", "ance", 1), *_same("abli", "able", 1), *_same("izer", "ize", 1), *_same("ator", "ate", 1), *_same("alli", "al", 1), *_same("bli", "ble", 1), ("ogi", "og", 1, "logi$", None), ("li", "", 1, "[cdeghkmnrt]li$", None),
    ],
    [*_same("ational", "ate", 1), *_same("tional", "tion", 1), *_same("alize", "al", 1), *_same("icate iciti ical", "ic", 1), *_same("ative", "", 2), *_same("ness ful", "", 1)],
    [*_same("ement", "", 2), *_same("ance ence able ible ment", "", 2), *_same("ant ent ism ate iti ous ive ize", "", 2), ("ion", "", 2, "[st]ion$", None), *_same("al er ic", "", 2)],
    [("e", "!", 2, None, None)],
    [("e", "!", 1, f"!{_SHORT}e$", None), ("l", "!", 2, "ll$", None)],
    [("!", "", 0, None, None)],
]
#: Below a lexeme's first letters its words agree: no rule reaches further back, but for the exceptions.
BACK = 2


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.transform(F.array(value), use).getItem(0)


def _step(word: Column, rules: list[tuple], first: Column, second: Column) -> Column:
    out = None
    for suffix, replacement, region, pattern, otherwise in rules:
        rest = F.length(word) - len(suffix)
        holds = {0: F.lit(True), 1: rest >= first, 2: rest >= second, -1: rest <= first}[region]
        if pattern:
            fits = F.regexp_like(word, F.lit(pattern.removeprefix("!")))
            holds = holds & (~fits if pattern[0] == "!" else fits)
        cut = F.substring(word, F.lit(1), rest)
        other = word if otherwise is None else F.concat(cut, F.lit(otherwise))
        one = F.when(holds, F.concat(cut, F.lit(replacement))).otherwise(other)
        out = F.when(word.endswith(suffix), one) if out is None else out.when(word.endswith(suffix), one)
    return out.otherwise(word)


def stem(word: Column) -> Column:
    """The stem of a word, as an expression; lambdas bind what a step needs twice."""

    def regions(w: Column) -> Column:
        return _let(F.when(F.regexp_like(w, F.lit(PREFIXES)), F.length(F.regexp_extract(w, PREFIXES, 0))).otherwise(_end(w, F.lit(0))), lambda one: F.struct(w.alias("w"), one.alias("one"), _end(w, one).alias("two")))

    def _end(w: Column, begin: Column) -> Column:
        found = F.length(F.regexp_extract(F.substring(w, begin + 1, F.length(w)), REGION, 0))
        return F.when(found > 0, begin + found).otherwise(F.length(w))

    def run(w: Column, one: Column, two: Column, steps: list) -> Column:
        return w if not steps else _let(_step(w, steps[0], one, two), lambda x: run(x, one, two, steps[1:]))

    def rest(s: Column) -> Column:
        singular = _step(s["w"], PLURAL, s["one"], s["two"])
        return _let(singular, lambda w: F.when(w.isin(*AFTER_PLURAL), w).otherwise(run(w, s["one"], s["two"], STEPS)))

    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    regular = F.translate(_let(_let(marked, regions), rest), "Y", "y")
    fixed = F.when(F.length(word) <= 2, word)
    for w, s in EXCEPTIONS.items():
        fixed = fixed.when(word == w, s)
    return fixed.otherwise(regular)


def stem_word(word: str) -> str:
    """The stem of one word, for queries."""
    if len(word) <= 2 or word in EXCEPTIONS:
        return EXCEPTIONS.get(word, word)
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    found = re.search(PREFIXES, word) or re.search(REGION, word)
    one = found.end() if found else len(word)
    found = re.search(REGION, word[one:])
    two = one + found.end() if found else len(word)
    for rules in [PLURAL, *STEPS]:
        for suffix, replacement, region, pattern, otherwise in rules:
            if word.endswith(suffix):
                rest = len(word) - len(suffix)
                holds = {0: True, 1: rest >= one, 2: rest >= two, -1: rest <= one}[region]
                if pattern:
                    holds = holds and bool(re.search(pattern.removeprefix("!"), word)) != (pattern[0] == "!")
                word = word[:rest] + replacement if holds else word if otherwise is None else word[:rest] + otherwise
                break
        if rules is PLURAL and word in AFTER_PLURAL:
            break
    return word.replace("Y", "y")


def _stem_batch(words: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(words)
    shown = np.array([*map(remembered_stem, distinct), None], object)
    return pd.Series(shown[codes])


#: ``stem_word`` for a worker that meets a word often
remembered_stem = lru_cache(maxsize=1 << 17)(stem_word)


def with_stem(df: DataFrame, word: str, out: str = "lexeme") -> DataFrame:
    """Adds the stem of a word column."""
    stemmed = F.pandas_udf(_stem_batch, "string")
    # behind an explode, so that a filter on the stem does not compute it twice
    return df.withColumn(out, F.explode(F.array(stemmed(F.col(word)))))


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, lexeme): each distinct word once with its stem."""
    return with_stem(words.select(word).distinct(), word)


def first_letters(lexeme: str) -> list[str]:
    """What every word of a lexeme begins with, one of these."""
    return sorted({lexeme[: max(1, len(lexeme) - BACK)], *(w for w, s in EXCEPTIONS.items() if s == lexeme)})


def sql(vocabulary: str, out: str = "stems") -> str:
    """The same rules as DuckDB CTEs: (word, lexeme) of the table ``vocabulary`` (word)."""

    def step(rules: list[tuple]) -> str:
        whens = []
        for suffix, replacement, region, pattern, otherwise in rules:
            rest = f"length(w) - {len(suffix)}"
            holds = [{0: "true", 1: f"{rest} >= one", 2: f"{rest} >= two", -1: f"{rest} <= one"}[region]]
            if pattern:
                holds.append(("NOT " if pattern[0] == "!" else "") + f"regexp_matches(w, '{pattern.removeprefix('!')}')")
            other = "w" if otherwise is None else f"left(w, {rest}) || '{otherwise}'"
            whens.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN {' AND '.join(holds)} THEN left(w, {rest}) || '{replacement}' ELSE {other} END")
        return f"CASE {' '.join(whens)} ELSE w END"

    def end(begin: str) -> str:
        found = f"length(regexp_extract(substring(w, {begin} + 1), '{REGION}'))"
        return f"CASE WHEN {found} > 0 THEN {begin} + {found} ELSE length(w) END"

    stay = ", ".join(f"'{w}'" for w in AFTER_PLURAL)
    parts = [f"{out}_m AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {vocabulary})", f"{out}_r AS (SELECT word, w, CASE WHEN regexp_matches(w, '{PREFIXES}') THEN length(regexp_extract(w, '{PREFIXES}')) ELSE {end('0')} END AS one FROM {out}_m)", f"{out}_0 AS (SELECT word, w, one, {end('one')} AS two FROM {out}_r)"]
    for k, rules in enumerate([PLURAL, *STEPS]):
        new = step(rules) if k == 0 else f"CASE WHEN w IN ({stay}) THEN w ELSE {step(rules)} END"
        parts.append(f"{out}_{k + 1} AS (SELECT word, one, two, {new} AS w FROM {out}_{k})")
    fixed = " ".join(f"WHEN '{w}' THEN '{s}'" for w, s in EXCEPTIONS.items())
    parts.append(f"{out} AS (SELECT word, CASE WHEN length(word) <= 2 THEN word ELSE CASE word {fixed} ELSE replace(w, 'Y', 'y') END END AS lexeme FROM {out}_{len(STEPS) + 1})")
    return ",\n".join(parts)
