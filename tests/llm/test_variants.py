import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import queries, variants


def near(u, v):
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def brute(words, ratio=5):
    found = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        found[w] = (form, n, len(close), words[form] if form else None)
    out = {}
    for w in words:
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (found[w][0], root, *found[w][1:])
    return out


def counted(rows, modulus=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_acceptor_numbers_its_sequences_and_shares_what_is_equal():
    words = sorted(["abc", "abd", "xbc", "xbd", "b"])
    flat, offsets = np.array([ord(c) for w in words for c in w]), np.cumsum([0, *map(len, words)])
    a = variants.Acceptor(flat, offsets)
    assert len(a) == 4  # initial; behind a and x; behind their b; the end, which b shares
    for i, w in enumerate(words):
        state, number = a.initial, 0
        for c in w:
            _, arcs = a.arcs(np.array([state]))
            arc = arcs[a.label[arcs] == ord(c)][0]
            state, number = a.target[arc], number + a.skip[arc]
        assert a.final[state] and number == i


@pytest.mark.parametrize(("letters", "low", "high", "n", "most"), [("ab", 1, 6, 90, 16384), ("ab", 6, 9, 150, 4), ("abcé", 3, 6, 150, 7), ("a", 1, 30, 40, 2)])
def test_neighbours_are_those_of_all_pairs(spark, letters, low, high, n, most):
    random.seed(n)
    words = {"".join(random.choices(letters, k=random.randint(low, high))): random.choice([5, 6, 30, 200, 1000, 6000]) for _ in range(n)}
    found = variants.forms(spark.createDataFrame(list(words.items()), "word string, n long"), 5, most)
    assert {r.word: (r.form, r.n, r.n_near, r.form_n) for r in found.collect()} == {w: (x[0], *x[2:]) for w, x in brute(words).items()}


def test_a_large_group_is_cut_until_its_words_fit(spark):
    words = [("stem" + a + b + c + "tail", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = variants.groups(spark.createDataFrame(words, "word string, n long"), 20)
    sizes = rows.groupBy("key", "low", "high").count().collect()
    assert max(r["count"] for r in sizes if r.high - r.low > 1) <= 20
    assert max(r["count"] for r in sizes) <= 20


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(40)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in links}


def test_query_equals_plain_counts_and_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(counted(rows))
    assert want and rows_of(queries.QUERIES["op11_spelling_variants"](spark, sf_dir)) == want


def test_awkward_texts(spark):
    long = "colour " * 60_000 + "x" * 100_000
    rows = [(1, long), (1, long), (None, "Color color COLOR color color color"), (3, None), (4, ""), (5, "flavour " * 10 + "flavoßr " * 5 + "fla×vour " * 6), (6, "flavour1flavour_flavour")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = rows_of(variants.variants(docs, modulus=199))
    assert got == brute(counted(rows))
    assert got["flavoßr"][0] is None and got["flavour"][3] == 2
    assert variants.variants(docs.limit(0)).collect() == []
