"""Spelling variants: words at one edit from each other, found by finite-state composition.

1. Words are counted over all whole texts (``word_counts``), by the JVM and with
   map-side sums; only words long and frequent enough stay, as a stored table.
2. A pair's edit has a place: the length of its common prefix, in the longer
   word of L letters. Each word joins, for pairs of L = its length and of L =
   its length + 1, a group for each half of the places: words of a group share
   the letters before the half and those after it. A group of over ``most``
   words is cut again, by halves of its own places, until a place is one letter,
   where a group cannot outgrow the alphabet. So no group is compared by pairs,
   and each pair has exactly one group.
3. Groups are dealt out by key. In a task a block of groups becomes one
   minimised acyclic acceptor, whose initial state has an arc a group (``Acceptor``).
   It is composed with a transducer of one edit and with itself: states are
   pairs of its states, those from which nothing is accepted are trimmed, and
   the paths that are left are enumerated from the initial state on, all with
   numpy, a step at a time (``near_pairs``). Arcs carry how many words come
   before theirs, so a path ends with the numbers of its two words.
4. A word's neighbours are counted and its best one kept by task, then by word.
   Forms are followed to their roots by doubling: every round follows twice as far.

Null or empty texts have no words; a null id counts as an empty one; repeated
rows count as often as they are there; of neighbours with the same count the
first in code-point order is the form. Empty tables give an empty result, other
columns are not read. A text is read as a whole by one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, stored

#: The contract's words: ASCII and Latin-1 letters (fixed values).
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the words of all texts, A-Z in lower case; of every run whose crc32 with its id ``modulus`` divides, one letter is taken out first."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if modulus:
        h = F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % modulus == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- groups ------------------------------------------------------------------------------------------------------------


def _struct(length: Column, low: Column, high: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the group (word letters outside the places low..high) and what is left of the word inside."""
    n, after = F.length("word"), F.col("length") - F.col("high")
    outside = F.concat(F.substring("word", F.lit(1), F.col("low")), F.substring("word", n - after + 1, after))
    rest = F.substring("word", F.col("low") + 1, n - F.col("low") - after)
    following = F.when(after > 0, F.ascii(F.substring("word", n - after + 1, F.lit(1)))).otherwise(0)
    key = F.concat(F.concat_ws(":", "length", "low", "high"), F.lit(":"), outside)
    return rows.withColumns({"key": key, "rest": rest, "next": following, "full": n == F.col("length")})


def groups(vocabulary: DataFrame, most: int = 16384) -> DataFrame:
    """The words in their groups, none of more than ``most`` words unless its places are down to one letter."""
    n = F.length("word")
    of = lambda length: [_struct(length, F.lit(0), F.floor(length / 2)), _struct(length, F.floor(length / 2), length)]
    rows = _keyed(vocabulary.select("word", "n", F.explode(F.array(*of(n), *of(n + 1))).alias("w")).select("word", "n", "w.*"))
    while True:
        large = stored(rows.where("high - low > 1").groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("key"), "large-groups")
        if large.isEmpty():
            return rows
        middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)
        halves = F.explode(F.array(_struct(F.col("length"), F.col("low"), middle), _struct(F.col("length"), middle, F.col("high"))))
        cut = rows.join(large, "key", "left_semi").select("word", "n", halves.alias("w")).select("word", "n", "w.*")
        rows = rows.join(large, "key", "left_anti").select(*rows.columns).unionByName(_keyed(cut))


# --- the acceptor and its composition ----------------------------------------------------------------------------------


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``: its number as often as it says, and 0, 1, ... beside."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Acceptor:
    """The minimal acyclic automaton of sorted, distinct sequences; state ``initial`` has an arc for each first symbol.

    Arcs are sorted by (state, label). ``skip`` of an arc counts the sequences that come before those through it, so the
    skips of a path add up to its sequence's number.
    """

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        n, lengths = len(offsets) - 1, np.diff(offsets)
        longest = int(lengths.max(initial=0))
        # the trie, by depth: a sequence has a node of its own from where it differs from the one before
        node, new = np.zeros(n, np.int64), np.zeros(n, bool)
        new[:1] = True
        live, total, parents, labels, ends, levels = np.arange(n), 1, [], [], [np.flatnonzero(lengths == 0)], [0, 1]
        final = [node[ends[0]]]
        for depth in range(longest):
            live = live[lengths[live] > depth]
            symbol = symbols[offsets[live] + depth]
            first = new[live]
            first[1:] |= (symbol[1:] != symbol[:-1]) | (live[1:] != live[:-1] + 1)
            first[:1] = True
            at = total + np.cumsum(first) - 1
            parents.append(node[live[first]])
            labels.append(symbol[first])
            node[live], new[live] = at, first
            total = int(at[-1]) + 1
            levels.append(total)
            final.append(node[live[lengths[live] == depth + 1]])
        parent, label = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (parents, labels))
        is_final = np.zeros(total, bool)
        is_final[np.concatenate(final)] = True
        # equal languages get one state: hashes from the leaves up, then checked arc by arc
        value, count, height = np.where(is_final, np.uint64(0x9E3779B97F4A7C15), np.uint64(1)), is_final.astype(np.int64), np.zeros(total, np.int64)
        for depth in range(longest, 0, -1):
            here = np.arange(levels[depth], levels[depth + 1])
            up = parent[here - 1]
            value[here] = _mix(value[here])
            start = np.flatnonzero(np.diff(up, prepend=-1))
            arc = _mix(value[here] + label[here - 1].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            value[up[start]] += np.add.reduceat(arc, start)
            count[up[start]] += np.add.reduceat(count[here], start)
            height[up[start]] = np.maximum.reduceat(height[here], start) + 1
        _, chosen, state = np.unique(value, return_index=True, return_inverse=True)
        degree = np.bincount(parent, minlength=total)
        begin = np.concatenate([[0], np.cumsum(degree)])
        by_parent = np.argsort(parent, kind="stable")
        label, child = label[by_parent], by_parent + 1
        same = (degree == degree[chosen][state]) & (is_final == is_final[chosen][state])
        if same.all():
            owner, k = _spread(degree)
            twin = begin[chosen[state[owner]]] + k
            same = (label == label[twin]) & (state[child] == state[child[twin]])
        if not same.all():
            raise ArithmeticError("two languages have one hash")
        owner, k = _spread(degree[chosen])
        arcs = begin[chosen[owner]] + k
        self.initial, self.final, self.height = int(state[0]), is_final[chosen], height[chosen]
        self.state, self.label, self.target = owner, label[arcs], state[child[arcs]]
        self.start = np.concatenate([[0], np.cumsum(degree[chosen])])
        passed = count[chosen][self.target]
        sums = np.concatenate([[0], np.cumsum(passed)])
        self.skip = sums[:-1] - sums[self.start[owner]] + self.final[owner]
        self._symbols = int(self.label.max(initial=0)) + 1
        self._keys = self.state * self._symbols + self.label

    def __len__(self) -> int:
        return len(self.final)

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``states``, arc) of all arcs that leave them."""
        owner, k = _spread(self.start[states + 1] - self.start[states])
        return owner, self.start[states[owner]] + k

    def both(self, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, arc of p, arc of r) for the labels that both states of a pair have."""
        width = np.diff(self.start)
        swap = width[p] > width[r]
        a, b = np.where(swap, r, p), np.where(swap, p, r)
        owner, one = self.arcs(a)
        want = b[owner] * self._symbols + self.label[one]
        at = np.minimum(np.searchsorted(self._keys, want), max(len(self._keys) - 1, 0))
        there = self._keys[at] == want if len(want) else np.zeros(0, bool)
        owner, one, two = owner[there], one[there], at[there]
        return owner, np.where(swap[owner], two, one), np.where(swap[owner], one, two)


def near_pairs(a: Acceptor, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (longer or first, other) of the sequences at one edit behind an equal first symbol, each pair once.

    An inserted symbol must differ from what the other sequence reads next there (``following`` is what a sequence's word
    has behind it), so an insertion into a run of one letter is one path.
    """
    n, none = len(a), np.empty(0, np.int64)
    # the edit: two arcs of a state with different labels, or an arc on one side only; never at the initial state
    inner = np.flatnonzero(a.state != a.initial)
    owner, k = _spread(a.start[a.state[inner] + 1] - inner - 1)
    sub_one, sub_two = inner[owner], inner[owner] + 1 + k
    sub_pair = a.target[sub_one] * n + a.target[sub_two]
    owner, one, two = a.both(a.target[inner], a.state[inner])
    other = a.label[one] != a.label[inner[owner]]
    ins_arc, ins_one, ins_two = inner[owner[other]], one[other], two[other]
    ins_pair = a.target[ins_one] * n + a.target[ins_two]
    # after the edit both sides read the same: all reachable pairs, highest first, then those that accept, lowest first
    waiting = defaultdict(list)

    def put(codes: np.ndarray) -> None:
        codes = np.unique(codes)
        high = np.minimum(a.height[codes // n], a.height[codes % n])
        for h in np.unique(high):
            waiting[int(h)].append(codes[high == h])

    put(sub_pair)
    put(ins_pair)
    reached, edges = [], []
    for h in range(int(a.height.max(initial=0)), -1, -1):
        if h not in waiting:
            continue
        codes = np.unique(np.concatenate(waiting.pop(h)))
        owner, one, two = a.both(codes // n, codes % n)
        child = a.target[one] * n + a.target[two]
        put(child)
        reached.append(codes)
        edges.append((codes[owner], child))
    pairs = np.sort(np.concatenate(reached)) if reached else none
    find = lambda codes: np.searchsorted(pairs, codes)
    accepts = a.final[pairs // n] & a.final[pairs % n] if len(pairs) else np.zeros(0, bool)
    for above, below in reversed(edges):
        accepts[find(above[accepts[find(below)]])] = True

    def alive(codes: np.ndarray) -> np.ndarray:
        return accepts[find(codes)] if len(codes) else np.zeros(0, bool)

    some = alive(sub_pair)
    sub_one, sub_two = sub_one[some], sub_two[some]
    some = alive(ins_pair)
    ins_arc, ins_one, ins_two = ins_arc[some], ins_one[some], ins_two[some]
    end_arc = inner[a.final[a.target[inner]] & a.final[a.state[inner]]]
    tables = []
    for arc in (sub_one, ins_arc, end_arc):
        order = np.argsort(a.state[arc], kind="stable")
        tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(a.state[arc], minlength=n))])))
    useful = sum(np.diff(t[1]) for t in tables) > 0
    rank = np.argsort(a.height[a.state], kind="stable")
    for arcs in np.split(rank, np.flatnonzero(np.diff(a.height[a.state][rank])) + 1) if len(rank) else ():
        useful[a.state[arcs[useful[a.target[arcs]]]]] = True

    def edits(states: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        owner, k = _spread(table[1][states + 1] - table[1][states])
        return owner, table[0][table[1][states[owner]] + k]

    # paths from the initial state on
    found_u, found_v = [], []
    q, i = np.array([a.initial]), np.zeros(1, np.int64)
    p = r = u = v = none
    while len(q) or len(p):
        owner, one, two = a.both(p, r)
        go = alive(a.target[one] * n + a.target[two])
        owner, one, two = owner[go], one[go], two[go]
        steps = [(a.target[one], a.target[two], u[owner] + a.skip[one], v[owner] + a.skip[two])]
        at, e = edits(q, tables[0])
        steps.append((a.target[sub_one[e]], a.target[sub_two[e]], i[at] + a.skip[sub_one[e]], i[at] + a.skip[sub_two[e]]))
        at, e = edits(q, tables[1])  # an insertion and the equal symbol after it: the other side is a step behind, so this one goes two
        steps.append((a.target[ins_one[e]], a.target[ins_two[e]], i[at] + a.skip[ins_arc[e]] + a.skip[ins_one[e]], i[at] + a.skip[ins_two[e]]))
        at, e = edits(q, tables[2])
        last, before = i[at] + a.skip[end_arc[e]], i[at]
        proper = a.label[end_arc[e]] != following[before]
        found_u.append(last[proper])
        found_v.append(before[proper])
        p, r, u, v = (np.concatenate(x) for x in zip(*steps, strict=True))
        done = a.final[p] & a.final[r]
        found_u.append(u[done])
        found_v.append(v[done])
        at, arc = a.arcs(q)
        go = useful[a.target[arc]]
        q, i = a.target[arc[go]], i[at[go]] + a.skip[arc[go]]
    return np.concatenate(found_u), np.concatenate(found_v)


# --- a task ------------------------------------------------------------------------------------------------------------

NEIGHBOURS = "word string, n_near long, best_n long, best string"


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), lengths


def _block(rows: pa.Table) -> pa.RecordBatch:
    """The neighbours of whole groups' words: their number, and the most frequent, first in code-point order."""
    keys, words = (rows.column(c).combine_chunks() for c in ("key", "word"))
    change = np.concatenate([[0], np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
    points, lengths = _code_points(rows.column("rest").combine_chunks())
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    symbols = np.empty(offsets[-1], np.int64)
    symbols[offsets[:-1]] = change
    symbols[np.delete(np.arange(len(symbols)), offsets[:-1])] = points
    u, v = near_pairs(Acceptor(symbols, offsets), rows.column("next").to_numpy().astype(np.int64))
    full, n = rows.column("full").to_numpy(zero_copy_only=False), rows.column("n").to_numpy()
    fits = full[u] | full[v]  # two of the shorter words are a pair of the shorter length
    one, two = np.concatenate([u[fits], v[fits]]), np.concatenate([v[fits], u[fits]])
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    near = np.diff(np.append(first, len(one)))
    return pa.RecordBatch.from_arrays([words.take(pa.array(one[first])), pa.array(near), pa.array(n[two[first]]), words.take(pa.array(two[first]))], ["word", "n_near", "best_n", "best"])


def _compose(most: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key")
            whole = pc.index(keys, keys[-1]).as_py()  # the last group may go on in the next batch
            if whole:
                yield _block(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), len(rows) - whole
        if size:
            yield _block(pa.Table.from_batches(held))

    return run


def neighbours(vocabulary: DataFrame, most: int = 16384) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n), each once, that have one at one edit."""
    spark = vocabulary.sparkSession
    rows = groups(vocabulary, most).select("key", "rest", "next", "full", "word", "n")
    parts = max(shuffle_partitions(spark), -(-4 * vocabulary.count() // 250_000))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key", "rest")
    return dealt.mapInArrow(_compose(most), NEIGHBOURS)


def forms(vocabulary: DataFrame, ratio: int = 5, most: int = 16384) -> DataFrame:
    """(word, form, n, n_near, form_n): a word's form is its most frequent neighbour, if that is ``ratio`` times as frequent."""
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("b"))
    near = neighbours(vocabulary, most).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), "best").alias("b"))
    each = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("b").alias("b"))
    is_form = -F.col("b.less") >= ratio * F.col("n")
    return each.select("word", F.when(is_form, F.col("b.best")).alias("form"), "n", "n_near", F.when(is_form, -F.col("b.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: forms followed to the last, twice as far each round."""
    at = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        step = at.join(on, "root", "left")
        if step.where("_further is not null").isEmpty():
            return at
        at = stored(step.select("word", F.coalesce("_further", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = None, least_length: int = 6, least_count: int = 5, ratio: int = 5, most: int = 16384) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that is long and frequent enough."""
    vocabulary = stored(word_counts(docs, id_col, text_col, modulus, least_length, least_count), "vocabulary")
    found = stored(forms(vocabulary, ratio, most), "forms")
    ends = roots(found.where("form is not null")).select("word", "root")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
