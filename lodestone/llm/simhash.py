"""SimHash near-dedup with anchor-point covering.

Fingerprints differ in at most 4 of 64 bits. Cut into three stretches of 22, 21
and 21 bits, some stretch then differs in at most 1. In each stretch the anchors
are the words of the perfect binary Golay code of length 23 (the stretch padded
with zeros), whose covering radius is 3: every fingerprint has exactly one
anchor within 3, its home, and is replicated to every anchor within
3 + 1, about five of them. A linked pair therefore meets at the home anchor of
either, where homes are compared with replicas. A bucket returns an edge a node
that has links, never the pairs, so a group of near copies costs rows in
proportion to its size. Nor are the pairs of a dense group compared: what one or two
bits join is looked up, and only what is left outside the largest component meets all.

An anchor with many homes is cut by blocks of bits: of five blocks, four differing bits
leave one equal, of six two, of seven three, and so on. Blocks share out the bits in which
this anchor's homes do differ, as counted, so that blocks of near copies tell them apart too.
Rows of such an anchor meet by every choice of as many blocks, so their number grows
with the rows; more blocks are taken as homes grow in number, up to nine. Homes beyond that
which are neither told apart by their bits nor joined by one or two are compared with each other.

Only distinct fingerprints are compared. Null and empty texts have fingerprint
zero and link like others. Texts of fewer words than a shingle are one shingle.
Repeated rows share a fingerprint. Ids are whole numbers. Null ids join groups but never name one that
has another id. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import components, power_of_two, stored

#: Bits of the three stretches, the Golay generator x^11+x^9+x^7+x^6+x^5+x+1, the code's covering radius.
STRETCHES, GENERATOR, RADIUS = (22, 21, 21), 0b101011100011, 3
#: Homes that are compared at once; anchors with more are cut, and cut finer as they grow.
MOST = 4096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(column, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """uint64 SimHash by text: bit i is set if over half the shingles' XXH64 have it."""
    data, off = tx.buffers(column)
    t = tx.Tokens(data, off, tx.WORDS)
    n_texts = len(off) - 1
    out = np.zeros(n_texts, np.uint64)
    if not len(t):
        return out
    # words joined by single spaces
    size = t.end - t.start
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    where = np.repeat(t.start - begin, size + 1) + np.arange(int(begin[-1] + size[-1] + 1))
    joined = _LOWER[data[np.minimum(where, len(data) - 1)]]
    joined[begin + size] = 32
    raw = joined.tobytes()
    words = np.diff(t.offsets)
    n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - t.offsets[:-1], n)
    last = np.minimum(first + shingle - 1, np.repeat(t.offsets[1:] - 1, n))
    spans = zip(begin[first].tolist(), (begin[last] + size[last]).tolist(), strict=True)
    h = np.fromiter(map(xxhash.xxh64_intdigest, [raw[a:b] for a, b in spans], repeat(seed)), np.uint64, len(first))
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
    some = np.flatnonzero(n)
    count = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int32)
    major = (2 * count > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long) of every row's whole text."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for i, j in tx.row_slices(column):
                fp = fingerprints_of(column.slice(i, j - i), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndrome(v: np.ndarray) -> np.ndarray:
    """v mod the generator, over 23 bits."""
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


class Anchors:
    """By syndrome: the error patterns of at most RADIUS + 1 bits, which lead to the anchors in reach."""

    def __init__(self, reach: int = RADIUS + 1):
        patterns = [sum(1 << b for b in c) for w in range(reach + 1) for c in combinations(range(23), w)]
        errors = np.array(patterns, np.int64)
        syndrome = _syndrome(errors)
        order = np.argsort(syndrome, kind="stable")
        self.error, self.home = errors[order], np.bitwise_count(errors[order]) <= RADIUS
        self.at = np.searchsorted(syndrome[order], np.arange(2049))

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, anchor (12 bits) and whether it is the row's home, for every anchor in reach."""
        s = _syndrome(v)
        n = self.at[s + 1] - self.at[s]
        row = np.repeat(np.arange(len(v)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[s], n)
        return row, (v[row] ^ self.error[k]) >> 11, self.home[k]


def _replicate(batches):
    """(id, fp) to (stretch, anchor, home, id, fp)."""
    anchors = Anchors()
    for batch in batches:
        ids, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i in range(0, len(fp), 20_000):
            part, shift = fp[i : i + 20_000], 0
            for stretch, bits in enumerate(STRETCHES):
                row, anchor, home = anchors.of(part >> shift & (1 << bits) - 1)
                shift += bits
                columns = [pa.array(np.full(len(row), stretch, np.int32)), pa.array(anchor.astype(np.int32)), pa.array(home), pa.array(ids[i + row]), pa.array(part[row])]
                yield pa.RecordBatch.from_arrays(columns, ["stretch", "anchor", "home", "id", "fp"])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels once a[i] and b[i] are joined. A node's label is the smallest position known to be reachable from it."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


#: A search in a sorted array costs as much as so many comparisons.
SEARCH = 16


def link_labels(nodes: np.ndarray, home: np.ndarray, distance: int) -> np.ndarray:
    """By node (distinct fingerprints, ascending): the first node that links of homes, or others, lead to.

    Nodes at one bit, then at two, are looked up where that is cheaper than comparing all; among many near copies
    these join nearly all. Then homes outside the largest component are compared with all nodes, and homes in it with those outside.
    """
    n = len(nodes)
    label = np.arange(n)
    varying = int(np.bitwise_or.reduce(nodes ^ nodes[0])) if n else 0
    one = [1 << b for b in range(64) if varying >> b & 1]
    for flips in ([one] if distance >= 1 else []) + ([[x | y for x, y in combinations(one, 2)]] if distance >= 2 else []):
        if len(flips) * SEARCH >= n:
            break
        source = np.flatnonzero(label != np.bincount(label).argmax())
        for flip in flips:
            wanted = nodes[source] ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(nodes, wanted), n - 1)
            hit = nodes[at] == wanted
            label = _merge(label, source[hit], at[hit])
    inside = label == np.bincount(label, minlength=1).argmax()
    every = np.arange(n)
    for left, right in ((np.flatnonzero(home & ~inside), every), (np.flatnonzero(home & inside), np.flatnonzero(~inside))):
        step = max(1, 2_000_000 // max(1, len(right)))
        for i in range(0, len(left) if len(right) else 0, step):
            part = left[i : i + step]
            a, b = np.nonzero(np.bitwise_count(nodes[part][:, None] ^ nodes[right][None, :]) <= distance)
            label = _merge(label, part[a], right[b])
    return label


def _compare(distance: int):
    def run(key, table):
        anchor, home = table.column("anchor").to_numpy(), table.column("home").to_numpy()
        ids, fp = table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        order = np.lexsort((~home, fp, anchor))
        edge = np.flatnonzero(np.diff(anchor[order], prepend=-1, append=1 << 30))
        a, b = [], []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            rows = order[i:j]
            if len(rows) > 1 and home[rows].any():
                rows = rows[np.concatenate([[True], fp[rows][1:] != fp[rows][:-1]])]
                label = link_labels(fp[rows], home[rows], distance)
                joined = np.flatnonzero(label != np.arange(len(rows)))
                a.append(ids[rows[joined]])
                b.append(ids[rows[label[joined]]])
        none = [np.empty(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none), pa.int64()), "b": pa.array(np.concatenate(b or none), pa.int64())})

    return run


#: Most blocks of a hot anchor: of nine, five are equal.
FINEST = 9


def _dealt(blocks: int, weight: np.ndarray) -> tuple[list[int], list[float]]:
    """Masks of the blocks and their weights: the heaviest bit goes to the lightest block, so that each tells fingerprints apart alike."""
    masks, total = [0] * blocks, [0.0] * blocks
    for bit in np.argsort(-weight, kind="stable").tolist():
        k = min(range(blocks), key=lambda k: (total[k], masks[k].bit_count()))
        masks[k] |= 1 << bit
        total[k] += float(weight[bit])
    return masks, total


def block_masks(blocks: int, distance: int, weight: np.ndarray | None = None) -> list[int]:
    """Masks over 64 bits: every choice of so many blocks as ``distance`` differing bits must leave equal."""
    masks, _ = _dealt(blocks, np.ones(64) if weight is None else weight)
    return [sum(c) for c in combinations(masks, blocks - distance)]


def cuts(homes: int, ones: np.ndarray, distance: int, most: int) -> list[int]:
    """The masks by which an anchor's rows meet, from how many of its homes have each bit.

    A bit weighs the binary logarithm of how rarely two homes agree in it; blocks are taken until about ``most`` homes agree in a choice of them.
    """
    share = ones / homes
    weight = -np.log2(share * share + (1 - share) * (1 - share))
    for blocks in range(distance + 1, FINEST + 1):
        lightest = sum(sorted(_dealt(blocks, weight)[1])[: blocks - distance])
        if homes <= most * 2**lightest:
            break
    return block_masks(blocks, distance, weight)


def _cut(distance: int, most: int):
    def run(batches):
        for batch in batches:
            stretch, anchor, homes, ones = (batch.column(k) for k in range(4))
            masks = [np.array(cuts(n, np.array(o), distance, most), np.uint64).view(np.int64) for n, o in zip(homes.to_pylist(), ones.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([stretch, anchor, pa.array(masks, pa.list_(pa.int64()))], ["stretch", "anchor", "masks"])

    return run


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) that join whatever links of at most ``distance`` bits join: a bucket's nodes with the first one of their component in it. nodes: distinct (id, fp)."""
    if distance > 5:
        raise ValueError("three stretches and one bit of slack cover at most 5 bits")
    replicas = stored(nodes.select("id", "fp").mapInArrow(_replicate, "stretch int, anchor int, home boolean, id long, fp long"), "replicas")
    cells = min(12, power_of_two(replicas.count() / 3 / 65536) + 4)
    homes = replicas.where("home")
    count = homes.groupBy("stretch", "anchor").agg(F.count("*").alias("homes")).where(F.col("homes") > MOST)
    ones = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1).cast("long"))) for b in range(64)]
    bits = homes.join(count, ["stretch", "anchor"]).groupBy("stretch", "anchor", "homes").agg(F.array(*ones).alias("ones"))
    hot = bits.select("stretch", "anchor", "homes", "ones").mapInArrow(_cut(distance, MOST), "stretch int, anchor int, masks array<long>")
    r = replicas.join(hot, ["stretch", "anchor"], "left")
    choices = F.transform("masks", lambda m, i: F.struct(i.alias("choice"), F.col("fp").bitwiseAND(m).alias("bits")))
    whole = F.array(F.struct(F.lit(0).alias("choice"), F.lit(0).cast("long").alias("bits")))
    dealt = r.select("stretch", "anchor", "home", "id", "fp", F.col("masks").isNull().alias("is_whole"), F.explode(F.coalesce(choices, whole)).alias("c"))
    # one group is a cell of anchors; parts of hot anchors are groups of their own
    cell = F.col("stretch") * 4096 + F.shiftright(F.col("anchor"), 12 - cells)
    part = F.when(F.col("is_whole"), F.lit(0).cast("long")).otherwise(F.xxhash64("anchor", "c"))
    both = dealt.select("anchor", "home", "id", "fp", cell.alias("cell"), part.alias("part"))
    return both.groupBy("cell", "part").applyInArrow(_compare(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("id"))
    # fingerprints are linked under themselves, so that those of null ids alone link too
    joined = components(links(nodes.select(F.col("fp").alias("id"), "fp"), distance))
    grouped = nodes.join(joined, nodes.fp == joined.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("_group"), "id")
    # stored, so that the join below is between plain shuffles, of which adaptive execution splits a hot fingerprint's
    named = stored(grouped.join(grouped.groupBy("_group").agg(F.min("id").alias("component_id")), "_group").select("_fp", "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
