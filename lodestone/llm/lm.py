"""LM scoring: interpolated modified Kneser-Ney bigrams, counted in Spark, kept as sorted hash arrays.

1. Tasks cut texts into words, add one end per text, and send each shard of the
   64-bit bigram hashes its distinct bigrams with counts, as packed arrays. The
   leading bits, which name the shard, come from the first word and a salt of the
   second: a word's bigrams lie close together, yet a frequent word spreads over
   eight shards, and over more as shards grow in number.
2. A shard merges its arrays, writes ``bi-<shard>`` (sorted hashes and counts)
   to the shared folder, and sends what the bigrams say of their words.
3. Word shards merge that into ``word-<shard>`` (sorted hashes; count, distinct
   left neighbours, and as a context: total and how many bigrams have count 1,
   2, 3 or more). Only sums by shard reach the driver: they give the discounts.
4. Scoring tasks memory-map the arrays and look up each slice's distinct
   bigrams in sorted order. At most ``MAPPED`` shards stay mapped.

Null texts are empty: they score their end alone. Repeated rows count as often
as they occur. A null id belongs to the training rows. An empty corpus gives
the uniform model.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import map_array, new_dir, power_of_two, remainder, save_array, shuffle_partitions, stored

BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA41B56C4E9)
#: Tokens that a task gathers before it sends its distinct bigrams.
BLOCK = 2_000_000
#: Shards that a scoring process keeps mapped, two files each; systems allow some 65,000 mappings.
MAPPED = 8192
WORD_FIELDS = ("count", "left", "total", "one", "two", "more")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums: tokens N, distinct tokens V, distinct bigrams, discounts by order."""

    uri: str
    bits: int
    word_bits: int
    tokens: int
    vocabulary: int
    bigrams: int
    discounts: tuple
    word_discounts: tuple
    #: Distinct left neighbours of all words that are left after discounting.
    left_mass: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3+ of the numbers of counts 1 to 4; 0.5, 1, 1.5 where those don't define them."""
    out, default = [], (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if y is not None and n[k - 1] else None
        out.append(d if d is not None and 0 < d < k else default[k - 1])
    return tuple(out)


def sequences(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with each text's end, the token before each (or the begin), and offsets by text."""
    t = tx.Tokens(*tx.buffers(column), tx.WORDS_LOWER)
    word = np.insert(t.hashes(), t.offsets[1:], END)
    offsets = t.offsets + np.arange(len(t.offsets))
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[offsets[:-1]] = BEGIN
    return word, before, offsets


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts key, and where its distinct values begin."""
    order = np.argsort(key)
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def bigram_keys(before: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """64-bit hashes of bigrams whose first ``bits`` bits name the shard."""
    key = tx.pair(before, word)
    if not bits:
        return key
    salts = np.uint64((1 << max(3, bits - 6)) - 1)
    lead = tx.mix(before + (word & salts) * np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64((1 << (64 - bits)) - 1)
    return (lead & ~low) | (key & low)


def _small(counts: np.ndarray) -> np.ndarray:
    most = counts.max(initial=0)
    return counts.astype(np.uint32 if most < 2**32 else np.uint64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, width in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, np.uint64 if width == 8 else np.uint32, size, at))
        at += size * width
    return out


def _bigram_messages(before: np.ndarray, word: np.ndarray, bits: int):
    key = bigram_keys(before, word, bits)
    order, at = _groups(key)
    count = np.diff(np.append(at, len(key))).astype(np.uint32)
    pick = order[at]
    shard = (key[pick] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pick), np.int64)
    edge = np.searchsorted(shard, np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(edge)):
        own = slice(edge[s], edge[s + 1])
        b, w, c = before[pick[own]], word[pick[own]], count[own]
        o, starts = _groups(b)
        yield int(s), _pack(b[o][starts], np.diff(np.append(starts, len(b))).astype(np.uint32), w[o], c[o])


def _count_block(bits: int):
    def run(batches):
        held, size = [], 0

        def flush():
            rows = list(_bigram_messages(np.concatenate([b for b, _ in held]), np.concatenate([w for _, w in held]), bits))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "payload"])

        for batch in batches:
            column = batch.column(0)
            for i, j in tx.row_slices(column):
                word, before, _ = sequences(column.slice(i, j - i))
                held.append((before, word))
                size += len(word)
                if size >= BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _word_messages(word: np.ndarray, before: np.ndarray, count: np.ndarray, word_bits: int):
    """By word shard: for words (hash, count, left) and for contexts (hash, total, one, two, more)."""
    o, at = _groups(word)
    words = [word[o][at], np.add.reduceat(count[o], at), np.diff(np.append(at, len(o)))]
    o, at = _groups(before)
    c = count[o]
    contexts = [before[o][at], np.add.reduceat(c, at), *(np.add.reduceat(x.astype(np.int64), at) for x in (c == 1, c == 2, c > 2))]
    cut = np.arange((1 << word_bits) + 1)
    shard = [(x[0] >> np.uint64(64 - word_bits)).astype(np.int64) if word_bits else np.zeros(len(x[0]), np.int64) for x in (words, contexts)]
    edges = [np.searchsorted(s, cut) for s in shard]
    for s in range(1 << word_bits):
        parts = [[a[e[s] : e[s + 1]] for a in x] for x, e in zip((words, contexts), edges, strict=True)]
        if len(parts[0][0]) or len(parts[1][0]):
            yield s, _pack(*(a if a.dtype == np.uint64 else _small(a) for a in parts[0] + parts[1]))


def _merge_bigrams(uri: str, bits: int, word_bits: int):
    def run(key, table):
        b, w, c = [], [], []
        for raw in table.column("payload"):
            ub, runs, uw, uc = _unpack(raw.as_py())
            b.append(np.repeat(ub, runs))
            w.append(uw)
            c.append(uc)
        b, w, c = np.concatenate(b), np.concatenate(w), np.concatenate(c)
        k = bigram_keys(b, w, bits)
        order, at = _groups(k)
        count = np.add.reduceat(c[order].astype(np.int64), at)
        first = order[at]
        save_array(uri, f"bi-{key[0].as_py():05d}.key", k[first])
        save_array(uri, f"bi-{key[0].as_py():05d}.count", count.astype(np.min_scalar_type(count.max())))
        n = [int((count == i).sum()) for i in (1, 2, 3, 4)]
        rows = list(_word_messages(w[first], b[first], count, word_bits))
        own = {"bigram_shard": pa.array([key[0].as_py()] + [None] * (len(rows) - 1), pa.int32()), "bigrams": pa.array([len(first)] + [None] * (len(rows) - 1), pa.int64())}
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())} | own | {f"n{i + 1}": pa.array([v] + [0] * (len(rows) - 1), pa.int64()) for i, v in enumerate(n)})

    return run


def _merge_words(uri: str):
    def run(key, table):
        parts = [_unpack(raw.as_py()) for raw in table.column("payload")]
        words = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        contexts = [np.concatenate([p[i] for p in parts]) for i in range(3, 8)]
        every = np.unique(np.concatenate([words[0], contexts[0]]))
        stats = np.zeros((len(every), 6), np.int64)
        for columns, fields in ((words, (0, 1)), (contexts, (2, 3, 4, 5))):
            at = np.searchsorted(every, columns[0])
            for values, f in zip(columns[1:], fields, strict=True):
                stats[:, f] = np.bincount(at, values.astype(np.float64), len(every)).astype(np.int64)
        save_array(uri, f"word-{key[0].as_py():05d}.key", every)
        save_array(uri, f"word-{key[0].as_py():05d}.stats", _small(stats))
        left = stats[:, 1]
        sums = [int(stats[:, 0].sum()), int((stats[:, 0] > 0).sum()), int(left.sum()), *(int((left == i).sum()) for i in (1, 2, 3, 4))]
        bigrams = [(a.as_py(), n.as_py()) for a, n in zip(table.column("bigram_shard"), table.column("bigrams"), strict=True) if a.is_valid]
        written = [{"kind": "word", "shard": key[0].as_py(), "keys": len(every)}, *({"kind": "bi", "shard": a, "keys": n} for a, n in bigrams)]
        return pa.table({"written": pa.array([written], pa.list_(pa.struct([("kind", pa.string()), ("shard", pa.int32()), ("keys", pa.int64())])))} | {f"s{i}": pa.array([v], pa.int64()) for i, v in enumerate(sums)} | {f"n{i}": pa.array([sum(x.as_py() for x in table.column(f"n{i}"))], pa.int64()) for i in (1, 2, 3, 4)})

    return run


def fit(docs: DataFrame, text_col: str = "text", rows_per_shard: int = 4000) -> Model:
    """Count ``docs`` and write the model to the shared folder. Shards follow the number of rows."""
    spark = docs.sparkSession
    bits = power_of_two(max(docs.count() / rows_per_shard, 2 * shuffle_partitions(spark)))
    word_bits = max(min(bits, 7), bits - 2)
    uri = new_dir(spark, "lm")
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_block(bits), "shard int, payload binary")
    numbers = ", ".join(f"n{i} long" for i in (1, 2, 3, 4))
    words = counted.groupBy("shard").applyInArrow(_merge_bigrams(uri, bits, word_bits), f"shard int, payload binary, bigram_shard int, bigrams long, {numbers}")
    sums = stored(words.groupBy("shard").applyInArrow(_merge_words(uri), "written array<struct<kind:string,shard:int,keys:long>>, " + ", ".join(f"s{i} long" for i in range(7)) + f", {numbers}"), "lm-sums")
    total = [x or 0 for x in sums.agg(*[F.sum(c) for c in sums.columns if c != "written"]).first()]
    # what was written: two numbers a shard, and a shard is some thousands of rows
    written = sums.select(F.explode("written").alias("w")).select("w.*").toPandas()
    for kind in ("word", "bi"):
        own = written[written["kind"] == kind].sort_values("shard")
        save_array(uri, f"{kind}-written", np.ascontiguousarray(own[["shard", "keys"]].to_numpy(np.int64)))
    d = discounts(total[3:7])
    more = total[1] - total[3] - total[4]  # words with three or more left neighbours
    left_mass = total[2] - d[0] * total[3] - d[1] * total[4] - d[2] * more
    return Model(uri, bits, word_bits, total[0], total[1], total[2], discounts(total[7:11]), d, left_mass)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row's whole text."""
    schema = docs.select(id_col).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    id_type = to_arrow_schema(schema).field(0).type

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for i, j in tx.row_slices(column, 4 << 20):
                out = score_column(model, column.slice(i, j - i))
                arrays = [ids.slice(i, j - i).cast(id_type), *(pa.array(out[k], pa.int64()) for k in ("n_tokens", "n_known")), *(pa.array(out[k], pa.float64()) for k in ("base_score", "score"))]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_tokens", "n_known", "base_score", "score"])

    fields = f"`{id_col}` {schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def score_held_out(docs: DataFrame, divisor: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows whose crc32(id) mod ``divisor`` is not ``held_out`` and score all."""
    fold = remainder(id_col, divisor)
    model = fit(docs.where(fold != held_out), text_col)
    return score(docs, model, id_col, text_col).select(
        id_col, (fold == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@lru_cache(maxsize=4)
def _files(model: str) -> OrderedDict:
    return OrderedDict()


@lru_cache(maxsize=8)
def _written(uri: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The shards that were written, and how many keys each has."""
    rows = np.array(map_array(uri, f"{kind}-written"))
    return rows[:, 0], rows[:, 1]


def _mapped(model: Model, kind: str, value: str, shard: int) -> tuple[np.ndarray, np.ndarray] | None:
    """A shard's keys and values; None if no training row had a hash in it. A file that is lost or cut is an error."""
    shards, sizes = _written(model.uri, kind)
    p = int(np.searchsorted(shards, shard))
    if p == len(shards) or shards[p] != shard:
        return None
    name = f"{kind}-{shard:05d}"
    keys, values = map_array(model.uri, f"{name}.key"), map_array(model.uri, f"{name}.{value}")
    if not len(keys) == len(values) == sizes[p]:
        raise ValueError(f"{model.uri}/{name} has {len(keys)} keys and {len(values)} values, not {sizes[p]}")
    return keys, values


def _find(model: Model, kind: str, value: str, bits: int, keys: np.ndarray, width: tuple) -> np.ndarray:
    """Values of sorted ``keys`` from the mapped shards; 0 where a key is absent."""
    files = _files(json.dumps(asdict(model)))
    out = np.zeros((len(keys), *width), np.int64)
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else []
    for i, j in zip(at, np.append(at[1:], len(keys)), strict=True):
        name = f"{kind}-{shard[i]:05d}"
        if name not in files:
            files[name] = _mapped(model, kind, value, int(shard[i]))
            if len(files) > MAPPED:
                files.popitem(last=False)
        files.move_to_end(name)
        if files[name] is not None:
            sorted_keys, values = files[name]
            p = np.minimum(np.searchsorted(sorted_keys, keys[i:j]), len(sorted_keys) - 1)
            hit = sorted_keys[p] == keys[i:j]
            out[i:j][hit] = values[p[hit]]
    return out


def _discounted(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def score_column(model: Model, column) -> dict[str, np.ndarray]:
    """By text: tokens, known tokens, base and model log10 probabilities."""
    word, before, offsets = sequences(column)
    words, where = np.unique(np.concatenate([word, before]), return_inverse=True)
    stats = _find(model, "word", "stats", model.word_bits, words, (6,))
    key, pick, back = np.unique(bigram_keys(before, word, model.bits), return_index=True, return_inverse=True)
    count = _find(model, "bi", "count", model.bits, key, ())
    w, b = stats[where[pick]], stats[where[len(word) + pick]]
    uniform = 1.0 / (model.vocabulary + 1)
    # one word: distinct left neighbours, discounted, the rest uniform over the words and one unknown
    left = stats[:, 1]
    if model.bigrams:
        rest = 1.0 - model.left_mass / model.bigrams
        unigram = _discounted(left, model.word_discounts) / model.bigrams + rest * uniform
    else:
        unigram = np.full(len(left), uniform)
    d, total = model.discounts, b[:, 2]
    seen = total > 0
    divisor = np.maximum(total, 1)
    back_off = np.where(seen, (d[0] * b[:, 3] + d[1] * b[:, 4] + d[2] * b[:, 5]) / divisor, 1.0)
    p = np.where(seen, _discounted(count, d) / divisor, 0.0) + back_off * unigram[where[pick]]
    c = w[:, 0]
    base = np.log10((c + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
    return {
        "n_tokens": np.diff(offsets),
        "n_known": tx.sums((c > 0)[back], offsets),
        "base_score": np.add.reduceat(base[back], offsets[:-1]) if len(word) else np.zeros(0),
        "score": np.add.reduceat(np.log10(p)[back], offsets[:-1]) if len(word) else np.zeros(0),
    }
