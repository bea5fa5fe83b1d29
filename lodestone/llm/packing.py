"""Best-fit packing by a configuration linear program over the length histogram.

1. Executors tokenise whole texts, add the end id and cut what is longer than a
   sequence into pieces; only the pieces' ids, lengths and checksums go on.
2. The histogram of lengths, at most ``capacity`` numbers, goes to the driver.
   Lengths from ``small`` on are the program's rows, neighbours with about equal
   tokens as one row of their mean length where there are more than ``groups``; shorter ones fit any room
   and are added at the end, as approximation schemes do. The program asks for
   the fewest sequences whose configurations (multisets of rows that fit) cover the rows. It is solved
   by multiplicative weights: a row's price falls exponentially as it gets covered, and a
   knapsack dynamic program finds the configuration of the highest price. Prices
   are dual solutions, which bound the value from below; the rounds end when the value, freed of what it
   covers twice, is within ``gap`` of that bound. The gap shrinks as rounds go on, so they end.
3. Multiplicities, scaled so that they sum to the bound, are rounded by their running sum. A configuration
   takes from each of its rows the longest length that leaves room for the rest, and at last the best fit; what is
   left over, about the gap's share, and short lengths go by best fit into the room that is left, longest first.
4. The plan lists runs of equally filled sequences, so its size follows the
   number of lengths, not of pieces. It is broadcast; a piece finds its place
   by its rank among pieces of its length, which is computed without bringing
   them together.

Null and empty texts are one end id. Repeated rows are packed each. Ids are whole numbers. Token ids are
those of the vocabulary file whose path is a parameter; its merges run in the
faster of two libraries that hold the same vocabulary, and in the other one for
texts that the faster one refuses (long runs of white space). An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import distributed_rank, stored

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SPECIAL = {"<|endoftext|>": 50256}


def default_vocabulary() -> str:
    """The vocabulary; its ranks for the faster library lie beside it, under the same name with .tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def full_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> np.ndarray:
    """The ids of a text, uint32."""
    try:
        return tokenizer(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its pattern's stack is too small for very long runs
        return np.array(full_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Edges of the pieces of n ids: full ones, after a shorter first one if need be."""
    first = n % capacity or capacity
    return [0, *range(min(first, n), n + 1, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(path, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                edges = cut(len(ids), capacity)
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def length_groups(lengths: np.ndarray, counts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, behind last) positions of at most ``most`` runs of neighbouring lengths with about equal tokens."""
    if len(lengths) <= most:
        return [(k, k + 1) for k in range(len(lengths))]
    tokens = np.cumsum(lengths * counts)
    edges = np.unique(np.searchsorted(tokens, np.linspace(0, tokens[-1], most + 1)[1:-1]) + 1)
    edges = [0, *[int(e) for e in edges if 0 < e < len(lengths)], len(lengths)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each size fill ``capacity`` at the highest price, and that price: unbounded knapsack, sizes ascending.

    Fill levels are computed in blocks as long as the smallest size, within which they don't depend on each other.
    """
    value, block = np.zeros(capacity + 1), int(sizes[0])
    choice = np.full(capacity + 1, -1)
    for c in range(block, capacity + 1, block):
        levels = np.arange(c, min(c + block, capacity + 1))
        before = levels[:, None] - sizes[: bisect.bisect_right(sizes, levels[-1])]
        x = np.where(before >= 0, value[np.maximum(before, 0)] + prices[: before.shape[1]], -1.0)
        best = x.argmax(1)
        own = x[np.arange(len(levels)), best]
        value[levels] = np.maximum(np.maximum.accumulate(own), value[c - 1])
        choice[levels] = np.where(own >= value[levels], best, -1)
    out, c = np.zeros(len(sizes), np.int64), capacity
    while c >= block:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return out, float(value[-1])


def without_excess(a: np.ndarray, times: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Multiplicities lowered as far as they cover ``demand`` still, those of configurations with the most excess first."""
    times, covered = times.copy(), times @ a
    excess = (a * (covered > demand * (1 + 1e-9))).sum(1) / a.sum(1)
    for i in np.argsort(-excess, kind="stable"):
        used = a[i] > 0
        less = min(times[i], max(0.0, float(((covered[used] - demand[used]) / a[i][used]).min())))
        times[i] -= less
        covered -= less * a[i]
    return times


@dataclass(frozen=True)
class Solution:
    """Configurations by row, their multiplicities and the lower bound that the prices prove."""

    configurations: np.ndarray
    times: np.ndarray
    bound: float

    @property
    def value(self) -> float:
        return float(self.times.sum())


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.015, rate: float = 2.0, patience: int = 6) -> Solution:
    """Multiplicative weights, priced by the knapsack, until the value is within ``gap`` of the bound.

    A round takes the best configuration as often as covers one of its rows once more. With ``level`` times
    all rows covered, 1 / level of the sum is a solution, in which rounds that differ by one cover weigh ever
    less; so does the rate at which prices fall. Where ``patience`` looks in a row narrow the gap by less
    than a fiftieth of it, as on a few pieces, the best solution so far is returned; ``Solution`` tells its gap.
    """
    covered, found, bound, rounds = np.zeros(len(sizes)), {}, 0.0, 0
    best, last, stalled = None, np.inf, 0
    while True:
        share = covered / demand
        level = share.min()
        if level > 0 and rounds % (2 * len(sizes) + 50) == 0:
            a, times = np.array([c for c, _ in found.values()]), np.array([n for _, n in found.values()]) / level
            times = without_excess(a, times, demand)
            if best is None or times.sum() < best[1].sum():
                best = a, times
            now = best[1].sum() / bound - 1
            stalled = stalled + 1 if now > 0.98 * last else 0
            last = min(last, now) if stalled == 0 else last
            if now <= gap or stalled >= patience:
                some = best[1] > 0
                return Solution(best[0][some], best[1][some], bound)
        prices = sizes * np.exp(-rate / np.sqrt(1 + level / 10) * (share - level))
        a, worth = best_configuration(sizes, prices, capacity)
        bound = max(bound, float(demand @ prices) / worth)
        used = a > 0
        n = float((demand[used] / a[used]).min())
        covered += a * n
        key = a.tobytes()
        found[key] = (a, found.get(key, (a, 0.0))[1] + n)
        rounds += 1


class Plan:
    """Runs of equally filled sequences: by free room, lists of (number, content); content: (before, length, copies)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.rooms = capacity, {}, []

    def add(self, room: int, number: int, content) -> None:
        if number:
            if room not in self.runs:
                bisect.insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((number, content))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                room, number, content = self.capacity, -(-count // (self.capacity // length)), None
            else:
                room = self.rooms[at]
                number, content = self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room]
                    self.rooms.pop(at)
            copies = room // length
            full = min(number, count // copies)
            self.add(room - length * copies, full, (content, length, copies))
            count, number = count - full * copies, number - full
            if number and count:  # fewer are left than one sequence takes
                part = min(count, copies)
                self.add(room - length * part, 1, (content, length, part))
                count, number = count - part, number - 1
            if content is not None or at < len(self.rooms):
                self.add(room, number, content)

    def segments(self) -> tuple[list[tuple[int, int, int, int]], int]:
        """(length, first rank, first sequence, offset) for every place in a run, and the number of sequences."""
        rank: dict[int, int] = {}
        out, sequence = [], 0
        for room in sorted(self.runs):
            for number, content in self.runs[room]:
                offset = 0
                while content is not None:
                    content, length, copies = content
                    for _ in range(copies):
                        first = rank.get(length, 0)
                        out.append((length, first, sequence, offset))
                        rank[length] = first + number
                        offset += length
                sequence += number
        return out, sequence


    def sequences(self) -> int:
        return sum(number for runs in self.runs.values() for number, _ in runs)


def program(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 96, small: int = 128, **solver) -> tuple[list[list[int]], Solution | None]:
    """The lengths of each row, and the solved program of those from ``small`` on."""
    lengths = np.array(sorted(x for x in histogram if small <= x < capacity and histogram[x]), np.int64)
    if not len(lengths):
        return [], None
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    spans = length_groups(lengths, counts, groups)
    demand = np.array([counts[a:b].sum() for a, b in spans])
    sizes = np.array([-(-int(lengths[a:b] @ counts[a:b]) // int(n)) for (a, b), n in zip(spans, demand, strict=True)])
    return [[int(x) for x in lengths[a:b]] for a, b in spans], configuration_lp(sizes, demand.astype(float), capacity, **solver)


def _longest(pool: list[int], room: int, taken: Counter, left: dict[int, int]) -> int:
    """The longest length of the pool that fits and is left; 0 if there is none."""
    at = bisect.bisect_right(pool, room) - 1
    while at >= 0 and taken[pool[at]] >= left[pool[at]]:
        at -= 1
    return pool[at] if at >= 0 else 0


def _picks(rows: list[int], pools: list[list[int]], every: list[int], left: dict[int, int], capacity: int) -> Counter:
    """Lengths for one sequence of ``rows``, longest first: each the longest that leaves room for the shortest of the rest, the last one the best fit of all."""
    rows = [g for g in rows if pools[g]]
    rest, taken, room = sum(pools[g][0] for g in rows), Counter(), capacity
    for k, g in enumerate(rows):
        rest -= pools[g][0]
        x = _longest(every if k == len(rows) - 1 else pools[g], room - rest, taken, left)
        if x:
            taken[x] += 1
            room -= x
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY, **solver) -> Plan:
    """The program's solution, rounded, and best fit for what it leaves over."""
    left, out = dict(histogram), Plan(capacity)
    out.add(0, left.pop(capacity, 0), (None, capacity, 1))
    pools, solution = program(histogram, capacity, **solver)
    order = np.argsort(-solution.times, kind="stable") if solution else []
    every = sorted(x for x in left if left[x])
    pool_of = {x: pool for pool in pools for x in pool}
    total, scale = 0.0, solution.bound / solution.value if solution else 1.0
    for i in order:
        times = float(solution.times[i]) * scale
        number = int(total + times + 1e-9) - int(total + 1e-9)
        total += times
        rows = [g for g in np.flatnonzero(solution.configurations[i])[::-1].tolist() for _ in range(solution.configurations[i][g])]
        while number:
            taken = _picks(rows, pools, every, left, capacity)
            if not taken:
                break
            copies = min([number, *(left[x] // k for x, k in taken.items())])
            content, room = None, capacity
            for x, k in sorted(taken.items(), reverse=True):
                content, room = (content, x, k), room - x * k
                left[x] -= copies * k
                if not left[x]:
                    for pool in (every, pool_of.get(x)):
                        if pool is not None:
                            pool.remove(x)
            out.add(room, copies, content)
            number -= copies
    for x in sorted(left, reverse=True):
        out.best_fit(x, left[x])
    return out


def report(histogram: dict[int, int], capacity: int = CAPACITY, **solver) -> dict[str, float]:
    """What the program was worth: its value and bound, the bound by tokens, the plan's sequences, and those of best fit alone for comparison."""
    _, solution = program(histogram, capacity, **solver)
    alone = Plan(capacity)
    for x in sorted(histogram, reverse=True):
        alone.best_fit(x, histogram[x])
    whole = histogram.get(capacity, 0)
    return {
        "lp_value": whole + (solution.value if solution else 0.0),
        "lp_bound": whole + (solution.bound if solution else 0.0),
        "tokens_bound": -(-sum(x * n for x, n in histogram.items()) // capacity),
        "sequences": plan(histogram, capacity, **solver).sequences(),
        "best_fit_alone": alone.sequences(),
    }


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs``."""
    cut_up = stored(pieces(docs, id_col, text_col, vocabulary, capacity=capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut_up.groupBy("length").count().collect()}  # at most ``capacity`` rows
    segments, _ = plan(histogram, capacity).segments()
    table = np.array(sorted(segments), np.int64).reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast(((table[:, 0] << 44) + table[:, 1], table))

    def place(batches):
        keys, rows = shared.value
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            arrays = [*(t[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(rows[at, 3])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    cells = max(16, max(histogram.values(), default=0) // 20_000)  # about so many pieces of one length meet in a task
    ranked = distributed_rank(cut_up.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells))), ["length"], "part", ["doc_id", "piece", "ids_crc32", "start"], "rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
