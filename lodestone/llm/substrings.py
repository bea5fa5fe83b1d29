"""Suffix-array dedup: bytes covered by a 50-byte string that a document with a smaller id also has.

1. Rows are dealt into buckets by their hash; this is the one shuffle of texts,
   whose output all steps read. Every 50-byte string picks an anchor, the 20-byte
   string in it of the least hash, so equal strings pick equal anchors. A bucket
   tells each shard its distinct anchors by short hashes, and the shard answers
   which of them other documents have. This only leaves out what cannot repeat: a
   hash that two anchors share costs work and changes no result.
2. The strings of one place's anchor make a context of 50 to 80 bytes. A bucket
   sends the bytes of the contexts of those anchors, equal ones once, to the
   anchors' shards. An anchor that more than ``hot`` places have is dealt by its
   strings instead, so that a frequent phrase spreads.
3. A shard brings equal contexts together, compared byte by byte. That already
   decides them: all strings of a context that several documents have are repeats
   for all but its smallest id, and no array is built to say so. Contexts of one
   anchor that differ are laid one after the other as a text of 8-byte letters,
   of which those are kept that one has in common with another, and the suffix
   array of every text is built. A 50-byte string holds five whole letters;
   suffixes with equal first five, now neighbours, are a run. A string is a
   repeat if its run holds it for a smaller id; the bytes beside the five
   letters are compared.
4. Repeats go back to their bucket, where a document drops their union.

The suffix array is built by linear grouping: suffixes are grouped by their
Lyndon prefix, groups are taken in descending order, each member's previous
smaller suffix moves to a group above its own, and at the end every group is
put in order from its members' pointers, without renaming and recursion. Small
texts take their steps at the same time, in numpy.

Bytes decide: whatever hashes bring together is compared. Matches never cross
documents. Null and empty texts have no bytes; texts under 50 bytes lose none.
Ids are whole numbers. Rows of one id, repeated rows among them, never remove each
other's bytes and get a result each. A null id is larger than any id. An empty
table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import power_of_two, shuffle_partitions

LENGTH, ANCHOR, LETTER = 50, 20, 8
#: Contexts are laid out so that their anchors start in one column.
COLUMN, WIDTH = LENGTH - ANCHOR, 2 * LENGTH - ANCHOR
PLACES = LENGTH - ANCHOR + 1
#: Whole letters that any string of LENGTH bytes holds, and how many bytes of it these are not.
WHOLE = (LENGTH - LETTER + 1) // LETTER
REST = LENGTH - WHOLE * LETTER
NO_ID = (1 << 63) - 1
#: Bits of an anchor's hash, beside those that name the shard, that buckets and shards exchange.
TAIL = 24
#: Longest text of the lockstep construction, and the symbols that it takes at once.
LOCKSTEP, BATCH = 320, 400_000


def suffix_array(text: np.ndarray) -> list[int]:
    """The sorted suffixes of a text (values from 1), by grouping along Lyndon prefixes."""
    s = array("i", (text + 1).astype(np.int32).tobytes()) + array("i", [0])
    n = len(s)
    # groups as a list linked from high to low, at first one for each value
    below: dict[int, int] = {}
    above: dict[int, int] = {}
    members: list[list[int]] = [[] for _ in range(max(s) + 1)]
    for i, c in enumerate(s):
        members[c].append(i)
    used = [c for c in range(len(members)) if members[c]]
    for a, b in zip(used, used[1:], strict=False):
        below[b], above[a] = a, b
    group = s[:]
    final = [False] * len(members)
    previous = array("i", [-1]) * n
    g: int | None = used[-1]
    while g is not None:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0:
                k = group[p]
                if k == g:
                    p = previous[p]
                    break
                if not final[k]:
                    break
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        final[g] = True
        if times:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moved.setdefault((group[p], k), []).append(p)
            for (old, k), ps in sorted(moved.items(), key=lambda x: -x[0][1]):
                # inserted from the highest count down, each directly above its old group
                new = len(members)
                members.append(ps)
                final.append(False)
                up = above.get(old)
                below[new], above[old] = old, new
                if up is not None:
                    below[up], above[new] = new, up
                for p in ps:
                    group[p] = new
        g = below.get(g)
    # from the lowest group up
    at, g = 0, used[0]
    first = [0] * len(members)
    while g is not None:
        first[g] = at
        at += len(members[g]) if final[g] else 0
        g = above.get(g)
    members.clear()
    out, placed = array("i", [-1]) * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            out[first[group[p]]] = p
            first[group[p]] += 1
            placed[p] = 1
            p = previous[p]
    return out[1:].tolist()


def _dense(key: np.ndarray) -> np.ndarray:
    """Each row's values by rank from 0; equal ones share a rank."""
    order = np.argsort(key, axis=1)
    s = np.take_along_axis(key, order, 1)
    rank = np.zeros_like(key)
    np.cumsum(s[:, 1:] != s[:, :-1], axis=1, out=rank[:, 1:])
    out = np.empty_like(key)
    np.put_along_axis(out, order, rank, 1)
    return out


def _lyndon_groups(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position of each row: a key that orders the groups by Lyndon prefix, and the previous smaller suffix.

    text: values from 1, then one 0, then -1. A key is the value and, for every step in which the
    position was pointed to, how often: steps descend, so that is the order of the groups.
    """
    m, w = text.shape
    keys, pointers = np.empty((m, w), np.int64), np.full((m, w), -1)
    rows = np.arange(m)  # those still at work
    key = _dense(text)
    bits = int(w).bit_length()
    final, pad, previous = text < 1, text < 0, np.full((m, w), -1)
    while True:
        current = np.where(final, -1, key)
        highest = current.max(1)
        done = highest < 0
        if done.sum() * 4 > len(done):
            keys[rows[done]], pointers[rows[done]] = np.where(pad, -1, key)[done], previous[done]
            if done.all():
                return keys, pointers
            go = ~done
            rows, key, final, pad, previous, current, highest = rows[go], key[go], final[go], pad[go], previous[go], current[go], highest[go]
        member = (current == highest[:, None]) & ~final
        where = np.flatnonzero(member)
        base = where - where % w
        p = where - base - 1
        flat_final, flat_member, flat_previous = final.reshape(-1), member.reshape(-1), previous.reshape(-1)
        walk = np.flatnonzero(p >= 0)
        while len(walk):  # over what is larger
            walk = walk[flat_final[base[walk] + p[walk]]]
            p[walk] = flat_previous[base[walk] + p[walk]]
            walk = walk[p[walk] >= 0]
        flat_previous[where] = p
        walk = np.flatnonzero(p >= 0)
        walk = walk[flat_member[base[walk] + p[walk]]]
        while len(walk):  # a member of the same group has the same one
            p[walk] = flat_previous[base[walk] + p[walk]]
            flat_previous[where[walk]] = p[walk]
            walk = walk[p[walk] >= 0]
            walk = walk[flat_member[base[walk] + p[walk]]]
        flat_final[where] = True
        hit = p >= 0
        times = np.bincount((base + p)[hit], minlength=key.size)
        more = int(times.max()).bit_length()
        if more:
            if bits + more > 62:
                key, bits = _dense(key), int(w).bit_length()
            key = (key << more) | times.reshape(key.shape)
            bits += more


def _lockstep(text: np.ndarray) -> np.ndarray:
    """Suffix arrays of the rows of ``text`` (values from 1, one 0, then -1), -1 behind a row's end."""
    m, w = text.shape
    key, previous = _lyndon_groups(text)
    size = (text >= 0).sum(1)
    key = np.where(text < 0, np.iinfo(np.int64).max, key)
    order = np.argsort(key, axis=1)
    s = np.take_along_axis(key, order, 1)
    start = np.zeros((m, w), np.int64)
    start[:, 1:] = np.maximum.accumulate(np.where(s[:, 1:] != s[:, :-1], np.arange(1, w), 0), axis=1)
    first = np.empty((m, w), np.int64)
    np.put_along_axis(first, order, start, 1)  # of each position's group
    base = np.arange(m) * w
    first, previous, placed = (first + base[:, None]).reshape(-1), previous.reshape(-1), np.zeros(m * w, bool)
    free = np.zeros(m * w, np.int64)  # members placed, by the group's first place
    out = np.full(m * w, -1)
    out[base] = size - 1
    placed[base + size - 1] = True
    for i in range(w):
        rows = base[size > i]
        p = out[rows + i] - 1
        while True:
            keep = p >= 0
            rows, p = rows[keep], p[keep]
            keep = ~placed[rows + p]
            rows, p = rows[keep], p[keep]
            if not len(rows):
                break
            g = first[rows + p]
            out[g + free[g]] = p
            free[g] += 1
            placed[rows + p] = True
            p = previous[rows + p]
    return out.reshape(m, w)


def suffix_arrays(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts, each of values from 1 and one 0 at its end, as positions in ``text``."""
    size = np.diff(offsets)
    out = np.empty(len(text), np.int64)
    less, w = 0, 16
    while True:
        own = np.flatnonzero((size > less) & (size <= w))
        for i in range(0, len(own), max(1, BATCH // w)):
            t = own[i : i + max(1, BATCH // w)]
            inside = np.arange(w) < size[t][:, None]
            where = (offsets[t][:, None] + np.arange(w))[inside]
            rows = np.full((len(t), w), -1, np.int64)
            rows[inside] = text[where]
            out[where] = (_lockstep(rows) + offsets[t][:, None])[inside]
        if w >= LOCKSTEP:
            break
        less, w = w, w * 4 // 3
    for t in np.flatnonzero(size > w).tolist():
        a, b = offsets[t], offsets[t + 1]
        out[a] = b - 1
        out[a + 1 : b] = np.array(suffix_array(text[a : b - 1])) + a
    return out


def _anchored(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(data)
    nothing = (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 4
    if n < LENGTH:
        return nothing
    prefix = tx.prefix_hashes(data)
    at = np.arange(n - ANCHOR + 1)
    h = tx.span_hashes(prefix, at, at + ANCHOR)
    bits = np.uint64(max(20, n.bit_length()))
    low, span = (h >> bits << bits) | at.astype(np.uint64), 1
    while span * 2 <= PLACES:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[PLACES - span : PLACES - span + n - LENGTH + 1])
    pick = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(n - LENGTH + 1)
    row = np.searchsorted(off, start, "right") - 1
    good = np.flatnonzero(start + LENGTH <= off[row + 1])
    if not len(good):
        return nothing
    cut = np.flatnonzero(np.concatenate([[True], (pick[good][1:] != pick[good][:-1]) | (np.diff(good) > 1)]))
    a, b = good[cut], good[np.append(cut[1:], len(good)) - 1]
    context = tx.pair(tx.span_hashes(prefix, a, b + LENGTH), (pick[a] - a).astype(np.uint64))
    # least hashes are small ones: mixed again, they spread evenly over the shards
    return tx.mix(h[pick[a]]), context, row[a], a, b, pick[a]


def anchored(data: np.ndarray, off: np.ndarray, window: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """By context: anchor hash, context hash, row, first start and last start of its strings, the anchor (positions in data).

    Long data is taken in windows, which bounds the memory; a window reads a context's most starts on
    either side and keeps the contexts that begin in it, so the cuts show in no result.
    """
    parts = []
    for s in range(0, max(1, len(data)), window):
        low, high = max(0, s - PLACES), min(len(data), s + window + PLACES + LENGTH)
        inside = np.clip(off, low, high) - low
        h, context, row, a, b, p = _anchored(data[low:high], inside)
        own = (a + low >= s) & (a + low < s + window)
        parts.append((h[own], context[own], row[own], a[own] + low, b[own] + low, p[own] + low))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Message:
    """Named integer columns, stored byte by byte so that they compress, and one run of bytes."""

    @staticmethod
    def pack(raw: bytes = b"", **columns: tuple[np.ndarray, int]) -> bytes:
        head = np.array([len(raw), *(len(a) for a, _ in columns.values())], "<i8").tobytes()
        planes = (a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for a, width in columns.values())
        return b"".join([head, *planes, raw])

    @staticmethod
    def unpack(message: memoryview, **widths: int) -> tuple[dict[str, np.ndarray], memoryview]:
        sizes = np.frombuffer(message, "<i8", 1 + len(widths)).tolist()
        at, out = 8 * len(sizes), {}
        for (name, width), n in zip(widths.items(), sizes[1:], strict=True):
            full = np.zeros((n, 8), np.uint8)
            full[:, :width] = np.frombuffer(message, np.uint8, n * width, at).reshape(width, n).T
            out[name] = full.view("<i8")[:, 0]
            at += n * width
        return out, message[at : at + sizes[0]]


ANCHORS = {"anchor": 3, "count": 1}
WANTED = {"anchor": 3, "hot": 1}
CONTEXTS = {"column": 1, "size": 1, "places": 3, "row": 3, "start": 4, "rows": 3, "docs": 8}
REPEATS = {"row": 3, "start": 4, "size": 1}
MESSAGE = "{} int, {} int, payload binary"


def _messages(to: str, by: str, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip((to, by, "payload"), columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)})


def _edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and those and the end."""
    at = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.empty(0, np.int64)
    return at, np.append(at, len(sorted_values))


def _in_order(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """A bucket's ids and texts in an order that does not depend on how its rows came in."""
    table = table.sort_by([("doc", "ascending"), ("rid", "ascending")])
    return table.column("doc").to_numpy(), table.column("text").combine_chunks().cast(pa.large_string())


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of an anchor's hash that name its shard, and TAIL more."""
    return (h >> np.uint64(64 - bits - TAIL)).astype(np.int64)


def _tell(bits: int):
    """A bucket's distinct anchors to their shards; a count is at most 127, and has 128 added where several ids have the anchor."""

    def run(key, table):
        doc, text = _in_order(table)
        anchors, docs = [], []
        for i, j in tx.row_slices(text, 1 << 19):
            h, _, row, *_ = anchored(*tx.buffers(text.slice(i, j - i)))
            anchors.append(_short(h, bits))
            docs.append(doc[i + row])
        h, d = np.concatenate(anchors or [np.empty(0, np.int64)]), np.concatenate(docs or [np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")  # ids ascend within an anchor
        h, d = h[order], d[order]
        at, ends = _edges(h)
        count = np.minimum(np.diff(ends), 127) + 128 * (d[at] != d[ends[1:] - 1])
        shard, tail = h[at] >> TAIL, h[at] & ((1 << TAIL) - 1)
        first, ends = _edges(shard)
        return _messages("shard", "bucket", [(int(shard[a]), key[0].as_py(), Message.pack(anchor=(tail[a:b], 3), count=(count[a:b], 1))) for a, b in zip(first, ends[1:], strict=True)])

    return run


def _answer(hot: int):
    """The anchors that several ids have, to each bucket its own; with 1 those in more than ``hot`` places."""

    def run(key, table):
        buckets = table.column("bucket").to_pylist()
        parts = [Message.unpack(memoryview(p.as_py()), **ANCHORS)[0] for p in table.column("payload")]
        sizes = [len(p["anchor"]) for p in parts]
        anchor, count = (np.concatenate([p[c] for p in parts]) for c in ("anchor", "count"))
        order = np.argsort(anchor, kind="stable")
        at, ends = _edges(anchor[order])
        several = (np.diff(ends) > 1) | (count[order][at] >= 128)
        frequent = np.add.reduceat(count[order] & 127, at) > hot
        flag = np.empty(len(anchor), np.int64)
        flag[order] = np.repeat(np.where(several, 1 + frequent, 0), np.diff(ends))
        rows, begin = [], 0
        for bucket, size in zip(buckets, sizes, strict=True):
            own = slice(begin, begin + size)
            begin += size
            pick = np.flatnonzero(flag[own])
            if len(pick):
                rows.append((bucket, key[0].as_py(), Message.pack(anchor=(anchor[own][pick], 3), hot=(flag[own][pick] - 1, 1))))
        return _messages("bucket", "shard", rows)

    return run


def _laid_out(data: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Contexts (first and last start, anchor) as rows of WIDTH bytes, 0 beside them."""
    column = np.arange(WIDTH)
    first = COLUMN - (p - a)
    inside = (column >= first[:, None]) & (column < (first + b - a + LENGTH)[:, None])
    return np.where(inside, data[np.clip((p - COLUMN)[:, None] + column, 0, max(0, len(data) - 1))], 0).astype(np.uint8)


def _same(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number by row): equal rows share a number; keys bring them together and the bytes decide."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    other = np.flatnonzero((rows[first[number]] != rows).any(axis=1))
    if len(other):  # one key for different bytes
        value = np.array([rows[k].tobytes() for k in other], object)
        _, f, n = np.unique(value, return_index=True, return_inverse=True)
        number[other] = len(first) + n
        first = np.concatenate([first, other[f]])
    return first, number


def _send(bits: int):
    """A bucket's contexts of wanted anchors to their shards: bytes, where they lie, and the ids of their rows."""

    def run(key, table, wanted):
        bucket = key[0].as_py()
        if not wanted.num_rows or not table.num_rows:
            return _messages("shard", "bucket", [])
        told = [Message.unpack(memoryview(p.as_py()), **WANTED)[0] for p in wanted.column("payload")]
        keys = np.concatenate([(s << TAIL) + t["anchor"] for s, t in zip(wanted.column("shard").to_pylist(), told, strict=True)])
        order = np.argsort(keys)
        keys, hot = keys[order], np.concatenate([t["hot"] for t in told])[order]
        doc, text = _in_order(table)
        shard, rows, column, hashes, own, start = [], [], [], [], [], []
        for i, j in tx.row_slices(text, 1 << 19):
            data, off = tx.buffers(text.slice(i, j - i))
            h, context, row, a, b, p = anchored(data, off)
            short = _short(h, bits)
            at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            hit = keys[at] == short
            for dealt in (0, 1):
                k = np.flatnonzero(hit & (hot[at] == dealt))
                if not len(k):
                    continue
                if dealt:  # string by string
                    n = (b - a + 1)[k]
                    again = np.repeat(k, n)
                    first = a[again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    prefix = tx.prefix_hashes(data)
                    mixed = tx.pair(tx.span_hashes(prefix, first, first + LENGTH), (p[again] - first).astype(np.uint64))
                    k, first, last, to = again, first, first, (tx.mix(mixed) >> np.uint64(64 - bits)).astype(np.int64)
                else:
                    first, last, mixed, to = a[k], b[k], context[k], short[k] >> TAIL
                shard.append(to)
                rows.append(_laid_out(data, first, last, p[k]))
                column.append(np.stack([COLUMN - p[k] + first, last - first + LENGTH + 128 * dealt], 1))
                hashes.append(tx.pair(h[k], mixed))
                own.append(i + row[k])
                start.append(first - off[row[k]])
        if not shard:
            return _messages("shard", "bucket", [])
        shard, rows, column, hashes, own, start = (np.concatenate(x) for x in (shard, rows, column, hashes, own, start))
        first, number = _same(hashes, np.concatenate([rows, column.astype(np.uint8)], axis=1))
        by_shard = np.argsort(shard[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[by_shard] = np.arange(len(first))
        number, first = place[number], first[by_shard]
        by_context = np.argsort(number, kind="stable")
        own, start, times = own[by_context], start[by_context], np.bincount(number, minlength=len(first))
        ends = np.concatenate([[0], np.cumsum(times)])
        inside = np.arange(WIDTH) - column[first, :1]
        inside = (inside >= 0) & (inside < (column[first, 1:] & 127))
        at, edges = _edges(shard[first])
        codec, out = pa.Codec("zstd", 1), []
        for x, y in zip(at, edges[1:], strict=True):
            lines, local = np.unique(own[ends[x] : ends[y]], return_inverse=True)
            raw = rows[first[x:y]][inside[x:y]].tobytes()
            c = column[first[x:y]]
            columns = {"column": c[:, 0], "size": c[:, 1], "places": times[x:y], "row": local, "start": start[ends[x] : ends[y]], "rows": lines, "docs": doc[lines]}
            out.append((int(shard[first[x]]), bucket, Message.pack(codec.compress(raw, asbytes=True), **{n: (v, CONTEXTS[n]) for n, v in columns.items()})))
        return _messages("shard", "bucket", out)

    return run


def _received(payloads) -> dict[str, np.ndarray]:
    """All messages' contexts (rows, column, size, hot) and places (context, message, row, start, doc)."""
    codec, rows, parts, contexts = pa.Codec("zstd", 1), [], [], 0
    for m, p in enumerate(payloads):
        t, raw = Message.unpack(memoryview(p.as_py()), **CONTEXTS)
        hot, size = t["size"] >> 7, t["size"] & 127
        data = np.frombuffer(codec.decompress(raw, int(size.sum()), asbytes=True), np.uint8)
        column = np.arange(WIDTH) - t["column"][:, None]
        laid = np.zeros(column.shape, np.uint8)
        laid[(column >= 0) & (column < size[:, None])] = data
        rows.append(laid)
        context = contexts + np.repeat(np.arange(len(size)), t["places"])
        contexts += len(size)
        parts.append({"column": t["column"], "size": size, "hot": hot, "context": context, "message": np.full(len(context), m), "row": t["rows"][t["row"]], "start": t["start"], "doc": t["docs"][t["row"]]})
    return {"rows": np.concatenate(rows)} | {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _row_hash(words: np.ndarray) -> np.ndarray:
    h = np.full(len(words), 7, np.uint64)
    for k in range(words.shape[1]):
        h = tx.pair(h, words[:, k])
    return h


def _shared_letters(letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context: the stretch of letters in which it shares five with another one, by their hash; 0, 0 where it shares none."""
    who, at, keys = [], [], []
    for c in range(WIDTH // LETTER - WHOLE + 1):
        k = np.flatnonzero((c >= a) & (c + WHOLE <= b))
        who.append(k)
        at.append(np.full(len(k), c))
        keys.append(_row_hash(letters[k, c : c + WHOLE]))
    _, number, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hit = times[number] > 1
    who, at = np.concatenate(who)[hit], np.concatenate(at)[hit]
    first, last = np.full(len(letters), WIDTH), np.zeros(len(letters), np.int64)
    np.minimum.at(first, who, at)
    np.maximum.at(last, who, at + WHOLE)
    return np.minimum(first, last), last


def _runs(letters: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By row of letters (from a to b) and letter: a number that rows of one group share where five letters from there are equal; -1 where fewer follow. group: ascending."""
    n = len(letters)
    # texts: the letters and a 1 behind each row, a 0 behind the last of a group
    width = b - a + 1
    begin = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(n), width)
    letter = np.arange(len(owner)) - begin[owner] + a[owner]
    inside = letter < b[owner]
    text = np.ones(len(owner), np.int64)
    text[inside] = np.unique(letters[owner[inside], letter[inside]], return_inverse=True)[1] + 2
    heads, ends = _edges(group)
    text[begin[ends[1:]] - 1] = 0
    order = suffix_arrays(text, begin[np.append(heads, n)])
    order = order[(letter + WHOLE <= b[owner])[order]]
    out = np.full((n, WIDTH // LETTER), -1)
    if len(order):  # neighbours with equal first letters are a run
        first = text[order[:, None] + np.arange(WHOLE)]
        o = owner[order]
        out[o, letter[order]] = np.cumsum(np.concatenate([[True], (first[1:] != first[:-1]).any(axis=1) | (group[o[1:]] != group[o[:-1]])]))
    return out


def _strings(column: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By context and column: does a string of the context begin there?"""
    return (np.arange(PLACES) >= column[:, None]) & (np.arange(PLACES) <= (column + size - LENGTH)[:, None])


#: By a string's first column: its first whole letter.
_FIRST_LETTER = -(-np.arange(PLACES) // LETTER)


def among(rows: np.ndarray, column: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which strings of contexts repeat one of a smaller id in another context of their group. a, b: the letters to compare; equal ones are laid out once."""
    letters = np.where((np.arange(WIDTH // LETTER) >= a[:, None]) & (np.arange(WIDTH // LETTER) < b[:, None]), rows.view("<u8"), 0).astype("<u8")
    shape = np.stack([group, a, b], 1).astype("<u8")
    first, number = _same(_row_hash(np.concatenate([letters, shape], axis=1)), np.concatenate([letters, shape], axis=1))
    order = np.argsort(group[first], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    run_of = _runs(letters[first[order]], a[first[order]], b[first[order]], group[first[order]])[place[number]]
    covered = np.zeros((len(rows), PLACES), bool)
    o, c = np.nonzero(run_of >= 0)
    run = run_of[o, c]
    # runs of several smallest ids: compare what is beside the letters
    low, high = np.full(run.max(initial=0) + 1, NO_ID), np.full(run.max(initial=0) + 1, -NO_ID - 1)
    np.minimum.at(low, run, doc[o])
    np.maximum.at(high, run, doc[o])
    pick = np.flatnonzero((low < high)[run])
    k, place = np.nonzero(_strings(column, size)[o[pick]] & (_FIRST_LETTER == c[pick][:, None]))
    if not len(k):
        return covered
    who, r = o[pick][k], run[pick][k]
    string = rows[who[:, None], place[:, None] + np.arange(LENGTH)]
    rest, before = np.arange(REST), (c[pick][k] * LETTER - place)[:, None]
    beside = np.zeros((len(k), 16), np.uint8)
    beside[:, :REST] = np.take_along_axis(string, np.where(rest < before, rest, rest + WHOLE * LETTER), 1)
    _, number = _same(tx.pair(_row_hash(beside.view("<u8")), (r * LETTER + before[:, 0]).astype(np.uint64)), string)
    by = np.lexsort((doc[who], number))
    at, ends = _edges(number[by])
    least = np.repeat(doc[who][by][at], np.diff(ends))
    hit = by[doc[who][by] > least]
    covered[who[hit], place[hit]] = True
    return covered


def _find(key, table):
    """One shard's repeats, to the buckets of their rows."""
    t = _received(table.column("payload"))
    rows = np.ascontiguousarray(t["rows"])
    words = rows.view("<u8")
    shape = np.stack([t["column"], t["size"], t["hot"]], 1).astype(np.uint8)
    first, number = _same(tx.pair(_row_hash(words), (t["column"] * 1024 + t["size"] * 2 + t["hot"]).astype(np.uint64)), np.concatenate([rows, shape], axis=1))
    context, doc = number[t["context"]], t["doc"]
    least, most = np.full(len(first), NO_ID), np.full(len(first), -NO_ID - 1)
    np.minimum.at(least, context, doc)
    np.maximum.at(most, context, doc)
    rows, words, column, size, hot = rows[first], words[first], t["column"][first], t["size"][first], t["hot"][first]
    # contexts of one anchor are a group, and of a frequent one those of one string
    anchor = rows[:, COLUMN : COLUMN + ANCHOR].copy()
    wide = np.zeros((len(rows), 24), np.uint8)
    wide[:, :ANCHOR] = anchor
    group = np.where(hot == 1, _row_hash(words), _row_hash(wide.view("<u8")))
    _, group = np.unique(group, return_inverse=True)
    low, high = np.full(group.max() + 1, NO_ID), np.full(group.max() + 1, -NO_ID - 1)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, most)
    one = np.flatnonzero((low < high)[group])
    a, b = _shared_letters(words[one], -(-column[one] // LETTER), (column[one] + size[one]) // LETTER)
    low[:], high[:] = NO_ID, -NO_ID - 1
    np.minimum.at(low, group[one[b > a]], least[one[b > a]])
    np.maximum.at(high, group[one[b > a]], least[one[b > a]])
    # with letters in common, and not all of one smallest id
    own = np.flatnonzero((b > a) & (low < high)[group[one]])
    one, a, b = one[own], a[own], b[own]
    two = np.flatnonzero(most > least)
    of = np.concatenate([one, two])
    covered = np.concatenate([among(rows[one], column[one], size[one], group[one], least[one], a, b), _strings(column[two], size[two])])  # of equal contexts every string repeats
    # stretches of strings by context: those of the smallest id, and those of the others
    padded = np.zeros((len(of), PLACES + 2), np.int8)
    padded[:, 1:-1] = covered
    step = np.diff(padded, axis=1)
    who, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    slot = 2 * of[who] + (who >= len(one))
    by = np.argsort(slot, kind="stable")
    slot, begin, span = slot[by], begin[by] - column[of[who]][by], (end - begin)[by] + LENGTH - 1
    own = 2 * context + (doc > least[context])
    low, high = np.searchsorted(slot, own), np.searchsorted(slot, own, "right")
    n = high - low
    at = np.repeat(np.arange(len(own)), n)
    pick = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    message, row, start, span = t["message"][at], t["row"][at], t["start"][at] + begin[pick], span[pick]
    order = np.lexsort((start, row, message))
    at, ends = _edges(message[order])
    buckets = table.column("bucket").to_pylist()
    columns = {"row": row, "start": start, "size": span}
    return _messages("bucket", "shard", [(buckets[int(message[order[a]])], key[0].as_py(), Message.pack(**{c: (v[order[a:b]], REPEATS[c]) for c, v in columns.items()})) for a, b in zip(at, ends[1:], strict=True)])


def _drop(with_text: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text

    def run(key, table, found):
        doc, text = _in_order(table)
        parts = [Message.unpack(memoryview(p.as_py()), **REPEATS)[0] for p in found.column("payload")]
        row, start, size = (np.concatenate([p[c] for p in parts] or [np.empty(0, np.int64)]) for c in REPEATS)
        order = np.argsort(row, kind="stable")
        row, start, size = row[order], start[order], size[order]
        out = []
        for i, j in tx.row_slices(text, 1 << 22):
            data, off = tx.buffers(text.slice(i, j - i))
            own = slice(*np.searchsorted(row, [i, j]))
            begin = off[row[own] - i] + start[own]
            step = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + size[own], minlength=len(data) + 1)
            removed = np.cumsum(step[:-1]) > 0
            head = removed.copy()
            head[1:] &= ~removed[:-1]
            edge = off[:-1][off[:-1] < len(data)]
            head[edge] = removed[edge]
            kept, cut = data[~removed], np.concatenate([[0], np.cumsum(~removed)])[off]
            for k, (gone, spans) in enumerate(zip(tx.sums(removed, off).tolist(), tx.sums(head, off).tolist(), strict=True)):
                left = kept[cut[k] : cut[k + 1]].tobytes()
                out.append((None if doc[i + k] == NO_ID else int(doc[i + k]), int(off[k + 1] - off[k]), gone, spans, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
        columns = list(zip(*out, strict=True)) or [[]] * len(fields)
        return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, fields, strict=True)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 1000, rows_per_shard: int = 2000, hot: int = 50_000, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the kept bytes) for every row of ``docs``.

    Buckets and shards are groups of tasks; of very large tables they hold more rows, which keeps the
    number of messages between them in proportion to the rows.
    """
    n = docs.count()
    wide = math.isqrt(n)
    buckets = max(n // max(rows_per_bucket, min(wide // 2, 16_000)), shuffle_partitions(docs.sparkSession), 1)
    bits = max(1, power_of_two(max(n / max(rows_per_shard, min(wide, 64_000)), shuffle_partitions(docs.sparkSession))))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rid = F.xxhash64(F.col(id_col).cast("long"), text)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), rid.alias("rid"), text.alias("text"))
    dealt = rows.select(F.pmod(F.hash("rid"), F.lit(buckets)).alias("bucket"), "doc", "rid", "text").groupBy("bucket")
    to_shard, to_bucket = MESSAGE.format("shard", "bucket"), MESSAGE.format("bucket", "shard")
    wanted = dealt.applyInArrow(_tell(bits), to_shard).groupBy("shard").applyInArrow(_answer(hot), to_bucket)
    sent = dealt.cogroup(wanted.groupBy("bucket")).applyInArrow(_send(bits), to_shard)
    found = sent.groupBy("shard").applyInArrow(_find, to_bucket)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return dealt.cogroup(found.groupBy("bucket")).applyInArrow(_drop(with_text), fields)
