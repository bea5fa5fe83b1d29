"""Secret scans: a linear-chain conditional random field over tokens, beside three fixed patterns.

Tokens are runs of letters, digits, `_`, `+`, `/`, `-` and non-ASCII bytes. A
token is tagged as a secret's begin, its inside or outside, from its shape (length,
kinds of characters and how often they change, distinct characters, vowels), the
neighbouring words, what stands before it and how many digits and symbols its
file has. What the token itself says is no feature, so that secrets which no text
has had are found. Weights are trained by AdaGrad on the conditional likelihood
(forward-backward over windows of tokens). Decoding is Viterbi. A token whose score for outside exceeds its others by more
than any transitions can repay is outside on every best path, so Viterbi runs
only over the stretches between such tokens; the result is the same.

The patterns' matches are the tags to learn from. A match is shown as it is, without the keyword
before it, and with the secret written anew in the alphabets and with the kinds of prefixes that
keys come in (``variants``), or the field would learn the patterns and no more. Outside
tokens come from windows at random places, at the longest token and at the one with the most digits.

The model is fitted on at most ``max_rows`` rows, those with the smallest hash
of their id; from each it takes at most ``per_text`` matches, and from one text in ``background`` three
windows elsewhere. These three are parameters of ``fit``, and bound what the one task that trains holds; the driver gets the weights alone. Null and empty texts have no
spans. Without a match to learn from, nothing but the patterns' spans is found.
Repeated rows are scanned each; whole texts are scanned, however long.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: A text without any of these has no match of the patterns.
_HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
_TOKEN = tx.byte_table(bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b) in "_+/-")), lower=True)
BITS, N_FEATURES, HALF = 14, 10, 12


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_DIGIT, _UPPER = _class(b"0123456789"), _class(bytes(range(65, 91)))
_HEXLETTER, _LOWER, _VOWEL = _class(b"abcdefABCDEF"), _class(bytes(range(97, 123))), _class(b"aeiouAEIOU")
#: Lower and upper case, digits, other ASCII, other bytes.
_KIND = np.where(_LOWER, 1, np.where(_UPPER, 2, np.where(_DIGIT, 3, np.where(np.arange(256) < 128, 4, 5))))
_GAP = np.zeros(256, np.int64)
for _value, _chars in ((1, b" \t"), (2, b"\n\r"), (4, b"=:"), (8, b"\"'`"), (16, b".,;!?"), (32, b"()[]{}<>|#*$%&@~^\\")):
    _GAP[list(_chars)] = _value


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches in code points, by start and kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _bytes_at(text: str, i: int) -> int:
    return len(text[:i].encode("utf-8", "surrogatepass"))


def _secret_parts(text: str) -> list[tuple[int, int]]:
    """What of the matches is the secret itself, in bytes."""
    parts = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for p, n in ((_ACCESS, 20), (_HEX, 24)) for m in p.finditer(text) if len(m[0]) >= n]
    return [(_bytes_at(text, a), _bytes_at(text, b)) for a, b in parts]


def token_features(data: np.ndarray, off: np.ndarray) -> tuple[tx.Tokens, np.ndarray]:
    """Tokens, and for each the N_FEATURES columns of the weight table."""
    t = tx.Tokens(data, off, _TOKEN)
    n = len(t)
    if not n:
        return t, np.empty((0, N_FEATURES), np.int64)
    h, row = t.hashes(), t.row()
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])[np.stack([t.start, t.end], 1)], axis=1)[:, 0]
    size = t.end - t.start
    digits, upper, lower, hexes, vowels = count(_DIGIT), count(_UPPER), count(_LOWER), count(_HEXLETTER), count(_VOWEL)
    length = np.minimum(size, 15) + (size > 20) + (size > 28) + (size > 40)
    shape = (((length * 4 + np.minimum(digits, 6) // 2) * 2 + (upper > 0)) * 2 + (lower > 0)) * 2 + (digits + hexes == size)
    kinds = _KIND[data]
    change = np.concatenate([[0], np.cumsum(np.concatenate([[False], kinds[1:] != kinds[:-1]]))])
    changes = change[t.end] - change[t.start + 1]
    # distinct bytes of what is long enough for a secret
    distinct = np.zeros(n, np.int64)
    some = np.flatnonzero(size >= 8)
    if len(some):
        who = np.repeat(some, size[some])
        at = np.arange(len(who)) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + t.start[who]
        distinct += np.bincount(np.unique(who * 256 + data[at]) >> 8, minlength=n)
    spelt = np.where(upper + lower > 0, vowels * 8 // np.maximum(upper + lower, 1), 9)
    # what stands before a token: the kinds of bytes since the last one of the same text
    before = np.maximum(np.concatenate([[0], t.end[:-1]]), off[row])
    gap = np.zeros(n, np.int64)
    for back in range(1, 5):
        at = t.start - back
        gap |= np.where(at >= before, _GAP[data[np.maximum(at, 0)]], 0)
    same = np.concatenate([[False], row[1:] == row[:-1]])
    nothing = np.uint64(0)
    previous = np.where(same, np.concatenate([h[:1], h[:-1]]), nothing)
    following = np.where(np.append(same[1:], False), np.append(h[1:], nothing), nothing)
    share = lambda flag: np.minimum(tx.sums(flag[data], off) * 100 // np.maximum(np.diff(off), 1), 15)[row]
    file = share(_DIGIT) * 16 + share((_GAP >= 32).astype(np.int64))
    mixed = np.minimum(digits, 9) * 10 + np.minimum(upper, 9)
    values = [
        shape, np.minimum(changes, 15) * 32 + length, np.minimum(distinct, 24) * 32 + length, spelt * 32 + length, mixed * 32 + length,
        (np.minimum(changes, 7) * 8 + np.minimum(digits, 7)) * 32 + np.minimum(distinct, 31), previous, following, file * 32 + length, pair_of(previous, gap),
    ]
    salt = np.arange(1, N_FEATURES + 1, dtype=np.uint64) << np.uint64(56)
    columns = [(tx.mix(np.asarray(v).astype(np.uint64) ^ s) >> np.uint64(64 - BITS)).astype(np.int64) for v, s in zip(values, salt, strict=True)]
    return t, np.stack(columns, 1)


def pair_of(h: np.ndarray, gap: np.ndarray) -> np.ndarray:
    return tx.pair(h, gap.astype(np.uint64))


def silver_tags(t: tx.Tokens, row: int, begin: int, parts: list[tuple[int, int]]) -> np.ndarray:
    """Tags of one text's tokens from its secret parts (bytes within the text)."""
    i, j = t.offsets[row], t.offsets[row + 1]
    tags = np.full(j - i, OUTSIDE)
    for a, b in sorted(parts):
        inside = np.flatnonzero((t.end[i:j] > begin + a) & (t.start[i:j] < begin + b))
        inside = inside[tags[inside] == OUTSIDE]
        tags[inside] = INSIDE
        tags[inside[:1]] = BEGIN
    return tags


@dataclass(frozen=True)
class Model:
    #: columns x tags; tags x tags, from the row's tag to the column's.
    weights: np.ndarray
    transitions: np.ndarray


def _forward_backward(e: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tags (w, n, 3) and summed marginals of transitions (3, 3). e: emissions of w windows; the mask is True on a prefix."""
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    w, n, _ = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0]
    for k in range(1, n):
        a[:, k] = np.where(mask[:, k, None], e[:, k] + lse(a[:, k - 1, :, None] + t, 1), a[:, k - 1])
    z = lse(a[:, -1], 1)
    for k in range(n - 2, -1, -1):
        b[:, k] = np.where(mask[:, k + 1, None], lse(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), b[:, k + 1])
    tags = np.exp(a + b - z[:, None, None]) * mask[..., None]
    pairs = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return tags, pairs.sum((0, 1))


#: Windows whose gradient is taken at once; a step sums over all of them, so that memory does not grow with their number.
CHUNK = 4096


def gradient(features: np.ndarray, tags: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows' negative log likelihood, by weights and by transitions."""
    g, g_t = np.zeros(weights.shape), np.zeros((3, 3))
    for i in range(0, len(tags), CHUNK):
        f, y = features[i : i + CHUNK].astype(np.int64), tags[i : i + CHUNK].astype(np.int64)
        mask = y >= 0
        p, pairs = _forward_backward(weights[f].sum(2), transitions, mask)
        d = (p - np.eye(3)[np.maximum(y, 0)])[mask]
        flat = f[mask].reshape(-1)
        for k in range(3):
            g[:, k] += np.bincount(flat, np.repeat(d[:, k], N_FEATURES), len(weights))
        g_t += pairs - np.bincount((y[:, :-1] * 3 + y[:, 1:])[mask[:, 1:]], minlength=9).reshape(3, 3)
    return g, g_t


def train(features: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """features (windows, tokens, N_FEATURES), tags (windows, tokens), -1 behind a window's end."""
    weights, transitions = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    if not len(tags) or not (tags == BEGIN).any():
        return Model(weights.astype(np.float32), transitions)
    squares, squares_t = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    for _ in range(rounds):
        g, g_t = gradient(features, tags, weights, transitions)
        g += decay * weights
        g_t += decay * transitions
        squares += g * g
        squares_t += g_t * g_t
        weights -= rate * g / np.sqrt(squares)
        transitions -= rate * g_t / np.sqrt(squares_t)
    return Model(weights.astype(np.float32), transitions)


def viterbi(e: np.ndarray, t: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best tags of w stretches of one length (w, n, 3); first and last: what is added to the scores at the ends."""
    w, n, _ = e.shape
    score, back = e[:, 0] + first, np.zeros((w, n, 3), np.int64)
    for k in range(1, n):
        x = score[:, :, None] + t
        back[:, k] = x.argmax(1)
        score = x.max(1) + e[:, k]
    tags = np.empty((w, n), np.int64)
    tags[:, -1] = (score + last).argmax(1)
    for k in range(n - 1, 0, -1):
        tags[:, k - 1] = back[np.arange(w), k, tags[:, k]]
    return tags


def decode(e: np.ndarray, offsets: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Viterbi tags of all texts' tokens; e: emissions (tokens, 3), offsets: tokens by text."""
    padded = np.concatenate([t, np.zeros((1, 3))])  # no token before
    padded = np.concatenate([padded, np.zeros((4, 1))], 1)  # no token behind
    gain = max(padded[a, s] + padded[s, c] - padded[a, OUTSIDE] - padded[OUTSIDE, c] for s in (BEGIN, INSIDE) for a in range(4) for c in range(4))
    tags = np.full(len(e), OUTSIDE)
    open_ = np.flatnonzero(e[:, OUTSIDE] - e[:, :OUTSIDE].max(1) <= gain) if len(e) else np.empty(0, np.int64)
    if not len(open_):
        return tags
    row = np.searchsorted(offsets, open_, "right")
    cut = np.concatenate([[True], (np.diff(open_) > 1) | (np.diff(row) > 0), [True]])
    at = np.flatnonzero(cut)
    start, size = open_[at[:-1]], np.diff(at)
    begins, ends = np.isin(start, offsets[:-1]), np.isin(start + size, offsets[1:])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        where = start[own][:, None] + np.arange(n)
        first = np.where(begins[own][:, None], 0.0, t[OUTSIDE])
        last = np.where(ends[own][:, None], 0.0, t[:, OUTSIDE])
        tags[where] = viterbi(e[where], t, first, last)
    return tags


def tagged_runs(tags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last tokens of secrets: a begin, or an inside that follows an outside, and the insides behind it."""
    if not len(tags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new_text = np.zeros(len(tags), bool)
    new_text[offsets[:-1][offsets[:-1] < len(tags)]] = True
    previous = np.concatenate([[OUTSIDE], tags[:-1]])
    first = (tags == BEGIN) | ((tags == INSIDE) & ((previous == OUTSIDE) | new_text))
    follows = np.append((tags[1:] == INSIDE) & ~new_text[1:], False)
    last = (tags != OUTSIDE) & ~follows
    return np.flatnonzero(first), np.flatnonzero(last)


_HEXES, _BASE32, _BASE62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def variants(text: str, outer: tuple[int, int], inner: tuple[int, int], seed: int, around: int = 160) -> list[tuple[str, tuple[int, int]]]:
    """A match (outer) and its secret (inner) with the text about it: as it is, without its keyword, and with secrets of other shapes."""
    rng = np.random.default_rng(seed)
    write = lambda alphabet, low, high: "".join(rng.choice(list(alphabet), int(rng.integers(low, high + 1))))
    before, keyword, behind = text[max(0, outer[0] - around) : outer[0]], text[outer[0] : inner[0]], text[inner[1] : inner[1] + around]
    bare = behind[1:] if behind[:1] in ("'", '"') else behind
    word = lambda low, high: write("abcdefghijklmnopqrstuvwxyz", low, high)
    prefixed = lambda: "_".join(filter(None, [word(2, 5), word(3, 5) if rng.random() < 0.5 else "", write(_BASE62, 16, 40)]))
    secret = text[inner[0] : inner[1]]
    shown = [(keyword, secret, behind), ("", secret, bare)]
    shown += [(keyword, write(_BASE62, 10, 40), behind), (keyword, prefixed(), behind)]
    shown += [("", write(alphabet, low, high), bare) for alphabet, low, high in ((_BASE62, 16, 24), (_BASE62, 25, 48), (_BASE62 + "-_", 20, 44), (_BASE62 + "+/", 24, 64), (_BASE32, 16, 32), (_HEXES, 20, 64))]
    shown += [("", prefixed(), bare), ("", word(2, 4) + "-" + write(_BASE62, 20, 40), bare)]
    return [(before + k + x + y, (len(before + k), len(before + k + x))) for k, x, y in shown]


def _window(features: np.ndarray, tags: np.ndarray, middle: int) -> bytes:
    width = 2 * HALF + 1
    a = max(0, middle - HALF)
    b = min(len(tags), a + width)
    f, g = np.zeros((width, N_FEATURES), np.int16), np.full(width, -1, np.int8)
    f[: b - a], g[: b - a] = features[a:b], tags[a:b]
    return f.tobytes() + g.tobytes()


def _shown(text: str, digest: bytes, per_text: int) -> list[bytes]:
    """Windows of a text's first matches in all variants."""
    whole = [(m.span(), m.span(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] + [(m.span(), m.span()) for p, n in ((_ACCESS, 20), (_HEX, 24)) for m in p.finditer(text) if len(m[0]) >= n]
    found: list = []
    for outer, inner in sorted(whole):  # a match inside another one is that one
        if not found or outer[0] >= found[-1][0][1]:
            found.append((outer, inner))
    out = []
    for k, (outer, inner) in enumerate(found[:per_text]):
        snippets = variants(text, outer, inner, int.from_bytes(digest[:7], "little") + k)
        column = pa.array([x for x, _ in snippets], pa.large_string())
        data, off = tx.buffers(column)
        t, features = token_features(data, off)
        for r, (x, (a, b)) in enumerate(snippets):
            tags = silver_tags(t, r, off[r], [(_bytes_at(x, a), _bytes_at(x, b)), *(s for s in _secret_parts(x))])
            own = slice(t.offsets[r], t.offsets[r + 1])
            begin = np.flatnonzero((tags == BEGIN) & (t.end[own] > off[r] + _bytes_at(x, a)))
            if len(begin):
                out.append(_window(features[own], tags, int(begin[0])))
    return out


def _windows(per_text: int, background: int):
    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for i, j in tx.row_slices(column):
                part = column.slice(i, j - i)
                data, off = tx.buffers(part)
                t, features = token_features(data, off)
                hint = pc.fill_null(pc.match_substring_regex(part, _HINT), False).to_numpy(zero_copy_only=False)
                digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
                out = []
                for r in range(j - i):
                    own = slice(t.offsets[r], t.offsets[r + 1])
                    n = own.stop - own.start
                    if not n:
                        continue
                    digest = hashlib.sha256(data[off[r] : off[r + 1]].tobytes()).digest()
                    if hint[r]:
                        out += _shown(part[r].as_py(), digest, per_text)
                    if int.from_bytes(digest[8:12], "little") % background == 0:
                        tags = silver_tags(t, r, off[r], _secret_parts(part[r].as_py()) if hint[r] else [])
                        outside = tags == OUTSIDE
                        size = np.where(outside, t.end[own] - t.start[own], -1)
                        numbers = np.where(outside, digits[t.end[own]] - digits[t.start[own]], -1)
                        middles = {int.from_bytes(digest[:8], "little") % int(n), int(size.argmax()), int(numbers.argmax())}
                        out += [_window(features[own], tags, m) for m in sorted(middles)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["window"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, per_text: int = 3, background: int = 8) -> Model:
    """The model from at most ``max_rows`` rows, ``per_text`` matches a text, and other windows of one text in ``background``."""
    chosen = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    texts = docs.join(F.broadcast(chosen), id_col).select(F.col(text_col).cast("string").alias("text"))
    windows = texts.mapInArrow(_windows(per_text, background), "window binary").repartition(1).sortWithinPartitions("window")
    row = windows.mapInArrow(_train, "weights binary, transitions binary").first()
    if row is None:
        return train(np.empty((0, 1, N_FEATURES), np.int16), np.empty((0, 1), np.int8))
    return Model(np.frombuffer(row.weights, np.float32).reshape(-1, 3), np.frombuffer(row.transitions, np.float64).reshape(3, 3))


def _train(batches):
    """All windows, sorted, to the one model; they stay in two bytes a feature."""
    width = 2 * HALF + 1
    features, tags = [np.empty((0, width, N_FEATURES), np.int16)], [np.empty((0, width), np.int8)]
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        cut = 2 * width * N_FEATURES
        features.append(np.ascontiguousarray(raw[:, :cut]).view(np.int16).reshape(-1, width, N_FEATURES))
        tags.append(np.ascontiguousarray(raw[:, cut:]).view(np.int8))
    model = train(np.concatenate(features), np.concatenate(tags))
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.transitions.tobytes()], pa.binary())], ["weights", "transitions"])


def scan_column(model: Model, column) -> list[tuple[list, list]]:
    """(base spans, all spans) by text."""
    data, off = tx.buffers(column)
    t, features = token_features(data, off)
    e = np.zeros((len(t), 3), np.float32)
    for k in range(N_FEATURES):
        e += model.weights[features[:, k]]
    first, last = tagged_runs(decode(e, t.offsets, model.transitions), t.offsets)
    rows = np.searchsorted(off, t.start[first], "right") - 1 if len(first) else first
    hint = pc.fill_null(pc.match_substring_regex(column, _HINT), False).to_numpy(zero_copy_only=False)
    out: list = [([], []) for _ in range(len(column))]
    for r in np.union1d(np.flatnonzero(hint), rows).astype(np.int64).tolist():
        base = base_spans(column[r].as_py()) if hint[r] else []
        own = slice(*np.searchsorted(rows, [r, r + 1]))
        points = np.concatenate([[0], np.cumsum((data[off[r] : off[r + 1]] & 0xC0) != 0x80)])
        more = [("crf", int(points[t.start[a] - off[r]]), int(points[t.end[b] - off[r]])) for a, b in zip(first[own], last[own], strict=True)]
        more = [s for s in more if not any(s[1] < x[2] and x[1] < s[2] for x in base)]
        out[r] = base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end), code points, for every row."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(id_col).schema
    array = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = schema.add("base", array).add("spans", array)
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i, j in tx.row_slices(batch.column(1)):
                found = scan_column(shared.value, batch.column(1).slice(i, j - i))
                as_rows = lambda which: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[which]] for f in found], arrow.field(which + 1).type)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(arrow.field(0).type), as_rows(0), as_rows(1)], schema=arrow)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit and scan; (id, base, spans)."""
    return spans(docs, fit(docs, id_col, text_col), id_col, text_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of the base kinds, the base spans' SHA-256 and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select(id_col, *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
