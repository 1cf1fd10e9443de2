"""Exact-substring dedup: repeated strings of a fixed length, found with suffix arrays over the contexts that can hold one.

A corpus-wide suffix array needs every text in one order.  Instead each window of LENGTH bytes is given to an anchor,
the K-gram in it with the least hash, so equal windows have equal anchors.  Anchors that occur once hold no repeated
window.  The bytes around each of the others go to the task of their anchor, where a two-stage suffix sort and the
common prefixes of neighbours decide.  What a task holds twice by itself is compared byte for byte and goes on once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, K = 200, 96
WINDOW = LENGTH - K + 1
CHUNK = 1 << 21
#: Contexts of one anchor beyond which they are dealt out in pieces (see ``_dealt``), and such contexts in one run of
#: texts, of HELD bytes, beyond which they do not even travel to their anchor.
SPLIT, LOCAL, HELD = 1000, 100, 1 << 26

_U = np.uint64
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        n = CHUNK + 4 * LENGTH
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, _U)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=_U))
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(_U).max, _U)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text, first window, last window, the anchor's place, its hash, the hash
    of the run's bytes and where they lie about the anchor.  A text over CHUNK bytes is taken piece by piece, whole."""
    out: list[list[np.ndarray]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        data = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        lens = np.array([len(t) for _, _, t in group])
        ends = np.cumsum(lens)
        power, inverse = _power_tables()
        n = len(data)
        if n >= LENGTH:
            sums = np.zeros(n + 1, _U)
            np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
            h = _mix((sums[K:] - sums[:-K]) * inverse[: n - K + 1])
            at = _sliding_min((h & ~_U(0x3FFFFF)) | np.arange(len(h), dtype=_U), WINDOW) & _U(0x3FFFFF)
            at = at.astype(np.int64)
            doc = np.repeat(np.arange(len(group)), lens)[: len(at)]
            ok = np.arange(len(at)) + LENGTH <= ends[doc]
            w = np.flatnonzero(ok)
            if len(w):
                cut = np.flatnonzero((np.diff(at[w]) != 0) | (np.diff(doc[w]) != 0) | (np.diff(w) != 1))
                first, last = w[np.concatenate(([0], cut + 1))], w[np.concatenate((cut, [len(w) - 1]))]
                a = at[first]
                back, span = a - first, last - first
                c = _mix((sums[last + LENGTH] - sums[first]) * inverse[first] + (back * 256 + span).astype(_U) * _U(0xA24BAED4963EE407))
                d = doc[first]
                start = (ends - lens)[d] - np.array([g[1] for g in group])[d]
                row = np.array([g[0] for g in group])[d]
                out.append([row, first - start, last - start, a - start, h[a], c])
        group.clear()
        size = 0

    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), CHUNK // 2):
            part = t[lo : lo + CHUNK // 2 + LENGTH - 1] if len(t) > CHUNK // 2 + LENGTH else t
            if size + len(part) > CHUNK:
                flush()
            group.append((i, lo if part is not t else 0, part))
            size += len(part)
            if part is t:
                break
    flush()
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    return tuple(np.concatenate(x) for x in zip(*out))


# A row of a table is known by two hashes of doc_id and text, 128 bits; equal rows share their repeated strings.
RUN = "anchor long, own1 long, own2 long, place long"
SETTLED, DEALT, HOT = 1, 2, -1


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a are those from b, byte for byte."""
    out, at = np.empty(len(a), bool), np.arange(LENGTH + WINDOW)
    for lo in range(0, len(a), 1 << 14):
        k = slice(lo, lo + (1 << 14))
        inside = at < n[k, None]
        x, y = (data[np.minimum(i[k, None] + at, len(data) - 1)] for i in (a, b))
        out[k] = ((x == y) | ~inside).all(1)
    return out


def _collapsed(texts: list[bytes], own1: np.ndarray, own2: np.ndarray) -> pa.RecordBatch | None:
    """The runs of some texts.  Of runs with the same bytes one goes on, and the windows of all of them are settled;
    an anchor with over LOCAL different runs is marked hot, and those are dealt out by themselves."""
    row, first, last, _, h, c = anchor_runs(texts)
    if not len(row):
        return None
    begin = np.cumsum([0] + [len(t) for t in texts])
    order = np.lexsort((c, h))
    row, first, last, h, c = (x[order] for x in (row, first, last, h, c))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = np.flatnonzero(~new)
    if len(again):
        data, at, n = np.frombuffer(b"".join(texts), np.uint8), begin[row] + first, last - first + LENGTH
        new[again[(n[again] != n[head[again]]) | ~_same(data, at[again], at[head[again]], n[again])]] = True
    again = np.flatnonzero(~new)
    settled = np.union1d(again, head[again])
    open_ = np.flatnonzero(new)
    # one that only repeats what is settled still serves others
    g = h[open_]
    many = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    size = np.diff(np.append(many, len(g)))
    hot = np.repeat(size > LOCAL, size)
    place = (first.astype(np.int64) << 16) | ((last - first).astype(np.int64) << 8)
    key = h.copy()
    spread = _mix(own1[row].view(_U) + place.astype(_U) * _U(0xA24BAED4963EE407))
    dealt = open_[hot]
    key[dealt] = spread[dealt]
    tops = g[many[size > LOCAL]]
    keys = np.concatenate([key[open_], spread[settled], tops])
    places = np.concatenate([place[open_] | np.where(hot, DEALT, 0), place[settled] | SETTLED, np.full(len(tops), HOT)])
    none = np.zeros(len(tops), np.int64)
    rows = [np.concatenate([o[row[open_]], o[row[settled]], none]) for o in (own1, own2)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), *rows, places)], ["anchor", "own1", "own2", "place"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each HELD bytes of text and what they settle by themselves; one text may be longer."""
    texts, own, size = [], [], 0

    def done() -> Iterator[pa.RecordBatch]:
        out = _collapsed(texts, *(np.concatenate(x) for x in zip(*own)))
        for lo in range(0, out.num_rows if out else 0, 1 << 16):
            yield out.slice(lo, 1 << 16)

    for b in batches:
        texts += C.binary(b.column(2))
        own.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += sum(map(len, texts[-b.num_rows :])) if b.num_rows else 0
        if size > HELD:
            yield from done()
            texts, own, size = [], [], 0
    if texts:
        yield from done()


FOUND = "own1 long, own2 long, first int, last int, kind int, anchor long"


def _groups(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor and place: kind 0, windows that are repeated for certain; 1, runs whose bytes are to be
    compared; 2, the same piece by piece, of anchors with over ``split`` runs or marked hot.  At most ``split`` runs
    of one anchor, and a batch, are held."""
    names, kinds = ["own1", "own2", "first", "last", "kind", "anchor"], (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64)

    def rows(x: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        first = x[3] >> 16
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip((x[1], x[2], first, first + (x[3] >> 8 & 255), kind, x[0]), kinds)], names)

    def whole(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole groups."""
        first = np.flatnonzero(np.concatenate(([True], x[0, 1:] != x[0, :-1])))
        size = np.diff(np.append(first, x.shape[1]))
        hot = np.repeat((x[3, first] == HOT) | (size > split), size)
        use = (hot | (np.repeat(size, size) > 1)) & (x[3] != HOT)
        if use.any():
            yield rows(x[:, use], np.where(hot[use], 2, 1))

    held, split_off = np.empty((4, 0), np.int64), None
    for b in batches:
        x = np.stack([c.to_numpy() for c in b.columns])
        for tag, kind in ((SETTLED, 0), (DEALT, 2)):
            own = (x[3] != HOT) & (x[3] & 255 == tag)
            if own.any():
                yield rows(x[:, own], np.full(own.sum(), kind))
                x = x[:, ~own]
        if split_off is not None:
            own = x[0] == split_off
            if own.any():
                yield rows(x[:, own], np.full(own.sum(), 2))
                x = x[:, ~own]
        x = np.concatenate([held, x], 1)
        if not x.shape[1]:
            held = x
            continue
        cut = int(np.searchsorted(x[0], x[0, -1]))
        if cut:
            yield from whole(x[:, :cut])
        held = x[:, cut:]
        if held.shape[1] > split:
            split_off = held[0, 0]
            held = held[:, held[3] != HOT]
            yield rows(held, np.full(held.shape[1], 2))
            held = held[:, :0]
    if held.shape[1]:
        yield from whole(held)


def _pieces(text: bytes, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Parts of a run of windows, of 16 on the average, as (first, last) starts.  The 8 bytes at a start say whether a part
    begins there, so equal strings are cut alike whatever is around them."""
    cuts = [i for i in range(first + 1, last + 1) if not crc32(text[i : i + 8]) & 15]
    return zip([first, *cuts], [*(i - 1 for i in cuts), last])


CONTEXT = "anchor long, context binary, windows int, own1 long, own2 long, first int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run asked for; of a split anchor's runs those of each piece, with 0 for ``windows``.  A row that
    ``twice`` says is there again is repeated whole: its last window comes as ``first``, with -1."""
    names = ["anchor", "context", "windows", "own1", "own2", "first"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    before = None
    for b in batches:
        rows: list[tuple] = []
        runs, at = b.column(4), 0
        offsets = runs.offsets.to_numpy()
        first, last, kind, anchor = (runs.values.field(i).to_numpy().tolist() for i in range(4))
        for k, (own1, own2, text, twice) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), C.binary(b.column(2)), b.column(3).to_pylist())):
            if (own1, own2) == before:  # equal rows: one sends them
                continue
            before = own1, own2
            if twice:
                rows.append((own1, b"", -1, own1, own2, len(text) - LENGTH))
            for at in range(offsets[k], offsets[k + 1]):
                a, z = first[at], last[at]
                if kind[at] == 1:
                    rows.append((anchor[at], text[a : z + LENGTH], z - a + 1, own1, own2, a))
                else:
                    rows += [(anchor[at], text[i : j + LENGTH], 0, own1, own2, i) for i, j in _pieces(text, a, z)]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def suffix_array(data: bytes, wanted: list[tuple[int, int, int]], depth: int = LENGTH) -> list[int]:
    """The suffixes of ``data`` that start in the ``wanted`` ranges (start, end, end of text), ordered by ``depth`` bytes.

    Two-stage sorting: suffixes smaller than their successors are sorted directly.  The rest are induced: a scan over
    the buckets of first bytes from the left takes each suffix in turn and puts the one before it, if that is larger
    than its successor, at the next place from its bucket's front.  Each range reaches on to its next directly sorted
    suffix, from which its last ones are induced, or to the end of its text, where nothing follows, which is smallest.
    Texts are parted by a byte that belongs to none.
    """
    n = len(data)
    d = np.frombuffer(data, np.uint8).astype(np.int16)
    after = np.append(d[1:], -1)
    begin, stop, end = np.array(wanted, np.int64).reshape(-1, 3).T
    after[end - 1] = -1
    at = np.arange(n)
    # smaller than the successor; with an equal byte as the successor itself is
    is_small = (d < after)[np.minimum.accumulate(np.where(d == after, n, at)[::-1])[::-1]]
    next_small = np.append(np.minimum.accumulate(np.where(is_small, at, n)[::-1])[::-1], n)
    reach = next_small[stop]
    induced = reach < end
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, begin, 1)
    np.add.at(mark, np.where(induced, reach + 1, end), -1)
    use = np.cumsum(mark[:-1]) > 0
    limit = np.zeros(n, np.int64)  # where the text of each place ends
    limit[begin] = end
    np.maximum.accumulate(limit, out=limit)
    first = np.flatnonzero(use & is_small)
    small = sorted(zip([data[i:z] for i, z in zip(first.tolist(), np.minimum(first + depth, limit[first]).tolist())], first.tolist()))
    order = [i for _, i in small]
    large = use & ~is_small
    larger = large.tobytes() + b"\0"  # the last is what -1 finds
    front = np.zeros(257, np.int64)
    front[1:] = np.bincount(d[large], minlength=256)
    fill = np.cumsum(front).tolist()
    room = [-1] * int(large.sum())  # larger suffixes by bucket: within one byte they come before the directly sorted ones
    put = fill[:256]
    for i in (end[~induced] - 1).tolist():
        if larger[i]:
            room[put[data[i]]] = i
            put[data[i]] += 1
    edges = np.searchsorted(d[order], np.arange(257)).tolist() if order else [0] * 257
    out: list[int] = []
    for c in range(256):
        k = fill[c]
        while k < put[c]:
            i = room[k]
            k += 1
            if larger[i - 1]:
                b = data[i - 1]
                room[put[b]] = i - 1
                put[b] += 1
        out += room[fill[c] : put[c]]
        own = order[edges[c] : edges[c + 1]]
        for i in own:
            if larger[i - 1]:
                b = data[i - 1]
                room[put[b]] = i - 1
                put[b] += 1
        out += own
    return out


def common_prefixes(data: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Of each suffix in ``order`` but the last the length of the prefix that it has in common with the next, up to
    ``depth``, a multiple of 8."""
    padded = np.frombuffer(data + bytes(depth), np.uint8)
    at = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.empty(max(len(order) - 1, 0), np.int64)
    for lo in range(0, len(out), 1 << 13):
        x = at[order[lo : lo + (1 << 13) + 1]].view("<u8")
        x = x[:-1] ^ x[1:]
        word = (x != 0).argmax(1)
        bits = x[np.arange(len(x)), word]
        out[lo : lo + (1 << 13)] = np.where(bits == 0, depth, 8 * word + np.bitwise_count((bits & (~bits + _U(1))) - _U(1)) // 8)
    return np.minimum(out, len(data) - np.maximum(order[1:], order[:-1]))


def repeated_starts(contexts: list[bytes], windows: list[int]) -> list[np.ndarray]:
    """For each context, which of its first ``windows`` places start LENGTH bytes that start at such a place elsewhere.
    Contexts that are equal byte for byte are sorted once, and all of their windows are repeated."""
    which: dict[bytes, int] = {}
    at = np.array([which.setdefault(c, len(which)) for c in contexts])
    many = np.bincount(at) > 1
    n = np.zeros(len(which), np.int64)
    np.maximum.at(n, at, windows)  # one for each length, as all have LENGTH - 1 bytes more than windows
    data = b"\0".join(which)
    size = np.array([len(c) + 1 for c in which])
    begin = np.cumsum(size) - size
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin], edge[begin + n] = 1, -1
    owner = np.cumsum(edge).astype(bool)
    order = np.array(suffix_array(data, list(zip(begin.tolist(), (begin + n).tolist(), (begin + size - 1).tolist()))), np.int64)
    order = order[owner[order]]
    same = np.flatnonzero(common_prefixes(data, order) >= LENGTH)
    marked = np.zeros(len(data) + 1, bool)
    marked[order[same]] = marked[order[same + 1]] = True
    for k in np.flatnonzero(many).tolist():
        marked[begin[k] : begin[k] + n[k]] = True
    marked = np.flatnonzero(marked)
    found = [m - b for m, b in zip(np.split(marked, np.searchsorted(marked, begin[1:])), begin.tolist())]
    return [found[k] for k in at]


SPAN = "own1 long, own2 long, first int, last int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, without those of split anchors: an anchor has SPLIT contexts at most, which with 1 MB of
    contexts of others and a batch is all that is held."""
    names = ["own1", "own2", "first", "last"]

    def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        starts = repeated_starts([r[1] for r in rows], [r[2] for r in rows])
        n = np.array([len(x) for x in starts])
        if not n.sum():
            return
        k, at = np.repeat(np.arange(len(rows)), n), np.concatenate(starts)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(k) != 0))))
        a, z, k = at[new], at[np.append(new[1:], len(at)) - 1], k[new]
        own1, own2, first = (np.array([r[i] for r in rows], np.int64)[k] for i in (3, 4, 5))
        yield pa.RecordBatch.from_arrays([pa.array(own1), pa.array(own2), pa.array((first + a).astype(np.int32)), pa.array((first + z).astype(np.int32))], names)

    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(6))):
            if r[2] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([r[3]]), pa.array([r[4]]), pa.array([0], pa.int32()), pa.array([r[5]], pa.int32())], names)
                continue
            if size > 1 << 20 and r[0] != rows[-1][0]:
                yield from done(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[1])
    if rows:
        yield from done(rows)


WINDOWS = "window binary, alone boolean, own1 long, own2 long, first int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-bit hash (BLAKE2) of each window of different pieces, and whether its piece is there once."""
    names, kinds = ["window", "alone", "own1", "own2", "first"], [pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
    for b in batches:
        rows: list[tuple] = []
        for context, n, own1, own2, first in zip(*(c.to_pylist() for c in b.columns)):
            rows += [(hashlib.blake2b(context[i : i + LENGTH], digest_size=16).digest(), n == 1, own1, own2, first + i) for i in range(len(context) - LENGTH + 1)]
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _dealt(pieces: DataFrame) -> DataFrame:
    """The repeated windows of split anchors.  Pieces that are equal byte for byte are counted with map-side combining and
    repeated whole, one row each.  Only windows of different pieces are counted by their hash, and only those of a piece
    that is there once are looked up one by one.  Both joins return a row of theirs once at most, and one that very many
    rows share is a hot key of the look-up alone, which Spark's skew join splits."""
    # of a piece that is there once the greatest place is its place
    different = C.stored(pieces.groupBy("context").agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("own1", "own2", "first"))), "pieces")
    whole = pieces.join(different.filter("n > 1").select("context"), "context", "left_semi")
    windows = C.map_arrow(different, _windows, WINDOWS)
    twice = C.stored(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "windows")
    single = windows.filter("alone").join(twice, "window", "left_semi").select("own1", "own2", "first", F.col("first").alias("last"))
    return whole.select("own1", "own2", "first", (F.col("first") + F.octet_length("context") - LENGTH).alias("last")).union(single)


def _own(docs: DataFrame) -> list:
    """Two hashes of doc_id and text with different seeds: they tell rows with equal or null doc_ids apart."""
    return [F.xxhash64(F.lit(k), "doc_id", F.coalesce("text", F.lit(""))) for k in (1, 2)]


def spans(docs: DataFrame) -> DataFrame:
    """(own1, own2, runs): the runs of windows, as (first, last) starts, that begin LENGTH bytes which also start
    elsewhere in the texts of ``docs`` (doc_id, text), for each row with any; the first two are those of ``_own``."""
    own1, own2 = _own(docs)
    rows = docs.select(own1.alias("own1"), own2.alias("own2"), "text").filter(F.octet_length("text") >= LENGTH)
    runs = C.map_arrow(rows, _anchors, RUN).repartition("anchor").sortWithinPartitions("anchor", "place")
    found = C.stored(C.map_arrow(runs, partial(_groups, split=SPLIT), FOUND), "anchors")
    # a run that is asked for twice is that of a row that is there twice
    asked = found.filter("kind > 0").groupBy("own1", "own2").agg(F.collect_set(F.struct("first", "last", "kind", "anchor")).alias("runs"), F.count("*").alias("n"))
    at = rows.join(asked, ["own1", "own2"]).select("own1", "own2", "text", (F.col("n") > F.size("runs")).alias("twice"), "runs")
    contexts = C.map_arrow(at, _contexts, CONTEXT)
    dealt = None
    if not found.filter("kind = 2").isEmpty():
        contexts = C.stored(contexts, "contexts")
        dealt = _dealt(contexts.filter("windows = 0"))
        contexts = contexts.filter("windows <> 0")
    verified = C.map_arrow(contexts.repartition("anchor").sortWithinPartitions("anchor"), _verify, SPAN)
    every = found.filter("kind = 0").select("own1", "own2", "first", "last").union(verified)
    every = every.union(dealt) if dealt else every
    return C.stored(every.groupBy("own1", "own2").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "spans")


def _union(runs: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows."""
    out: list[list[int]] = []
    for a, z in sorted((r["first"], r["last"] + length) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _kept(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, z in cuts:
        parts.append(text[at:a])
        at = z
    return b"".join([*parts, text[at:]])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, runs in zip(C.binary(b.column(1)), b.column(2).to_pylist()):
            cuts = _union(runs or [])
            rows.append((len(t), sum(z - a for a, z in cuts), len(cuts), hashlib.sha256(_kept(t, cuts)).hexdigest()))
        n, r, s, h = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame) -> DataFrame:
    own1, own2 = _own(docs)
    names = ["_".join([n, *docs.columns]) for n in ("own1", "own2")]  # names that no column has
    d = docs.withColumn(names[0], own1).withColumn(names[1], own2).alias("d")
    found = spans(docs).select(F.col("own1").alias(names[0]), F.col("own2").alias(names[1]), "runs").alias("s")
    return d.join(found, names, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("s.runs").alias("_".join(["runs", *docs.columns])))


def removed(docs: DataFrame) -> DataFrame:
    """What goes from each row of ``docs`` (doc_id, text): every byte of its UTF-8 text covered by a LENGTH-byte string
    that also starts anywhere else, judged on the input.  doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty and, as any under LENGTH bytes, loses nothing.  Repeated rows are each other's elsewhere, so
    those of LENGTH bytes or more lose all; so does a text that holds one long run of a byte.  A null doc_id is kept.
    """
    rows = _with_spans(C.pick(docs, "doc_id", "text"))
    return C.map_arrow(rows, _digest, DIGEST)


def cut_text(text: bytes, runs: list[dict]) -> str:
    """The text without its repeated strings; a character that is not wholly inside one stays."""
    cuts = []
    for a, z in _union(runs):
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        cuts.append((a, z))
    return _kept(text, cuts).decode()


def _cut(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if t is None else cut_text(t, r) if r else t.decode() for t, r in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
        cols = [b.column(i) for i in range(b.num_columns - 1)]
        cols[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(cols, [b.schema.field(i).name for i in range(b.num_columns - 1)])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns and rows, each text without the strings that ``removed`` finds, kept to whole characters."""
    return C.map_arrow(_with_spans(docs), partial(_cut, at=docs.columns.index("text")), docs.schema)
