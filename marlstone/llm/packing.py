"""Best-fit-decreasing packing of documents into fixed-length token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, kind: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    tk = C.unit_tokenizer(tokenizer, kind)
    end, wide = np.array([end_id], "<u4").tobytes(), tk.dtype.itemsize == 4
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for lo, hi in C.slices(texts):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, e in enumerate(tk.encode(texts[lo:hi]), lo):
                ids = (e if wide else np.frombuffer(e, tk.dtype).astype("<u4").tobytes()) + end
                n = len(ids) // 4
                for k, a in enumerate(range(0, n, size)):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(min(size, n - a))
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + size)]))
            # the rank of a piece among those of its length in this task
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            first = np.searchsorted(n[order], n[order])
            local = np.empty(len(n), np.int64)
            local[order] = np.arange(len(n)) - first + seen[n[order]]
            seen += np.bincount(n, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(local)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])


class CapacityTree:
    """A segment tree over remaining capacities: whether any open bin has one, and the least that is enough."""

    def __init__(self, size: int):
        self.n = 1 << (size + 1).bit_length()
        self.has = [0] * (2 * self.n)

    def put(self, r: int, bins: int) -> None:
        r += self.n
        while r:
            self.has[r] += bins
            r >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is ``least`` or more, in logarithmic time."""
        r = least + self.n
        if self.has[r]:
            return least
        while r > 1:
            if not r & 1 and self.has[r + 1]:
                r += 1
                while r < self.n:
                    r = 2 * r + (not self.has[2 * r])
                return r - self.n
            r >>= 1
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length: (length, first rank, first bin, pieces a bin,
    offset), by length and rank.  Pieces of one length that meet bins of one remaining capacity are placed together,
    which puts each where it would go one at a time; so the plan's size depends on the lengths, not on the documents."""
    tree, open_bins, plan, bins = CapacityTree(size), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(b: int, n: int, room: int) -> None:
            nonlocal left, rank
            each = room // length
            full, rest = min(n, left // each), 0
            if full:
                plan.append((length, rank, b, each, size - room))
                keep(b, full, room - each * length)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                rest = 1
                plan.append((length, rank, b + full, each, size - room))
                keep(b + full, 1, room - left * length)
                rank, left = rank + left, 0
            if full + rest < n:
                keep(b + full + rest, n - full - rest, room)

        def keep(b: int, n: int, room: int) -> None:
            if room:
                open_bins.setdefault(room, []).append((b, n))
                tree.put(room, n)

        while left:
            room = tree.tightest(length)
            if room is None:
                new = -(-left // (size // length))
                b, bins = bins, bins + new
                place(b, new, size)
            else:
                b, n = open_bins[room].pop()
                tree.put(room, -n)
                place(b, n, room)
    return plan


def _place(batches: Iterator[pa.RecordBatch], keys: np.ndarray, plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        p = plan[np.searchsorted(keys, (n.astype(np.uint64) << np.uint64(48)) | rank.astype(np.uint64), side="right") - 1]
        k = rank - p[:, 1]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(p[:, 2] + k // p[:, 3]), pa.array(p[:, 4] + k % p[:, 3] * n)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 0, size: int = 2048) -> DataFrame:
    """Packs every whole ``text`` of ``docs`` (doc_id, text) into sequences of at most ``size`` tokens.

    A document is its ids and ``end_id``; only a longer one is cut, into pieces of ``size``.  Returns a row per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Texts stay where they are read: a task ranks its
    pieces of each length, counts by task and length give each task's first rank, and the plan made from the counts
    of lengths (at most ``size`` of them, so bounded) turns length and rank into a place.  A null text is empty and
    takes one token; a null doc_id and repeated rows are kept as they are; an empty table packs to nothing.
    """
    pieces = C.stored(C.map_arrow(C.pick(docs, "doc_id", "text"), partial(_pieces, tokenizer=tokenizer, kind=kind, end_id=end_id, size=size), PIECES), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))
    plan = best_fit_plan({r["length"]: r["n"] for r in totals.collect()}, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    rows = np.array(sorted(plan), np.int64).reshape(-1, 5)
    keys = (rows[:, 0].astype(np.uint64) << np.uint64(48)) | rows[:, 1].astype(np.uint64)
    return C.map_arrow(ranked, partial(_place, keys=keys, plan=rows), PACKED)
