"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

THRESHOLD = 2


def fingerprint(text: bytes) -> int:
    """Of the 3-word shingles, repeats included: a bit is 1 if set in over half of their XXH64 values (seed 42)."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    s = b" ".join(words)
    if n < 4:
        return xxh(s, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    total = np.zeros(64, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    for lo in range(0, n - 2, 1 << 16):
        hi = min(n - 2, lo + (1 << 16))
        h = np.fromiter((xxh(s[a:z], 42) for a, z in zip(starts[lo:hi].tolist(), ends[lo + 2 : hi + 2].tolist())), np.uint64, hi - lo)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        # eight byte lanes at a time; 255 rows cannot overflow a lane
        total += np.add.reduceat(bits, np.arange(0, hi - lo, 255)).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n - 2, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in C.binary(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def _masks() -> np.ndarray:
    """By syndrome: the words to flip for each codeword at distance 2 or less.  The code is the perfect [63,57] Hamming
    code with a free 64th bit: column j of its check matrix is j+1, so a word's syndrome is the xor of j+1 over its bits."""
    top, out = 1 << 63, np.zeros((64, 33), np.uint64)
    for s in range(1, 64):
        one = 1 << (s - 1)
        two = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 64) if i != s and i < i ^ s]
        out[s] = np.array([one, one | top, *two], np.uint64)
    out[0, 1] = top
    return out


MASKS = _masks()
CHECKS = np.array([sum(1 << j for j in range(63) if (j + 1) >> b & 1) for b in range(6)], np.uint64)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every codeword at distance 2 or less from each fingerprint: 33, or 2 for a codeword itself."""
    s = sum((np.bitwise_count(fp & c) & 1).astype(np.int64) << b for b, c in enumerate(CHECKS))
    row = np.repeat(np.arange(len(fp)), np.where(s == 0, 2, 33))
    first = np.cumsum(np.where(s == 0, 2, 33)) - np.where(s == 0, 2, 33)
    return row, fp[row] ^ MASKS[s[row], np.arange(len(row)) - first[row]]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for lo in range(0, len(fp), 4096):
            part = fp[lo : lo + 4096]
            row, a = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(part[row].view(np.int64))], ["anchor", "fp"])


def _linked(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within each row of ``groups`` (equal sizes): every member to its least one."""
    n = groups.shape[1]
    near = np.bitwise_count(groups[:, :, None] ^ groups[:, None, :]) <= THRESHOLD
    label = np.broadcast_to(np.arange(n), groups.shape)
    while True:
        new = np.where(near, label[:, None, :], n).min(2)
        if (new == label).all():
            break
        label = new
    g, i = np.nonzero(label != np.arange(n))
    return groups[g, i], groups[g, label[g, i]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor.  An anchor has at most 2081 fingerprints, the points at distance 2 or less from it."""

    def done(a: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        size = np.diff(np.append(first, len(a)))
        us, vs = [], []
        for n in np.unique(size[size > 1]).tolist():
            at = first[size == n]
            step = max(1, (1 << 21) // (n * n))
            for lo in range(0, len(at), step):
                u, v = _linked(fp[at[lo : lo + step, None] + np.arange(n)])
                us.append(u)
                vs.append(v)
        if us:
            e = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["u", "v"])

    a, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for b in batches:
        a = np.concatenate([a, b.column(0).to_numpy()])
        fp = np.concatenate([fp, b.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(a, a[-1])) if len(a) else 0  # the last anchor may go on
        if cut:
            yield from done(a[:cut], fp[:cut])
            a, fp = a[cut:], fp[cut:]
    if len(a):
        yield from done(a, fp)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of ``fps`` (one column, distinct) at THRESHOLD or fewer differing bits.

    Anchors are a covering code of radius 1.  Some word lies within 1 of both ends of a link of up to 2 bits, and some
    anchor within 1 of that word: so both ends are within 2 of a common anchor, and replicating to the anchors within
    the radius plus half the threshold finds every link.
    """
    spread = C.map_arrow(fps, _replicate, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    return C.map_arrow(spread, _compare, "u long, v long").distinct()


def _rooted(points: DataFrame) -> DataFrame:
    """``points`` (one row for each fingerprint fp) with the root of each one's component."""
    roots = components(links(points.select("fp")))
    return points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links between fingerprints.  Fingerprints are made distinct
    before anything is replicated, so a group of equal texts is one point.  A null or blank text has fingerprint zero,
    linked like any other; a null doc_id is kept but never names a component unless all of its ids are null; repeated
    rows stay; an empty table gives no rows.
    """
    own = C.stored(C.map_arrow(C.pick(docs, "doc_id", "text"), _fingerprints, "doc_id long, fp long"), "fingerprints")
    points = C.stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    points = _rooted(points)
    names = points.groupBy("root").agg(F.min("least").alias("component_id"))
    named = C.stored(points.join(names, "root").select("fp", "component_id"), "named")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest doc_id, null after all others; of equal ids, that
    with the least hash of its text.

    A row is known by a 128-bit hash of doc_id and text, so null and repeated doc_ids lose nothing.  Rows equal in both
    share their component and are made one, with map-side combining, before they are looked up.
    """
    row = "_".join(["row", *docs.columns])  # a name that no column has
    own = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    own_fps = C.map_arrow(docs.select("doc_id", "text", own.alias("row")), _fingerprints, "doc_id long, fp long, row string")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")
    points = _rooted(C.stored(own_fps.groupBy("fp").agg(first), "points"))
    keep = points.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return docs.withColumn(row, own).dropDuplicates([row]).join(keep, row, "left_semi").select(*docs.columns)
