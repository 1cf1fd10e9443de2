"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is rendered."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PREFIXES = "conv_id long, n long, prefix binary, last boolean"
RENDERED = "conv_id long, n_turns long, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(3)))


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation and turn: the hash of every prefix from the one before it; only that is held."""
    rows, conv, state, n, began = [], None, b"", 0, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], ["conv_id", "n", "prefix", "last"])

    for c, role, text in _turns(batches):
        if began and c == conv:
            rows.append((conv, n, state, False))
        else:
            if began:
                rows.append((conv, n, state, True))
            conv, state, n, began = c, b"", 0, True
        r = (role or "").encode()
        state = hashlib.sha256(state + len(r).to_bytes(8, "little") + r + (text or "").encode()).digest()
        n += 1
        if len(rows) >= 10_000:
            yield out()
            rows.clear()
    if began:
        rows.append((conv, n, state, True))
        yield out()


def _render(batches: Iterator[pa.RecordBatch], template: str, end: str) -> Iterator[pa.RecordBatch]:
    rows, size, conv, parts, began = [], 0, None, [], False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n_turns", "text"])

    for c, role, text in _turns(batches):
        if not began or c != conv:
            if began:
                rows.append((conv, len(parts), "".join(parts) + end))
                size += len(rows[-1][2])
                if size > 1 << 22:
                    yield out()
                    rows.clear()
                    size = 0
            conv, parts, began = c, [], True
        parts.append(template.replace("{role}", role or "").replace("{text}", text or ""))
    if began:
        rows.append((conv, len(parts), "".join(parts) + end))
        yield out()


def collapse(turns: DataFrame, template: str = "<|{role}|>\n{text}\n", end: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, text for each maximal conversation of ``turns`` (conv_id, turn, role, text).

    A conversation whose turns (role and text, in order of turn) begin a longer one's is a snapshot of it and goes;
    of equal ones that with the smallest conv_id stays.  Rolling hashes of prefixes (SHA-256) find both by an
    anti-join with distinct hashes on both sides, so a first turn or a conversation that very many share is one row.  A null role or text is empty;
    a null conv_id is a conversation; equal turn numbers are ordered by role and text; no rows give none.
    """
    rows = C.pick(turns, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", "role", "text")
    prefixes = C.stored(C.map_arrow(rows, _roll, PREFIXES), "prefixes")
    # equal conversations are one row before they are looked up; min() skips nulls, so a null conv_id stays only where
    # no numbered conversation is equal
    whole = prefixes.filter("last").groupBy("prefix").agg(F.min("conv_id").alias("conv_id"))
    keep = whole.join(prefixes.filter("not last").select("prefix").distinct(), "prefix", "left_anti").select("conv_id")
    kept = turns.select("conv_id", "turn", "role", "text").alias("t").join(keep.alias("k"), F.expr("t.conv_id <=> k.conv_id"), "left_semi")
    kept = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return C.map_arrow(kept, partial(_render, template=template, end=end), RENDERED)
