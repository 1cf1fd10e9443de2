"""COCO files of any size: one JSON document, written from pieces and read by blocks, both by tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .paths import discard, work_path

#: Bytes that the joining task holds at once.
BLOCK = 1 << 24
_SEP = ",\n"
_EMPTY = {"images": "id long, file_name string, height long, width long", "categories": "id long, name string", "annotations": "id long, image_id long, category_id long, bbox array<double>"}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(path: str, parts: dict[str, DataFrame]) -> None:
    """A list for each of ``parts``.  Tasks write their rows as pieces, which one task joins, block by block: no row comes
    to the driver."""
    spark = next(iter(parts.values())).sparkSession
    folder, names = work_path(spark, "pieces"), list(parts)
    for i, df in enumerate(parts.values()):
        df.select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", _SEP).text(f"{folder}/{i}")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            (pieces, root), (store, out) = _store(folder), _store(path)
            store.create_dir(out.rpartition("/")[0], recursive=True)
            with store.open_output_stream(out) as f:
                for i, name in enumerate(names):
                    f.write(f"{', ' if i else '{'}{json.dumps(name)}: [".encode())
                    found = sorted((x.path, x.size) for x in pieces.get_file_info(fs.FileSelector(f"{root}/{i}")) if x.base_name.startswith("part-") and x.size)
                    for k, (piece, left) in enumerate(found):
                        left -= len(_SEP) if k == len(found) - 1 else 0
                        with pieces.open_input_stream(piece) as g:
                            while left:
                                b = g.read(min(left, BLOCK))
                                if not b:
                                    raise OSError(f"{piece} is shorter than its listing")
                                f.write(b)
                                left -= len(b)
                    f.write(b"]")
                f.write(b"}")
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(join, "id long").collect()
    discard(folder)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The text of a batch's rows, by block."""
    ids, texts = batch.column(0).dictionary_encode(), batch.column(1).cast(pa.large_string())
    codes, ends = ids.indices.to_numpy(), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    for a, z in zip(cuts, cuts[1:]):
        if a < z:
            yield ids.dictionary[int(codes[a])].as_py(), texts.buffers()[2][int(ends[a]) : int(ends[z])].to_pybytes()


def _run(b: bytes, at: int) -> int:
    """Backslashes right before a place."""
    n = 0
    while n < at and b[at - n - 1] == 92:
        n += 1
    return n


def _brackets(b: bytes) -> tuple[np.ndarray, ...]:
    """(quotes, brackets, quotes before each bracket, 1 or -1 for each); a text never starts behind a backslash."""
    a = np.frombuffer(b, np.uint8)
    quotes = np.flatnonzero(a == 34)
    taken = [q for q in quotes[(quotes > 0) & (a[quotes - 1] == 92)].tolist() if _run(b, q) % 2]
    quotes = quotes[~np.isin(quotes, taken)] if taken else quotes
    at = np.flatnonzero(((a | 32) == 123) | ((a | 32) == 125))  # [ and {, ] and }
    return quotes, at, np.searchsorted(quotes, at), np.where((a[at] | 32) == 123, 1, -1)


def _name(b: bytes, quotes: np.ndarray, at: int) -> str | None:
    """Of the list that opens there; None for an object."""
    i = int(np.searchsorted(quotes, at))
    return json.loads(b[quotes[i - 2] : quotes[i - 1] + 1]) if b[at : at + 1] == b"[" and i > 1 and b[quotes[i - 1] + 1 : at].strip() == b":" else None


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to the place in the document, were its start outside or inside a string."""
    seen: dict[str, dict] = {}
    for batch in batches:
        for block, b in _blocks(batch):
            s = seen.setdefault(block, {"odd": 0, "depth": [0, 0], "names": [{}, {}]})
            quotes, at, before, step = _brackets(b)
            for h in (0, 1):
                out = (before + s["odd"] + h) % 2 == 0
                p, d = at[out], step[out]
                level = s["depth"][h] + np.cumsum(d) - d
                p, opened = p[d > 0], level[d > 0]
                for u in np.unique(opened).tolist():
                    s["names"][h][u] = _name(b, quotes, int(p[np.flatnonzero(opened == u)[-1]]))
                s["depth"][h] += int(d.sum())
            s["odd"] ^= len(quotes) & 1
    yield pa.RecordBatch.from_pydict({"block": list(seen), "found": [json.dumps(s) for s in seen.values()]}, pa.schema([("block", pa.string()), ("found", pa.string())]))


def _elements(states: dict[str, tuple[int, int, str | None]]):
    """The objects of the lists: value, list, and whether it is a fragment of one that goes over the end of a block."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, depth, name, head, rest = None, 0, 0, None, False, []

        def fragment(end: bool) -> list[tuple]:
            file, _, start = block.rpartition("\t")
            text = b"".join(rest).replace(b"\n", b" ").replace(b"\r", b" ").decode()
            return [(json.dumps({"f": file, "b": int(start), "p": int(not head), "t": text}), name, 1)] if rest and (head or end) else []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            value, of, part = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(value, pa.string()), pa.array(of, pa.string()), pa.array(part, pa.int32())], ["value", "list", "part"])

        for batch in batches:
            for k, b in _blocks(batch):
                out: list[tuple] = []
                if k != block:
                    out += fragment(True) if block is not None else []
                    block, (inside, depth, name), rest = k, states[k], []
                    head = depth > 2 and name is not None
                quotes, at, before, step = _brackets(b)
                ok = (before + inside) % 2 == 0
                p, d = at[ok], step[ok]
                level = depth + np.cumsum(d) - d
                inside, depth = (inside + len(quotes)) % 2, int(depth + d.sum())
                opens, ends = p[(d > 0) & (level == 2)], p[(d < 0) & (level == 3)]
                context = p[(d > 0) & (level == 1)]
                names = [name, *(_name(b, quotes, int(c)) for c in context)]
                if rest or head:
                    if len(ends):
                        rest.append(b[: ends[0] + 1])
                        out += fragment(False) if head else [(b"".join(rest).replace(b"\n", b" ").replace(b"\r", b" "), name, 0)]
                        ends, rest, head = ends[1:], [], False
                    else:
                        rest.append(b)
                clean = b if b"\n" not in b and b"\r" not in b else b.replace(b"\n", b" ").replace(b"\r", b" ")
                of = np.searchsorted(context, opens).tolist()
                starts, stops = opens.tolist(), (ends + 1).tolist()
                out += [(clean[x:y], names[i], 0) for x, y, i in zip(starts, stops, of) if names[i] is not None]
                name = names[-1]
                if len(starts) > len(stops) and names[of[-1]] is not None:
                    rest = [b[starts[-1] :]]
                if out:
                    yield rows(out)
        last = fragment(True) if block is not None else []
        if last:
            yield rows(last)

    return split


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lists ``images``, ``annotations`` and ``categories`` of a document.  It is cut at closing braces, wherever they
    are; a first pass tells in which list, how deep and whether in a string each block of the file starts."""
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select(F.concat_ws("\t", "_metadata.file_path", "_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"))
    found = {r.block: json.loads(r.found) for r in text.mapInArrow(_surveyed, "block string, found string").collect()}  # one row a block
    states, file, at = {}, None, (0, 0, None)
    for block in sorted(found, key=lambda k: (k.rpartition("\t")[0], int(k.rpartition("\t")[2]))):
        if block.rpartition("\t")[0] != file:
            file, at = block.rpartition("\t")[0], (0, 0, None)
        inside, depth, name = states[block] = at
        s = found[block]
        at = (inside + s["odd"]) % 2, depth + s["depth"][inside], s["names"][inside].get(str(1 - depth), name)
    folder = work_path(spark, "lists")
    rows = text.mapInArrow(_elements(states), "value string, list string, part int").filter(F.col("list").isin(*_EMPTY))
    rows.write.partitionBy("list", "part").text(folder)
    out = {}
    for name, empty in _EMPTY.items():
        there = _exist(f"{folder}/list={name}")
        if "part=1" in there:
            ends = spark.read.schema("f string, b long, p int, t string").json(f"{folder}/list={name}/part=1")  # two rows a block at most
            ends = ends.withColumn("g", F.sum("p").over(Window.partitionBy("f").orderBy("b", "p")))
            whole = ends.groupBy("f", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "p", "t"))), lambda x: x.t), "").alias("value"))
            whole.select("value").write.text(f"{folder}/list={name}/part=2")
        kept = [f"{folder}/list={name}/{p}" for p in ("part=0", "part=2") if p in there or (p == "part=2" and "part=1" in there)]
        out[name] = spark.read.json(kept) if kept else spark.createDataFrame([], empty)
    return out


def _exist(folder: str) -> set[str]:
    from pyarrow import fs

    store, root = _store(folder)
    return {x.base_name for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True))}
