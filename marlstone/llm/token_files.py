"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped on reading."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

META = "part long, docs long, tokens long, stem string"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(batches: Iterator[pa.RecordBatch], out_uri: str, tokenizer: str, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    tk = C.unit_tokenizer(tokenizer, kind)
    part = TaskContext.get().partitionId()
    fs, root = C.open_fs(out_uri)
    fs.create_dir(root, recursive=True)
    stem = f"part-{part:06d}"
    # each attempt writes files of its own; the rows that win name them
    stem += f"-{TaskContext.get().taskAttemptId()}"
    end = np.array([end_id], tk.dtype).tobytes()
    ids, sizes = [], []
    with fs.open_output_stream(f"{root}/{stem}.ids") as out:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids.append(b.column(0))
            for lo, hi in C.slices(texts):
                for e in tk.encode(texts[lo:hi]):
                    out.write(e)
                    out.write(end)
                    sizes.append(len(e) // tk.dtype.itemsize + 1)
    if not sizes:
        return
    offsets = np.zeros(len(sizes) + 1, "<u8")
    np.cumsum(sizes, out=offsets[1:])
    with fs.open_output_stream(f"{root}/{stem}.off") as out:
        out.write(offsets.tobytes())
    with fs.open_output_stream(f"{root}/{stem}.docs") as out:
        pq.write_table(pa.table({"doc_id": pa.chunked_array(ids, pa.int64())}), out)
    yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(sizes)], "tokens": [int(offsets[-1])], "stem": [stem]})


def write_token_files(docs: DataFrame, out_uri: str, tokenizer: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    """Writes the ids of every whole ``text`` of ``docs`` (doc_id, text) in ascending doc_id order.

    Each range of doc_ids becomes three files: ``.ids`` (little-endian unsigned 16-bit integers when the vocabulary
    fits, else 32-bit), ``.off`` (64-bit offsets, one more than documents) and ``.docs`` (the doc_ids).  Returns a
    stored row per file: part, docs, tokens, stem, and ``base``, the tokens of all files before it, a prefix sum over
    the parts.  A null text is empty; a null doc_id sorts first; rows with equal ids are ordered by a hash of their
    texts, so that one id's rows can be dealt to many files; an empty table gives no file.  A task that runs again writes new files, and only those named in the result count.
    """
    spark = docs.sparkSession
    rows = C.pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    meta = C.stored(C.map_arrow(ordered, partial(_write, out_uri=out_uri, tokenizer=tokenizer, kind=kind, end_id=end_id), META), "token-meta")
    # one short row for each file of many megabytes: the manifest that any reader of the format holds
    rows, base = sorted(meta.collect(), key=lambda r: r["part"]), 0
    out = []
    for r in rows:
        out.append((r["part"], r["docs"], r["tokens"], r["stem"], base))
        base += r["tokens"]
    return spark.createDataFrame(out, META + ", base long")


def _read(batches: Iterator[pa.RecordBatch], out_uri: str, itemsize: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    fs, root = C.open_fs(out_uri)
    local = fs.type_name == "local"
    kind = f"<u{itemsize}"
    for b in batches:
        for row in b.to_pylist():
            at = f"{root}/{row['stem']}"
            with fs.open_input_file(f"{at}.docs") as f:
                doc_ids = pq.read_table(f).column(0).combine_chunks()
            with fs.open_input_file(f"{at}.off") as f:
                off = np.frombuffer(f.read(), "<u8").astype(np.int64)
            ids = np.memmap(f"{at}.ids", kind, "r") if local else None
            if len(off) != row["docs"] + 1 or off[-1] != row["tokens"] or (local and len(ids) != off[-1]):
                raise ValueError(f"token file {at} does not have the length in its manifest")
            with fs.open_input_file(f"{at}.ids") as f:
                for lo in range(0, len(off) - 1, 10_000):
                    hi, crc = min(lo + 10_000, len(off) - 1), []
                    for i in range(lo, hi):
                        a, z = int(off[i]), int(off[i + 1])
                        own = ids[a:z] if local else np.frombuffer(f.read_at((z - a) * itemsize, a * itemsize), kind)
                        crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([doc_ids[lo:hi], pa.array(off[lo:hi] + row["base"]), pa.array(np.diff(off[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, out_uri: str, itemsize: int = 2) -> DataFrame:
    """A row per document, read back from the memory-mapped files: doc_id, start, n_tokens, ids_crc32 (CRC-32 of the
    ids as little-endian unsigned 32-bit integers).  Checks each file's length against the manifest."""
    n = max(1, min(manifest.sparkSession.sparkContext.defaultParallelism * 8, manifest.count()))
    return C.map_arrow(manifest.repartition(n), partial(_read, out_uri=out_uri, itemsize=itemsize), DOCS)
