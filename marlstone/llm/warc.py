"""WARC archives in Zstandard frames, one for each record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SKIPPABLE = 0x184D2A5D
DICT_MAGIC = 0xEC30A437
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CHUNK = 1 << 16


def _record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None) -> bytes:
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}", "Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], out_uri: str, level: int, dict_kb: int) -> Iterator[pa.RecordBatch]:
    import zstandard as zstd

    fs, root = C.open_fs(out_uri)
    fs.create_dir(root, recursive=True)
    ctx = TaskContext.get()
    name, out, z, n = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.zst", None, None, 0
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        records = [_record(p, u, h or b"", len(h or b""), d, r) for p, u, h, d, r in zip(*cols)]
        if out is None and records:
            # trained on the first records of the file, 1 MB of them at most
            sample, total = [], 0
            for r in records:
                if total < 1 << 20:
                    sample.append(r[: 1 << 15])
                    total += len(sample[-1])
            try:
                d = zstd.train_dictionary(dict_kb << 10, sample)
            except zstd.ZstdError:  # too few samples to train on
                d = None
            out = fs.open_output_stream(f"{root}/{name}")
            if d:
                frame = zstd.ZstdCompressor(level=level).compress(d.as_bytes())
                out.write(struct.pack("<II", SKIPPABLE, len(frame)) + frame)
            z = zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
        for r in records:
            out.write(z.compress(r))
        n += len(records)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [f"{out_uri}/{name}"], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))


def write_archives(pages: DataFrame, out_uri: str, level: int = 3, dict_kb: int = 32, least: int = 100) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html), the payload the html in UTF-8.  Of records with equal
    payloads of ``least`` bytes or more, that with the smallest page_id is the response and the others revisit it.
    Returns (path, records), a stored row per archive.

    A null html is an empty payload, a null url an empty target.  Repeated rows with the smallest page_id are all
    responses; a row with a null page_id revisits a numbered one with its payload and is a response when there is none.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    narrow = own.filter(F.length("payload") >= least).select("page_id", "digest")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    # the digest of a very common page is a hot key: only ids and digests meet on it, payloads by page
    again = narrow.join(groups, "digest").filter("first is not null and not page_id <=> first").distinct()
    rows = own.alias("o").join(again.alias("g"), F.expr("o.page_id <=> g.page_id and o.digest = g.digest"), "left")
    rows = rows.select("o.page_id", "url", "payload", "o.digest", F.col("first").alias("refers_to"))
    return C.stored(C.map_arrow(rows, partial(_write, out_uri=out_uri, level=level, dict_kb=dict_kb), "path string, records long"), "warc-meta")


def frames(f) -> Iterator[bytes]:
    """The contents of each frame of an open archive, after its dictionary; raises ValueError where it is not whole."""
    import zstandard as zstd

    d, at, data = None, 0, b""
    head = f.read(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        length = struct.unpack("<I", head[4:])[0]
        raw = f.read(length)
        if len(raw) != length:
            raise ValueError("the dictionary's frame is cut off")
        if struct.unpack("<I", raw[:4])[0] != DICT_MAGIC:
            raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
        if struct.unpack("<I", raw[:4])[0] != DICT_MAGIC:
            raise ValueError("the leading skippable frame holds no dictionary")
        d = zstd.ZstdCompressionDict(raw)
    else:
        data = head
    z = zstd.ZstdDecompressor(dict_data=d)
    while True:
        obj, parts = z.decompressobj(), []
        while not obj.eof:
            if at >= len(data):
                data, at = f.read(CHUNK), 0
                if not data:
                    if parts:
                        raise ValueError("the last frame is cut off")
                    return
            part = memoryview(data)[at : at + 8192]
            parts.append(obj.decompress(part))
            at += len(part) - len(obj.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple:
    """A record's row, its header and lengths checked."""
    end = record.find(b"\r\n\r\n")
    lines = record[: max(end, 0)].decode().split("\r\n")
    if end < 0 or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if k not in h:
            raise ValueError(f"a record lacks {k}")
    payload, n = record[end + 4 : -4], int(h["Content-Length"])
    if len(payload) != n or record[-4:] != b"\r\n\r\n":
        raise ValueError(f"a record has {len(payload)} bytes; its header says {n}")
    digest, refers = h["WARC-Payload-Digest"].removeprefix("sha256:"), None
    if h["WARC-Type"] == "response":
        if n != int(h["X-Payload-Length"]) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
    elif h["WARC-Type"] == "revisit":
        refers = int(h["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">"))
    else:
        raise ValueError(f"unknown record type {h['WARC-Type']}")
    page = h["WARC-Record-ID"].removeprefix("<urn:page:").rstrip(">")
    return int(page) if page else None, int(h["X-Payload-Length"]), digest, h["WARC-Type"], refers


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for path, records in zip(*(b.column(i).to_pylist() for i in range(2))):
            fs, p = C.open_fs(path)
            rows, n = [], 0
            with fs.open_input_stream(p) as f:
                for r in frames(f):
                    rows.append(parse(r))
                    n += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if n != records:
                raise ValueError(f"{path} has {n} records, not {records}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of ``archives`` (path, records): page_id, payload_bytes, payload_digest, record_type, refers_to.
    Each frame is decoded with the file's dictionary, and headers, lengths and digests are validated."""
    n = max(1, min(archives.sparkSession.sparkContext.defaultParallelism * 8, archives.count()))
    return C.map_arrow(archives.select("path", "records").repartition(n), _read, RECORDS)
