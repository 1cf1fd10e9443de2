"""Helpers shared by the training-data operators: scratch tables, Arrow access, word-cached tokenizing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_kept: list[str] = []
#: A full stop or comma that ends a word of other signs: those may be one piece together.
_GLUED = re.compile(r"[.,\0](?:(?<=\0)| (?:(?<=[\W_]..)|(?<=\A..)))")
#: White space other than spaces and line ends: among ASCII signs, and beyond.
_BLANKS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_BLANKS = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where the session names none and all runs in
    one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
    return _own_dir[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a table in the shared folder, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` wrote in this process, once their readers are done; the number deleted."""
    jvm, n = spark._jvm, 0
    while _kept:
        path = jvm.org.apache.hadoop.fs.Path(_kept.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names never matter."""
    return df.select(*cols)


def binary(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z only, as against lower(), which changes other letters too."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(text: str) -> bool:
    """Whether all of its white space is spaces and line ends."""
    for c in _BLANKS:
        if c in text:
            return False
    if not text.isascii():
        for c in _WIDE_BLANKS:
            if c in text:
                return False
    return True


class UnitTokenizer:
    """Ids of whole texts through the ``tokenizers`` library, with a cache of units that it never merges across.

    A unit is a run between separators at which the vocabulary's pre-tokenizer always cuts, so the ids of a text
    are those of its units in order.  ``kind`` "byte": cuts around a line end and before a space that stands
    alone between non-spaces; the space stays with the word after it.  ``kind`` "word": cuts at ASCII white space, which that vocabulary drops.
    The cache is emptied at ``limit`` entries, so its memory is bounded.  A text with a sign that may begin a special
    token of the vocabulary goes to the library whole; the library's settings stay as the file has them, unless
    ``specials_as_text``, with which the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, kind: str, limit: int = 800_000, specials_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tk, self.kind, self.limit = np, Tokenizer.from_file(path), kind, limit
        self.tk.no_padding()
        self.tk.no_truncation()
        self.tk.encode_special_tokens = specials_as_text
        # what every special token begins with: texts without it hold none
        self.special = os.path.commonprefix([t.content for t in self.tk.get_added_tokens_decoder().values()]) if not specials_as_text else None
        self.dtype = np.dtype("<u2") if self.tk.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        (self.sep,) = self.tk.encode("\1", add_special_tokens=False).ids
        # split-off stops and commas: a tab begins no unit after a cut, as what follows one is no white space
        self.marks = {f"\t{c}": self.np.array(self.tk.encode(c, add_special_tokens=False).ids, self.dtype).tobytes() for c in ".,"}
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        # by id: pieces that begin a unit after a space, or end one
        self.edge = np.zeros(self.tk.get_vocab_size(), bool)
        for piece, i in self.tk.get_vocab().items():
            self.edge[i] = piece.startswith("\u0120") if kind == "byte" else piece.endswith("</w>")

    def _units(self, text: str) -> list:
        if self.kind == "word":
            if not _plain(text):
                return re.split("[ \t\n\r\x0b\x0c]+", text)
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            text = text.lower().replace("\n", " ")
            return text.replace(". ", " . ").replace(", ", " , ").split() if not _GLUED.search(text) else text.split()
        if text[:1] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or not _plain(text):
            return [re.split(r"(?<=\S) (?=\S)", text)]
        if not _GLUED.search(text):
            text = text.replace(". ", " \t. ").replace(", ", " \t, ")
        return [line.split(" ") for line in text.split("\n")]

    def _learn(self, cache: dict[str, bytes], missing: list[str], lead: str) -> None:
        """Units whose first or last piece shows where they begin or end go many to a call."""
        if self.kind == "word":
            together = [u for u in missing if u.isalpha() and (u.isascii() or max(u) < "\u0100")]
            apart = [u for u in missing if not (u.isalpha() and (u.isascii() or max(u) < "\u0100"))]
        else:
            together = [u for u in missing if lead and u and " " not in u]
            apart = [u for u in missing if not (lead and u and " " not in u)]
        for at in range(0, len(together), 1 << 16):
            apart += self._runs(cache, together[at : at + (1 << 16)])
        self._parted(cache, apart, lead)

    def _runs(self, cache: dict[str, bytes], units: list[str], each: int = 128) -> list[str]:
        """Learns ``units``, parted by spaces alone; returns those of runs in which the pieces show another number."""
        np, size, word = self.np, self.dtype.itemsize, self.kind == "word"
        runs = [units[at : at + each] for at in range(0, len(units), each)]
        ids = [e.ids for e in self.tk.encode_batch_fast([" ".join(run) if word else " " + " ".join(run) for run in runs], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), self.dtype, sum(map(len, ids)))
        edge = self.edge[flat]
        starts = np.cumsum([0] + [len(x) for x in ids])
        count = np.concatenate(([0], np.cumsum(edge)))
        good = count[starts[1:]] - count[starts[:-1]] == [len(run) for run in runs]
        left: list[str] = []
        if not good.all():
            left = list(chain.from_iterable(run for run, ok in zip(runs, good) if not ok))
            units = list(chain.from_iterable(run for run, ok in zip(runs, good) if ok))
            flat = flat[np.repeat(good, np.diff(starts))]
            edge = self.edge[flat]
        at = np.flatnonzero(edge)
        bounds = ((np.concatenate(([0], at + 1)) if word else np.append(at, len(flat))) * size).tolist()
        raw = flat.tobytes()
        cache.update(zip(units, [raw[a:z] for a, z in zip(bounds, bounds[1:])]))
        return left

    def _parted(self, cache: dict[str, bytes], missing: list[str], lead: str) -> None:
        """Units of Latin letters and digits with a sign between them that no piece of theirs holds; the rest one by one."""
        plain, odd = [], []
        for u in missing:
            (plain if u.isalnum() and (u.isascii() or max(u) < "\u0100") else odd).append(u)
        size, sep = self.dtype.itemsize, self.sep
        runs = [plain[at : at + 64] for at in range(0, len(plain), 64)]
        for run, e in zip(runs, self.tk.encode_batch_fast(["".join([f"{lead}{u}\1" for u in run]) for run in runs], add_special_tokens=False)):
            ids = self.np.array(e.ids, self.dtype)
            ends = self.np.flatnonzero(ids == sep).tolist()
            if len(ends) != len(run):
                odd += run
                continue
            raw, a = ids.tobytes(), 0
            for u, z in zip(run, ends):
                cache[u] = raw[a * size : z * size]
                a = z + 1
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for u, e in zip(part, self.tk.encode_batch_fast([lead + u for u in part], add_special_tokens=False)):
                cache[u] = self.np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``self.dtype``; some texts at a time, whose units stay in the
        processor's cache from their cutting to their joining."""
        import gc

        out: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()  # units make no cycles, and their number sets off one collection after the other
        try:
            for lo, hi in slices(texts, 1 << 16):
                out += self._encode(texts[lo:hi])
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.rest) + len(self.first) > self.limit:
            self.first.clear()
            self.rest.clear()
        if self.special is not None and any(self.special in t for t in texts):
            # an empty beginning in common is in every text
            out = self._encode([t if self.special not in t else "" for t in texts]) if self.special else [b""] * len(texts)
            at = [i for i, t in enumerate(texts) if self.special in t]
            for i, e in zip(at, self.tk.encode_batch_fast([texts[i] for i in at], add_special_tokens=False)):
                out[i] = self.np.array(e.ids, self.dtype).tobytes()
            return out
        split = [self._units(t) for t in texts]
        first, rest = self.first, self.rest
        if self.kind == "word":
            self._learn(rest, list(set(filterfalse(rest.__contains__, chain.from_iterable(split)))), "")
            return [b"".join(map(rest.__getitem__, s)) for s in split]
        rest |= self.marks
        heads = [line.pop(0) for s in split for line in s]
        self._learn(first, list({"\n", *heads}.difference(first)), "")
        self._learn(rest, list(set(filterfalse(rest.__contains__, chain.from_iterable(chain.from_iterable(split))))), " ")
        get, end, head = rest.__getitem__, first["\n"], iter(map(first.__getitem__, heads))
        return [end.join([next(head) + b"".join(map(get, line)) for line in s]) for s in split]


_tokenizers: dict[tuple[str, str], UnitTokenizer] = {}


def unit_tokenizer(path: str, kind: str) -> UnitTokenizer:
    """One for each worker process."""
    if (path, kind) not in _tokenizers:
        _tokenizers[path, kind] = UnitTokenizer(path, kind)
    return _tokenizers[path, kind]


def slices(texts: list[str], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` characters, so that work on a batch needs bounded memory."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def open_fs(uri: str):
    """(file system, path) for a URI that executors share; a bare path is local."""
    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", uri)  # Hadoop's names for it
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1))
