"""Versioned datasets: immutable Parquet files listed by a manifest for each commit, with branches and tags.

A row's number is its file's first number and its place in the file, so an append is one write and numbers nothing; an
update or delete rewrites the files that hold the rows.  A write makes new files first and then adds one small manifest
under the next number, which only one writer can take, so readers see the old state or the new one and no writer's
change is lost.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..errors import DatasetError
from ..operators.rows import ROW_ID


class _Files:
    """Small files under a URI."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def read(self, name: str) -> dict | None:
        from pyarrow import fs

        if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def create(self, name: str, value: object) -> bool:
        """Writes a file that must not be there yet; False when it is.  Atomic on local and Hadoop file systems; on
        object stores, which have no exclusive rename, for one writer at a time."""
        import os

        from pyarrow import fs

        path = f"{self.root}/{name}"
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as f:
            f.write(json.dumps(value).encode())
        if self.fs.type_name == "local":
            try:
                os.link(temp, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
        if self.fs.get_file_info(path).type != fs.FileType.NotFound:
            self.fs.delete_file(temp)
            return False
        try:
            self.fs.move(temp, path)
        except OSError:  # another writer's file came between
            return False
        return True

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return [i.base_name for i in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))]


def _number(file: str) -> int:
    """The number of the partition that wrote a file."""
    return int(re.match(r"part-(\d+)", file)[1])


class _Register:
    """A value whose every version is a numbered file; a writer takes the next number or learns that another did."""

    def __init__(self, files: _Files, folder: str):
        self.files, self.folder = files, folder

    def load(self) -> tuple[int, dict | None]:
        found = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        if not found:
            return 0, None
        last = max(found)
        return int(last[:-5]), self.files.read(f"{self.folder}/{last}")["value"]

    def swap(self, seen: int, value: dict | None) -> bool:
        return self.files.create(f"{self.folder}/{seen + 1:012d}.json", {"value": value})


def _schema(text: str | StructType | Mapping[str, str]) -> StructType:
    if isinstance(text, StructType):
        return text
    return _parse_datatype_string(text) if isinstance(text, str) else _parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in text.items()))


#: Runs of touched files that a write rewrites one by one; with more, all between the first and the last are one run.
RUNS = 16


class Dataset:
    def __init__(self, spark: SparkSession, uri: str, branch: str = "main", version: str | None = None, read_only: bool = False):
        self.spark, self.uri, self.branch, self.version, self.read_only = spark, uri.rstrip("/"), branch, version, read_only
        self.files = _Files(self.uri)
        self.log: list[dict] | None = None

    # opening

    @classmethod
    def exists(cls, spark: SparkSession, uri: str) -> bool:
        return _Register(_Files(uri), "refs").load()[1] is not None

    @classmethod
    def create(cls, spark: SparkSession, uri: str, schema: str | StructType | Mapping[str, str] = "") -> Dataset:
        if cls.exists(spark, uri):
            raise DatasetError(f"{uri} is a dataset already")
        d = cls(spark, uri)
        kind = _schema(schema) if schema else StructType([])
        first = d._commit_file([], kind, None, "created")
        if not _Register(d.files, "refs").swap(0, {"branches": {"main": first}, "tags": {}, "metadata": {}}):
            raise DatasetError(f"{uri} is a dataset already")
        return d

    @classmethod
    def open(cls, spark: SparkSession, uri: str, branch: str = "main", version: str | None = None, read_only: bool = False) -> Dataset:
        d = cls(spark, uri, branch, version, read_only)
        refs = d._refs()
        if version is not None:
            d.version = refs["tags"].get(version, version)
            if d.files.read(f"commits/{d.version}.json") is None:
                raise DatasetError(f"{uri} has no version {version}")
        elif branch not in refs["branches"]:
            raise DatasetError(f"{uri} has no branch {branch}")
        return d

    @classmethod
    def read(cls, spark: SparkSession, uri: str) -> DataFrame:
        return cls.open(spark, uri).df()

    @classmethod
    def open_read_only(cls, spark: SparkSession, uri: str, branch: str = "main", version: str | None = None) -> Dataset:
        return cls.open(spark, uri, branch, version, read_only=True)

    @classmethod
    def convert(cls, spark: SparkSession, source: str | DataFrame, target: str) -> Dataset:
        """A dataset of a Parquet folder's or a DataFrame's rows, committed."""
        df = spark.read.parquet(source) if isinstance(source, str) else source
        d = cls.create(spark, target, df.schema)
        d.append(df)
        d.commit("converted")
        return d

    @classmethod
    def link(cls, spark: SparkSession, source: str, target: str) -> Dataset:
        """A dataset at ``target`` whose rows are those of ``source`` where they lie; writes go to ``target`` alone."""
        other = cls.open_read_only(spark, source)
        s = other._state()
        d = cls.create(spark, target, other.schema)
        parts = [{**p, "path": p["path"] if "://" in p["path"] or p["path"].startswith("/") else f"{other.uri}/{p['path']}", "id": uuid.uuid4().hex} for p in s["parts"]]
        d._stage(d._state(), parts, other.schema, {"op": "link", "source": source})
        d.commit("linked")
        return d

    @classmethod
    def copy(cls, spark: SparkSession, source: str, target: str) -> Dataset:
        """All of it: data, commits and refs."""
        from pyarrow import fs

        a, b = _Files(source), _Files(target)
        b.fs.create_dir(b.root, recursive=True)
        fs.copy_files(a.root, b.root, source_filesystem=a.fs, destination_filesystem=b.fs)
        return cls.open(spark, target)

    @classmethod
    def like(cls, spark: SparkSession, source: str, target: str) -> Dataset:
        """An empty dataset with the columns of another."""
        return cls.create(spark, target, cls.open(spark, source).schema)

    @classmethod
    def delete_all(cls, spark: SparkSession, uri: str) -> None:
        f = _Files(uri)
        if not cls.exists(spark, uri):
            raise DatasetError(f"{uri} is not a dataset")
        f.fs.delete_dir(f.root)

    # state

    def _refs(self) -> dict:
        refs = _Register(self.files, "refs").load()[1]
        if refs is None:
            raise DatasetError(f"{self.uri} is not a dataset")
        return refs

    def _change_refs(self, f) -> dict:
        """``f`` changes the refs in place, once more from the newest ones when another writer was quicker."""
        if self.read_only:
            raise DatasetError(f"{self.uri} was opened to be read only")
        register = _Register(self.files, "refs")
        while True:
            n, refs = register.load()
            if refs is None:
                raise DatasetError(f"{self.uri} is not a dataset")
            f(refs)
            if register.swap(n, refs):
                return refs

    def _commit_file(self, parts: list, schema: StructType, parent: str | None, message: str) -> str:
        key = uuid.uuid4().hex[:16]
        rows = sum(n for p in parts for _, n in p["files"])
        self.files.create(f"commits/{key}.json", {"id": key, "parent": parent, "message": message, "time": time.time(), "parts": parts, "schema": schema.jsonValue(), "rows": rows})
        return key

    def _working(self) -> tuple[int, dict | None]:
        """The number of the branch's uncommitted state, and the state where it stands on the branch's last commit."""
        n, w = _Register(self.files, f"working/{self.branch}").load()
        return n, w if w and w["base"] == self._refs()["branches"].get(self.branch) else None

    def _state(self) -> dict:
        if self.version is not None:
            return self.files.read(f"commits/{self.version}.json")
        n, w = self._working()
        head = self._refs()["branches"].get(self.branch)
        if head is None:
            raise DatasetError(f"{self.uri} has no branch {self.branch}")
        return {**(w or {**self.files.read(f"commits/{head}.json"), "base": head}), "seen": n}

    def _stage(self, seen: dict, parts: list, schema: StructType, what: dict) -> bool:
        """The next uncommitted state, from that in ``seen``; False when another writer made one meanwhile."""
        if self.version is not None or self.read_only:
            raise DatasetError("an old version, or what was opened to be read, can't be written")
        value = {"parts": parts, "schema": schema.jsonValue(), "rows": sum(n for p in parts for _, n in p["files"]), "base": seen["base"]}
        if not _Register(self.files, f"working/{self.branch}").swap(seen["seen"], value):
            return False
        if self.log is not None:
            self.log.append(what)
        return True

    def _staged(self, seen: dict, parts: list, schema: StructType, what: dict) -> None:
        if not self._stage(seen, parts, schema, what):
            raise DatasetError(f"{what['op']}: another writer changed the branch meanwhile")

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self._state()["schema"])

    def token(self) -> str:
        """Names the present rows: equal tokens, equal rows."""
        s = self._state()
        return hashlib.sha256(json.dumps([s["parts"], s["schema"]], sort_keys=True).encode()).hexdigest()

    def __len__(self) -> int:
        return self._state()["rows"]

    def _place(self, path: str) -> str:
        return path if "://" in path or path.startswith("/") else f"{self.uri}/{path}"

    def _scan(self, parts: list, schema: StructType, files: bool = False, only: list[set[str]] | None = None) -> DataFrame:
        """The rows of ``parts`` with their dense _row_id; with ``files`` their path and file too.  Files of one folder
        are one scan, whose numbers are looked up by the file's number and its place in it.  ``only`` names each part's files to read."""
        groups: dict[str, list] = {}
        base = 0
        for k, p in enumerate(parts):
            g = groups.setdefault(json.dumps([p["path"], sorted(p["columns"]), p["names"]]), [p, [], {}])
            for name, n in p["files"]:
                if only is None or name in only[k]:
                    g[1].append(name)
                g[2][_number(name)] = base
                base += n
        out = None
        for p, names, bases in groups.values():
            if not names:
                continue
            stored = p["names"]  # stored name by column
            own = StructType([StructField(stored.get(f.name, f.name), f.dataType) for f in schema if f.name in p["columns"]])
            where = self._place(p["path"])
            rows = self.spark.read.schema(own).parquet(*([where] if len(names) == p["all"] else [f"{where}/{n}" for n in names]))
            at = F.split(F.lit(",".join(str(bases.get(i, 0)) for i in range(max(bases) + 1))), ",").cast("array<bigint>")
            name = F.col("_metadata.file_name")
            number = F.get(at, F.split_part(name, F.lit("-"), F.lit(2)).cast("int")) + F.col("_metadata.row_index")
            cols = [F.col(f"`{stored.get(f.name, f.name)}`").alias(f.name, metadata=f.metadata) if f.name in p["columns"] else F.lit(f.metadata.get("default")).cast(f.dataType).alias(f.name) for f in schema]
            more = [F.lit(p["path"]).alias("__path"), name.alias("__file")] if files else []
            rows = rows.select(*cols, number.alias(ROW_ID), *more)
            out = rows if out is None else out.unionByName(rows)
        if out is not None:
            return out
        more = [StructField(n, _parse_datatype_string("string")) for n in ("__path", "__file")] if files else []
        return self.spark.createDataFrame([], StructType([*schema.fields, StructField(ROW_ID, _parse_datatype_string("long")), *more]))

    def df(self) -> DataFrame:
        """The rows with their dense _row_id; columns added after a part was written are filled with their default."""
        s = self._state()
        return self._scan(s["parts"], StructType.fromJson(s["schema"]))

    def take(self, numbers: Sequence[int]) -> DataFrame:
        """The rows of a list of numbers that fits the driver, from the files alone that hold them."""
        s, want, parts, base = self._state(), sorted(set(numbers)), [], 0
        for p in s["parts"]:
            files = []
            for f in p["files"]:
                at = bisect.bisect_left(want, base)
                if at < len(want) and want[at] < base + f[1]:
                    files.append(f)
                base += f[1]
            parts.append({f[0] for f in files})
        return self._scan(s["parts"], StructType.fromJson(s["schema"]), only=parts).filter(F.col(ROW_ID).isin(want))

    # writes

    def _write(self, df: DataFrame, part: str | None = None) -> dict:
        """A part of the rows in their present order, partition by partition; ``part`` is the id of that it replaces."""
        path = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", 0).parquet(f"{self.uri}/{path}")
        # a row for each file
        found = self.spark.read.schema(df.schema).parquet(f"{self.uri}/{path}").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()
        files = sorted(((r.f, r.n) for r in found), key=lambda x: _number(x[0]))
        return {"path": path, "columns": df.columns, "names": {}, "files": files, "all": len(files), "id": part or uuid.uuid4().hex}

    def append(self, rows: DataFrame | Sequence[Mapping] | Mapping[str, Sequence]) -> None:
        """Rows as a DataFrame, a list of records or columns of equal length; names must be the dataset's.  Appends of
        several writers all stay."""
        schema = self.schema
        if self.version is not None or self.read_only:
            raise DatasetError("an old version, or what was opened to be read, can't be written")
        if isinstance(rows, Mapping):
            sizes = {len(v) for v in rows.values()}
            if len(sizes) > 1:
                raise DatasetError("the columns have different lengths")
            rows = [dict(zip(rows, r)) for r in zip(*rows.values())]
        if not isinstance(rows, DataFrame):
            for r in rows:
                if set(r) != set(schema.names):
                    raise DatasetError(f"a row has the columns {sorted(r)}, the dataset {sorted(schema.names)}")
            df = self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema).coalesce(1)
        else:
            extra = set(rows.columns) - {ROW_ID}
            if extra != set(schema.names):
                raise DatasetError(f"the rows have the columns {sorted(extra)}, the dataset {sorted(schema.names)}")
            if ROW_ID in rows.columns:
                rows = rows.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID)
            df = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))
        self._add([self._write(df)], schema)

    def _add(self, parts: list, schema: StructType) -> None:
        while True:
            s = self._state()
            if StructType.fromJson(s["schema"]).names != schema.names:
                raise DatasetError("append: another writer changed the columns meanwhile")
            if self._stage(s, [*s["parts"], *parts], schema, {"op": "append", "rows": sum(n for p in parts for _, n in p["files"])}):
                return

    def _rewritten(self, where: Column, change, what: dict) -> None:
        """Rewrites the files that hold rows of ``where`` by ``change``; all others stay as they are."""
        s = self._state()
        schema = StructType.fromJson(s["schema"])
        scan = self._scan(s["parts"], schema, files=True)
        touched = {(r[0], r[1]) for r in scan.filter(where).select("__path", "__file").distinct().collect()}  # names of files
        flat = [(p, f) for p in s["parts"] for f in p["files"]]
        hit = [k for k, (p, f) in enumerate(flat) if (p["path"], f[0]) in touched]
        runs: list[list[int]] = []
        for k in hit:
            # a run is of neighbours in one part, so that what is replaced keeps the part's id
            if runs and runs[-1][-1] == k - 1 and flat[k - 1][0] is flat[k][0]:
                runs[-1].append(k)
            else:
                runs.append([k])
        if len(runs) > RUNS:
            spans: dict[int, list[int]] = {}
            for k in hit:
                spans.setdefault(id(flat[k][0]), []).append(k)
            runs = [list(range(v[0], v[-1] + 1)) for v in spans.values()]
        new = {}
        base = [0]
        for _, f in flat:
            base.append(base[-1] + f[1])
        for run in runs:
            p, n = flat[run[0]][0], len(run)
            own = self._scan([{**p, "files": [flat[k][1] for k in run]}], schema)
            own = change(own.withColumn(ROW_ID, F.col(ROW_ID) + base[run[0]]))
            own = own.coalesce(1).sortWithinPartitions(ROW_ID) if n == 1 else own.repartitionByRange(n, ROW_ID).sortWithinPartitions(ROW_ID)
            new[run[0]] = self._write(own.drop(ROW_ID), p["id"])
        gone = {k for run in runs for k in run}
        parts: list[dict] = []
        for k, (p, f) in enumerate(flat):
            if k in new:
                parts += [new[k]] if new[k]["files"] else []
            elif k not in gone:
                if parts and parts[-1]["path"] == p["path"] and parts[-1]["names"] == p["names"]:
                    parts[-1]["files"].append(f)
                else:
                    parts.append({**p, "files": [f]})
        self._staged(s, parts, schema, what)

    def update(self, where: Column | str, values: Mapping[str, object]) -> None:
        where = F.expr(where) if isinstance(where, str) else where
        schema = self.schema
        for c in values:
            if c not in schema.names:
                raise DatasetError(f"there is no column {c}")

        def change(df: DataFrame) -> DataFrame:
            return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(schema[c].dataType) for c, v in values.items()})

        self._rewritten(where, change, {"op": "update", "columns": list(values)})

    def delete(self, where: Column | str | int | range) -> None:
        """By condition, by row number or by a range of them; the rows after move up."""
        if isinstance(where, int):
            where = F.col(ROW_ID) == where
        elif isinstance(where, range):
            where = (F.col(ROW_ID) >= where.start) & (F.col(ROW_ID) < where.stop)
        where = F.expr(where) if isinstance(where, str) else where
        self._rewritten(where, lambda df: df.filter(~F.coalesce(where, F.lit(False))), {"op": "delete"})

    def add_column(self, name: str, kind: str, default: object = None) -> None:
        s, schema = self._state(), self.schema
        if name in schema.names:
            raise DatasetError(f"there is a column {name} already")
        f = StructField(name, _parse_datatype_string(kind), True, {} if default is None else {"default": default})
        self._staged(s, s["parts"], StructType([*schema.fields, f]), {"op": "add_column", "name": name})

    def drop_column(self, name: str) -> None:
        s, schema = self._state(), self.schema
        if name not in schema.names:
            raise DatasetError(f"there is no column {name}")
        parts = [{**p, "columns": [c for c in p["columns"] if c != name]} for p in s["parts"]]
        self._staged(s, parts, StructType([f for f in schema if f.name != name]), {"op": "drop_column", "name": name})

    def rename_column(self, old: str, new: str) -> None:
        s, schema = self._state(), self.schema
        if old not in schema.names or new in schema.names:
            raise DatasetError(f"{old} can't become {new}")
        parts = [{**p, "columns": [new if c == old else c for c in p["columns"]], "names": {**{k: v for k, v in p["names"].items() if k != old}, **({new: p["names"].get(old, old)} if old in p["columns"] else {})}} for p in s["parts"]]
        self._staged(s, parts, StructType([StructField(new, f.dataType, f.nullable, f.metadata) if f.name == old else f for f in schema]), {"op": "rename_column"})

    # versions

    def commit(self, message: str = "") -> str:
        """Makes the uncommitted state the branch's last commit; raises when another writer committed since it began."""
        n, w = self._working()
        if w is None:
            head = self._refs()["branches"].get(self.branch)
            if _Register(self.files, f"working/{self.branch}").load()[1] is not None:
                self.rollback()
                raise DatasetError("another writer committed since these changes began; they are dropped")
            return head
        key = self._commit_file(w["parts"], StructType.fromJson(w["schema"]), w["base"], message)

        def move(refs: dict) -> None:
            if refs["branches"].get(self.branch) != w["base"]:
                raise DatasetError("another writer committed since these changes began")
            refs["branches"][self.branch] = key

        self._change_refs(move)
        register = _Register(self.files, f"working/{self.branch}")
        if not register.swap(n, None):
            # written since: that state has this one's rows and now stands on its commit
            while True:
                n, later = register.load()
                if later is None or later["base"] != w["base"] or register.swap(n, {**later, "base": key}):
                    break
        return key

    def rollback(self) -> None:
        """Drops what is not committed."""
        register = _Register(self.files, f"working/{self.branch}")
        while True:
            n, w = register.load()
            if w is None or register.swap(n, None):
                return

    def savepoint(self) -> dict | None:
        return self._working()[1]

    def restore(self, point: dict | None) -> None:
        register = _Register(self.files, f"working/{self.branch}")
        if not register.swap(register.load()[0], point):
            raise DatasetError("restore: another writer changed the branch meanwhile")

    def history(self) -> list[dict]:
        """Commits from the newest on."""
        key, out = self.version or self._refs()["branches"][self.branch], []
        while key:
            c = self.files.read(f"commits/{key}.json")
            out.append({k: c[k] for k in ("id", "message", "time", "rows", "parent")})
            key = c["parent"]
        return out

    def branches(self) -> list[str]:
        return sorted(self._refs()["branches"])

    def create_branch(self, name: str) -> Dataset:
        def add(refs: dict) -> None:
            if name in refs["branches"]:
                raise DatasetError(f"there is a branch {name} already")
            refs["branches"][name] = self.version or refs["branches"][self.branch]

        self._change_refs(add)
        return Dataset.open(self.spark, self.uri, name)

    def rename_branch(self, old: str, new: str) -> None:
        def rename(refs: dict) -> None:
            if old == "main" or old not in refs["branches"] or new in refs["branches"]:
                raise DatasetError(f"branch {old} can't be renamed to {new}")
            refs["branches"][new] = refs["branches"].pop(old)

        self._change_refs(rename)

    def delete_branch(self, name: str) -> None:
        def delete(refs: dict) -> None:
            if name == "main" or name not in refs["branches"]:
                raise DatasetError(f"branch {name} can't be deleted")
            del refs["branches"][name]

        self._change_refs(delete)

    def merge(self, branch: str) -> None:
        """Rows that ``branch`` appended since the last common commit are appended here, as they are there now.  Parts
        are known by what appended them, so rows that the branch deleted or changed meanwhile confuse nothing."""
        own = {c["id"] for c in self.history()}
        other = Dataset.open(self.spark, self.uri, branch)
        base = next((c for c in other.history() if c["id"] in own), None)
        if base is None:
            raise DatasetError("the branches have no common commit")
        if other.schema.names != self.schema.names:
            raise DatasetError(f"the branch has the columns {other.schema.names}, this one {self.schema.names}")
        old = {p["id"] for p in self.files.read(f"commits/{base['id']}.json")["parts"]}
        here = {p["id"] for p in self._state()["parts"]}
        self._add([p for p in other._state()["parts"] if p["id"] not in old | here], self.schema)

    def tag(self, name: str, version: str | None = None) -> None:
        def add(refs: dict) -> None:
            if name in refs["tags"]:
                raise DatasetError(f"there is a tag {name} already")
            refs["tags"][name] = version or self.version or refs["branches"][self.branch]

        self._change_refs(add)

    def tags(self) -> dict[str, str]:
        return dict(self._refs()["tags"])

    def delete_tag(self, name: str) -> None:
        def delete(refs: dict) -> None:
            if refs["tags"].pop(name, None) is None:
                raise DatasetError(f"there is no tag {name}")

        self._change_refs(delete)

    def tag_view(self, name: str, query: str) -> None:
        """Keeps a query over this dataset, with its commit, under a name."""
        version = self.version or self._refs()["branches"][self.branch]

        def add(refs: dict) -> None:
            if name in refs.setdefault("views", {}):
                raise DatasetError(f"there is a view {name} already")
            refs["views"][name] = {"query": query, "version": version}

        self._change_refs(add)

    def view(self, name: str) -> DataFrame:
        """The rows of a kept query at its commit."""
        from ..api import query

        found = self._refs().get("views", {}).get(name)
        if found is None:
            raise DatasetError(f"there is no view {name}")
        return query(found["query"], self.spark, view=Dataset.open(self.spark, self.uri, version=found["version"]).df())

    def views(self) -> list[str]:
        return sorted(self._refs().get("views", {}))

    def metadata(self, **values) -> dict:
        return self._change_refs(lambda refs: refs["metadata"].update(values))["metadata"] if values else self._refs()["metadata"]

    def change_metadata(self, change) -> None:
        """``change`` edits the newest metadata in place, so that writers do not undo each other's."""
        self._change_refs(lambda refs: change(refs["metadata"]))

    def push(self, target: str) -> None:
        """Copies the data folders and commits that ``target`` lacks, then moves its branches on; a branch that has
        commits there which are not here is an error, and nothing is moved."""
        from pyarrow import fs

        other = _Files(target)
        for folder in ("data", "commits"):
            there = set(other.names(folder))
            for n in self.files.names(folder):
                if n in there:
                    continue
                other.fs.create_dir(f"{other.root}/{folder}/{n}" if folder == "data" else f"{other.root}/{folder}", recursive=True)
                fs.copy_files(f"{self.files.root}/{folder}/{n}", f"{other.root}/{folder}/{n}", source_filesystem=self.files.fs, destination_filesystem=other.fs)
        own = self._refs()
        register = _Register(other, "refs")
        while True:
            n, refs = register.load()
            refs = refs or {"branches": {}, "tags": {}, "metadata": {}}
            for b, key in own["branches"].items():
                if refs["branches"].get(b, key) not in self._ancestors(key):
                    raise DatasetError(f"branch {b} of {target} has commits that are not here; pull first")
            for t, key in own["tags"].items():
                if refs["tags"].get(t, key) != key:
                    raise DatasetError(f"tag {t} of {target} is another commit's")
            new = {**own, "branches": refs["branches"] | own["branches"], "tags": refs["tags"] | own["tags"], "metadata": refs["metadata"] | own["metadata"]}
            if register.swap(n, new):
                return

    def _ancestors(self, key: str | None) -> set[str]:
        out = set()
        while key:
            out.add(key)
            key = (self.files.read(f"commits/{key}.json") or {}).get("parent")
        return out

    def pull(self, source: str) -> None:
        Dataset(self.spark, source).push(self.uri)

    def start_logging(self) -> None:
        self.log = []

    def stop_logging(self) -> list[dict]:
        log, self.log = self.log or [], None
        return log

    # rows

    def __getitem__(self, at: int | slice | list) -> DataFrame:
        from ..operators.rows import row_list, row_slice

        if isinstance(at, int):
            at = at + len(self) if at < 0 else at
            return row_slice(self.df(), at, at + 1)
        if isinstance(at, slice):
            return row_slice(self.df(), at.start, at.stop)
        return row_list(self.df(), at)
