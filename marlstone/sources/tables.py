"""SQL statements that define and change tables, each a versioned dataset in one folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import DatasetError, QuerySyntaxError
from ..operators.rows import ROW_ID, with_row_id
from ..plans import sqlcompat
from . import io
from .dataset import Dataset
from .storage import Reader

#: SQL type names and what stores them.
TYPES = {
    "int2": "smallint", "smallint": "smallint", "int4": "int", "int": "int", "integer": "int", "int8": "bigint", "bigint": "bigint", "serial": "bigint", "bigserial": "bigint",
    "float4": "float", "real": "float", "float8": "double", "double precision": "double", "double": "double", "bool": "boolean", "boolean": "boolean",
    "char": "string", "bpchar": "string", "varchar": "string", "text": "string", "uuid": "string", "file_id": "string", "json": "string", "jsonb": "string", "time": "string",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "image": "binary", "video": "binary", "file": "string",
    "embedding": "array<float>", "embedding_2d": "array<array<float>>",
}
_ZERO = {"string": "", "boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0}


def spark_type(name: str, numeric_as_double: bool = True) -> str:
    """``numeric(p,s)`` is a double unless exact decimals are asked for; ``[]`` after a name is an array of it."""
    n = " ".join(name.lower().split())
    if n.endswith("[]"):
        return f"array<{spark_type(n[:-2], numeric_as_double)}>"
    base, _, size = n.partition("(")
    if base.strip() in ("numeric", "decimal"):
        return "double" if numeric_as_double else f"decimal({size}" if size else "decimal(38,18)"
    try:
        return TYPES[base.strip()]
    except KeyError:
        raise QuerySyntaxError(f"unknown type {name!r}") from None


def split_list(text: str) -> list[str]:
    """Parts between commas that are in no string, parentheses or brackets."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


def _cut(text: str, word: str) -> tuple[str, str | None]:
    """What stands before and after a keyword that is in no string or parentheses."""
    depth, quoted = 0, False
    for m in re.finditer(rf"'|[(\[]|[)\]]|\b{word}\b", text, re.I):
        c = m[0]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth:
            return text[: m.start()].strip(), text[m.end() :].strip()
    return text.strip(), None


class Database:
    """Tables under ``folder``; each statement is a commit of its own outside of BEGIN and COMMIT.

    With ``null_compat`` nulls that are written become zeros and empty texts, as on a surface that stores no nulls.
    """

    def __init__(self, spark: SparkSession, folder: str, numeric_as_double: bool = True, null_compat: bool = False):
        self.spark, self.folder, self.numeric_as_double, self.null_compat = spark, folder.rstrip("/"), numeric_as_double, null_compat
        self.prepared: dict[str, str] = {}
        self.attached: dict[str, str] = {}
        self.points: dict[str, dict] | None = None
        self.start: dict | None = None

    # tables

    def names(self) -> list[str]:
        return sorted({*Reader(self.folder).list_dirs(), *self.attached})

    def _uri(self, name: str) -> str:
        return self.attached.get(name, f"{self.folder}/{name}")

    def table(self, name: str) -> Dataset:
        name = name.strip('"` ')
        if not Dataset.exists(self.spark, self._uri(name)):
            raise DatasetError(f"there is no table {name}")
        return Dataset.open(self.spark, self._uri(name))

    def attach(self, name: str, uri: str) -> Dataset:
        """An existing dataset under a name of its own."""
        if not Dataset.exists(self.spark, uri):
            raise DatasetError(f"{uri} is not a dataset")
        self.attached[name] = uri
        return self.table(name)

    def select(self, sql: str, args: list | dict | None = None) -> DataFrame:
        for n in self.names():
            if re.search(rf"\b{re.escape(n)}\b", sql):
                self.table(n).df().drop(ROW_ID).createOrReplaceTempView(n)
        return sqlcompat.run(self.spark, sql, args)

    def _done(self, d: Dataset, message: str) -> None:
        if self.start is None:
            d.commit(message)

    def _written(self, df: DataFrame, schema: StructType) -> DataFrame:
        return df.fillna({f.name: _ZERO[k] for f in schema if (k := f.dataType.simpleString()) in _ZERO and f.name in df.columns}) if self.null_compat else df

    # statements

    def execute(self, sql: str, args: list | dict | None = None) -> DataFrame | None:
        """A query's rows; nothing for a statement that changes something."""
        s = sql.strip().rstrip(";").strip()
        word = s.split(None, 1)[0].lower() if s else ""
        if word in ("select", "with", "values"):
            return self.select(s, args)
        f = getattr(self, f"_{word}", None) if word in ("create", "drop", "alter", "insert", "update", "delete", "truncate", "copy", "import", "show", "describe", "prepare", "execute", "deallocate", "begin", "commit", "rollback", "savepoint") else None
        if f is None:
            raise QuerySyntaxError(f"unknown statement {word!r}")
        return f(s)

    @staticmethod
    def _match(pattern: str, s: str) -> re.Match:
        m = re.fullmatch(pattern, s, re.I | re.S)
        if not m:
            raise QuerySyntaxError(f"not understood: {s[:80]}")
        return m

    def _columns(self, text: str) -> tuple[list[tuple[str, str, object]], list[str]]:
        cols, serial = [], []
        for part in split_list(text):
            if re.match(r"(primary key|unique|constraint|foreign key|check)\b", part, re.I):
                continue
            m = self._match(r'"?(\w+)"?\s+((?:double precision|\w+)(?:\s*\([\d\s,]+\))?(?:\s*\[\s*\])*)(.*)', part)
            default = re.search(r"\bdefault\s+('(?:[^']|'')*'|-?[\d.]+|true|false)", m[3], re.I)
            value = None
            if default:
                d = default[1]
                value = d[1:-1].replace("''", "'") if d[0] == "'" else d.lower() == "true" if d.lower() in ("true", "false") else float(d) if "." in d else int(d)
            if m[2].lower() in ("serial", "bigserial"):
                serial.append(m[1])
            cols.append((m[1], spark_type(re.sub(r"\s*\[\s*\]", "[]", m[2]), self.numeric_as_double), value))
        return cols, serial

    def _create(self, s: str) -> None:
        if re.match(r"create\s+(or\s+replace\s+)?(temp(orary)?\s+)?view\b", s, re.I):
            m = self._match(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+(\w+)\s+as\s+(.*)", s)
            self.select(m[2]).createOrReplaceTempView(m[1])
            return
        if re.match(r"create\s+index\b", s, re.I):
            m = self._match(r"create\s+index\s+(?:if\s+not\s+exists\s+)?(\w+)\s+on\s+(\w+)\s*(?:using\s+\w+\s*)?\(\s*(\w+)[^)]*\)\s*(?:with\s*\(\s*index_type\s*=\s*'?(\w+)'?\s*\))?", s)
            from ..operators.indexes import Indexes

            Indexes(self.table(m[2])).create(m[3], m[4], name=m[1])
            return
        m = self._match(r"create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*(?:using\s+\w+\s*)?(.*)", s)
        if Dataset.exists(self.spark, self._uri(m[2])):
            if m[1]:
                return
            raise DatasetError(f"there is a table {m[2]} already")
        rest = m[3].strip()
        body, query = _cut(rest, "as") if not rest.startswith("(") else (rest, None)
        if query:
            df = self.select(query)
            Dataset.create(self.spark, self._uri(m[2]), df.schema)
            d = self.table(m[2])
            d.append(self._written(df, df.schema))
            self._done(d, "create table as")
            return
        inner = self._match(r"\((.*)\)\s*(?:using\s+\w+)?", body)[1]
        cols, serial = self._columns(inner)
        d = Dataset.create(self.spark, self._uri(m[2]))
        for name, kind, default in cols:
            d.add_column(name, kind, default)
        d.commit("create table")
        if serial:
            d.metadata(serial=serial)

    def _drop(self, s: str) -> None:
        m = self._match(r"drop\s+(table|view|index)\s+(if\s+exists\s+)?(\w+)(?:\s+on\s+(\w+))?(?:\s+cascade)?", s)
        if m[1].lower() == "view":
            self.spark.catalog.dropTempView(m[3])
        elif m[1].lower() == "index":
            from ..operators.indexes import Indexes

            for t in [m[4]] if m[4] else self.names():
                Indexes(self.table(t)).drop(name=m[3])
        elif m[3] in self.attached:
            del self.attached[m[3]]
        elif Dataset.exists(self.spark, self._uri(m[3])):
            Dataset.delete_all(self.spark, self._uri(m[3]))
        elif not m[2]:
            raise DatasetError(f"there is no table {m[3]}")

    def _alter(self, s: str) -> None:
        m = self._match(r"alter\s+table\s+(\w+)\s+(add|drop|rename)\s+(?:column\s+)?(.*)", s)
        d = self.table(m[1])
        if m[2].lower() == "add":
            ((name, kind, default),), _ = self._columns(m[3])
            d.add_column(name, kind, default)
        elif m[2].lower() == "drop":
            d.drop_column(m[3].split()[-1])
        else:
            old, new = self._match(r"(\w+)\s+to\s+(\w+)", m[3]).groups()
            d.rename_column(old, new)
        self._done(d, "alter table")

    def _insert(self, s: str) -> None:
        m = self._match(r"insert\s+into\s+(\w+)\s*(\([^()]*\)(?=\s*(?:values|select|with)\b))?\s*(.*)", s)
        d = self.table(m[1])
        schema, serial = d.schema, d.metadata().get("serial", [])
        names = [c.strip(' "') for c in m[2].strip("() ").split(",")] if m[2] else [f.name for f in schema]
        unknown = [c for c in names if c not in schema.names]
        if unknown:
            raise DatasetError(f"{m[1]} has no column {unknown[0]}")
        df = self.select(m[3])
        if not m[2] and len(df.columns) < len(names):
            names = names[: len(df.columns)]
        if len(df.columns) != len(names):
            raise DatasetError(f"{len(names)} columns are named and {len(df.columns)} given")
        df = df.toDF(*names)
        made = [c for c in serial if c not in names]
        if made:
            last = d.df().agg(*(F.coalesce(F.max(c), F.lit(0)).alias(f"__{c}") for c in made))
            df = with_row_id(df.withColumn("__o", F.monotonically_increasing_id()), ["__o"]).join(F.broadcast(last))  # one row
            df = df.withColumns({c: F.col(f"__{c}") + F.col(ROW_ID) + 1 for c in made}).drop("__o", ROW_ID, *(f"__{c}" for c in made))
        rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(f.metadata.get("default"))).cast(f.dataType).alias(f.name) for f in schema))
        d.append(self._written(rows, schema))
        self._done(d, "insert")

    def _update(self, s: str) -> None:
        m = self._match(r"update\s+(\w+)\s+set\s+(.*)", s)
        sets, where = _cut(m[2], "where")
        d = self.table(m[1])
        values = {}
        for part in split_list(sets):
            c, e = part.split("=", 1)
            values[c.strip(' "')] = F.expr(sqlcompat.translate(e.strip()))
        d.update(F.expr(sqlcompat.translate(where)) if where else F.lit(True), values)
        self._done(d, "update")

    def _delete(self, s: str) -> None:
        m = self._match(r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", s)
        d = self.table(m[1])
        d.delete(F.expr(sqlcompat.translate(m[2])) if m[2] else F.lit(True))
        self._done(d, "delete")

    def _truncate(self, s: str) -> None:
        for n in self._match(r"truncate\s+(?:table\s+)?(.*)", s)[1].split(","):
            d = self.table(n.strip())
            d.delete(F.lit(True))
            self._done(d, "truncate")

    def _copy(self, s: str) -> None:
        m = self._match(r"copy\s+(\w+|\(.*\))\s+(from|to)\s+'([^']*)'.*", s)
        if m[2].lower() == "to":
            df = self.select(m[1][1:-1]) if m[1].startswith("(") else self.table(m[1]).df().drop(ROW_ID)
            io.to_csv(df, m[3])
            return
        self._load(m[1], m[3])

    def _import(self, s: str) -> None:
        m = self._match(r"import\s+from\s+(?:csv|parquet)?\s*(?:file\s+)?'([^']*)'\s+into\s+(\w+)", s)
        self._load(m[2], m[1])

    def _load(self, name: str, path: str) -> None:
        d = self.table(name)
        rows = self.spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else io.from_csv(self.spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema))
        d.append(self._written(rows.select(*d.schema.names), d.schema))
        self._done(d, "copy")

    def _show(self, s: str) -> DataFrame:
        m = re.fullmatch(r"show\s+columns\s+(?:from\s+)?(\w+)", s, re.I)
        if m:
            return self._describe(f"describe {m[1]}")
        self._match(r"show\s+tables", s)
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")

    def _describe(self, s: str) -> DataFrame:
        d = self.table(self._match(r"describe\s+(\w+)", s)[1])
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in d.schema], "name string, type string")

    def _prepare(self, s: str) -> None:
        m = self._match(r"prepare\s+(\w+)\s+(?:as|from)\s+(.*)", s)
        self.prepared[m[1]] = m[2].strip("' ")

    def _execute(self, s: str) -> DataFrame | None:
        m = self._match(r"execute\s+(\w+)\s*(?:\((.*)\))?", s)
        if m[1] not in self.prepared:
            raise QuerySyntaxError(f"no statement is prepared as {m[1]}")
        values = split_list(m[2]) if m[2] else []
        parts = self.prepared[m[1]].split("?")
        if len(parts) - 1 != len(values):
            raise QuerySyntaxError(f"{m[1]} takes {len(parts) - 1} values, not {len(values)}")
        return self.execute("".join(a + b for a, b in zip(parts, [*values, ""])))

    def _deallocate(self, s: str) -> None:
        self.prepared.pop(self._match(r"deallocate\s+(?:prepare\s+)?(\w+)", s)[1], None)

    # transactions

    def _points(self) -> dict:
        return {n: self.table(n).savepoint() for n in self.names()}

    def _begin(self, s: str) -> None:
        self.start, self.points = self._points(), {}

    def _commit(self, s: str) -> None:
        for n in self.names():
            self.table(n).commit("transaction")
        self.start = self.points = None

    def _savepoint(self, s: str) -> None:
        if self.start is None:
            raise DatasetError("a savepoint stands in a transaction")
        self.points[self._match(r"savepoint\s+(\w+)", s)[1]] = self._points()

    def _rollback(self, s: str) -> None:
        m = self._match(r"rollback(?:\s+to(?:\s+savepoint)?\s+(\w+))?", s)
        if self.start is None:
            raise DatasetError("there is no transaction")
        if m[1] and m[1] not in self.points:
            raise DatasetError(f"there is no savepoint {m[1]}")
        to = self.points[m[1]] if m[1] else self.start
        for n in self.names():
            self.table(n).restore(to.get(n))
        if not m[1]:
            self.start = self.points = None
