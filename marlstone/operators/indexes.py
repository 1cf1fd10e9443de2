"""Index declarations of a dataset and the searches that they allow; side tables are kept beside the data."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..errors import DatasetError
from ..functions import tensor as T
from ..functions import text as X
from ..sources.paths import discard, work_path
from . import search
from .rows import ROW_ID

KINDS = ("inverted", "json", "bm25", "exact_text", "clustered", "clustered_quantized", "pooled_quantized")
#: Older names.
ALIASES = {"inverted_index": "inverted", "binary_quantized": "clustered_quantized", "quantized": "clustered_quantized"}


#: Levels of a JSON object that its index holds; a deeper path is looked up by reading the rows.
JSON_DEPTH = 8
#: Rows found up to which their numbers go to the driver and only the files that hold them are read.
FEW = 10_000


def _exploded(level: DataFrame) -> DataFrame:
    """The fields of each object, with their names after its path."""
    v = level.alias("l").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("l.v").outer()).alias("x"))
    return v.select(f"l.{ROW_ID}", F.concat("l.path", F.when(F.col("l.path") != "", ".").otherwise(""), "x.key").alias("path"), F.col("x.value").alias("v"))


def _entries(df: DataFrame, column: str) -> DataFrame:
    """(path, value, _row_id) of every scalar in JSON objects, one level of nesting after the other."""
    level = df.select(ROW_ID, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).filter("v is not null")
    out = None
    for _ in range(JSON_DEPTH):
        level = _exploded(level.filter("schema_of_variant(v) like 'OBJECT%'"))
        found = level.filter("not schema_of_variant(v) like 'OBJECT%'").select("path", F.expr("cast(v as string)").alias("value"), ROW_ID)
        out = found if out is None else out.union(found)
    return out


class Indexes:
    """Indexes of a dataset's columns, one for each: side tables sorted by what is looked up, so that the statistics of
    their files lead to the few that hold it.  They are built for the dataset's present rows, which a token names; a
    search after any further write, an update in place too, reads the rows instead, until ``refresh``."""

    def __init__(self, dataset):
        self.d = dataset

    def all(self) -> dict[str, dict]:
        return dict(self.d.metadata().get("indexes", {}))

    def default(self, column: str) -> str:
        kind = self.d.schema[column].dataType
        if isinstance(kind, StringType):
            return "bm25"
        if isinstance(kind, ArrayType):
            return "pooled_quantized" if isinstance(kind.elementType, ArrayType) else "clustered"
        return "inverted"

    def create(self, column: str, kind: str | None = None, name: str | None = None, clusters: int = 16) -> str:
        if column not in self.d.schema.names:
            raise DatasetError(f"there is no column {column}")
        kind = ALIASES.get(kind or "", kind) or self.default(column)
        if kind not in KINDS:
            raise DatasetError(f"there is no index of kind {kind}")
        if column in self.all():
            raise DatasetError(f"{column} has an index already")
        self._keep(column, self._built(column, kind, name or f"{column}_{kind}", clusters))
        return kind

    def refresh(self, column: str | None = None) -> None:
        """Builds the indexes that are out of date again."""
        for c, e in self.all().items():
            if column in (None, c) and not self._fresh(e):
                self._keep(c, self._built(c, e["kind"], e["name"], e["clusters"]))

    def _keep(self, column: str, entry: dict) -> None:
        self.d.change_metadata(lambda m: m.setdefault("indexes", {}).update({column: entry}))

    def _built(self, column: str, kind: str, name: str, clusters: int) -> dict:
        path = f"{self.d.uri}/indexes/{column}-{kind}-{uuid.uuid4().hex[:8]}"
        df, c = self.d.df(), F.col(f"`{column}`")
        entry = {"kind": kind, "name": name, "token": self.d.token(), "path": path, "clusters": clusters}

        def sorted_by(rows: DataFrame, *keys: str) -> None:
            rows.repartitionByRange(*keys, ROW_ID).sortWithinPartitions(*keys, ROW_ID).write.parquet(path)

        if kind in ("bm25", "inverted") and isinstance(self.d.schema[column].dataType, StringType):
            # a row's words are counted where the row is, once; ranges are then drawn from what is stored
            folder = work_path(self.d.spark, "words")
            df.select(ROW_ID, X.tokens(c).alias("w")).mapInArrow(X.counted_words, f"{ROW_ID} long, dl int, token string, tf long").write.parquet(folder)
            post = self.d.spark.read.parquet(folder)
            sorted_by(post, "token")
            # the rows without a word count too
            entry |= {"n": df.count(), "total": post.agg(F.sum("tf")).first()[0] or 0}
            discard(folder)
        elif kind in ("inverted", "exact_text"):
            sorted_by(df.select(c.alias("value"), ROW_ID).filter("value is not null"), "value")
        elif kind == "json":
            sorted_by(_entries(df, column), "path", "value")
        elif kind == "pooled_quantized":
            # a row's mean row and its signs: what is searched is as wide as one row of the matrix
            size = df.filter(c.isNotNull()).select(F.size(F.get(c, 0)).alias("n")).first()
            size = size.n if size else 0
            df.filter(F.size(c) > 0).select(ROW_ID, T.mean_rows(c).alias("pooled")).withColumn("bits", T.sign_bits(F.col("pooled"), size)).write.parquet(path)
            entry |= {"size": size}
        else:
            index = search.ClusteredIndex.build(df, ROW_ID, column, path, clusters, quantised=kind == "clustered_quantized")
            entry |= {"centres": index.centres}
        return entry

    def drop(self, column: str | None = None, name: str | None = None) -> None:
        def left(m: dict) -> None:
            m["indexes"] = {c: e for c, e in m.get("indexes", {}).items() if c != column and e["name"] != name}

        self.d.change_metadata(left)

    def _entry(self, column: str) -> dict:
        if column not in self.all():
            raise DatasetError(f"{column} has no index")
        return self.all()[column]

    def _fresh(self, entry: dict) -> bool:
        return entry["token"] == self.d.token()

    def _side(self, entry: dict) -> DataFrame:
        return self.d.spark.read.parquet(entry["path"])

    # each search is a condition on rows, and where the index is fresh their numbers

    def _plan(self, column: str, op: str, values: tuple):
        """(condition, numbers of the rows or None)."""
        e, c, op = self._entry(column), F.col(f"`{column}`"), op.lower()
        kind, fresh = e["kind"], self._fresh(e)
        if op == "contains":
            if kind not in ("inverted", "bm25") or not isinstance(self.d.schema[column].dataType, StringType):
                raise DatasetError(f"an index of kind {kind} does not look up words")
            if kind == "bm25":
                raise DatasetError("a bm25 index ranks; exact search needs an index of kind exact_text or inverted")
            word = str(values[0]).lower()
            return F.array_contains(X.tokens(c), word), self._side(e).filter(F.col("token") == word).select(ROW_ID) if fresh else None
        if op.startswith("json"):
            if kind != "json":
                raise DatasetError(f"an index of kind {kind} does not look up JSON")
            path, want = values
            text = want if isinstance(want, str) else json.dumps(want, separators=(",", ":"))
            there = F.get_json_object(c, f"$.{path}") == text
            deep = path.count(".") >= JSON_DEPTH
            return there, self._side(e).filter((F.col("path") == path) & (F.col("value") == text)).select(ROW_ID).distinct() if fresh and not deep else None
        if kind == "bm25":
            raise DatasetError("a bm25 index ranks; exact search needs an index of kind exact_text or inverted")
        text = isinstance(self.d.schema[column].dataType, StringType)
        if op != "=" and (kind != "inverted" or text):
            raise DatasetError("comparisons need an inverted index of numbers")
        how = {"=": lambda x: x == values[0], "<": lambda x: x < values[0], "<=": lambda x: x <= values[0], ">": lambda x: x > values[0], ">=": lambda x: x >= values[0], "between": lambda x: x.between(*values), "in": lambda x: x.isin(*values)}
        valued = kind == "exact_text" or (kind == "inverted" and not text)
        return how[op](c), self._side(e).filter(how[op](F.col("value"))).select(ROW_ID) if fresh and valued else None

    def find(self, *conditions: tuple) -> DataFrame:
        """Rows for which all of ``conditions`` hold, each (column, operator, values...): contains, json, =, <, <=, >,
        >=, between or in.  The numbers that fresh indexes give are intersected before any row is read; conditions
        without one are checked on the rows that are left."""
        ids, rest = None, []
        for column, op, *values in conditions:
            condition, found = self._plan(column, op, tuple(values))
            if found is None:
                rest.append(condition)
            else:
                ids = found if ids is None else ids.join(found, ROW_ID, "left_semi")
        df = self.d.df() if ids is None else self._rows(ids)
        for c in rest:
            df = df.filter(c)
        return df

    def _rows(self, ids: DataFrame) -> DataFrame:
        few = ids.limit(FEW + 1).collect()
        if len(few) <= FEW:
            return self.d.take([r[0] for r in few])
        return self.d.df().join(ids, ROW_ID, "left_semi")

    def contains(self, column: str, word: str) -> DataFrame:
        """Rows whose text has ``word`` among its words."""
        return self.find((column, "contains", word))

    def equals(self, column: str, value: object) -> DataFrame:
        return self.find((column, "=", value))

    def json_equals(self, column: str, path: str, value: object) -> DataFrame:
        """Rows whose JSON object has ``value`` at a path of names with points between."""
        return self.find((column, "json", path, value))

    def compare(self, column: str, op: str, *values) -> DataFrame:
        """Rows by =, <, <=, >, >=, between or in on a column with an inverted index."""
        if self._entry(column)["kind"] != "inverted":
            raise DatasetError("comparisons need an inverted index")
        return self.find((column, op, *values))

    def bm25_scores(self, column: str, query: str) -> DataFrame:
        """(_row_id, score) from the stored postings: only the files that hold the query's terms are read."""
        e = self._entry(column)
        if e["kind"] != "bm25":
            raise DatasetError(f"an index of kind {e['kind']} does not rank texts")
        if not self._fresh(e):
            return X.bm25(self.d.df(), column, ROW_ID, query)
        terms = X.query_terms(query)
        post = self._side(e).filter(F.col("token").isin(sorted(set(terms))))
        counts = {r.token: r.n for r in post.groupBy("token").agg(F.count("*").alias("n")).collect()}  # of the query's terms
        weight = F.lit(0.0)
        for t, df in counts.items():
            weight = F.when(F.col("token") == t, F.lit(terms.count(t) * math.log((e["n"] - df + 0.5) / (df + 0.5)))).otherwise(weight)
        length = F.lit(1 - X.B) + X.B * F.col("dl") / F.lit(e["total"] / max(e["n"], 1))
        return post.groupBy(ROW_ID).agg(F.sum(weight * (X.K1 + 1) * F.col("tf") / (F.col("tf") + X.K1 * length)).alias("score"))

    def top_k(self, column: str, query: str | Sequence, k: int, config: search.SearchConfig | None = None) -> DataFrame:
        """(_row_id, score) of the k best rows: BM25 for text, cosine for vectors, MAXSIM for matrices."""
        e, df = self._entry(column), self.d.df()
        if e["kind"] == "bm25":
            return self.bm25_scores(column, str(query)).orderBy(F.desc("score"), ROW_ID).limit(k)
        if e["kind"] == "pooled_quantized":
            if not self._fresh(e):
                return search.maxsim_top_k(df, column, query, k, ROW_ID)
            return self._pooled(e, column, query, k, config or search.SearchConfig.default())
        if e["kind"].startswith("clustered"):
            if not self._fresh(e):
                return search.cosine_top_k(df, column, query, k, ROW_ID)
            index = search.ClusteredIndex(self.d.spark, e["path"], ROW_ID, column, e["centres"], len(query), e["kind"] == "clustered_quantized")
            return index.search(query, k, config)
        raise DatasetError(f"an index of kind {e['kind']} does not rank")

    def _pooled(self, e: dict, column: str, query: Sequence, k: int, config: search.SearchConfig) -> DataFrame:
        """Signs choose candidates, mean rows the fewer of them, MAXSIM ranks those; only their files are read."""
        pooled = [sum(r[j] for r in query) / len(query) for j in range(len(query[0]))]
        many = max(k, int(k * config.rerank * search.WIDEN))
        apart = T.bits_apart(F.col("bits"), T.sign_bits(T.vector(pooled), e["size"]))
        near = self._side(e).withColumn("d", apart).orderBy("d", ROW_ID).limit(8 * many)
        near = search.top_k(near, T.cosine_const(F.col("pooled"), pooled), many, ROW_ID).select(ROW_ID)
        return search.maxsim_top_k(self._rows(near), column, query, k, ROW_ID)
