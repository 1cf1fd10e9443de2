"""Lowering of parsed queries to lazy DataFrames; Catalyst picks the physical plan."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FloatType, IntegralType, MapType, NumericType, StringType, StructType

from .. import errors as E
from ..functions import jsonfn, registry
from ..functions import tensor as T
from ..functions import text as X
from ..operators import rows as R
from ..operators import search
from ..operators import sequences as S
from .parser import Node, Select, SetOp

_AGG = {"count", "sum", "avg", "mean", "min", "max", "stddev", "std", "stdev", "variance", "var", "any_value"}
_CELL = {"sum": T.total, "avg": T.mean, "mean": T.mean, "prod": T.product, "amin": T.least, "amax": T.greatest, "min": T.least, "max": T.greatest, "std": T.stdev, "stdev": T.stdev, "stddev": T.stdev, "median": T.median}
_OPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
#: Of these, floats are doubles: two of them would be added in 24 bits.
_ARITHMETIC = ("+", "-", "*", "/", "%")
_PLAIN = {"lower": F.lower, "upper": F.upper, "length": F.length, "trim": F.trim, "lpad": F.lpad, "rpad": F.rpad, "substring": F.substring, "substr": F.substr, "concat": F.concat, "coalesce": F.coalesce, "greatest": F.greatest, "least": F.least, "floor": F.floor, "ceil": F.ceil, "exp": F.exp, "ln": F.log, "power": F.pow, "regexp_substr": F.regexp_substr, "array_length": F.size, "nullif": F.nullif, "log10": F.log10, "sign": F.sign}


@dataclass
class Context:
    """Where names are looked up: ``tables`` first, then session views, then paths.  ``order`` names, for each table, the
    columns that give its rows their order when it has no _row_id."""

    spark: SparkSession
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    order: Mapping[str, Sequence[str]] = field(default_factory=dict)
    default: DataFrame | None = None
    default_order: Sequence[str] = ()
    params: Sequence = ()
    seed: int = 42
    allow_nested: bool = True
    allow_group: bool = True

    def source(self, name: str) -> tuple[DataFrame, list[str]]:
        key = name.removeprefix("mem://")
        if key in self.tables or name in self.tables:
            df = self.tables.get(key, self.tables.get(name))
        elif "/" in name:
            from ..sources.dataset import Dataset

            df = Dataset.read(self.spark, name) if Dataset.exists(self.spark, name) else self._parquet(name)
        elif self.spark.catalog.tableExists(name):
            df = self.spark.table(name)
        else:
            raise E.SourceNotFound(name)
        return df, list(self.order.get(key, self.order.get(name, ())))

    def _parquet(self, path: str) -> DataFrame:
        try:
            return self.spark.read.parquet(path)
        except Exception as e:
            raise E.SourceNotFound(path) from e


def names_in(n, kind: str) -> list[Node]:
    out = []
    if isinstance(n, Node):
        if n.kind == kind:
            out.append(n)
        for a in n.args:
            out += names_in(a, kind)
        if n.kind in ("index",):
            for a in n.value:
                out += names_in(a, kind)
    elif isinstance(n, (list, tuple)):
        for a in n:
            out += names_in(a, kind)
    return out


class Lowering:
    def __init__(self, ctx: Context):
        self.ctx = ctx

    # statements

    def query(self, q: Select | SetOp) -> DataFrame:
        if q.ctes:
            tables = ChainMap({}, self.ctx.tables)
            inner = Lowering(Context(**{**self.ctx.__dict__, "tables": tables}))
            for name, sub in q.ctes:
                tables[name] = inner.query(sub)
            ctes, q.ctes = q.ctes, []
            try:
                return inner.query(q)
            finally:
                q.ctes = ctes
        if isinstance(q, SetOp):
            df = R.set_operation(self.query(q.left), self.query(q.right), q.kind, q.keep_all)
            scope = Scope(self, df, list(df.columns))
            if q.order:
                df = df.orderBy(*(scope.ordering(e, asc) for e, asc in q.order))
            return self.limited(df, q)
        return self.select(q)

    def limited(self, df: DataFrame, q) -> DataFrame:
        if q.offset is not None:
            df = df.offset(self.number(q.offset))
        if q.percent is not None:
            df = df.sample(q.percent / 100, self.ctx.seed)
        return df if q.limit is None else df.limit(self.number(q.limit))

    def number(self, n: Node) -> int:
        if n.kind == "lit":
            return int(n.value)
        if n.kind == "param":
            return int(self.ctx.params[n.value])
        if n.kind == "scalar":
            return int(self.query(n.value).first()[0])  # one value, needed to plan
        one = self.ctx.spark.range(1)
        return int(one.select(Scope(self, one, []).col(n)).first()[0])

    def relation(self, n: Node) -> tuple[DataFrame, list[str]]:
        if n.kind == "table":
            df, order = self.ctx.source(n.value)
            alias = n.value.split("/")[-1]
            return (df.alias(alias) if alias.isidentifier() else df), order
        if n.kind == "subquery":
            if not self.ctx.allow_nested:
                raise E.QueryError("nested queries are off")
            return self.query(n.value), []
        if n.kind == "alias":
            df, order = self.relation(n.args[0])
            return df.alias(n.value), order
        kind, on, using = n.value
        (left, order), (right, _) = map(self.relation, n.args)
        if kind.startswith("natural:"):
            return left.join(right, [c for c in left.columns if c in right.columns], kind[8:]), order
        if using:
            return left.join(right, using, kind), order
        if on is None:
            return left.crossJoin(right), order
        both = left.crossJoin(right)
        return left.join(right, Scope(self, both, []).col(on), "inner" if kind == "cross" else kind), order

    def select(self, q: Select) -> DataFrame:
        ctx = self.ctx
        if q.source is not None:
            df, order = self.relation(q.source)
        elif ctx.default is not None:
            df, order = ctx.default, list(ctx.default_order)
        else:
            df, order = ctx.spark.range(1).drop("id"), []
        order = [R.ROW_ID] if R.ROW_ID in df.columns else order
        exprs = [e for e, _ in q.items] + [q.where, q.having, *(e for e, _ in q.order), *q.group]
        calls = [c for e in exprs for c in names_in(e, "call")]
        numbered = any(c.value == "row_number" for c in calls)
        if (numbered or any(c.value == "data" for c in calls)) and R.ROW_ID not in df.columns:
            df = R.with_row_id(df, self._order(df, order))
            hidden = True
        else:
            hidden = False
        scope = Scope(self, df, order)
        if any(names_in(e, "similar") for e in exprs):
            q = scope.similarities(q)
            calls = [c for e in [e for e, _ in q.items] + [q.where, q.having, *(e for e, _ in q.order), *q.group] for c in names_in(e, "call")]
        for c in calls:
            if c.value == "bm25_similarity":
                scope.bm25(c, alone=repr(c) in {repr(e) for e, _ in [*q.order, *q.items]})
        for c in calls:
            if c.value == "data":
                scope.data(c)
        if q.where is not None:
            scope.df = scope.df.filter(scope.predicate(q.where))
        for c in calls:
            if c.value == "hybrid_similarity":
                scope.hybrid(c, None if q.limit is None else self.number(q.limit) + (0 if q.offset is None else self.number(q.offset)))
        if q.expand:
            scope.df = self.expanded(scope, q.expand, order)
        aggregate = bool(q.group) and not ctx.allow_group
        if aggregate:
            raise E.QueryError("grouping is off")
        is_agg = [c for e in [x for x, _ in q.items] + [q.having, *(x for x, _ in q.order)] for c in names_in(e, "call") if scope.across_rows(c, bool(q.group))]
        items = self.items(q, scope, hidden or scope.numbered)
        if q.group and not is_agg:
            df = self.folded(q, scope, items)
        elif q.group or is_agg:
            df = self.grouped(q, scope, items)
        else:
            df = self.plain(q, scope, items)
        if q.ungroup is not None:
            arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
            if q.ungroup == "split":
                df = S.ungroup_split(df, arrays)
            elif q.ungroup.kind == "lit":
                df = S.ungroup_ranges(df, arrays, int(q.ungroup.value))
            else:
                df = S.ungroup_lengths(df, arrays, [self.number(a) for a in q.ungroup.args])
        if q.distinct and not q.distinct_on:
            df = df.distinct()
        df = self.limited(df, q)
        if q.sample:
            w, replace, n, pct = q.sample
            if w.kind == "lit" and isinstance(w.value, float) and w.value <= 1 and n is None and pct is None:
                return df.sample(w.value, ctx.seed)
            df = R.sample_by(df, Scope(self, df, order).col(w), None if n is None else self.number(n), pct, replace, ctx.seed)
        return df

    def _order(self, df: DataFrame, order: list[str]) -> list[str]:
        if R.ROW_ID in df.columns:
            return [R.ROW_ID]
        return order or [f.name for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType))]

    def expanded(self, scope: Scope, expand: tuple, order: list[str]) -> DataFrame:
        back, ahead, overlap, _ = expand
        return S.expand(scope.df, self._order(scope.df, order), int(back), int(ahead), overlap)

    def items(self, q: Select, scope: Scope, hidden: bool) -> list[tuple[Node, str]]:
        """Each with its name; stars are spelled out."""
        out = []
        for e, alias in q.items:
            if e.kind == "star":
                cols = scope.df.columns if e.value is None else scope.df.select(f"{e.value}.*").columns
                out += [(Node("col", c if e.value is None else f"{e.value}.{c}"), c) for c in cols if not c.startswith("__bm") and not (hidden and c == R.ROW_ID)]
            else:
                out.append((e, alias or scope.name(e)))
        return out

    def ordered(self, q: Select, scope: Scope, df: DataFrame, names: dict[str, Node], done: bool) -> DataFrame:
        """ORDER BY over aliases and expressions; ``done``: the items are columns already."""
        if not q.order:
            return df
        at = Scope(self, df, scope.order) if done else scope
        keys = []
        for i, (e, asc) in enumerate(q.order):
            e = names.get(e.value, e) if e.kind == "col" and not done else e
            if not done and names_in(e, "call") and not (e.kind == "call" and e.value == "random"):
                # a column first: vectorised functions can't stand in a sort, and the same call is then made once
                df = at.df = df.withColumn(f"__o{i}", at.col(e))
                if e.kind == "call":
                    at.scores[repr(e)] = F.col(f"__o{i}")
                keys.append(F.col(f"__o{i}").asc_nulls_last() if asc else F.col(f"__o{i}").desc_nulls_last())
            else:
                keys.append(at.ordering(e, asc))
        return df.orderBy(*keys)

    def plain(self, q: Select, scope: Scope, items: list) -> DataFrame:
        names = {n: e for e, n in items}
        if q.distinct_on:
            keys = [scope.col(e) for e in q.distinct_on]
            flat = scope.df.select(*(scope.col(e).alias(n) for e, n in items), *(k.alias(f"__k{i}") for i, k in enumerate(keys)), *(scope.col(names.get(e.value, e) if e.kind == "col" else e).alias(f"__o{i}") for i, (e, _) in enumerate(q.order)))
            w = Window.partitionBy(*(f"__k{i}" for i in range(len(keys)))).orderBy(*((F.asc_nulls_last if asc else F.desc_nulls_last)(f"__o{i}") for i, (_, asc) in enumerate(q.order)) or [F.lit(1)])
            rows = flat.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
            if q.order:
                rows = rows.orderBy(*((F.asc_nulls_last if asc else F.desc_nulls_last)(f"__o{i}") for i, (_, asc) in enumerate(q.order)))
            return rows.select(*(F.col(f"`{n}`") for _, n in items))
        if q.distinct and q.order:  # sorted after duplicates go
            df = scope.df.select(*(scope.col(e).alias(n) for e, n in items)).distinct()
            q.distinct = False
            return self.ordered(q, scope, df, names, True)
        df = self.ordered(q, scope, scope.df, names, False)
        return df.select(*(scope.col(e).alias(n) for e, n in items))

    def folded(self, q: Select, scope: Scope, items: list) -> DataFrame:
        """GROUP BY without aggregates: rows of a group become sequences."""
        order = self._order(scope.df, scope.order)
        if q.having is not None:
            raise E.InvalidGroupFunction("HAVING needs an aggregate")
        flat = scope.df.select(*(scope.col(e).alias(f"__g{i}") for i, e in enumerate(q.group)), *(F.col(c).alias(f"__r{i}") for i, c in enumerate(order)), *(scope.col(e).alias(n) for e, n in items))
        df = S.group_to_sequence(flat, [f"__g{i}" for i in range(len(q.group))], [f"__r{i}" for i in range(len(order))], [n for _, n in items], q.across or "time", keep_keys=True)
        if q.order:
            keys = {self._text(e): f"__g{i}" for i, e in enumerate(q.group)}
            df = df.orderBy(*((F.asc_nulls_last if asc else F.desc_nulls_last)(keys.get(self._text(e), str(e.value))) for e, asc in q.order))
        return df.select(*(n for _, n in items))

    @staticmethod
    def _text(e: Node) -> str:
        return repr(e)

    def grouped(self, q: Select, scope: Scope, items: list) -> DataFrame:
        keys = {self._text(e): f"__g{i}" for i, e in enumerate(q.group)}
        aliases = {n: e for e, n in items}
        groups = [aliases[e.value] if e.kind == "col" and e.value in aliases and e.value not in scope.df.columns else e for e in q.group]
        keys |= {self._text(e): f"__g{i}" for i, e in enumerate(groups)}
        aggs: dict[str, tuple[str, Node]] = {}

        def split(e):
            """Aggregates and keys in ``e`` become columns of the aggregated table."""
            if isinstance(e, Node):
                if self._text(e) in keys:
                    return Node("col", keys[self._text(e)])
                if e.kind == "call" and scope.across_rows(e, bool(q.group)):
                    t = self._text(e) + str(getattr(e, "distinct", ""))
                    aggs.setdefault(t, (f"__a{len(aggs)}", e))
                    return Node("col", aggs[t][0])
                n = Node(e.kind, e.value, [split(a) for a in e.args])
                n.__dict__.update({k: v for k, v in e.__dict__.items() if k not in ("kind", "value", "args")})
                return n
            return type(e)(split(a) for a in e) if isinstance(e, (list, tuple)) else e

        outs = [(split(e), n) for e, n in items]
        having = split(q.having) if q.having is not None else None
        orders = [(split(aliases.get(e.value, e) if e.kind == "col" and e.value in aliases else e), asc) for e, asc in q.order]
        made = [scope.aggregate(e).alias(n) for n, e in aggs.values()]
        df = scope.df.groupBy(*(scope.col(e).alias(f"__g{i}") for i, e in enumerate(groups))).agg(*(made or [F.lit(1).alias("__one")]))
        at = Scope(self, df, [])
        if having is not None:
            df = at.df = df.filter(at.predicate(having))
        if orders:
            df = df.orderBy(*(at.ordering(e, asc) for e, asc in orders))
        try:
            return df.select(*(at.col(e).alias(n) for e, n in outs))
        except E.ColumnNotFound as e:
            raise E.InvalidGroupFunction(f"{e}; it is neither a group's key nor in an aggregate") from e


class Scope:
    """Expressions over one DataFrame."""

    def __init__(self, lowering: Lowering, df: DataFrame, order: list[str]):
        self.low, self.df, self.order, self.scores, self.numbered = lowering, df, order, {}, False
        self.corpus = df

    def kind(self, c: Column) -> DataType:
        return self.df.select(c.alias("__x")).schema[0].dataType

    def rank(self, c: Column) -> int:
        return T.rank(self.kind(c))

    def name(self, e: Node) -> str:
        if e.kind == "col":
            return e.value.split(".")[-1]
        if e.kind == "call" and len(e.args) <= 1:
            inner = e.args[0].value if e.args and e.args[0].kind == "col" else "*" if e.args and e.args[0].kind == "star" else ""
            return f"{e.value}({inner})"
        raise E.AmbiguousName("a computed column needs AS and a name")

    def predicate(self, e: Node) -> Column:
        c = self.col(e)
        k = self.kind(c)
        if isinstance(k, ArrayType):
            raise E.TypeMismatch("the condition is an array; ANY or ALL makes it one value")
        return c if isinstance(k, BooleanType) else c != 0 if isinstance(k, NumericType) else c

    def ordering(self, e: Node, asc: bool) -> Column:
        if e.kind == "call" and e.value == "random":
            c = F.rand(self.low.ctx.seed)
        elif e.kind == "lit" and isinstance(e.value, int):
            c = F.col(self.df.columns[e.value - 1])
        else:
            c = self.col(e)
        return c.asc_nulls_last() if asc else c.desc_nulls_last()

    def across_rows(self, c: Node, grouped: bool) -> bool:
        """Whether a call aggregates over rows; on an array, and without groups, reducers work within the cell."""
        if c.value not in _AGG | {"prod", "amin", "amax", "median"} or not c.args:
            return c.value == "count"
        if c.value == "count" or c.args[0].kind == "star":
            return True
        if getattr(c, "kwargs", {}).get("axis") is not None:
            return False
        array = self.rank(self.col(c.args[0])) > 0
        return grouped if array else c.value in _AGG or grouped

    def aggregate(self, c: Node) -> Column:
        if c.value == "count":
            if not c.args or c.args[0].kind == "star":
                return F.count(F.lit(1))
            x = self.col(c.args[0])
            return F.countDistinct(x) if getattr(c, "distinct", False) else F.count(x)
        x = self.col(c.args[0])
        depth = self.rank(x)
        name = {"mean": "avg", "amin": "min", "amax": "max", "std": "stddev", "stdev": "stddev", "var": "variance"}.get(c.value, c.value)
        if depth:
            flat = T.flat(x, depth)
            return {"sum": lambda: F.sum(T.total(flat)), "avg": lambda: F.try_divide(F.sum(T.total(flat)), F.sum(F.size(flat))), "min": lambda: F.min(F.array_min(flat)), "max": lambda: F.max(F.array_max(flat)), "prod": lambda: F.product(T.product(flat))}[name]()
        if getattr(c, "distinct", False):
            return {"sum": F.sum_distinct}.get(name, lambda v: F.expr("null"))(x)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_samp, "variance": F.var_samp, "prod": F.product, "median": F.median, "any_value": F.any_value}[name](x)

    def bm25(self, c: Node, alone: bool) -> None:
        """Joins the scores, once for each different call; a ranking by BM25 alone keeps the documents that match."""
        if repr(c) in self.scores:
            return
        name = f"__bm{len(self.scores)}"
        self.df = X.with_bm25(self.df, self.corpus, self.col(c.args[0]), str(self.value(c.args[1])), name, matching=alone)
        self.scores[repr(c)] = F.col(name) if alone else F.coalesce(F.col(name), F.lit(0.0))

    def similarities(self, q):
        """``q`` with calls in place of ``a <#> b``: cosine for vectors, MAXSIM for matrices, BM25 for texts, both for a
        record of a vector and a text.  A sort by one without ASC or DESC is from the best on."""

        def call(e):
            if isinstance(e, Node):
                n = Node(e.kind, e.value, [call(a) for a in e.args])
                n.__dict__.update({k: v for k, v in e.__dict__.items() if k not in ("kind", "value", "args")})
                return self.similarity(*n.args) if n.kind == "similar" else n
            return type(e)(call(a) for a in e) if isinstance(e, (list, tuple)) else e

        names = {alias: e for e, alias in q.items}
        order = []
        for e, asc in q.order:
            of = names.get(e.value, e) if e.kind == "col" else e
            order.append((call(e), asc and not (of.kind == "similar" and getattr(e, "implied", False))))
        return replace(q, items=[(call(e), n) for e, n in q.items], where=call(q.where), having=call(q.having), group=[call(e) for e in q.group], order=order)

    def similarity(self, a: Node, b: Node) -> Node:
        if a.kind == "tuple":
            weights = [Node("lit", 0.5), Node("lit", 0.5)]
            while b.kind == "cast":
                # a record that is cast without weights has those of 1
                weights, b = [Node("lit", 1.0), Node("lit", 1.0)], b.args[0]
            if b.kind not in ("tuple", "call") or (b.kind == "call" and not b.value.endswith("hybrid_record")) or len(b.args) not in (2, 4) or len(a.args) != 2:
                raise E.TypeMismatch("a record of a vector and a text is compared with a hybrid record")
            return Node("call", "hybrid_similarity", [*a.args, *b.args[:2], *(b.args[2:] or weights)])
        if isinstance(self.kind(self.col(a)), StringType):
            return Node("call", "bm25_similarity", [a, b])
        return Node("call", "maxsim" if self.rank(self.col(a)) == 2 else "cosine_similarity", [a, b])

    def hybrid(self, c: Node, k: int | None) -> None:
        """Keeps the rows that vector or text ranks among its best ``k``, with the weighted sum of each side's softmax."""
        if repr(c) in self.scores:
            return
        vector, text, q_vector, q_text, w_vector, w_text = c.args
        if R.ROW_ID not in self.df.columns and not self.order:
            self.df, self.numbered = R.with_row_id(self.df, self.low._order(self.df, self.order)), True
        key, name = self.low._order(self.df, self.order)[0], f"__bm{len(self.scores)}"
        find = "maxsim" if self.rank(self.col(vector)) == 2 else "cosine_similarity"
        best = lambda df: df if k is None else df.orderBy(F.desc("score"), key).limit(k)
        near = best(self.df.select(key, self.col(Node("call", find, [vector, q_vector])).alias("score")).filter("score is not null"))
        said = X.with_bm25(self.df, self.corpus, self.col(text), str(self.value(q_text)), "score", matching=True)
        both = search.hybrid(near, best(said.select(key, "score")), k, key, float(self.value(w_vector)), float(self.value(w_text)))
        self.df = self.df.join(both.withColumnRenamed("score", name), key)
        self.scores[repr(c)] = F.col(name)

    def data(self, c: Node) -> None:
        """A cell as a constant: one row, joined to all."""
        if repr(c) not in self.scores:
            name = f"__bmd{len(self.scores)}"
            cell = self.df.filter(F.col(R.ROW_ID) == int(self.value(c.args[1]))).select(self.col(c.args[0]).alias(name))
            self.df = self.df.crossJoin(F.broadcast(cell.limit(1)))
            self.scores[repr(c)] = F.col(name)

    def value(self, e: Node):
        """The Python value of a constant."""
        if e.kind == "lit":
            return e.value
        if e.kind == "param":
            return self.low.ctx.params[e.value]
        if e.kind == "array":
            return [self.value(a) for a in e.args]
        raise E.TypeMismatch("a constant is needed here")

    def constant(self, e: Node) -> bool:
        return e.kind in ("lit", "param") or (e.kind == "array" and all(map(self.constant, e.args)))

    def col(self, e: Node) -> Column:
        return getattr(self, f"_{e.kind}")(e)

    def _lit(self, e: Node) -> Column:
        return F.lit(e.value)

    def _param(self, e: Node) -> Column:
        v = self.low.ctx.params
        if e.value >= len(v):
            raise E.QueryError(f"parameter {e.value + 1} is missing")
        return T.literal(v[e.value])

    def _col(self, e: Node) -> Column:
        parts = e.value.split(".")
        c = F.col(".".join(f"`{p}`" for p in parts)) if len(parts) > 1 else F.col(f"`{e.value}`")
        try:
            self.df.select(c)
        except Exception as x:
            raise E.ColumnNotFound(e.value) from x
        return c

    def _array(self, e: Node) -> Column:
        return F.array(*map(self.col, e.args))

    def _tuple(self, e: Node) -> Column:
        return F.struct(*map(self.col, e.args))

    def _and(self, e: Node) -> Column:
        return self.predicate(e.args[0]) & self.predicate(e.args[1])

    def _or(self, e: Node) -> Column:
        return self.predicate(e.args[0]) | self.predicate(e.args[1])

    def _not(self, e: Node) -> Column:
        return ~self.predicate(e.args[0])

    def _null(self, e: Node) -> Column:
        return self.col(e.args[0]).isNull()

    def _minus(self, e: Node) -> Column:
        c = self.col(e.args[0])
        return T.each(c, self.rank(c), lambda v: -v)

    def _between(self, e: Node) -> Column:
        return self.col(e.args[0]).between(self.col(e.args[1]), self.col(e.args[2]))

    def _in(self, e: Node) -> Column:
        return self.col(e.args[0]).isin(*map(self.col, e.args[1:]))

    def _in_query(self, e: Node) -> Column:
        return self.col(e.args[0]).isin(self.low.query(e.value))

    def _scalar(self, e: Node) -> Column:
        return self.low.query(e.value).scalar()

    def _exists(self, e: Node) -> Column:
        return self.low.query(e.value).exists()

    def _like(self, e: Node, fold: bool = False) -> Column:
        c = X.glob(self.col(e.args[0]), str(self.value(e.args[1])), fold)
        return ~c if e.value else c

    def _ilike(self, e: Node) -> Column:
        return self._like(e, True)

    def _weighted(self, e: Node) -> Column:
        raise E.QuerySyntaxError("condition:weight pairs stand in MAX_WEIGHT and SUM_WEIGHT only")

    def _cast(self, e: Node) -> Column:
        names = {"double precision": "double", "int4": "int", "int8": "bigint", "int2": "smallint", "float4": "float", "float8": "double", "text": "string", "varchar": "string", "numeric": "double", "real": "float", "bool": "boolean", "jsonb": "string", "json": "string", "float32": "float", "float64": "double", "int32": "int", "int64": "bigint", "int16": "smallint", "uint8": "smallint"}
        t = str(e.value).lower()
        c, to = self.col(e.args[0]), names.get(t, t)
        k = self.kind(c)
        depth = T.rank(k)
        return T.each(c, depth, lambda v: v.cast(to))

    def _date(self, e: Node) -> Column:
        return F.lit(e.value).cast("date")

    def _interval(self, e: Node) -> Column:
        return F.expr(f"interval {e.value}" if e.value.split()[0].lstrip("-").isdigit() else f"interval '{e.value}'")

    def _case(self, e: Node) -> Column:
        arms, other = e.args
        base = self.col(e.value) if isinstance(e.value, Node) else None
        out = None
        for c, v in arms:
            cond = self.predicate(c) if base is None else base == self.col(c)
            out = F.when(cond, self.col(v)) if out is None else out.when(cond, self.col(v))
        return out.otherwise(self.col(other)) if other is not None else out

    def _binary(self, e: Node) -> Column:
        a, b = map(self.col, e.args)
        if e.value == "||":
            return F.concat(a, b)
        if e.value == "^":
            return F.pow(a, b)
        ka, kb = self.kind(a), self.kind(b)
        la, lb = T.leaf(ka), T.leaf(kb)
        if (isinstance(la, StringType) and isinstance(lb, NumericType)) or (isinstance(lb, StringType) and isinstance(la, NumericType)):
            raise E.TypeMismatch(f"{ka.simpleString()} and {kb.simpleString()} do not go together")
        f = _OPS[e.value]
        if e.value in _ARITHMETIC and (isinstance(la, FloatType) or isinstance(lb, FloatType)):
            f = lambda x, y: _OPS[e.value](*(v.cast("double") if isinstance(k, FloatType) else v for v, k in ((x, la), (y, lb))))
        if T.rank(ka) or T.rank(kb):
            return T.zipped(a, T.rank(ka), b, T.rank(kb), f)
        return f(a, b)

    def _index(self, e: Node) -> Column:
        steps, base = [], e
        while base.kind == "index":  # a chain of steps into JSON
            steps.insert(0, base.value)
            base = base.args[0]
        c = self.col(base)
        k = self.kind(c)
        if isinstance(k, StringType):
            return jsonfn.get(c, [self.value(s[0]) for s in steps])
        for axes in steps:
            k = self.kind(c)
            if isinstance(k, StructType):
                c = c[self.value(axes[0])]
            elif isinstance(k, MapType):
                c = F.try_element_at(c, self.col(axes[0]))
            else:
                if len(axes) > T.rank(k):
                    raise E.IndexDimensionError(f"{len(axes)} indices into an array of rank {T.rank(k)}")
                c = self.axes(c, axes)
        return c

    def axes(self, c: Column, axes: list[Node]) -> Column:
        if not axes:
            return c
        head, rest = axes[0], axes[1:]
        if head.kind == "slice":
            c = T.slice_(c, *(None if a is None else int(self.value(a)) for a in head.args))
            return F.transform(c, lambda v: self.axes(v, rest)) if rest else c
        return self.axes(T.index(c, self.col(head)), rest)

    def _slice(self, e: Node) -> Column:
        raise E.QuerySyntaxError("a slice stands in brackets only")

    def _star(self, e: Node) -> Column:
        raise E.QuerySyntaxError("* stands alone or in COUNT only")

    def _call(self, e: Node) -> Column:
        name, args, kw = e.value, e.args, getattr(e, "kwargs", {})
        if repr(e) in self.scores:
            return self.scores[repr(e)]
        column = args[0].value.split(".")[-1] if args and args[0].kind == "col" else None
        if column and registry.has_function(name, column):
            return registry.call(registry.own_name(name, column), *map(self.col, args))
        if name in ("max_weight", "sum_weight"):
            cases = [(self.predicate(a.args[0]), self.value(a.args[1])) for a in args if a.kind == "weighted"]
            if len(cases) != len(args):
                raise E.QuerySyntaxError(f"{name} takes condition:weight pairs")
            return R.weight(cases, name[:3])
        if name == "row_number":
            return F.col(R.ROW_ID)
        if name == "random":
            return (F.rand(self.low.ctx.seed) * (1 << 32)).cast("bigint")
        if name == "extract":
            f = args[0].value
            c = self.col(args[1])
            return F.unix_micros(c.cast("timestamp")) / 1e6 if f == "epoch" else F.extract(F.lit(f), c)
        if name == "shape":
            c = self.col(args[0])
            return T.shape(c, self.rank(c))
        if name in ("cosine_similarity", "dot", "inner_product", "hamming_distance", "maxsim"):
            if len(args) != 2:
                raise E.FunctionNotFound(f"{name} takes two arguments, not {len(args)}")
            if name == "cosine_similarity" and self.constant(args[1]):
                return (T.cosine_to if args[0].kind == "col" else T.cosine_const)(self.col(args[0]), self.value(args[1]))
            if name == "maxsim" and self.constant(args[1]) and not names_in(args[0], "call"):
                return T.maxsim_batch(self.value(args[1]))(self.col(args[0]))
            a, b = map(self.col, args)
            if name == "cosine_similarity" and self.rank(a) == 2:
                return T.maxsim(a, b)
            return {"cosine_similarity": T.cosine, "dot": T.dot, "inner_product": T.dot, "hamming_distance": T.hamming, "maxsim": T.maxsim}[name](a, b)
        if registry.has_function(name):
            return registry.call(name, *map(self.col, args))
        cols = [self.col(a) for a in args]
        ranks = [self.rank(c) for c in cols]
        if name in _CELL and cols and ranks[0]:
            return T.along(cols[0], ranks[0], int(kw["axis"]), _CELL[name]) if kw.get("axis") is not None else _CELL[name](cols[0], ranks[0])
        if name in ("any", "all", "all_strict"):
            f = {"any": T.any_of, "all": T.all_of, "all_strict": T.all_strict}[name]
            if not ranks[0]:
                return cols[0].cast("boolean")
            axis = kw.get("axis", self.value(args[1]) if len(args) > 1 else None)
            return f(cols[0], ranks[0]) if axis is None else T.along(cols[0], ranks[0], int(axis), f)
        if name in ("logical_and", "logical_or"):
            op = (lambda a, b: a & b) if name == "logical_and" else (lambda a, b: a | b)
            b = lambda f: lambda x, y: f(x.cast("boolean"), y.cast("boolean"))
            return T.zipped(cols[0], ranks[0], cols[1], ranks[1], b(op))
        if name == "logical_not":
            return T.each(cols[0], ranks[0], lambda v: ~v.cast("boolean"))
        if name in ("abs", "sqrt", "round"):
            return T.each(cols[0], ranks[0], lambda v: F.round(v, int(self.value(args[1])) if len(args) > 1 else 0) if name == "round" else getattr(F, name)(v))
        if name == "isclose":
            return T.zipped(cols[0], ranks[0], cols[1], ranks[1], T.is_close)
        if name == "contains":
            return F.array_contains(cols[0], cols[1]) if ranks[0] else F.contains(cols[0], cols[1])
        if name == "equals":
            return cols[0] == cols[1]
        if name == "keys":
            return jsonfn.keys(cols[0]) if isinstance(self.kind(cols[0]), StringType) else F.map_keys(cols[0])
        if name == "unnest":
            return F.explode(cols[0])
        if name in ("maxsim_pooled", "maxsim_bq"):
            return (T.maxsim_pooled if name == "maxsim_pooled" else T.maxsim_bits)(*cols)
        simple = {"l1_norm": T.l1_norm, "l2_norm": T.l2_norm, "linf_norm": T.linf_norm, "nonzero": T.nonzero, "transpose": T.transpose, "mean_pool_rows": T.mean_rows}
        if name in simple:
            return simple[name](cols[0])
        if name == "flat":
            return T.flat(cols[0], ranks[0])
        if name == "arange":
            return T.arange(*cols[:2])
        if name == "div":
            return F.call_function("div", *cols) if all(isinstance(self.kind(c), IntegralType) for c in cols) else (cols[0] / cols[1]).cast("bigint")
        if name == "trunc":
            return F.when(cols[0] < 0, F.ceil(cols[0])).otherwise(F.floor(cols[0]))
        if name == "regexp_substr":
            return F.regexp_substr(cols[0], cols[1])
        if name == "to_timestamp":
            return F.timestamp_seconds(cols[0])
        if name in _PLAIN:
            return _PLAIN[name](*cols)
        raise E.FunctionNotFound(name)
