"""Entry points: queries, prepared queries, explanations, futures."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from .errors import QueryError
from .functions.registry import has_function, register_function, unregister_function
from .plans.lower import Context, Lowering
from .plans.parser import Select, SetOp, keywords, parse
from .sources.paths import stored

__all__ = ["Executor", "QueryFuture", "explain_query", "has_function", "is_filter", "is_valid", "keywords", "parse", "prepare_query", "query", "query_async", "register_function", "unregister_function"]

_pool: list[ThreadPoolExecutor] = []


def query(text: str, spark: SparkSession | None = None, view: DataFrame | None = None, tables: Mapping[str, DataFrame] | None = None, order: Mapping[str, Sequence[str]] | Sequence[str] | None = None, params: Sequence = (), seed: int = 42) -> DataFrame:
    """The lazy result of a query.

    FROM names are looked up in ``tables``, then among session views, then as paths; without FROM the query is over
    ``view``.  ``order`` names the columns that give rows their order where there is no _row_id.
    """
    spark = spark or SparkSession.getActiveSession()
    by_table = order if isinstance(order, Mapping) else {}
    ctx = Context(spark, tables or {}, by_table, view, () if isinstance(order, Mapping) or order is None else order, params, seed)
    return Lowering(ctx).query(parse(text))


class Executor:
    """A parsed query to run with values for its ? marks."""

    def __init__(self, text: str, **where):
        self.text, self.where, self.tree = text, where, parse(text)

    def run_single(self, params: Sequence = ()) -> DataFrame:
        return query(self.text, params=params, **self.where)

    def run_batch(self, params: Sequence[Sequence]) -> list[DataFrame]:
        """A lazy view for each row of values."""
        return [self.run_single(p) for p in params]


def prepare_query(text: str, **where) -> Executor:
    return Executor(text, **where)


def explain_query(text: str, as_json: bool = False, **where) -> str:
    """The plan as text, or as JSON: the parsed query, the optimised and the physical plan, whose nodes are listed from
    the root on.  Nothing is run."""
    df = query(text, **where)
    if as_json:
        plans = df._jdf.queryExecution()
        return json.dumps({"query": text, "parsed": repr(parse(text)), "optimised": json.loads(plans.optimizedPlan().toJSON()), "physical": json.loads(plans.executedPlan().toJSON())})
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class QueryFuture:
    """A query that runs in the background.  Its result is a DataFrame over the rows, stored in the shared folder, so
    nothing is gathered in the driver; ``cancel`` also stops what runs already."""

    def __init__(self, text: str, **where):
        self.spark = where.get("spark") or SparkSession.getActiveSession()
        self.tag, where["spark"] = f"query-{uuid.uuid4().hex}", self.spark
        if not _pool:
            set_max_num_parallel_queries(4)
        self._future: Future = _pool[0].submit(self._run, text, where)

    def _run(self, text: str, where: dict) -> DataFrame:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return stored(query(text, **where), "async")
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def result(self, timeout: float | None = None) -> DataFrame:
        return self._future.result(timeout)

    def is_completed(self) -> bool:
        return self._future.done()

    def cancel(self) -> None:
        self._future.cancel()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


def query_async(text: str, **where) -> QueryFuture:
    return QueryFuture(text, **where)


def set_max_num_parallel_queries(n: int) -> None:
    _pool[:] = [ThreadPoolExecutor(n)]


def is_valid(text: str) -> bool:
    try:
        parse(text)
    except QueryError:
        return False
    return True


def is_filter(text: str) -> bool:
    """Whether a query only chooses rows: SELECT * with no more than WHERE, ORDER BY and LIMIT."""
    q = parse(text)
    if isinstance(q, SetOp) or not isinstance(q, Select):
        return False
    return [e.kind for e, _ in q.items] == ["star"] and not (q.group or q.ungroup or q.expand or q.distinct or q.sample)
