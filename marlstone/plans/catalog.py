"""All queries of the engine over a folder of tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import register
from . import op_queries, sqlcompat, tql_queries
from .sql_queries import SQL


def _sql(text: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables)
        return sqlcompat.run(spark, text)

    return run


def _named(text: str) -> tuple[str, ...]:
    from ..session import TABLES

    return tuple(t for t in TABLES if t in text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _name, _text in SQL.items():
    _own, _duck = (_text, _text) if isinstance(_text, str) else _text
    QUERIES[_name], ORACLE[_name] = _sql(_own, _named(_own)), _duck
for _part in (tql_queries, op_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
