"""SQL of the PostgreSQL kind on Spark: the forms that Spark does not parse itself are rewritten outside of strings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "YYYY": "yyyy", "DD": "dd", "HH24": "HH", "MI": "mm", "SS": "ss"}
_STRINGS = re.compile(r"('(?:[^']|'')*')")
_CAST = re.compile(r"::\s*(double precision|\w+)(\[\])?", re.I)


def _arrow(m: re.Match) -> str:
    path = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in re.findall(r"'(\w+)'|(?<=>)\s*(\d+)", m[2]) for s in s if s)
    return f"get_json_object({m[1]}, '${path}')"


def _contained(m: re.Match) -> str:
    """``a @> '{...}'``: every field of the object, at any depth, equals."""

    def parts(v: object, path: str) -> list[str]:
        if isinstance(v, dict):
            return [p for k, x in v.items() for p in parts(x, f"{path}.{k}")]
        at = f"get_json_object({m[1]}, '{path}')"
        if isinstance(v, list):
            return [f"coalesce(array_contains(from_json({at}, 'array<string>'), '{x if isinstance(x, str) else json.dumps(x)}'), false)" for x in v]
        if isinstance(v, str):
            quoted = v.replace("'", "''")
            return [f"coalesce({at} = '{quoted}', false)"]
        return [f"coalesce(try_cast({at} as double) = {float(v)}, false)"] if not isinstance(v, bool) and v is not None else [f"coalesce({at} = '{json.dumps(v)}', false)"]

    try:
        want = json.loads(m[2].replace("''", "'"))
    except ValueError:
        want = None
    if not isinstance(want, (dict, list)):  # of a text: its part
        return f"contains({m[1]}, '{m[2]}')"
    return f"({' and '.join(parts(want, '$')) or 'true'})"


def _trunc(m: re.Match) -> str:
    ten = f"power(10, {m[2]})" if m[2] else "1"
    return f"(sign({m[1]}) * floor(abs({m[1]}) * {ten}) / {ten})"


def _outside(pattern: str, to: str | Callable, sql: str) -> str:
    """Replaces outside of strings."""
    return "".join(part if i % 2 else re.sub(pattern, to, part, flags=re.I) for i, part in enumerate(_STRINGS.split(sql)))


def translate(sql: str) -> str:
    """``a ->> 'k'`` chains, ``a @> '{…}'``, DIV, TRUNC, to_date with a format, TO_TIMESTAMP, EPOCH, generate_series,
    subscripts from 1, array_length and casts by ``::``."""
    sql = re.sub(r"((?:\w+\.)?\w+)\s*@>\s*'((?:[^']|'')*)'(?:::jsonb?)?", _contained, sql)
    sql = re.sub(r"'epoch'\s*(?:::\s*timestamp)?\s*\+\s*interval\s*'1 microsecond'\s*\*\s*((?:\w+\.)?\w+)", r"timestamp_micros(\1)", sql, flags=re.I)
    sql = _outside(r"\bTO_TIMESTAMP\s*\(\s*([^(),]+)\s*\)", r"timestamp_seconds(\1)", sql)
    sql = _outside(r"\bTRUNC\s*\(\s*([^(),]+?)\s*(?:,\s*(\d+)\s*)?\)", _trunc, sql)
    sql = _outside(r"\b(from|join)\s+generate_series\s*\(([^()]*)\)", r"\1 (select explode(sequence(\2)) as generate_series)", sql)
    sql = _outside(r"\bgenerate_series\s*\(([^()]*)\)", r"explode(sequence(\1))", sql)
    sql = _outside(r"\barray_length\s*\(\s*([^(),]+)\s*,\s*1\s*\)", r"array_size(\1)", sql)
    sql = _outside(r"\b(?!array\b)((?:\w+\.)?[a-z_]\w*)\[(\d+)\]", r"try_element_at(\1, \2)", sql)
    sql = re.sub(r"((?:\w+\.)?\w+)((?:\s*->>?\s*(?:'\w+'|\d+))+)", _arrow, sql)
    sql = re.sub(r"\bDIV\s*\(\s*([^(),]+)\s*,\s*([^(),]+)\s*\)", r"((\1) div (\2))", sql, flags=re.I)

    def fmt(m: re.Match) -> str:
        f = m[2]
        for k, v in _FORMATS.items():
            f = f.replace(k, v)
        return f"to_timestamp({m[1]}, '{f}')"

    sql = re.sub(r"\bto_date\s*\(\s*((?:'[^']*')|[\w.]+)\s*,\s*'([^']*)'\s*\)", fmt, sql, flags=re.I)
    sql = re.sub(r"EXTRACT\s*\(\s*EPOCH\s+FROM\s*\(\s*([\w.]+)\s*-\s*([\w.]+)\s*\)\s*\)", r"(timestampdiff(MICROSECOND, \2, \1) / 1000000.0)", sql, flags=re.I)
    sql = re.sub(r"EXTRACT\s*\(\s*EPOCH\s+FROM\s+([\w.]+)\s*\)", r"(unix_micros(cast(\1 as timestamp)) / 1000000.0)", sql, flags=re.I)
    kinds = {"int4": "int", "int8": "bigint", "int2": "smallint", "float4": "float", "float8": "double", "text": "string", "varchar": "string", "numeric": "double", "jsonb": "string", "json": "string", "double precision": "double", "real": "float", "bool": "boolean"}
    at = 0
    while (m := _CAST.search(sql, at)) is not None:
        quoted = {i for q in _STRINGS.finditer(sql) for i in range(*q.span())}
        if m.start() in quoted:
            at = m.end()
            continue
        start = _operand(sql, m.start(), quoted)
        kind = kinds.get(m[1].lower(), m[1])
        sql = f"{sql[:start]}cast({sql[start : m.start()]} as {f'array<{kind}>' if m[2] else kind}){sql[m.end() :]}"
        at = start
    return sql


def _operand(sql: str, end: int, quoted: set[int]) -> int:
    """Where the operand that ends at ``end`` starts: a name, a number, a string, or parentheses and the name before."""
    i = end
    if sql[i - 1] == "'":
        i -= 1
        while i - 1 in quoted:
            i -= 1
        return i
    if sql[i - 1] == ")":
        depth = 0
        while i > 0:
            i -= 1
            if i not in quoted:
                depth += (sql[i] == ")") - (sql[i] == "(")
                if not depth:
                    break
    while i > 0 and (sql[i - 1].isalnum() or sql[i - 1] in "_."):
        i -= 1
    return i


def _glob(m: re.Match) -> str:
    return f"{m[1]}'{m[2].replace('*', '?').replace('%', '*').replace('_', '?')}'"


def run(spark: SparkSession, sql: str, args: list | dict | None = None) -> DataFrame:
    """A query with ``<#>`` goes through the tensor query language, which knows its operands' types."""
    if any("<#>" in part for part in _STRINGS.split(sql)[::2]):
        from .. import api

        return api.query(re.sub(r"(\bi?like\s+)'((?:[^']|'')*)'", _glob, sql, flags=re.I), spark, params=list(args.values() if isinstance(args, dict) else args or ()))
    return spark.sql(translate(sql), args=args) if args else spark.sql(translate(sql))
