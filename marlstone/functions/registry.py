"""User functions for queries: numpy in, numpy out, run as vectorised Arrow batches."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from ..errors import FunctionNotFound

_functions: dict[str, tuple[Callable, int, str]] = {}


def register_function(f: Callable, name: str | None = None, returns: str = "double", is_batch: bool = True, column: str | None = None) -> str:
    """Makes ``f`` callable from queries under its name; of no, one or two arrays.  A batch function gets whole columns
    as numpy arrays, another one value at a time.  With ``column`` it is that column's own: calls whose first argument
    is the column find it, before a function of that name for all."""
    name = own_name((name or f.__name__).lower(), column)
    arity = len(inspect.signature(f).parameters)
    if arity > 2:
        raise ValueError("user functions take two arguments at most")
    _functions[name] = (f, arity, returns if is_batch else f"each:{returns}")
    return name


def own_name(name: str, column: str | None) -> str:
    return name if column is None else f"{column}:{name}"


def unregister_function(name: str, column: str | None = None) -> None:
    if _functions.pop(own_name(name.lower(), column), None) is None:
        raise FunctionNotFound(name)


def has_function(name: str, column: str | None = None) -> bool:
    return own_name(name.lower(), column) in _functions


def call(name: str, *args):
    """The column of a registered function on columns."""
    key = name if name in _functions else name.lower()
    if key not in _functions:
        raise FunctionNotFound(name)
    f, arity, kind = _functions[key]
    if len(args) != arity:
        raise FunctionNotFound(f"{name} takes {arity} arguments, not {len(args)}")
    one, returns = kind.startswith("each:"), kind.removeprefix("each:")

    def batch(a: pd.Series) -> pd.Series:
        return pd.Series(list(map(f, a)) if one else list(f(a.to_numpy())))

    def pair(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(f, a, b)) if one else list(f(a.to_numpy(), b.to_numpy())))

    if arity == 0:
        return F.lit(f().item() if hasattr(f(), "item") else f())
    return F.pandas_udf(batch if arity == 1 else pair, returns)(*args)
