"""JSON: paths, keys, containment; missing is null unless strict."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "." + s if s.isidentifier() else f"['{s}']" for s in steps)


def get(c: Column, steps: list[str | int], kind: str = "string", strict: bool = False) -> Column:
    """The value at a path, cast; a negative array step counts from the end.  With ``strict`` a missing one fails."""
    at = next((i for i, s in enumerate(steps) if isinstance(s, int) and s < 0), None)
    if at is None:
        v = F.get_json_object(c, path(steps))
    else:
        items = F.from_json(F.get_json_object(c, path(steps[:at])), "array<string>")
        v = F.get(items, F.size(items) + F.lit(steps[at]))
        if steps[at + 1 :]:
            v = get(v, steps[at + 1 :])
    if strict:
        v = F.coalesce(v, F.raise_error(F.lit(f"there is nothing at {steps}")).cast("string"))
    return v if kind == "string" else v.cast(kind)


def keys(c: Column) -> Column:
    return F.json_object_keys(c)


def field_eq(c: Column, field: str, value: str) -> Column:
    """Text equality of a field; false where it is missing."""
    return F.coalesce(get(c, [field]) == value, F.lit(False))


def holds(c: Column, wanted: dict | list | str, steps: tuple = ()) -> Column:
    """Whether the document contains ``wanted``: every field of objects, every element of lists."""
    if isinstance(wanted, str) and not steps:
        wanted = json.loads(wanted)
    if isinstance(wanted, dict):
        parts = [holds(c, v, (*steps, k)) for k, v in wanted.items()]
    elif isinstance(wanted, list):
        items = F.from_json(get(c, list(steps)) if steps else c, "array<string>")
        parts = [F.coalesce(F.array_contains(items, v if isinstance(v, str) else json.dumps(v)), F.lit(False)) for v in wanted]
    else:
        text = wanted if isinstance(wanted, str) else json.dumps(wanted)
        v = get(c, list(steps))
        same = v.isNull() & F.lit(False) if wanted is None else v.cast("double") == float(wanted) if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) else v == text
        parts = [F.coalesce(F.expr("true") & same, F.lit(False))] if wanted is None or not isinstance(wanted, (int, float)) or isinstance(wanted, bool) else [F.coalesce(v.try_cast("double") == float(wanted), F.lit(False))]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
