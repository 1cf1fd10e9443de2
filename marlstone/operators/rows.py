"""Dense row numbers, slices of rows, first rows of keys, weighted samples, checked set operations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..errors import MergeError
from ..sources.paths import stored

ROW_ID = "_row_id"


def with_row_id(df: DataFrame, order: Sequence[str], name: str = ROW_ID) -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, without bringing all rows to one task: rows are ranged over
    partitions and sorted in them, and a partition's first number is the count of rows before it (one row each).
    The ranged rows are stored, as ranges drawn a second time from another sample would not have the same counts."""
    if name in df.columns:
        return df
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    counts = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = ranged.withColumn("__p", part).join(base.select("__p", "__base"), "__p")
    return rows.withColumn(name, F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__base")


def row_slice(df: DataFrame, start: int | None = None, stop: int | None = None, name: str = ROW_ID) -> DataFrame:
    """The rows numbered from ``start`` up to ``stop``; negative numbers count from the end."""
    if (start or 0) < 0 or (stop or 0) < 0:
        n = df.agg((F.max(name) + 1).alias("n"))
        df = df.join(F.broadcast(n))  # one row
        at = lambda v: F.col("n") + v if v < 0 else F.lit(v)
        for v, ok in ((start, lambda b: F.col(name) >= b), (stop, lambda b: F.col(name) < b)):
            df = df.filter(ok(at(v))) if v is not None else df
        return df.drop("n")
    df = df.filter(F.col(name) >= start) if start else df
    return df.filter(F.col(name) < stop) if stop is not None else df


def row_list(df: DataFrame, rows: Sequence[int], name: str = ROW_ID) -> DataFrame:
    """The rows of a list of numbers, in its order and as often as there."""
    want = df.sparkSession.createDataFrame(list(enumerate(rows)), f"__at int, {name} long")
    return df.join(want, name).orderBy("__at").drop("__at")


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """DISTINCT ON: each key's first row.  One aggregate with map-side combining, so a hot key is no hot task."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min_by(F.struct("*"), F.struct(*cols)) if cols else F.first(F.struct("*"))
    return df.groupBy(*(k.alias(f"__k{i}") if isinstance(k, Column) else F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(first.alias("__r")).select("__r.*")


def weight(cases: Sequence[tuple[Column, float]], how: str = "max") -> Column:
    """MAX_WEIGHT and SUM_WEIGHT: of the weights of the conditions that hold, 0 when none does."""
    parts = [F.when(c, F.lit(float(w))).otherwise(0.0) for c, w in cases]
    return (F.greatest(*parts) if len(parts) > 1 else parts[0]) if how == "max" else sum(parts[1:], parts[0])


def sample_by(df: DataFrame, w: Column, n: int | None = None, percent: float | None = None, replace: bool = True, seed: int = 42) -> DataFrame:
    """Rows by weight.  Without replacement: the greatest of ln(u)/w, a top-k.  With: n draws are dealt to partitions by
    their weight, a multinomial over one number each, and in a partition row by row, a binomial of what is left at the
    row's share of the weight left; one pass, and always n rows where any has a weight.

    The count is n, or percent of the rows, or all of them; without replacement no more than there are.
    """
    rows = df.withColumn("__w", w.cast("double"))
    if n is None:
        total = df.count()
        n = total if percent is None else int(total * percent / 100)
    if not replace:
        key = F.log(1 - F.rand(seed)) / F.col("__w")
        return rows.filter("__w > 0").withColumn("__k", key).orderBy(F.desc("__k")).limit(n).drop("__k", "__w")
    # both passes must see the same partitions
    rows = stored(rows.filter("__w > 0").withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33).cast("int")), "weighted")
    sums = {r["__p"]: r["s"] for r in rows.groupBy("__p").agg(F.sum("__w").alias("s")).collect()}  # a number for each partition
    if not sums:
        return rows.drop("__p", "__m", "__w").limit(0)
    share = np.array(list(sums.values()))
    draws = dict(zip(sums, np.random.default_rng(seed).multinomial(n, share / share.sum()).tolist()))
    dealt = partial(_dealt, sums=sums, draws=draws, seed=seed, columns=df.columns)
    return rows.repartition("__p").sortWithinPartitions("__p", "__m").mapInArrow(dealt, df.schema)


def _dealt(batches: Iterator[pa.RecordBatch], sums: dict[int, float], draws: dict[int, int], seed: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Repeats each row as often as it is drawn; of rows sorted by partition, one batch and one row are held."""
    part, left, weight, rng, last = None, 0, 0.0, None, None
    for b in batches:
        own, w = b.column(b.schema.get_field_index("__p")).to_numpy(), b.column(b.schema.get_field_index("__w")).to_numpy()
        rows = b.select(columns)
        times = np.zeros(b.num_rows, np.int64)
        for i in range(b.num_rows):
            if own[i] != part:
                if left:  # what rounding left over falls on the partition's last row
                    if i:
                        times[i - 1] += left
                    else:
                        yield last.take(pa.array(np.zeros(left, np.int64)))
                part = own[i]
                left, weight, rng = draws[part], sums[part], np.random.default_rng([seed, int(part)])
            k = left if w[i] >= weight else int(rng.binomial(left, w[i] / weight)) if left else 0
            times[i], left, weight = k, left - k, weight - w[i]
        yield rows.take(pa.array(np.repeat(np.arange(b.num_rows), times)))
        last = rows.slice(b.num_rows - 1, 1) if b.num_rows else last
    if left:
        yield last.take(pa.array(np.zeros(left, np.int64)))


def _checked(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` with its columns in the order of ``a``; names and types must agree."""
    if len(a.columns) != len(b.columns):
        raise MergeError(f"{len(a.columns)} columns and {len(b.columns)}")
    for f in a.schema:
        if f.name not in b.columns:
            raise MergeError(f"the second side has no column {f.name}")
        if b.schema[f.name].dataType != f.dataType:
            raise MergeError(f"column {f.name} is {f.dataType.simpleString()} and {b.schema[f.name].dataType.simpleString()}")
    return b.select(*a.columns)


def set_operation(a: DataFrame, b: DataFrame, kind: str, keep_all: bool = False) -> DataFrame:
    """union, intersect or except, columns matched by name; ALL keeps repeats."""
    b = _checked(a, b)
    if kind == "union":
        return a.union(b) if keep_all else a.union(b).distinct()
    if kind == "intersect":
        return a.intersectAll(b) if keep_all else a.intersect(b)
    return a.exceptAll(b) if keep_all else a.subtract(b)


def class_label(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Names for an integer label column, kept in its metadata."""
    return df.withMetadata(column, {**df.schema[column].metadata, "class_names": list(names)})


def class_names(field: StructField) -> list[str]:
    return list(field.metadata.get("class_names", []))


def union_labels(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Union whose label column gets the names of both sides; the second side's numbers follow their names."""
    first, second = class_names(a.schema[column]), class_names(b.schema[column])
    names = first + [n for n in second if n not in first]
    to = F.array(*(F.lit(names.index(n)) for n in second)) if second else F.array().cast("array<int>")
    kind = a.schema[column].dataType
    moved = b.withColumn(column, F.get(to, F.col(column).cast("int")).cast(kind))
    return class_label(a.union(_checked(a, moved)), column, names)


def label_name(column: str, names: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(column).cast("int"))


def sparse_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Zeros and empty texts for nulls, as the SQL surface that stores no nulls reads them back."""
    return df.fillna({k: v for k, v in defaults.items()})
