"""Rows into sequences and back: grouping, ungrouping, frames around a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..errors import TypeMismatch


def group_to_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None, across: str = "time", keep_keys: bool = False) -> DataFrame:
    """Every column of a group as one more leading dimension, in the order of ``order``.

    ACROSS SPACE joins arrays along their first axis instead.  A group is a cell of the result and so one row's size.
    """
    columns = list(columns or df.columns)
    packed = F.sort_array(F.collect_list(F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)))))
    rows = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(packed.alias("__s"))
    out: list[Column] = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)] if keep_keys else []
    for i, c in enumerate(columns):
        if keep_keys and c in keys:
            continue
        v = F.col("__s")[f"__c{i}"]
        if across == "space" and isinstance(df.schema[c].dataType, ArrayType):
            v = F.flatten(v)
        out.append(v.alias(c))
    return rows.select(*out)


def ungroup_split(df: DataFrame, columns: Sequence[str], position: str | None = None) -> DataFrame:
    """Unrolls the first axis of ``columns`` together; the other columns repeat."""
    rest = [c for c in df.columns if c not in columns]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("__pos", "__v"))
    return rows.select(*rest, *([F.col("__pos").alias(position)] if position else []), *(F.col("__v")[c].alias(c) for c in columns))


def ungroup_ranges(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Splits the first axis into ``n`` runs of nearly equal length, the longer ones first; empty ones too."""
    rest = [c for c in df.columns if c not in columns]
    size = F.size(F.col(columns[0]))
    q, r = F.expr(f"size(`{columns[0]}`) div {n}").cast("int"), size % n
    i = F.col("__i")
    start, length = i * q + F.least(i, r), q + F.when(i < r, 1).otherwise(0)
    rows = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*rest, *(F.slice(F.col(c), start + 1, length).alias(c) for c in columns))


def ungroup_lengths(df: DataFrame, columns: Sequence[str], lengths: Sequence[int] | str) -> DataFrame:
    """Splits the first axis into runs of given lengths: constants, or an array column."""
    rest = [c for c in df.columns if c not in columns]
    sizes = F.col(lengths) if isinstance(lengths, str) else F.array(*map(F.lit, lengths))
    starts = F.transform(sizes, lambda v, i: F.struct((F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x.cast("int"))).alias("s"), v.cast("int").alias("n")))
    rows = df.withColumn("__r", F.explode(starts))
    return rows.select(*rest, *(F.slice(F.col(c), F.col("__r.s") + 1, F.col("__r.n")).alias(c) for c in columns))


#: Rows of a block of frames.
BLOCK = 4096


def expand(df: DataFrame, order: Sequence[str], back: int, ahead: int = 0, overlap: bool = True, columns: Sequence[str] | None = None, partition: Sequence[str] = ()) -> DataFrame:
    """EXPAND BY: each row's columns as the sequence of ``back`` rows before it to ``ahead`` after; without overlap one
    row for each run of back + ahead + 1.

    Frames run over ``partition``; without one the rows are numbered densely first and framed in blocks of numbers, so
    that no task holds the whole table.
    """
    columns = list(columns or [c for c in df.columns if c not in order and c not in partition])
    if any(c in order for c in columns):
        raise TypeMismatch("ordering columns are not expanded")
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        if overlap:
            frame = w.rowsBetween(-back, ahead)
            return df.select(*partition, *order, *(F.collect_list(c).over(frame).alias(c) for c in columns))
        rows = df.withColumn("__g", F.floor((F.row_number().over(w) - 1) / (back + ahead + 1)))
        return group_to_sequence(rows, [*partition, "__g"], order, [*order, *columns], keep_keys=True).drop("__g")
    from .rows import with_row_id

    rows = with_row_id(df, order, "__n")
    if overlap:
        # blocks of rows are framed each in a window; only rows at a block's edge go to its neighbours too
        block = max(BLOCK, 4 * (back + ahead))
        at = lambda n: F.floor(n / block)
        spread = rows.withColumn("__b", F.explode(F.sequence(at(F.col("__n") - ahead), at(F.col("__n") + back))))
        frame = Window.partitionBy("__b").orderBy("__n").rangeBetween(-back, ahead)
        seqs = spread.select("__b", "__n", *order, F.collect_list(F.struct(*columns)).over(frame).alias("__s"))
        return seqs.filter(at(F.col("__n")) == F.col("__b")).select(*order, *(F.col(f"__s.{c}").alias(c) for c in columns))
    rows = rows.withColumn("__g", F.floor(F.col("__n") / (back + ahead + 1)))
    return group_to_sequence(rows, ["__g"], order, [*order, *columns], keep_keys=True).drop("__g")
