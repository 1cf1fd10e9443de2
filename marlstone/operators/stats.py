"""Column statistics: share of nulls, mean width, distinct values, least and greatest, most common values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType


EXACT_COLUMNS = 4


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool | None = None) -> DataFrame:
    """A row per column, from one pass over the table.  n_distinct is minus the share of rows when over a tenth of them
    are distinct, as planners keep it.  Exact counts of distinct values take a copy of each row for each column, so beyond
    EXACT_COLUMNS they are estimated unless asked for."""
    columns = [f.name for f in df.schema if not isinstance(f.dataType, (ArrayType, MapType)) and f.name in (columns or df.columns)]
    exact = len(columns) <= EXACT_COLUMNS if exact is None else exact
    distinct = F.countDistinct if exact else F.approx_count_distinct
    agg = [F.count("*").alias("__n")]
    for c in columns:
        width = F.octet_length(c) if isinstance(df.schema[c].dataType, StringType) else F.octet_length(F.col(c).cast("string"))
        agg += [F.count(c).alias(f"{c}__c"), distinct(c).alias(f"{c}__d"), F.avg(width).alias(f"{c}__w"), F.min(c).cast("string").alias(f"{c}__lo"), F.max(c).cast("string").alias(f"{c}__hi")]
    one = df.agg(*agg)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.try_divide(F.col("__n") - F.col(f"{c}__c"), F.col("__n")).alias("null_frac"), F.col(f"{c}__w").alias("avg_width"), F.when(F.col(f"{c}__d") > 0.1 * F.col("__n"), -F.col(f"{c}__d") / F.col("__n")).otherwise(F.col(f"{c}__d").cast("double")).alias("n_distinct"), F.col(f"{c}__lo").alias("min"), F.col(f"{c}__hi").alias("max")) for c in columns))
    return one.select(F.inline(rows))


def most_common(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)
