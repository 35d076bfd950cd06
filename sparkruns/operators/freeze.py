"""First rows of keys within runs, and features frozen to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import ordered


def first_keys(df: DataFrame, keys: list[str], order: list[str], least_rows: int = 2) -> DataFrame:
    """The order columns of the first row of each group of at least so many rows."""
    first = F.min(F.struct(*order)).alias("_first")
    groups = df.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least_rows)
    return groups.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in order), "n_rows")


def freeze_first(df: DataFrame, keys: list[str], order: list, columns: list[str], keep_null_keys: bool = True) -> DataFrame:
    """Columns take the value of the first row of their group; rows with a null key keep their own."""
    w = Window.partitionBy(*keys).orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, 0)
    null_key: Column = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    frozen = {c: F.first(c).over(w) for c in columns}
    if keep_null_keys:
        frozen = {c: F.when(null_key, F.col(c)).otherwise(f) for c, f in frozen.items()}
    return df.withColumns(frozen)


def key_values(first: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Source values at the rows of a first-row map."""
    return first.join(source.select(*keys, *columns), keys)
