"""Data-quality jobs: profiles, catalogues, reconciliation, drift within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_partitions(df: DataFrame, part: str, ts: str, keys: list[str]) -> DataFrame:
    """Rows, rows of this, the previous and the next period, null keys, and the range of timestamps of each partition."""
    shift = F.year(ts) - F.col(part)
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(shift == 0).alias("in_period"),
        F.count_if(shift == -1).alias("prior_period"),
        F.count_if(shift == 1).alias("next_period"),
        *(F.count_if(F.col(k).isNull()).alias(f"null_{k}") for k in keys),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows and number of columns of each table."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
    return reduce(DataFrame.unionByName, (one(n, d) for n, d in tables.items()))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of two tables by key where they differ; one pass over each, summed before the shuffle."""
    mark = lambda df, l, r: df.select(*keys, F.lit(l).alias("l"), F.lit(r).alias("r"))
    both = mark(left, 1, 0).unionByName(mark(right, 0, 1))
    return both.groupBy(*keys).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")).filter("left_rows <> right_rows")


class RowCountMismatch(ValueError):
    pass


def assert_reconciled(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    bad = reconcile(left, right, keys).limit(5).collect()
    if bad:
        raise RowCountMismatch(f"row counts differ, for instance {bad}")


def drift_groups(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups of two rows or more in which a column that should be constant is not."""
    return (
        df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("most"), F.count(F.lit(1)).alias("n_rows"))
        .filter((F.col("n_rows") > 1) & ~F.col("least").eqNullSafe(F.col("most")))
    )


def verify_first_keys(first: DataFrame, source: DataFrame, keys: list[str], order: list[str], sample: int = 1000) -> DataFrame:
    """Of a hash-ordered sample of keys: how many first rows are in the map, and how many of them are truly first."""
    some = first.select(*keys, *(F.col(c).alias(f"first_{c}") for c in order)).orderBy(F.xxhash64(*keys), *keys).limit(sample)
    least = source.join(some.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*order)).alias("least"))
    claimed = F.struct(*(F.col(f"first_{c}").alias(c) for c in order))
    return some.join(least, keys).agg(F.count(F.lit(1)).alias("checked"), F.count_if(claimed == F.col("least")).alias("agreeing"))


def state_counts(df: DataFrame, state: str) -> DataFrame:
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
