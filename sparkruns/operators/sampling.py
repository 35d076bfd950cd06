"""Deterministic sampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh
from .rank import running


def hashed(*keys: str, seed: int = 0) -> Column:
    """A hexadecimal hash of keys and seed that other engines compute alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))


def unit(*keys: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone: the first 40 bits of their hash."""
    return F.conv(F.substring(hashed(*keys, seed=seed), 1, 10), 16, 10).cast("long") / float(1 << 40)


def downsample_negatives(df: DataFrame, keys: list[str], target: str, ratio: float, seed: int = 0) -> DataFrame:
    """All positives, and negatives at about ``ratio`` for each; empty without positives. Two counts reach the driver."""
    n = df.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q")).first()
    if not n["p"]:
        return df.limit(0)
    share = min(1.0, ratio * n["p"] / max(n["q"], 1))
    return df.filter((F.col(target) == 1) | ((F.col(target) == 0) & (unit(*keys, seed=seed) < share)))


def hash_order(df: DataFrame, strata: list[str], ids: list[str], name: str = "place", seed: int = 0) -> DataFrame:
    """Number of each row within its stratum in an order by hash; ``ids`` tell rows apart. Strata of any size are ranged over all tasks."""
    h, one = fresh(df, "hash", "one")
    rows = df.withColumns({h: hashed(*ids, seed=seed), one: F.lit(1)})
    return running(rows, strata, [h, *ids], [one]).select(*df.columns, F.col(f"{one}_to").alias(name))


def sample_runs(df: DataFrame, run: str, strata: list[str], budget: int, seed: int = 0) -> DataFrame:
    """Whole runs in hash order under a budget of rows for each stratum, by the stratum's mean length."""
    length, take, place = fresh(df, "length", "take", "place")
    runs = df.groupBy(*strata, run).agg(F.count(F.lit(1)).alias(length))
    size = runs.groupBy(*strata).agg(F.greatest(F.floor(budget / F.avg(length)), F.lit(1)).alias(take))
    some = hash_order(runs, strata, [run], place, seed).join(size, strata).filter(F.col(place) <= F.col(take)).select(*strata, run)
    return df.join(some, [*strata, run], "left_semi")
