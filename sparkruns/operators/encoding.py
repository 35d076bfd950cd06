"""Mixed-type encoding whose state merges batch by batch, and ordered statistics of the target by category.

An encoder's state is two tables: sums and counts of numbers and times, and the
codes of categories. Categories of any number stay tables, and codes are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import fresh, scratch
from .rank import running, scanned

#: The category of a missing value.
MISSING = "missing"
UNSEEN = -1.0


def kind_of(df: DataFrame, feature: str) -> str:
    """``time``, ``number`` or ``category`` by a column's type; a column that is absent is a number without values."""
    if feature not in df.columns:
        return "number"
    t = df.schema[feature].dataType
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "number" if isinstance(t, (T.NumericType, T.BooleanType)) else "category"


def _number(df: DataFrame, feature: str, kind: str) -> Column:
    """A value as a double, times as nanoseconds; null where there is none or it cannot be read."""
    if feature not in df.columns:
        return F.lit(None).cast("double")
    if kind == "time":
        x = F.unix_micros(F.col(feature).cast("timestamp")).cast("double") * 1000.0
    elif isinstance(df.schema[feature].dataType, (T.NumericType, T.BooleanType)):
        x = F.col(feature).cast("double")
    else:
        x = F.col(feature).cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def category(df: DataFrame, feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("string"), F.lit(MISSING)) if feature in df.columns else F.lit(MISSING)


@dataclass
class Encoder:
    """``kinds`` of the features; ``numbers`` (feature, total, n); ``codes`` (feature, value, code) from 0 in the order of first sight."""

    kinds: dict[str, str]
    numbers: DataFrame
    codes: DataFrame

    def fills(self) -> dict[str, float]:
        """What stands for a missing number: the mean of all seen, 0 without any. One number for each feature."""
        found = {r.feature: r.total / r.n if r.n else 0.0 for r in self.numbers.collect()}
        return {f: found.get(f, 0.0) for f, kind in self.kinds.items() if kind != "category"}


def fit_batch(df: DataFrame, features: list[str], order: list[str], encoder: Encoder | None = None) -> Encoder:
    """An encoder that has also seen a batch of rows.

    Features keep the kind of their first batch. Values that are new get the next codes, in the order of their first row
    in the batch (by ``order``, then by value); codes given before never change. Missing categories are a value of their
    own, and so are those of an absent column.
    """
    kinds = encoder.kinds if encoder else {f: kind_of(df, f) for f in features}
    numeric = [f for f, kind in kinds.items() if kind != "category"]
    named = [f for f, kind in kinds.items() if kind == "category"]
    empty = F.array().cast("array<struct<feature:string,total:double,n:bigint>>")
    sums = F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.sum(_number(df, f, kinds[f])), F.lit(0.0)).alias("total"), F.count(_number(df, f, kinds[f])).alias("n")) for f in numeric)) if numeric else empty
    numbers = df.agg(sums.alias("x")).select(F.explode("x").alias("x")).select("x.*")
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), category(df, f).alias("value")) for f in named)) if named else F.array().cast("array<struct<feature:string,value:string>>")
    seen = df.select(F.explode(cells).alias("x"), F.struct(*order).alias("first")).groupBy("x.feature", "x.value").agg(F.min("first").alias("first"))
    taken = None
    if encoder:
        numbers = encoder.numbers.unionByName(numbers).groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        seen = seen.join(encoder.codes, ["feature", "value"], "left_anti")
        taken = encoder.codes.groupBy("feature").agg((F.max("code") + 1).alias("taken"))
    new = running(seen.withColumn("one", F.lit(1)), ["feature"], ["first", "value"], ["one"])
    if encoder:
        new = new.join(taken, "feature", "left")
        codes = encoder.codes.unionByName(new.select("feature", "value", (F.coalesce("taken", F.lit(0)) + F.col("one_to") - 1).alias("code")))
    else:
        codes = new.select("feature", "value", (F.col("one_to") - 1).alias("code"))
    return Encoder(kinds, scratch(numbers, "encoder-numbers"), scratch(codes, "encoder-codes"))


def encode(encoder: Encoder, df: DataFrame) -> DataFrame:
    """One double column ``code_<feature>`` for each feature: numbers with missing ones filled, codes, -1 for an unseen category."""
    fills = encoder.fills()
    out = df.select("*", *(F.coalesce(_number(df, f, kind), F.lit(fills[f])).alias(f"code_{f}") for f, kind in encoder.kinds.items() if kind != "category"))
    for f, kind in encoder.kinds.items():
        if kind == "category":
            (value, code) = fresh(out, "value", "code")
            side = encoder.codes.filter(F.col("feature") == f).select(F.col("value").alias(value), F.col("code").alias(code))
            out = out.withColumn(value, category(df, f)).join(side, value, "left").withColumn(f"code_{f}", F.coalesce(F.col(code).cast("double"), F.lit(UNSEEN))).drop(value, code)
    return out.select(*df.columns, *(f"code_{f}" for f in encoder.kinds))


# statistics of the target by category


@dataclass
class TargetStatistics:
    """Per feature a table (value, total, n) of the target over all training rows, and the mean over all."""

    tables: dict[str, DataFrame]
    mean: float
    strength: float

    def transform(self, df: DataFrame, prefix: str = "stat_") -> DataFrame:
        """Smoothed means of the target for each category; the overall mean for unseen ones."""
        out = df
        for f, table in self.tables.items():
            value, total, n = fresh(out, "value", "total", "n")
            side = table.toDF(value, total, n)
            share = (F.coalesce(F.col(total), F.lit(0.0)) + self.mean * self.strength) / (F.coalesce(F.col(n), F.lit(0)) + self.strength)
            out = out.withColumn(value, category(df, f)).join(side, value, "left").withColumn(f"{prefix}{f}", share).drop(value, total, n)
        return out.select(*df.columns, *(f"{prefix}{f}" for f in self.tables))


def ordered_statistics(df: DataFrame, target: str, features: list[str], ids: list[str], strength: float = 10.0, seed: int = 0, prefix: str = "stat_") -> tuple[DataFrame, TargetStatistics]:
    """Training rows with ``stat_<feature>``, and what other rows get.

    A training row's statistic is over the rows of its category before it in an order by hash, so that it never sees its
    own target; a category of any number of rows is ranged over tasks, and categories may be as many as rows.
    """
    y = F.col(target).cast("double")
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    statistics = TargetStatistics({f: scratch(df.groupBy(category(df, f).alias("value")).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("total"), F.count(y).alias("n")), "target-statistics") for f in features}, mean, strength)
    out = df
    for i, f in enumerate(features):
        place, value, total, n = fresh(out, "hash", "value", "total", "n")
        rows = out.withColumns({place: F.xxhash64(F.lit(seed + i), *ids), value: category(df, f)})
        rows = scanned(rows, [value], [place, *ids], {total: ("sum", F.coalesce(y, F.lit(0.0))), n: ("sum", F.when(y.isNotNull(), 1).otherwise(0))}, inclusive=False)
        share = (F.coalesce(F.col(total), F.lit(0.0)) + mean * strength) / (F.coalesce(F.col(n), F.lit(0)) + strength)
        out = rows.withColumn(f"{prefix}{f}", share).drop(place, value, total, n)
    return out.select(*df.columns, *(f"{prefix}{f}" for f in features)), statistics
