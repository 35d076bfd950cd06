"""Deduplication, ranks within runs, extremes, top rows and limits by run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import fresh, scratch


def ordered(order: list) -> list[Column]:
    """Sort keys with nulls last; a leading minus in a name sorts it descending."""
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append(o)
        else:
            out.append(F.desc_nulls_last(o[1:]) if o.startswith("-") else F.asc_nulls_last(o))
    return out


def placed(df: DataFrame, keys: list[str], by: list, name: str) -> DataFrame:
    """The table written once in ranges of (keys, order) over all tasks, with each row's place in that order.

    Places are whole numbers of which the upper bits number the range. Rows that the order does not tell apart keep the
    places that they were written with.
    """
    columns = [*(F.col(k) for k in keys), *ordered(by)]
    spread = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return scratch(spread.withColumn(name, F.monotonically_increasing_id()), "ranges")


#: Bits of a place below the number of its range.
_RANGE_BITS = 33


def carried(df: DataFrame, keys: list[str], place: str, states: dict[str, tuple[str, Column]], inclusive: bool = True, totals: bool = False) -> DataFrame:
    """States along the places of each key: ``sum``, ``max`` or ``last`` (non-null value) of a column, up to each row.

    Any state whose parts combine can be carried so. Each range is scanned alone, from the state that the ranges of the
    key before it leave; a key of any size is no task of its own, and only ranges' own states are ordered in one place.
    With ``inclusive`` a row counts for itself; with ``totals`` sums of the whole key come as ``<name>_all``.
    """
    ranged, row, ahead = fresh(df, "range", "row", "ahead")
    held = {n: f"state_{i}" for i, n in enumerate(states)}
    # the key columns stand beside the row, which a range's first state has not
    rows = df.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.shiftright(place, _RANGE_BITS).alias(ranged), F.col(place).alias("at"), F.struct(*df.columns).alias(row), *(c.alias(held[n]) for n, (_, c) in states.items()))
    by = [f"key_{i}" for i in range(len(keys))]
    within = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    part = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))}
    kinds = {held[n]: kind for n, (kind, _) in states.items()}
    parts = rows.groupBy(*by, ranged).agg(*(part[kind](c).alias(c) for c, kind in kinds.items()))
    before, whole = Window.partitionBy(*by).orderBy(ranged).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = parts.select(
        *by, ranged, (F.shiftleft(F.col(ranged), _RANGE_BITS) - 1).alias("at"), F.lit(True).alias(ahead), F.count(F.lit(1)).over(whole).alias("n"),
        *(within[kind](c).over(before).alias(c) for c, kind in kinds.items()), *((F.sum(c).over(whole) - F.coalesce(F.col(c), F.lit(0))).alias(f"rest_{c}") for c in kinds if totals),
    ).filter("n > 1").drop("n")
    both = rows.unionByName(starts, allowMissingColumns=True)
    group = Window.partitionBy(*by, ranged)
    frame = group.orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    every = group.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [within[kind](c).over(frame) for c, kind in kinds.items()]
    all_ = [F.coalesce(F.sum(F.when(F.col(ahead).isNull(), F.col(c))).over(every), F.lit(0)) + F.coalesce(F.max(f"rest_{c}").over(every), F.lit(0)) for c in kinds] if totals else []
    names = [*states, *(f"{n}_all" for n in states if totals)]
    found = both.select(row, ahead, *(c.alias(f"out_{i}") for i, c in enumerate([*out, *all_])))
    return found.filter(F.col(ahead).isNull()).select(*(F.col(row)[c].alias(c) for c in df.columns), *(F.col(f"out_{i}").alias(n) for i, n in enumerate(names)))


#: Rows of a key beyond which it is scanned in ranges.
HOT_ROWS = 1 << 17


def scanned(df: DataFrame, keys: list[str], by: list, states: dict[str, tuple[str, Column]], inclusive: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The table with states carried along an order within the keys, as in ``carried``.

    Keys of up to ``hot_rows`` rows take one exchange; only larger ones are written in ranges.
    """
    (place,) = fresh(df, "place")
    ranged = lambda rows: carried(placed(rows, keys, by, place), keys, place, states, inclusive).drop(place)
    if not keys:
        return ranged(df)
    rows = df if hasattr(df, "_scratch") else scratch(df, "scanned")
    mine = [f"hot_{i}" for i in range(len(keys))]
    hot = scratch(rows.groupBy(*(F.col(k).alias(m) for k, m in zip(keys, mine, strict=True))).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(*mine), "hot-keys")
    frame = Window.partitionBy(*keys).orderBy(*ordered(by)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    light = lambda t: t.select("*", *(within[kind](c).over(frame).alias(n) for n, (kind, c) in states.items()))
    if hot.isEmpty():
        return light(rows)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine, strict=True)))
    return light(rows.join(hot, same, "left_anti")).unionByName(ranged(rows.join(hot, same, "left_semi")))


def running(df: DataFrame, keys: list[str], by: list[str], sums: list[str]) -> DataFrame:
    """Running sums (``<sum>_to``, the row included) and totals (``<sum>_all``) along an order within the keys.

    ``by`` must tell the rows of a key apart; a leading minus sorts descending. Keys of any size are ranged over tasks.
    """
    (place,) = fresh(df, "place")
    out = carried(placed(df, keys, by, place), keys, place, {f"{c}_to": ("sum", F.coalesce(F.col(c), F.lit(0))) for c in sums}, totals=True)
    return out.select(*df.columns, *(F.col(f"{c}_to_all").alias(f"{c}_all") for c in sums), *(f"{c}_to" for c in sums))


def numbered(df: DataFrame, keys: list, order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered(order))))


def latest_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; Spark limits each partition's groups before the shuffle."""
    (n,) = fresh(df, "n")
    return numbered(df, keys, order, n).filter(F.col(n) == 1).drop(n)


def preferred_type(df: DataFrame, keys: list[str], kind: str, preferred: list[str], then: list) -> DataFrame:
    """One row of each key: kinds in order of preference, others after them, then by further keys."""
    priority = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        priority = F.when(F.col(kind) == p, i).otherwise(priority)
    return latest_per_key(df, keys, [priority.asc(), *then])


def instance_ordinal(df: DataFrame, keys: list[str], order: list, name: str = "instance") -> DataFrame:
    """Number of a row among those that repeat a key."""
    return numbered(df, keys, order, name)


def offer_rank(df: DataFrame, run: str, order: list, name: str = "offer_rank") -> DataFrame:
    return numbered(df, [run], order, name)


def sort_key(df: DataFrame, keys: list[str], ts_micros: str, order: list, name: str = "sort_micros") -> DataFrame:
    """Timestamps in microseconds with ties spread by one microsecond each, in an order."""
    w = Window.partitionBy(*keys, ts_micros).orderBy(*ordered(order))
    return df.withColumn(name, F.col(ts_micros) + F.row_number().over(w) - 1)


def nth_event(df: DataFrame, run: str, condition: Column, order: list, n: int) -> DataFrame:
    """The n-th row of a kind in each run."""
    (place,) = fresh(df, "place")
    return numbered(df.filter(condition), [run], order, place).filter(F.col(place) == n).drop(place)


def best_row(df: DataFrame, run: str, score: str, rank: str) -> DataFrame:
    """The row of the highest score in each run; ties go to the lowest rank."""
    return latest_per_key(df, [run], [f"-{score}", rank])


def top_rows(df: DataFrame, run: str, score: str, rank: str, k: int) -> DataFrame:
    """The rows of the ``k`` highest scores of each run, ties to the lowest rank, with their ``place``.

    A column ``place`` that the table has of its own is handed through, and the new one gets the next free name.
    """
    (place,) = fresh(df, "place")
    return numbered(df, [run], [f"-{score}", rank], place).filter(F.col(place) <= k)


def limit_runs(df: DataFrame, run: str, split: str, ts: str, n: int) -> DataFrame:
    """All rows of the first ``n`` runs of each split by their first timestamp, then by run."""
    first, place = fresh(df, "first", "place")
    runs = df.groupBy(split, run).agg(F.min(ts).alias(first))
    some = numbered(runs, [split], [first, run], place).filter(F.col(place) <= n).select(split, run)
    return df.join(some, [split, run], "left_semi")


def distinct_on(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def priority_match(facts: DataFrame, offers: DataFrame, keys: list[str], fact_id: str, priority: Column, order: list) -> DataFrame:
    """For each fact the best of the offers that share its keys: lowest priority number, then an order."""
    both = facts.join(offers, keys)
    (first,) = fresh(both, "priority")
    return latest_per_key(both.withColumn(first, priority), [fact_id], [first, *order]).drop(first)
