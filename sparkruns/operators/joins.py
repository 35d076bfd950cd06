"""Dimension, point-in-time and semi joins; distances and geocoding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_NM, haversine_nm
from ..sources.tables import fresh, scratch
from .rank import latest_per_key, running, scanned


def enrich(fact: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins with dimensions; whether one is broadcast follows its size and the session's threshold."""
    for dim, keys in dims:
        fact = fact.join(dim, keys, "left")
    return fact


def enrich_compound(fact: DataFrame, dim: DataFrame, key: str, part: str) -> DataFrame:
    """Left join on a key and a second part of which null equals the empty string."""
    (known,) = fresh(fact.select(*fact.columns, *(F.lit(1).alias(c) for c in dim.columns)), "part")
    side = dim.withColumn(known, F.coalesce(F.col(part), F.lit(""))).drop(part)
    return fact.withColumn(known, F.coalesce(F.col(part), F.lit(""))).join(side, [key, known], "left").drop(known)


#: Intervals of a key up to which they travel to its facts as one list.
LISTED = 64


def valid_at(facts: DataFrame, history: DataFrame, keys: list[str], ts: str, begin: str, end: str, values: list[str], listed: int = LISTED) -> DataFrame:
    """Values of the latest interval ``[begin, end)`` that holds a fact's timestamp; a null end is open.

    Intervals of a key may overlap in any way. Of intervals with one begin the longest-lasting counts, then the larger
    values. Intervals without a begin, or that end by it, hold nothing; a fact without a timestamp, or with a null key,
    is held by none. Keys of up to ``listed`` intervals are joined by the keys alone, intervals as a list. Of the others
    it is found first what holds from each end point of a key's intervals on (``_states``); the last of these is carried
    to the facts' times, in ranges of (key, time), so that neither a key's facts nor its history are one task.
    """
    history = history.select(*keys, F.col(begin).alias("_at"), F.col(end).alias("_end"), F.struct(*values).alias("_values"))
    there = history.dropna(subset=[*keys, "_at"]).filter("_end is null or _end > _at")
    many = scratch(there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > listed).select(*keys), "long-histories")
    any_ = not many.isEmpty()
    (found,) = fresh(facts, "found")
    lists = (there.join(many, keys, "left_anti") if any_ else there).groupBy(*keys).agg(F.collect_list(_interval()).alias(found))
    holds = lambda i: (i["_at"] <= F.col(ts)) & (i["open"] | (i["end"] > F.col(ts)))
    best = F.array_max(F.filter(found, holds))["values"]
    from_list = lambda rows: rows.join(lists, keys, "left").withColumn(found, best).select(*facts.columns, *(F.col(found)[v].alias(v) for v in values))
    if not any_:
        return from_list(facts)
    long_ = _carried_to(facts.join(many, keys, "left_semi"), _states(there.join(many, keys, "left_semi"), keys), keys, ts, "_values", values)
    return from_list(facts.join(many, keys, "left_anti")).unionByName(long_)


def _interval() -> Column:
    """Intervals in order of precedence: by begin, then by end, open ones last, then by values."""
    return F.struct("_at", F.col("_end").isNull().alias("open"), F.col("_end").alias("end"), F.col("_values").alias("values"))


def _carried_to(facts: DataFrame, marks: DataFrame, keys: list[str], ts: str, state: str, values: list[str]) -> DataFrame:
    """Facts with the values of the last mark (keys, _at, a struct or null) at or before their time.

    Only the distinct (keys, time) of the facts move along the order; the facts then meet them by equality, so that wide
    rows are moved once. A null key or time meets nothing.
    """
    points = facts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(ts).alias("_at")).dropna().distinct()
    by = [f"_k{i}" for i in range(len(keys))]
    marks = marks.select(*(F.col(k).alias(b) for k, b in zip(keys, by, strict=True)), "_at", F.struct(F.col(state).alias("held")).alias("_mark"))
    both = points.withColumn("_fact", F.lit(1)).unionByName(marks.withColumn("_fact", F.lit(0)), allowMissingColumns=True)
    seen = scanned(both, by, ["_at", "_fact"], {"_seen": ("last", F.col("_mark"))}).filter("_fact = 1")
    found, *others = fresh(facts, "found", *(f"k{i}" for i in range(len(keys))), "time")
    seen = seen.select(F.col("_seen.held").alias(found), *(F.col(c).alias(o) for c, o in zip([*by, "_at"], others, strict=True)))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(o) for c, o in zip([*keys, ts], others, strict=True)))
    return facts.join(seen, same, "left").select(*facts.columns, *(F.col(found)[v].alias(v) for v in values))


def _states(history: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _at, _values): the latest-begun interval that is open from each end point to the next; null if none is.

    End points of a key are numbered, in ranges. Each interval covers a run of numbers, which is cut in dyadic segments:
    few of each length, O(log n) together. A segment keeps the latest-begun of the intervals that cover it whole, and
    every end point looks up the O(log n) segments that it lies in. All are joins and groups on equal (key, segment), so
    that a key with a million intervals is many tasks.
    """
    history = history.dropna(subset=[*keys, "_at"]).filter("_end is null or _end > _at")
    times = F.explode(F.array("_at", "_end")).alias("_at")
    points = history.select(*keys, times).filter("_at is not null").distinct().withColumn("_one", F.lit(1))
    points = running(points, keys, ["_at"], ["_one"]).select(*keys, "_at", (F.col("_one_to") - 1).alias("_i"), F.col("_one_all").alias("_n"))
    # the end points are read by every join below
    points = scratch(points, "end-points")
    starts = points.select(*keys, "_at", F.col("_i").alias("_from"), "_n")
    ends = points.select(*keys, F.col("_at").alias("_end"), F.col("_i").alias("_to"))
    runs = history.join(starts, [*keys, "_at"]).join(ends, [*keys, "_end"], "left").withColumn("_to", F.coalesce("_to", "_n"))
    best = _interval()
    levels = lambda n: F.sequence(F.lit(0), F.length(F.bin(n)) - 1)
    cut = runs.select(*keys, "_from", "_to", best.alias("_best"), F.explode(levels(F.col("_to") - F.col("_from"))).alias("_level"))
    # at each level at most the first and the last segment of what is left are taken
    first, last = F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), F.expr("shiftright(_to, _level)")
    taken = F.array(F.when((first < last) & (first % 2 == 1), first), F.when((first < last) & (last % 2 == 1), last - 1))
    segments = cut.select(*keys, "_level", "_best", F.explode(F.array_compact(taken)).alias("_segment"))
    segments = segments.groupBy(*keys, "_level", "_segment").agg(F.max("_best").alias("_best"))
    up = points.select(*keys, "_at", "_i", F.explode(levels(F.col("_n"))).alias("_level")).withColumn("_segment", F.expr("shiftright(_i, _level)"))
    open_ = up.join(segments, [*keys, "_level", "_segment"], "left").groupBy(*keys, "_at").agg(F.max("_best").alias("_best"))
    return open_.select(*keys, "_at", F.col("_best.values").alias("_values"))


def asof_backward(facts: DataFrame, events: DataFrame, keys: list[str], ts: str, value: str, lag: int = 0) -> DataFrame:
    """The value of the last event at or before ``ts - lag`` (whole numbers) of the same keys, carried in ranges of (key, time)."""
    marks = events.select(*keys, (F.col(ts) + lag).alias("_at"), F.struct(F.col(value).alias(value)).alias("_event"))
    return _carried_to(facts, marks, keys, ts, "_event", [value])


def exists_flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Whether a row's keys occur in another table."""
    marks = keys.select(*on).distinct().withColumn(name, F.lit(1))
    return df.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def exists_before(df: DataFrame, run: str, order: list, condition: Column, name: str) -> DataFrame:
    """Whether an earlier row of the run meets a condition; a maximum carried along instead of a correlated subquery."""
    out = scanned(df, [run], order, {name: ("max", F.when(condition, 1).otherwise(0))}, inclusive=False)
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def distance_matrix(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Distance of each site of ``a`` (a_id, a_lat, a_lon) to each of ``b``, and whether it lies within a radius.

    Every pair is the result; the sides are small reference tables of sites.
    """
    pairs = a.crossJoin(b)
    nm = haversine_nm(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return pairs.select("a_id", "b_id", nm.alias("distance_nm")).withColumn("within", F.when(F.col("distance_nm") <= radius, 1).otherwise(0))


def neighbours(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, distance_nm) of the sites of ``b`` (b_id, b_lat, b_lon) within ``radius`` nautical miles of each of ``a``, without a cross join.

    The sphere is cut in bands of latitude as high as the radius, and each band in cells of longitude that are as wide
    as the radius reaches at its side next to the pole. A site of ``b`` lies in one cell; one of ``a`` asks the cells
    beside it in its own band and the next ones, around the date line, and a band that reaches a pole is one cell.
    What meets is then measured. Sites without coordinates have no neighbours.
    """
    degrees = math.degrees(radius / EARTH_RADIUS_NM) * (1 + 1e-9)
    if degrees >= 60:  # such a radius spans most of the sphere: one cell
        degrees = 360.0
    band = lambda lat: F.floor((lat + 90.0) / degrees).cast("int")
    # the widest difference of longitude within the radius of a site in the band, or of its neighbours
    poleward = lambda n: F.greatest(F.abs(n * degrees - 90.0), F.abs((n + 1) * degrees - 90.0)) + degrees
    reach = lambda n: F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(min(degrees, 89.0)))) / F.cos(F.radians(F.least(poleward(n) - degrees, F.lit(89.999)))))))
    cells = lambda n: F.when(poleward(n) >= 90.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach(n) * 1.000001)))).cast("int")
    place = lambda lon, n: F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells(n)).cast("int"), cells(n) - 1)

    there = b.dropna(subset=["b_lat", "b_lon"]).withColumn("_band", band(F.col("b_lat")))
    there = there.withColumn("_cell", place(F.col("b_lon"), F.col("_band")))
    here = a.dropna(subset=["a_lat", "a_lon"]).withColumn("_own", band(F.col("a_lat")))
    here = here.withColumn("_band", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1)))
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(place(F.col("a_lon"), F.col("_band")) + d, cells(F.col("_band"))))
    here = here.withColumn("_cell", F.explode(F.array_distinct(beside)))
    nm = haversine_nm(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return here.join(there, ["_band", "_cell"]).select("a_id", "b_id", nm.alias("distance_nm")).filter(F.col("distance_nm") <= radius)


def count_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, n_within): how many sites of ``b`` lie within a radius of each site of ``a``, none included."""
    n = neighbours(a, b, radius).groupBy("a_id").agg(F.count(F.lit(1)).alias("n_within"))
    return a.select("a_id").join(n, "a_id", "left").select("a_id", F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"))


def geocode(sites: DataFrame, postal: DataFrame) -> DataFrame:
    """Coordinates of sites (site, zip, city) from postal codes (zip, city, lat, lon), with their source.

    First the site's own code, then the mean of coded sites of its city, then the mean of the city's codes.
    """
    codes = latest_per_key(postal, ["zip"], ["lat", "lon"]).select("zip", F.col("lat").alias("z_lat"), F.col("lon").alias("z_lon"))
    found = sites.join(codes, "zip", "left")
    own = found.filter("z_lat is not null").groupBy("city").agg(F.avg("z_lat").alias("o_lat"), F.avg("z_lon").alias("o_lon"))
    city = postal.groupBy("city").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    out = found.join(own, "city", "left").join(city, "city", "left")
    source = F.when(F.col("z_lat").isNotNull(), "zip").when(F.col("o_lat").isNotNull(), "sites_of_city").when(F.col("c_lat").isNotNull(), "city")
    return out.select("site", F.coalesce("z_lat", "o_lat", "c_lat").alias("lat"), F.coalesce("z_lon", "o_lon", "c_lon").alias("lon"), source.alias("geo_source"))


def update_from(df: DataFrame, other: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replaces a column by another table's; rows without a match get null."""
    return df.drop(column).join(other.select(*keys, column), keys, "left").select(*df.columns)


def bridge(disposition: DataFrame, transplants: DataFrame, donors: DataFrame, followups: DataFrame) -> DataFrame:
    """Disposition rows with their transplant, donor and latest follow-up."""
    latest = latest_per_key(followups, ["transplant"], ["-followup_ts", "-followup_id"])
    return disposition.join(transplants, ["donor", "candidate"], "left").join(donors, "donor", "left").join(latest, "transplant", "left")


def offers_with_outcome(offers: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return offers.join(outcomes, keys, "left")


def assemble_features(base: DataFrame, families: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of feature families that share the base's keys; equal partitioning is reused between them."""
    for family in families:
        base = base.join(family, keys, "left")
    return base


def mode_feasible(train: DataFrame, runs: DataFrame, rank: str, length: str) -> DataFrame:
    """For each run the most frequent training rank that its length allows, ties to the smallest, else 1.

    The ranks' histogram becomes a best-so-far table by length, so that runs join on equality. Only distinct
    ranks and lengths pass through its one ordered window.
    """
    histogram = train.groupBy(F.col(rank).cast("long").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    lengths = runs.select(F.col(length).cast("long").alias("_r")).distinct()
    w = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    best = (
        histogram.join(lengths, "_r", "full")
        .withColumn("_best", F.max(F.when(F.col("_n").isNotNull(), F.struct("_n", (-F.col("_r")).alias("_neg")))).over(w))
        .select(F.col("_r").alias(length), (-F.col("_best._neg")).alias("predicted_rank"))
    )
    return runs.withColumn(length, F.col(length).cast("long")).join(best, length, "left").withColumn("predicted_rank", F.coalesce("predicted_rank", F.lit(1).cast("long")))
