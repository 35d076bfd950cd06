"""Column expressions: flags, buckets, rates, calendar parts, text keys. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
#: Mean year of the Gregorian calendar in seconds.
SECONDS_PER_YEAR = 31_556_952
EARTH_RADIUS_NM = 3440.065


def flag(of: Column, condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not, null where ``of`` is null."""
    return F.when(of.isNull(), F.lit(None).cast("int")).when(condition, F.lit(1)).otherwise(F.lit(0))


def truth(of: Column) -> Column:
    """A 0/1 flag as 0.0/1.0; any other value is null."""
    return F.when(of == 1, F.lit(1.0)).when(of == 0, F.lit(0.0))


def bucketize(value: Column, bounds: list[float], labels: list[str], lower: float | None = None) -> Column:
    """Right-closed buckets: the first label whose bound is not below the value; null beyond the last, or under ``lower``."""
    if len(labels) == len(bounds) + 1:
        out = F.when(value > bounds[-1], F.lit(labels[-1]))
    else:
        out = F.when(value > bounds[-1], F.lit(None).cast("string"))
    if lower is not None:
        out = out.when(value < lower, F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(value <= bound, F.lit(label))
    return out


def segment_number(value: Column, bounds: list[float]) -> Column:
    """Number of the right-closed interval between consecutive bounds, from 1; the first takes all below, the last all above."""
    inner = bounds[1:-1]
    number = F.lit(1)
    for b in inner:
        number = number + F.when(value > b, 1).otherwise(0)
    return F.when(value.isNotNull(), number).cast("int")


def round6(value: Column) -> Column:
    """Six digits; a tie that sums in another order would miss by their last bit still goes up."""
    return F.round(value + F.lit(1e-9), 6)


def rate(positive: Column, negative: Column, digits: int = 6) -> Column:
    """positive / (positive + negative), rounded on the scaled number, so that decimal ties go up; null if both are zero or either is null."""
    share = positive.cast("double") / F.nullif(positive + negative, F.lit(0))
    return F.round(share * F.lit(10.0**digits)) / F.lit(10.0**digits)


def component_sum(*parts: Column) -> Column:
    """Sum with nulls as zero."""
    total = F.coalesce(parts[0], F.lit(0))
    for p in parts[1:]:
        total = total + F.coalesce(p, F.lit(0))
    return total


def whole_bucket(total: Column, least: int, most: int) -> Column:
    """A whole number as text if it lies between the bounds, else null."""
    return F.when(total.between(least, most), total.cast("int").cast("string"))


def assign_split(ts: Column, train: str, validation: str, test: str) -> Column:
    """Period of a timestamp by three cut dates."""
    at = lambda d: F.lit(d).cast("timestamp")
    return F.when(ts < at(train), "history").when(ts < at(validation), "train").when(ts < at(test), "validation").when(ts.isNotNull(), "test").otherwise("train")


def row_id(*keys: Column) -> Column:
    """Stable 64-bit identifier; nulls count as a value of their own."""
    return F.xxhash64(*(F.coalesce(k.cast("string"), F.lit("\x00null")) for k in keys))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def iso_weekday(ts: Column) -> Column:
    return (F.weekday(ts) + 1).cast("int")


def week_of_month(ts: Column) -> Column:
    return (F.lit(1) + F.floor((F.dayofmonth(ts) - 1) / 7)).cast("int")


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Days between two timestamps from whole seconds, to six digits."""
    return F.round((F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))) / F.lit(86400.0), 6)


def age_at(base_years: Column, base_ts: Column, ts: Column) -> Column:
    """Age at ``ts`` of one who was ``base_years`` old at ``base_ts``; never younger than then, null if any is null."""
    seconds = F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(base_ts.cast("timestamp"))
    later = F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0)))
    return F.round(base_years + later / F.lit(float(SECONDS_PER_YEAR)), 6)


def five_digits(code: Column) -> Column:
    """The first five-digit run; the placeholder 99999 and its absence are null."""
    return F.nullif(F.nullif(F.regexp_extract(code, r"(\d{5})", 1), F.lit("")), F.lit("99999"))


def place_key(name: Column) -> Column:
    """Comparable form of a place name: upper case, no punctuation, spelled-out abbreviations, single spaces."""
    key = F.regexp_replace(F.upper(name), r"[^A-Z0-9 ]", " ")
    for short, full in (("ST", "SAINT"), ("FT", "FORT"), ("MT", "MOUNT")):
        key = F.regexp_replace(key, rf"\b{short}\b", full)
    return F.nullif(F.trim(F.regexp_replace(key, r"\s+", " ")), F.lit(""))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_NM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def number_text(value: Column) -> Column:
    """A number as text, without a fraction where it has none."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
