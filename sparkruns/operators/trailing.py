"""Sums and moments of strictly earlier events within trailing windows, exact and for keys of any size.

The rows of a key go to one task, sorted by time, and all windows and strata of
a family of measures come from that one exchange. A key with more rows than a
task should hold is hot, and is cut in time slices whose width divides every
window. A window ``[t - w, t)`` is then the end of one slice, whole slices, and
the beginning of the slice of ``t``: rows go to the task of their key and slice,
and events once more, moved by each window's width, to the slice where that
window's edge passes them. What the whole slices between hold comes as one row
of each key and slice. So a hot key is as many tasks as it has slices, and no
row is joined.

Whole numbers are counted: what the edge has passed is taken off again, which is
exact. Moments (number, sum, squared deviations) are never taken off: those of
the parts are merged, so that nothing before a window touches it. Within a key
that is not cut, the parts are those of two windows' widths of time, one on each
side of the last multiple of the width.

Timestamps are whole microseconds. A row without one has no history and is in
nobody's, and the same holds for a null key, or a null stratum in its family.
Repeated rows count each; rows of one time do not see each other; an empty table
gives an empty result; names of columns are free, as rows travel as one struct.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import MICROS_PER_DAY
from ..sources.tables import scratch

#: Rows of a key beyond which it is cut in slices.
HOT_ROWS = 1 << 17
#: Rows that a task takes at once, whole groups at least.
ROWS_AT_ONCE = 1 << 16


@dataclass
class Family:
    """Measures over the events of the same keys and the same ``within`` columns.

    ``counts`` are whole numbers that are summed; ``moments`` are real numbers, of which nulls are left out.
    """

    within: list[str] = field(default_factory=list)
    counts: dict[str, Column] = field(default_factory=dict)
    moments: dict[str, Column] = field(default_factory=dict)


def _rounded_share(part: np.ndarray, other: np.ndarray) -> np.ndarray:
    """As ``functions.columns.rate``: rounded to six digits on the scaled number, ties going up."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x = part / (part + other) * 1e6
        return (np.floor(x) + (x - np.floor(x) >= 0.5)) / 1e6


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return a / b


#: What becomes of measures: counts as they are, their sum, one by another, the share of the first among both; of
#: moments the number, the sum, the mean, the sample deviation. What would divide by zero is null.
KINDS = {
    "count": lambda a: a,
    "total": lambda a, b: a + b,
    "share": lambda a, n: np.where(n > 0, _quotient(a, n), np.nan),
    "rate": _rounded_share,
    "values": lambda m: m[0],
    "sum": lambda m: m[1],
    "mean": lambda m: np.where(m[0] > 0, _quotient(m[1], m[0]), np.nan),
    "deviation": lambda m: np.where(m[0] > 1, np.sqrt(_quotient(m[2], m[0] - 1)), np.nan),
}
_WHOLE = ("count", "total", "values")


@dataclass
class Feature:
    """A column of the result: a kind of ``KINDS`` of a family's measures in the window of so many days."""

    kind: str
    family: int
    measures: tuple[str, ...]
    days: int


_MOMENTS = "struct<n:bigint,s:double,d:double>"


def _moments(x: Column) -> Column:
    n, s, v = F.count(x), F.sum(x), F.var_pop(x)
    return F.struct(n.alias("n"), F.coalesce(s, F.lit(0.0)).alias("s"), F.coalesce(v * n, F.lit(0.0)).alias("d"))


def _merged_list(parts: Column) -> Column:
    """Moments of a list of disjoint parts: deviations from the parts' means, and of those from the common one."""
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    s = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["s"])
    total = F.struct(n.alias("n"), s.alias("s"))
    apart = lambda t: lambda a, p: a + F.when(p["n"] > 0, p["d"] + p["n"] * F.pow(p["s"] / p["n"] - t["s"] / t["n"], 2)).otherwise(F.lit(0.0))
    return F.transform(F.array(total), lambda t: F.struct(t["n"].alias("n"), t["s"].alias("s"), F.aggregate(parts, F.lit(0.0), apart(t)).alias("d")))[0]


def _whole_slices(fine: DataFrame, by: list[str], families: list[Family], strata: dict[str, str], counts: list, moments: list, same: dict[int, int], steps: list[int], width: int) -> list[DataFrame]:
    """For each family (tag -1, -2, ...) a row of each key, stratum and slice: sums over the whole slices of each window before it.

    Sums hold the slice that the edge passes too, as that is taken off row by row; moments do not.
    """
    out = []
    for k, f in enumerate(families):
        own = [strata[c] for c in f.within]
        mine = [same[i] for i, (g, _, _) in enumerate(counts) if g is f]
        real = [i for i, (g, _, _) in enumerate(moments) if g is f]
        table = fine
        if set(own) != set(strata.values()):
            table = fine.groupBy(*by, *own, "slice").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in sorted(set(mine))), *(_merged_list(F.collect_list(f"m{i}")).alias(f"m{i}") for i in real))
        span = Window.partitionBy(*by, *own).orderBy("slice")
        before = lambda c, last, span=span: F.coalesce(F.sum(c).over(span.rangeBetween(Window.unboundedPreceding, last)), F.lit(0))
        whole = [before(f"c{i}", -1) - before(f"c{i}", -s - 1) for s in steps for i in mine]
        none = F.expr("named_struct('n', 0L, 's', 0D, 'd', 0D)")
        between = [_merged_list(F.collect_list(f"m{i}").over(span.rangeBetween(1 - s, -1))) if s > 1 else none for s in steps for i in real]
        out.append(table.select(
            *by, *own, "slice", (F.col("slice") * width - 1).alias("pos"), F.lit(-1 - k).alias("tag"),
            F.array(*whole).cast("array<bigint>").alias("whole"), F.array(*between).cast(f"array<{_MOMENTS}>").alias("between"),
        ))
    return out


# within a task


def _merge(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    apart = np.where((a[0] > 0) & (b[0] > 0), b[1] / np.maximum(b[0], 1) - a[1] / np.maximum(a[0], 1), 0.0)
    return n, a[1] + b[1], a[2] + b[2] + apart * apart * a[0] * b[0] / some


def _scan(of: np.ndarray, x: np.ndarray) -> tuple:
    """Moments of each run of equal ``of`` up to each row, in rounds that double the rows covered; NaN is no value."""
    there = ~np.isnan(x)
    state = (there.astype(np.int64), np.where(there, x, 0.0), np.zeros(len(x)))
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    longest = int(np.diff(np.append(first, len(of))).max(initial=0))
    step = 1
    while step < longest:
        same = of[step:] == of[:-step]
        more = _merge(tuple(s[:-step] for s in state), tuple(s[step:] for s in state))
        state = tuple(np.append(s[:step], np.where(same, m, s[step:])) for s, m in zip(state, more, strict=True))
        step *= 2
    return state


def _scan_back(of: np.ndarray, x: np.ndarray) -> tuple:
    return tuple(s[::-1] for s in _scan(of[::-1], x[::-1]))


def _at(state: tuple, index: np.ndarray, there: np.ndarray) -> tuple:
    index = np.where(there, index, 0)
    return tuple(np.where(there, s[index], s.dtype.type(0)) if len(s) else np.zeros(len(index), s.dtype) for s in state)


class _Group:
    """Whole groups of a task (rows in order of group and time), hot ones or others."""

    def __init__(self, group: np.ndarray, table: pa.Table, hot: bool):
        self.group, self.table, self.hot = group, table, hot
        self.pos = table.column("pos").to_numpy()
        self.tag = table.column("tag").to_numpy()
        self.own = np.flatnonzero(self.tag == 0)

    def column(self, name: str, missing) -> np.ndarray:
        c = self.table.column(name)
        return c.fill_null(missing).to_numpy() if missing == missing else np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float)

    def measure(self, k: int, within: list[str], counts: list[str], moments: list[str], windows: list[int]) -> tuple[list, list]:
        """Per window: sums of ``counts``, and moments of ``moments``, for each row of tag 0 in the order of the group."""
        codes = [np.asarray(self.table.column(x).combine_chunks().dictionary_encode(null_encoding="encode").indices) for x in within]
        order = np.lexsort((self.pos, *codes, self.group)) if codes else np.arange(len(self.pos))
        apart = np.zeros(len(order), bool)
        apart[:1] = True
        for c in (self.group, *codes):
            c = c[order]
            apart[1:] |= c[1:] != c[:-1]
        seg = np.cumsum(apart) - 1
        tag, pos = self.tag[order], self.pos[order]
        mine = tag == 0
        rows, seg_own, t = order[mine], seg[mine], pos[mine]
        n = len(rows)
        if not n:
            return [[np.zeros(0, np.int64)] * len(counts)] * len(windows), [[(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(moments)] * len(windows)
        new_seg = np.append(True, seg_own[1:] != seg_own[:-1])
        new_time = new_seg | np.append(True, t[1:] != t[:-1])
        first = np.maximum.accumulate(np.where(new_time, np.arange(n), 0))  # of the rows of one time
        seg_first = np.maximum.accumulate(np.where(new_seg, np.arange(n), 0))
        back = np.empty(n, np.int64)  # to the order of the group
        back[np.searchsorted(self.own, rows)] = np.arange(n)
        values = {c: self.column(c, 0)[order] for c in counts} | {m: self.column(m, np.nan)[order] for m in moments}
        sums = {c: np.append(0, np.cumsum(values[c][mine])) for c in counts}
        base = np.full(int(seg[-1]) + 1, -1)
        if self.hot:
            for_all = order[tag == -1 - k]
            base[seg[tag == -1 - k]] = np.arange(len(for_all))
            whole = np.asarray(self.table.column("whole").combine_chunks().take(pa.array(for_all)).flatten()).reshape(len(for_all), -1)
            between = self.table.column("between").combine_chunks().take(pa.array(for_all)).flatten()
            between = [np.asarray(between.field(i)).reshape(len(for_all), -1) for i in range(3)]
        known = base[seg_own]
        counted, measured = [], []
        for j, w in enumerate(windows):
            edge = tag == j + 1 if self.hot else mine
            seg_e, pos_e = seg[edge], pos[edge] + (0 if self.hot else w)
            times = np.unique(pos_e)
            key = seg_e * (len(times) + 1) + np.searchsorted(times, pos_e)
            at = np.searchsorted(key, seg_own * (len(times) + 1) + np.searchsorted(times, t))  # first event that the edge has not passed
            start = np.searchsorted(key, seg_own * (len(times) + 1))
            found = []
            for i, c in enumerate(counts):
                gone = np.append(0, np.cumsum(values[c][edge]))
                x = sums[c][first] - sums[c][seg_first] - gone[at] + gone[start]
                if self.hot:
                    x = x + np.where(known >= 0, whole[known, j * len(counts) + i], 0)
                found.append(x[back])
            counted.append(found)
            found = []
            # parts on both sides of the last multiple of the width, or of the slice's beginning
            part = np.zeros(n, np.int64) if self.hot else t // w
            part_e = np.zeros(len(pos_e), np.int64) if self.hot else pos_e // w
            of, of_e = np.cumsum(new_seg | np.append(True, part[1:] != part[:-1])), np.cumsum(np.append(True, (seg_e[1:] != seg_e[:-1]) | (part_e[1:] != part_e[:-1]))[: len(seg_e)])
            ahead = np.maximum(first - 1, 0)
            has = (first > 0) & (of[ahead] == of)
            near = np.minimum(at, max(len(seg_e) - 1, 0))
            ends = (at < len(seg_e)) & (seg_e[near] == seg_own) & (part_e[near] == part) if len(seg_e) else np.zeros(n, bool)
            for i, m in enumerate(moments):
                x = _merge(_at(_scan(of, values[m][mine]), ahead, has), _at(_scan_back(of_e, values[m][edge]), near, ends))
                if self.hot:
                    x = _merge(x, tuple(np.where(known >= 0, b[known, j * len(moments) + i], 0) for b in between))
                found.append(tuple(v[back] for v in x))
            measured.append(found)
        return counted, measured


def _task(by: list[str], families: list[tuple[list[str], dict[str, str], dict[str, str]]], features: list[Feature], windows: list[int], days: list[int], schema: pa.Schema):
    def judged(table: pa.Table, group: np.ndarray) -> pa.Table:
        g = _Group(group, table, bool(table.column("hot")[0].as_py()))
        own = table.take(pa.array(g.own))
        known = ~np.asarray(reduce(lambda a, c: pa.compute.or_(a, c), (own.column(b).is_null() for b in [*by, "at"])))
        found: dict = {}
        there = []
        for k, (within, counts, moments) in enumerate(families):
            counted, measured = g.measure(k, within, list(counts.values()), list(moments.values()), windows)
            there.append(reduce(lambda a, b: a & b, (~np.asarray(own.column(x).is_null()) for x in within), known))
            for j, d in enumerate(days):
                found |= {(k, m, d): x for m, x in zip(counts, counted[j], strict=True)} | {(k, m, d): x for m, x in zip(moments, measured[j], strict=True)}
        arrays = own.column("row").combine_chunks().flatten()
        for f in features:
            x = KINDS[f.kind](*(found[f.family, m, f.days] for m in f.measures))
            arrays.append(pa.array(x, mask=~there[f.family] if f.kind in _WHOLE else ~there[f.family] | np.isnan(x)))
        return pa.table(arrays, schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            apart = np.zeros(len(table), bool)
            apart[:1] = True
            for b in [*by, "slice"]:
                code = np.asarray(table.column(b).combine_chunks().dictionary_encode(null_encoding="encode").indices)
                apart[1:] |= code[1:] != code[:-1]
            cut = len(table) if last else int(np.flatnonzero(apart)[-1])
            group = np.cumsum(apart)
            hot = np.asarray(table.column("hot"))[:cut]
            out = []
            for which in (np.flatnonzero(hot), np.flatnonzero(~hot)):
                if len(which):
                    out.append(judged(table.take(pa.array(which)), group[which]))
            return out, table.slice(cut)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_AT_ONCE:
                out, rest = flush(False)
                for t in out:
                    yield from t.to_batches()
                # a group that fills all that is held waits for twice as much
                size = 0 if out else -size
                held = rest.to_batches()
        if held:
            for t in flush(True)[0]:
                yield from t.to_batches()

    return run


def trailing(df: DataFrame, keys: list[str], at: str, families: list[Family], features: dict[str, Feature], slice_days: int | None = None, hot_rows: int = HOT_ROWS, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with features of earlier events in the windows before each row.

    Keys of more than ``hot_rows`` rows are cut in slices of ``slice_days``, which must divide every window; by default
    that is the widest such number up to a week.
    """
    windows = sorted({f.days for f in features.values()})
    days = slice_days or max(d for d in range(1, 8) if reduce(gcd, windows) % d == 0)
    if any(w % days for w in windows):
        raise ValueError(f"slices of {days} days do not divide the windows {list(windows)}")
    width, steps = days * MICROS_PER_DAY, [w // days for w in windows]
    by = [f"k{i}" for i in range(len(keys))]
    strata = {c: f"x{i}" for i, c in enumerate(sorted({c for f in families for c in f.within}))}
    counts = [(f, m, c) for f in families for m, c in f.counts.items()]
    # a column that several families measure travels once
    first: dict[int, int] = {}
    same = {i: first.setdefault(id(c), i) for i, (_, _, c) in enumerate(counts)}
    moments = [(f, m, c) for f in families for m, c in f.moments.items()]
    there = F.col(at).isNotNull()
    key_columns = [F.col(k).alias(b) for k, b in zip(keys, by, strict=True)]
    values = [f"c{i}" for i in sorted(set(same.values()))] + [f"m{i}" for i in range(len(moments))]
    rows = df.select(
        F.struct(*(keep or df.columns)).alias("row"), *key_columns, *(F.col(c).alias(s) for c, s in strata.items()), F.col(at).cast("long").alias("at"),
        *(F.when(there, F.coalesce(c.cast("long"), F.lit(0))).otherwise(0).alias(f"c{i}") for i, (_, _, c) in enumerate(counts) if same[i] == i), *(F.when(there, c.cast("double")).alias(f"m{i}") for i, (_, _, c) in enumerate(moments)),
    )
    full = reduce(lambda a, b: a & b, (F.col(b).isNotNull() for b in by))
    held = scratch(df.select(*key_columns).filter(full).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select(*by, F.lit(True).alias("hot")), "hot-keys")
    # rows of null keys have no history: they are dealt by anything
    plain = [F.col("at").alias("pos"), F.when(full, F.lit(0)).otherwise(F.pmod(F.xxhash64("at"), F.lit(1 << 16))).cast("long").alias("slice"), F.lit(0).alias("tag"), F.lit(False).alias("hot")]
    # empty, not null: writing many null lists to Arrow takes time with the square of their number
    more = [F.array().cast("array<bigint>").alias("whole"), F.array().cast(f"array<{_MOMENTS}>").alias("between")]
    columns = ["row", *by, *strata.values(), "at", *values]
    if held.isEmpty():
        dealt = rows.select(*columns, *plain, *more)
    else:
        marked = rows.join(held, by, "left")
        light = marked.filter(F.col("hot").isNull()).select(*columns, *plain, *more)
        hot = marked.filter("hot").withColumn("slice", F.expr(f"(at - pmod(at, {width}L)) div {width}L"))
        fine = hot.groupBy(*by, *strata.values(), "slice").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in sorted(set(same.values()))), *(_moments(F.col(f"m{i}")).alias(f"m{i}") for i in range(len(moments))))
        ahead = [t.withColumns({"hot": F.lit(True)}) for t in _whole_slices(fine, by, families, strata, counts, moments, same, steps, width)]
        # each row in its own slice (tag 0), and events moved by window i into the slice of its edge (tag i)
        copy = lambda tag, w, s: F.struct((F.col("at") + w * MICROS_PER_DAY).alias("pos"), (F.col("slice") + s).alias("slice"), F.lit(tag).alias("tag"))
        event = reduce(lambda a, b: a | b, [F.col(f"c{i}") != 0 for i in sorted(set(same.values()))] + [F.col(f"m{i}").isNotNull() for i in range(len(moments))])
        copies = F.when(event, F.array(copy(0, 0, 0), *(copy(i + 1, w, s) for i, (w, s) in enumerate(zip(windows, steps, strict=True))))).otherwise(F.array(copy(0, 0, 0)))
        spread = hot.select(*columns, F.explode(copies).alias("x")).select(F.when(F.col("x.tag") == 0, F.col("row")).alias("row"), *columns[1:], "x.pos", "x.slice", "x.tag", F.lit(True).alias("hot"), *more)
        dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ahead, light.unionByName(spread))
    dealt = dealt.withColumn("pos", F.coalesce("pos", F.lit(0))).repartition(*by, "slice").sortWithinPartitions(*by, "slice", "pos")

    plan = []
    for f in families:
        mine = {m: f"c{same[i]}" for i, (g, m, _) in enumerate(counts) if g is f}
        real = {m: f"m{i}" for i, (g, m, _) in enumerate(moments) if g is f}
        plan.append(([strata[c] for c in f.within], mine, real))
    new = [T.StructField(n, T.LongType() if f.kind in _WHOLE else T.DoubleType()) for n, f in features.items()]
    schema = T.StructType([*(df.select(*keep) if keep else df).schema.fields, *new])
    shape = to_arrow_schema(schema, timestamp_utc=True)
    return dealt.mapInArrow(_task(by, plan, list(features.values()), [w * MICROS_PER_DAY for w in windows], windows, shape), schema)
