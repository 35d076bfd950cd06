"""Leakage-safe history features: counts, means, deviations and rates of strictly earlier events within trailing windows.

``trailing`` gives the sums; here they become features, beside the row's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elapsed_days, rate, truth
from ..sources.tables import fresh
from .rank import carried, placed, running, scanned
from .trailing import Family, Feature, trailing

WINDOWS = (30, 90, 150, 365)


def _counted(measures: dict[str, Column]) -> dict[str, Column]:
    """Whole-number measures with the number of their values."""
    return measures | {f"n_{n}": F.when(c.isNotNull(), 1) for n, c in measures.items()}


def trailing_sums(df: DataFrame, keys: list[str], at: str, value: Column, name: str, windows=WINDOWS) -> DataFrame:
    """Sum of a real measure in each window before each row; zero without events."""
    return trailing(df, keys, at, [Family(moments={"v": value})], {f"{name}_{d}d": Feature("sum", 0, ("v",), d) for d in windows})


def trailing_counts(df: DataFrame, keys: list[str], at: str, condition: Column, name: str, windows=WINDOWS) -> DataFrame:
    return trailing(df, keys, at, [Family(counts={"n": F.when(condition, 1)})], {f"{name}_{d}d": Feature("count", 0, ("n",), d) for d in windows})


def decline_history(df: DataFrame, key: str, at: str, declined: Column, measures: dict[str, Column], shares: dict[str, Column], windows=WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Per window: number of declines, mean and deviation of measures over them, shares of flags among them."""
    family = Family(counts={"declines": F.when(declined, 1)} | _counted({n: F.when(declined, truth(s)) for n, s in shares.items()}), moments={n: F.when(declined, m) for n, m in measures.items()})
    out: dict[str, Feature] = {}
    for d in windows:
        out[f"decline_count_{d}d"] = Feature("count", 0, ("declines",), d)
        for name in measures:
            out[f"declined_{name}_avg_{d}d"] = Feature("mean", 0, (name,), d)
            out[f"declined_{name}_stddev_{d}d"] = Feature("deviation", 0, (name,), d)
        out |= {f"declined_{name}_frac_{d}d": Feature("share", 0, (name, f"n_{name}"), d) for name in shares}
    return trailing(df, [key], at, [family], out, keep=keep)


def last_response(df: DataFrame, key: str, at: str, ts: str, answered: Column, value: str, years_back: int | None = 1) -> DataFrame:
    """Value and days since the last answered row before each row; older calendar years than ``years_back`` do not count."""
    (seen,) = fresh(df, "last")
    answer = F.when(answered, F.struct(F.col(ts).alias("ts"), F.col(value).alias("value")))
    out = scanned(df, [key], [at], {seen: ("last", answer)}, inclusive=False)
    if years_back is not None:
        out = out.withColumn(seen, F.when(F.year(f"{seen}.ts") >= F.year(ts) - years_back, F.col(seen)))
    return out.select(*df.columns, F.col(f"{seen}.value").alias(f"last_answered_{value}"), elapsed_days(F.col(f"{seen}.ts"), F.col(ts)).alias("days_since_answer"))


def prior_decliners(df: DataFrame, run: str, order: list, who: str, declined: Column, name: str = "prior_decliners") -> DataFrame:
    """Distinct decliners before each row of a run: the place of each one's first decline is found, and such places are counted."""
    place, first, mark = fresh(df, "place", "first", "mark")
    rows = placed(df, [run], order, place)
    # places are unique over the whole table, so that first declines meet their rows on them alone
    firsts = rows.filter(declined).groupBy(run, who).agg(F.min(place).alias(first)).select(first)
    marked = rows.join(firsts, F.col(place) == F.col(first), "left").withColumn(mark, F.when(F.col(first).isNotNull(), 1).otherwise(0)).drop(first)
    out = carried(marked, [run], place, {name: ("sum", F.col(mark))}, inclusive=False)
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop(place, mark)


def prior_event_counts(facts: DataFrame, events: DataFrame, key: str, at: str, name: str, windows=WINDOWS) -> DataFrame:
    """Events of another stream (key, at) in the windows before each fact."""
    (mark,) = fresh(facts, "mark")
    both = facts.withColumn(mark, F.lit(0)).unionByName(events.select(key, at, F.lit(1).alias(mark)), allowMissingColumns=True)
    out = trailing(both, [key], at, [Family(counts={"n": F.col(mark)})], {f"{name}_{d}d": Feature("count", 0, ("n",), d) for d in windows})
    return out.filter(F.col(mark) == 0).drop(mark)


def org_history(runs: DataFrame, org: str, at: str, stratum: str, windows=WINDOWS) -> DataFrame:
    """Per window, of earlier runs of an organisation: shares of flags, mean declines and length, placement rate in the same stratum.

    Columns: dcd, placed_any, placed_both, wasted_both, out_of_sequence (0/1), first_accept_declines, run_len. There are
    few organisations with very many runs each; both key sets come from one exchange by organisation and slice.
    """
    flags = ("dcd", "placed_any", "placed_both", "wasted_both", "out_of_sequence")
    means = {f"{n}_frac": truth(F.col(n)) for n in flags} | {"mean_declines": F.when(F.col("placed_any") == 1, F.col("first_accept_declines")), "mean_run_len": F.col("run_len")}
    families = [Family(counts=_counted(means)), Family([stratum], _counted({"stratum_rate": truth(F.col("placed_any"))}))]
    names = [*(f"{f}_frac" for f in flags), "stratum_rate", "mean_declines", "mean_run_len"]
    return trailing(runs, [org], at, families, {f"org_{n}_{d}d": Feature("share", int(n == "stratum_rate"), (n, f"n_{n}"), d) for d in windows for n in names})


def strata_rate_history(df: DataFrame, keys: list[str], strata: list[str], at: str, positive: Column, negative: Column, name: str, count: bool = True, windows=WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Share of positive responses among all of the same keys, and within the same value of each stratum, in the windows before each row.

    With ``count``, also the number of responses. Rows with a null key or stratum get null there.
    """
    measures = {"pos": F.when(positive, 1), "neg": F.when(negative, 1)}
    families = [Family(counts=measures), *(Family([s], dict(measures)) for s in strata)]
    out = {f"{n}_rate_{d}d": Feature("rate", k, ("pos", "neg"), d) for k, n in enumerate([name, *(f"{name}_same_{s}" for s in strata)]) for d in windows}
    if count:
        out |= {f"{name}_count_{d}d": Feature("total", 0, ("pos", "neg"), d) for d in windows}
    return trailing(df, keys, at, families, out, keep=keep)


def rate_history(df: DataFrame, keys: list[str], at: str, positive: Column, negative: Column, name: str, count: bool = False, windows=WINDOWS) -> DataFrame:
    """The share of positive responses of the same keys, without strata."""
    return strata_rate_history(df, keys, [], at, positive, negative, name, count, windows)


def acceptance_history(df: DataFrame, accepted: DataFrame, keys: list[str], at: str, length: str, sequence: str, asof: bool = False, windows=WINDOWS) -> DataFrame:
    """Per window, of earlier acceptances of the same keys: mean sequence, mean share of the run, share beyond half of it.

    By default a row gets values only if its keys accepted at that very timestamp; with ``asof`` every row does.
    """
    share = F.col(sequence).cast("double") / F.nullif(F.col(length), F.lit(0))
    names = {"seq": "mean_accepted_seq", "share": "mean_accepted_share", "late": "late_rate"}
    events = accepted.filter(F.col(sequence).isNotNull()).dropna(subset=keys)
    events = events.select(*keys, at, F.col(sequence).cast("double").alias("seq"), share.alias("share"), F.when(share > 0.5, 1.0).otherwise(0.0).alias("late"))
    if asof:
        events = events.unionByName(df.dropna(subset=keys).select(*keys, at).distinct(), allowMissingColumns=True)
    found = trailing(events, keys, at, [Family(moments={m: F.col(m) for m in names})], {f"{label}_{d}d": Feature("mean", 0, (m,), d) for d in windows for m, label in names.items()})
    # events of one time have one history
    return df.join(found.drop(*names).dropDuplicates([*keys, at]), [*keys, at], "left")


def prior_success_rate(df: DataFrame, key: str, order: list, success: Column, name: str = "prior_success") -> DataFrame:
    """Share of successes among strictly earlier rows; null for the first. The order tells rows of a key apart."""
    one, good = fresh(df, "one", "good")
    run = running(df.withColumns({one: F.lit(1), good: F.when(success, 1).otherwise(0)}), [key], order, [one, good])
    n = F.col(f"{one}_to") - 1
    return run.select(*df.columns, F.when(n > 0, (F.col(f"{good}_to") - F.col(good)).cast("double") / n).alias(name))


def prior_sum(df: DataFrame, key: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum over the strictly earlier rows of a key; zero before the first."""
    return scanned(df, [key], order, {name: ("sum", value)}, inclusive=False).withColumn(name, F.coalesce(name, F.lit(0)))


def declines_before(df: DataFrame, run: str, order: list, declined: Column, name: str = "declines_before") -> DataFrame:
    return prior_sum(df, run, order, F.when(declined, 1).otherwise(0), name)
