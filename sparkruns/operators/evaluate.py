"""Evaluation tables: exact ranking metrics, hit rates, calibration, confusion, recall at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import running, top_rows

TOLERANCES = (0, 1, 5, 10, 25, 50)


def split_balance(rows: DataFrame, split: str, target: str) -> DataFrame:
    return rows.groupBy(split).agg(F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("positives"), F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).alias("negatives"))


def hit_rates(df: DataFrame, keys: list[str], predicted: str, true: str, tolerances=TOLERANCES) -> DataFrame:
    """Share of predictions within each tolerance; no prediction is a miss."""
    hit = lambda d: F.when(F.abs(F.col(predicted) - F.col(true)) <= d, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(hit(d)), 6).alias(f"hit_{d}") for d in tolerances))


def _ranked(df: DataFrame, keys: list[str], target: str, score: str) -> DataFrame:
    """Per key: numbers of positives and negatives, squared errors, pairs won, and summed precisions.

    Rows are first summed by distinct score, and running sums walk the scores in ranges.
    """
    y = F.col(target)
    by_score = df.groupBy(*keys, score).agg(F.sum(y).cast("double").alias("p"), F.sum(1 - y).cast("double").alias("q"), F.sum((F.col(score) - y) * (F.col(score) - y)).alias("e"))
    run = running(by_score, keys, [f"-{score}"], ["p", "q"]).withColumnsRenamed({"p_to": "tp", "q_to": "fp"})
    # a positive beats the negatives below its score and ties with half of those at it
    run = run.withColumn("below", F.col("q_all") - F.col("fp"))
    return run.groupBy(*keys).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("e").alias("e"),
        F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("wins"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
    )


def average_precision(df: DataFrame, keys: list[str], target: str, score: str) -> DataFrame:
    """(keys, average_precision): exact, unrounded; null without a positive. Ties are one step."""
    return _ranked(df, keys, target, score).select(*keys, F.when(F.col("n_pos") > 0, F.col("ap") / F.col("n_pos")).alias("average_precision"))


def binary_metrics(df: DataFrame, keys: list[str], target: str, score: str) -> DataFrame:
    """Brier score, and exact ROC-AUC (ties count half) and average precision; null where one class is missing."""
    out = _ranked(df, keys, target, score)
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *keys, (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"), F.round(F.col("e") / (F.col("n_pos") + F.col("n_neg")), 6).alias("brier"),
        F.when(both, F.round(F.col("wins") / (F.col("n_pos") * F.col("n_neg")), 6)).alias("roc_auc"), F.when(both, F.round(F.col("ap") / F.col("n_pos"), 6)).alias("average_precision"),
    )


def shares(df: DataFrame, keys: list[str], of: str) -> DataFrame:
    """Counts of a column's values and their share within the keys."""
    n = df.groupBy(*keys, of).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 6))


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, n, q): exact quantiles, interpolated between neighbours; only the rows around each place are kept."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = running(n, keys, [value], ["n"])
    out = []
    for i, s in enumerate(shares):
        at = F.lit(s) * (F.col("n_all") - 1)
        inside = lambda p: (F.col("n_to") > p) & (F.col("n_to") - F.col("n") <= p)
        low, high = F.floor(at), F.ceil(at)
        out += [F.max(F.when(inside(low), F.col(value))).alias(f"l{i}"), F.max(F.when(inside(high), F.col(value))).alias(f"h{i}")]
    found = run.groupBy(*keys).agg(F.max("n_all").alias("n"), *out)
    exact = lambda i, s: F.col(f"l{i}") + (F.lit(s) * (F.col("n") - 1) - F.floor(F.lit(s) * (F.col("n") - 1))) * (F.col(f"h{i}") - F.col(f"l{i}"))
    return found.select(*keys, "n", F.array(*(exact(i, s) for i, s in enumerate(shares))).alias("q"))


def score_deciles(df: DataFrame, score: str, target: str) -> DataFrame:
    """Rows, positive rate and score range of each decile; deciles with equal edges are one."""
    edges = order_statistics(df, [], score, [i / 10 for i in range(11)]).select(F.array_distinct("q").alias("edges"))
    rows = df.select(score, target).crossJoin(F.broadcast(edges))  # one row of eleven numbers
    # right-closed intervals between edges, the first closed on both sides
    number = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(score))), F.lit(1))
    return rows.groupBy(number.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 6).alias("positive_rate"), F.min(score).alias("least"), F.max(score).alias("most"))


def rank_histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between the least and the largest value (bin, lower, upper, n); empty bins are kept.

    Bins are closed below, the last on both sides; a single value lies in the middle of a range of one.
    """
    edges = df.agg(F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most")).filter("least is not null")
    flat = F.col("least") == F.col("most")
    edges = edges.select(F.when(flat, F.col("least") - 0.5).otherwise(F.col("least")).alias("least"), F.when(flat, F.col("most") + 0.5).otherwise(F.col("most")).alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    lower = lambda i: F.col("least") + i * width
    grid = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "least", "most").withColumns({"lower": lower(F.col("bin")), "upper": F.when(F.col("bin") == bins - 1, F.col("most")).otherwise(lower(F.col("bin") + 1))})
    x = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(edges))
    n = rows.groupBy(F.least(F.floor((x - F.col("least")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("k").alias("n"))
    return grid.join(n, "bin", "left").select("bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def class_histogram(df: DataFrame, score: str, cls: str, bins: int = 30) -> DataFrame:
    """Equal bins on [0, 1] per class, with the share of the class."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    n = df.groupBy(cls, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(cls)), 6))


def box_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    out = order_statistics(df, keys, value, [0.25, 0.5, 0.75])
    return out.select(*keys, "n", *(F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("lower", "median", "upper"))))


def empirical_cdf(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of a group's rows at or below each distinct value; rows are summed by value before they move."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return running(n, [key], [value], ["n"]).select(key, value, F.round(F.col("n_to") / F.col("n_all"), 6).alias("cdf"))


def state_by_year(df: DataFrame, state: str, year: str, states: list[str]) -> DataFrame:
    return df.groupBy(year).pivot(state, states).agg(F.count(F.lit(1))).fillna(0)


def confusion(df: DataFrame, true: str, predicted: str, labels: list[str]) -> DataFrame:
    """Counts and row shares on the full grid of labels."""
    session = df.sparkSession
    grid = session.createDataFrame([(a, b) for a in labels for b in labels], f"{true} string, {predicted} string")
    n = df.groupBy(true, predicted).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, [true, predicted], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(true))
    return out.withColumn("share", F.when(total > 0, F.round(F.col("n") / total, 6)).otherwise(0.0))


def recall_precision_at(df: DataFrame, run: str, score: str, rank: str, target: str, ks=(1, 3, 5, 10)) -> DataFrame:
    """Mean over all runs: whether the top k hold a positive (recall), and the share of the top k that is positive (precision).

    Runs without a positive count as misses. All k come from one pass over the top rows.
    """
    top = top_rows(df, run, score, rank, max(ks))
    of = lambda k: F.when(F.col(top.columns[-1]) <= k, F.col(target))
    runs = top.groupBy(run).agg(*(F.max(of(k)).alias(f"r{k}") for k in ks), *(F.avg(of(k)).alias(f"p{k}") for k in ks))
    means = runs.agg(*(F.avg(f"{m}{k}").alias(f"{m}{k}") for k in ks for m in "rp"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall"), F.col(f"p{k}").alias("precision")) for k in ks)))
    return means.select(rows.alias("x")).select("x.k", F.round("x.recall", 6).alias("recall"), F.round("x.precision", 6).alias("precision"))


def rate_by_bucket(df: DataFrame, bucket: Column, labels: list[str], hit: Column) -> DataFrame:
    """Share of hits in each bucket; empty buckets are kept."""
    names = df.sparkSession.createDataFrame([(b,) for b in labels], "bucket string")
    n = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("rate"))
    return names.join(n, "bucket", "left").fillna(0, ["n"])


def compare_baselines(df: DataFrame, predictions: dict[str, str], true: str, tolerances=TOLERANCES) -> DataFrame:
    """Hit rates and coverage of several prediction columns, from one pass over the rows."""
    models = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), F.col(c).cast("long").alias("guess")) for n, c in predictions.items())))
    rows = df.select(F.col(true), models.alias("x")).select(true, "x.model", "x.guess")
    hit = lambda d: F.when(F.abs(F.col("guess") - F.col(true)) <= d, 1.0).otherwise(0.0)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *(F.round(F.avg(hit(d)), 6).alias(f"hit_{d}") for d in tolerances),
        F.round(F.avg(F.when(F.col("guess").isNotNull(), 1.0).otherwise(0.0)), 6).alias("coverage"),
    )


def scorecard(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics as rows; missing values are left out."""
    long = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
