"""Run and segment features, segment mass, hazards, and their combination to row probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import segment_number
from .rank import best_row

#: Bounds of the ten segments of a run, as shares of its length.
SEGMENTS = [0.0, 0.01, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0]
TINY = 1e-12


def score_summary(rows: DataFrame, run: str = "run_id", rank: str = "offer_rank", score: str = "score") -> DataFrame:
    """Maximum, mean, head and tail sums, head maxima and the head's mean above the tail's, per run."""
    s, r = F.col(score), F.col(rank)
    head = {f"score_sum_first{k}": F.sum(F.when(r <= k, s).otherwise(0.0)) for k in (10, 25, 50)}
    best = {f"score_top{k}_max": F.max(F.when(r <= k, s)) for k in (10, 25, 50)}
    gap = F.coalesce(F.avg(F.when(r <= 25, s)), F.lit(0.0)) - F.coalesce(F.avg(F.when(r > 50, s)), F.lit(0.0))
    aggs = {"score_max": F.max(s), "score_mean": F.avg(s), **head, "score_sum_tail": F.sum(F.when(r > 50, s).otherwise(0.0)), **best, "score_head_minus_tail": gap}
    return rows.groupBy(run).agg(*(c.alias(n) for n, c in aggs.items()))


def run_features(runs: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
    """Run table with score summaries; missing columns and nulls are zero."""
    joined = runs.join(summary, "run_id", "left")
    return joined.select(*[c for c in joined.columns if c not in columns], *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in joined.columns else F.lit(0.0).alias(c) for c in columns))


def join_scores(rows: DataFrame, row_scores: DataFrame, run_scores: DataFrame) -> DataFrame:
    """Rows with their own and their run's score; rows without one score zero."""
    out = rows.join(row_scores, ["run_id", "offer_rank"], "left").join(run_scores, "run_id", "left")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))


def segment_table(rows: DataFrame, means: list[str], bounds: list[float] = SEGMENTS) -> DataFrame:
    """Per run and segment: share, rank and score aggregates, means of measures, and whether the first acceptance lies in it.

    rows: run_id, split, run_state, run_len, first_y_rank, offer_rank, score and the measures.
    """
    share = F.col("offer_rank").cast("double") / F.col("run_len")
    base = rows.withColumns({"_share": share, "segment": segment_number(share, bounds), "score": F.coalesce("score", F.lit(0.0))})
    spread = lambda c, n: [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.avg(c).alias(f"{n}_mean")]
    out = base.groupBy("run_id", "split", "run_state", "run_len", "first_y_rank", "segment").agg(
        *spread("_share", "share"), *spread("offer_rank", "rank"), F.count(F.lit(1)).alias("n_rows"),
        F.sum("score").alias("score_sum"), F.max("score").alias("score_max"), F.avg("score").alias("score_mean"),
        *(F.avg(F.col(m).cast("double")).alias(f"{m}_mean") for m in means),
    )
    inside = (F.col("run_state") == "localizable_observed_y") & F.col("first_y_rank").between(F.col("rank_min"), F.col("rank_max"))
    out = out.withColumn("segment_target", F.when(inside, 1).otherwise(0))
    return out.withColumn("true_segment", F.max(F.when(F.col("segment_target") == 1, F.col("segment"))).over(Window.partitionBy("run_id")))


def mass_profile(segments: DataFrame, keys: list[str] = ["split", "run_id"]) -> DataFrame:  # noqa: B006
    """Each segment's share of its run's score (of its rows where the score is nil), and the shares before and after it."""
    run = Window.partitionBy(*keys)
    total, n = F.sum("score_sum").over(run), F.sum("n_rows").over(run)
    mass = F.when(F.abs(total) > TINY, F.col("score_sum") / total).otherwise(F.col("n_rows") / F.greatest(n, F.lit(1)))
    out = segments.withColumn("mass", mass)
    before = F.sum("mass").over(run.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - F.col("mass")
    out = out.withColumn("mass_before", F.greatest(before, F.lit(0.0)))
    return out.withColumn("mass_after", F.greatest(1.0 - F.col("mass_before") - F.col("mass"), F.lit(0.0)))


def segment_training(segments: DataFrame, bounds: list[float] = SEGMENTS) -> DataFrame:
    """Segments up to the true one, each run weighing one, with the segment's bounds."""
    kept = mass_profile(segments).filter("true_segment is not null and segment <= true_segment")
    edges = F.array(*(F.lit(b) for b in bounds))
    n = F.count(F.lit(1)).over(Window.partitionBy("split", "run_id"))
    return kept.withColumns({"sample_weight": 1.0 / n, "segment_lower": F.element_at(edges, F.col("segment")), "segment_upper": F.element_at(edges, F.col("segment") + 1)})


def hazard_to_mass(segments: DataFrame, hazard: str, keys: list[str] = ["run_id"]) -> DataFrame:  # noqa: B006
    """Discrete hazards as normalised event mass and survival; runs without mass are uniform."""
    h = F.least(F.greatest(F.coalesce(F.nanvl(F.col(hazard), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1 - 1e-6))
    run = Window.partitionBy(*keys)
    log = F.log1p(-h)
    before = F.coalesce(F.sum(log).over(run.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = segments.withColumns({"_mass": F.exp(before) * h, "survival": F.exp(F.sum(log).over(run))})
    total = F.sum("_mass").over(run)
    return out.withColumn("segment_probability", F.when(total <= TINY, 1.0 / F.count(F.lit(1)).over(run)).otherwise(F.col("_mass") / total)).drop("_mass")


def final_rows(rows: DataFrame, threshold: float = 0.5, renormalize: bool = False) -> DataFrame:
    """Probability of each row to be the first acceptance: its segment's mass by its share of the segment's score.

    rows: run_id, offer_rank, score, segment, segment_probability, discard_probability. Runs at or above the threshold
    are discarded and get zero. ``renormalize`` makes the mass of the segments that have rows one.
    """
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) if renormalize else F.coalesce("score", F.lit(0.0))
    part = Window.partitionBy("run_id", "segment")
    out = rows.withColumns({"_score": score, "decision": F.when(F.col("discard_probability") >= threshold, "discard").otherwise("localize"), "_p": F.coalesce("segment_probability", F.lit(0.0))})
    if renormalize:
        first = F.row_number().over(part.orderBy("offer_rank")) == 1
        run = Window.partitionBy("run_id")
        out = out.withColumn("_one", F.when(first, 1.0).otherwise(0.0)).withColumn("_p", F.greatest("_p", F.lit(0.0)))
        mass, n = F.sum(F.col("_one") * F.col("_p")).over(run), F.sum("_one").over(run)
        out = out.withColumn("_p", F.when(mass <= TINY, 1.0 / n).otherwise(F.col("_p") / mass)).drop("_one")
    total, n = F.sum("_score").over(part), F.count(F.lit(1)).over(part)
    share = F.when(total > TINY, F.col("_score") / total).otherwise(1.0 / n)
    live = (F.col("decision") == "localize") & (F.col("_p") > 0)
    return out.withColumn("row_probability", F.when(live, F.col("_p") * share).otherwise(F.lit(0.0))).drop("_score", "_p")


def run_predictions(final: DataFrame) -> DataFrame:
    """Decision and most probable row of each run; discarded runs have none."""
    modal = best_row(final, "run_id", "row_probability", "offer_rank")
    return modal.select("run_id", "decision", F.when(F.col("decision") == "localize", F.col("offer_rank")).alias("predicted_rank"), F.col("row_probability").alias("modal_probability"))
