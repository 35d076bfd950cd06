"""Rollups by day, year and participant; run summaries and organ outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rate
from .joins import exists_before
from .rank import latest_per_key, priority_match


def response_counts(response: str = "response") -> dict[str, Column]:
    is_ = lambda x: F.count_if(F.col(response) == x)
    return {"n_rows": F.count(F.lit(1)), "n_accept": is_("Y"), "n_decline": is_("N"), "n_provisional": is_("Z"), "n_bypass": is_("B")}


def response_rollup(offers: DataFrame, by: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """Counts of responses, and the share of positive ones (accept or provisional) among those given."""
    positive = F.count_if(F.col("response").isin("Y", "Z"))
    given = F.nullif(F.count("response"), F.lit(0))
    aggs = response_counts() | {"positive_rate": F.round(positive.cast("double") / given, 6)} | (extra or {})
    return offers.groupBy(*(c.alias(n) for n, c in by.items())).agg(*(c.alias(n) for n, c in aggs.items()))


def daily_responses(offers: DataFrame, ts: str) -> DataFrame:
    return response_rollup(offers, {"day": F.to_date(ts)})


def yearly_responses(offers: DataFrame, year: str, score: str) -> DataFrame:
    return response_rollup(offers, {"year": F.col(year)}, {"mean_score": F.round(F.avg(score), 6), "n_runs": F.countDistinct("run_id")})


def participant_year(offers: DataFrame, who: str, year: str, distinct: list[str], means: list[str]) -> DataFrame:
    """Per participant and year: response counts, accept rate among answers, distinct partners, means of measures."""
    yes, no = F.count_if(F.col("response") == "Y"), F.count_if(F.col("response") == "N")
    return offers.filter(F.col(who).isNotNull()).groupBy(who, year).agg(
        *(c.alias(n) for n, c in response_counts().items()), rate(yes, no).alias("accept_rate"),
        *(F.countDistinct(d).alias(f"n_{d}") for d in distinct), *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means),
    )


def center_outcomes(outcomes: DataFrame, center: str, ts: str, means: list[str]) -> DataFrame:
    """Transplants of a center and year with means of measures."""
    return outcomes.filter(F.col(center).isNotNull()).groupBy(center, F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("n_transplants"), *(F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means)
    )


def score_bin_counts(donors: DataFrame, org: str, ts: str, bin_: str, bins: list[str]) -> DataFrame:
    """Donors of an organisation and year in each score bin."""
    return donors.filter(F.col(org).isNotNull()).groupBy(org, F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("n_donors"), *(F.count_if(F.col(bin_) == b).alias(f"n_bin_{b.replace('-', '_')}") for b in bins)
    )


def organ_outcomes(placed: DataFrame, offers: DataFrame, order: list[str]) -> DataFrame:
    """Each placed organ (organ_id, run_id, candidate, placed_ts) with the offer row it came from, and whether a
    qualifying bypass stood before that row.

    The latest record of an organ counts; the candidate's accepted row goes before any other of its rows.
    """
    organs = latest_per_key(placed, ["organ_id"], ["-placed_ts", "candidate"])
    flagged = exists_before(offers, "run_id", order, F.col("response") == "B", "bypassed_before")
    priority = F.when(F.col("response") == "Y", 0).when(F.col("response") == "Z", 1).otherwise(2)
    rows = flagged.select("run_id", "candidate", "center", "seq", "offer_rank", "response", "bypassed_before")
    matched = priority_match(organs, rows, ["run_id", "candidate"], "organ_id", priority, ["seq", "offer_rank"])
    return organs.join(matched.select("organ_id", F.col("center").alias("accepted_center"), F.col("seq").alias("accepted_seq"), F.col("offer_rank").alias("accepted_rank"), F.col("bypassed_before").alias("out_of_sequence")), "organ_id", "left")


def run_summary(offers: DataFrame, outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Per run: length, timestamp, organisation, placements, first acceptance, declines before it, accepted sequence and late share."""
    yes = F.col("response") == "Y"
    runs = offers.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_len"), F.max("submit_ts").alias("submit_ts"), F.max("org").alias("org"), F.min(F.when(yes, F.col("offer_rank"))).alias("first_accept_rank"))
    firsts = offers.join(runs.select("run_id", "first_accept_rank"), "run_id").filter("offer_rank < first_accept_rank")
    declines = firsts.groupBy("run_id").agg(F.count_if(F.col("response") == "N").alias("declines"))
    placed = outcomes.join(runs.select("run_id", "run_len"), "run_id").withColumn("share", F.col("accepted_seq").cast("double") / F.col("run_len"))
    of_run = placed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_placed"), F.max("out_of_sequence").alias("out_of_sequence"), F.round(F.avg("accepted_seq"), 6).alias("mean_accepted_seq"),
        F.round(F.avg("share"), 6).alias("mean_accepted_share"), F.round(F.avg(F.when(F.col("share") > 0.5, 1.0).when(F.col("share").isNotNull(), 0.0)), 6).alias("late_rate"),
    )
    out = runs.join(declines, "run_id", "left").join(of_run, "run_id", "left").fillna(0, ["n_placed"])
    return out.withColumns({
        "placed_both": F.when(F.col("n_placed") >= 2, 1).otherwise(0), "placed_any": F.when(F.col("n_placed") >= 1, 1).otherwise(0),
        "wasted_both": F.when(F.col("n_placed") == 0, 1).otherwise(0), "out_of_sequence": F.coalesce("out_of_sequence", F.lit(0)),
        "first_accept_declines": F.when(F.col("first_accept_rank").isNotNull(), F.coalesce("declines", F.lit(0))),
    }).drop("declines")


def history_of(df: DataFrame, column: str, value, order: list) -> DataFrame:
    """All rows of one identifier, in order: a table function over a fact or an outcome view."""
    return df.filter(F.col(column) == value).orderBy(*order)
