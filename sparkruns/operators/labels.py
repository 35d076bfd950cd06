"""Run labels and the supervised tables that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import assign_split, bucketize
from .rank import nth_event

LOCALIZABLE, CENSORED, ORPHAN, NONE = "localizable_observed_y", "censored_positive", "audit_orphan_y", "none"
SUPERVISED = ("train", "validation", "test")


@dataclass(frozen=True)
class LabelConfig:
    """Cut dates and cut points; a column ``response`` holds Y, N, Z or B."""

    history_start: str
    train: str
    validation: str
    test: str
    end: str
    early: float = 0.1
    mid: float = 0.5

    def within(self, ts: str) -> Column:
        return F.col(ts).between(F.lit(self.history_start).cast("timestamp"), F.lit(self.end).cast("timestamp"))


def match_labels(offers: DataFrame, outcomes: DataFrame, config: LabelConfig, placed: Column) -> DataFrame:
    """One row per run: length, acceptances, the first acceptance's keys, link and placement, state and audit reason.

    offers: run_id, submit_ts, run_year, row_order, seq, candidate, response, offer_rank; outcomes: run_id and what ``placed`` reads.
    """
    yes = F.col("response") == "Y"
    first = lambda c: F.min_by(c, F.when(yes & F.col(c).isNotNull(), F.col("offer_rank"))).alias(f"first_y_{c}")
    runs = offers.filter(config.within("submit_ts")).groupBy("run_id").agg(
        F.max("submit_ts").alias("submit_ts"), F.max("run_year").alias("run_year"), F.count(F.lit(1)).alias("run_len"),
        F.count_if(yes).alias("y_rows"), F.max(F.when(yes, 1).otherwise(0)).alias("has_y"),
        first("row_order"), first("seq"), first("candidate"), F.min(F.when(yes, F.col("offer_rank"))).alias("first_y_rank"),
    )
    linked = outcomes.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.lit(1).alias("linked"), F.count_if(placed).alias("placed_count"), F.max(F.when(placed, 1).otherwise(0)).alias("placed_any")
    )
    has, any_ = F.col("has_y") == 1, F.col("placed_any") == 1
    return (
        runs.join(linked, "run_id", "left").fillna(0, ["linked", "placed_count", "placed_any"])
        .withColumns({
            "split": assign_split(F.col("submit_ts"), config.train, config.validation, config.test),
            "first_y_share": F.col("first_y_rank").cast("double") / F.col("run_len"),
            "run_state": F.when(has & any_, LOCALIZABLE).when(~has & any_, CENSORED).when(has, ORPHAN).otherwise(NONE),
            "audit_reason": F.when(has & ~any_ & (F.col("linked") == 0), "missing_saf_link").when(has & ~any_, "non_kidney_only_saf_outcome"),
        })
    )


def audit_runs(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("run_state") == ORPHAN)


def _labelled(offers: DataFrame, labels: DataFrame, states: tuple[str, ...], columns: list[str]) -> DataFrame:
    some = labels.filter(F.col("split").isin(*SUPERVISED) & F.col("run_state").isin(*states))
    return offers.join(some.select("run_id", *columns), "run_id")


def _until_second(offers: DataFrame) -> DataFrame:
    return nth_event(offers, "run_id", F.col("response") == "Y", ["offer_rank", "row_order"], 2).select("run_id", F.col("offer_rank").alias("second_y_rank"))


def loss_rows(offers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answered rows of localizable and empty runs up to the second acceptance, with the target."""
    rows = _labelled(offers.filter(F.col("response").isin("Y", "N")), labels, (LOCALIZABLE, NONE), ["split", "run_state"])
    rows = rows.join(_until_second(offers), "run_id", "left").filter("second_y_rank is null or offer_rank <= second_y_rank")
    return rows.withColumn("target", F.when(F.col("response") == "Y", 1).otherwise(0)).drop("second_y_rank")


def scoring_rows(offers: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of supervised runs; the target is null for unanswered rows, and ``use_for_loss`` marks those of ``loss_rows``."""
    rows = _labelled(offers, labels, (LOCALIZABLE, NONE, CENSORED), ["split", "run_state"]).join(_until_second(offers), "run_id", "left")
    answered = F.col("response").isin("Y", "N")
    early = F.col("second_y_rank").isNull() | (F.col("offer_rank") <= F.col("second_y_rank"))
    return rows.withColumns({
        "target": F.when(F.col("response") == "Y", 1).when(F.col("response") == "N", 0),
        "use_for_loss": F.when(F.col("run_state").isin(LOCALIZABLE, NONE) & answered & early, 1).otherwise(0),
    }).drop("second_y_rank")


def run_rows(offers: DataFrame, labels: DataFrame, features: dict[str, Column], config: LabelConfig) -> DataFrame:
    """One row per supervised run: aggregate features, and the discard, route and timing targets."""
    carried = ["submit_ts", "run_year", "split", "run_state", "run_len", "y_rows", "has_y", "first_y_rank", "first_y_share"]
    base = _labelled(offers.drop("submit_ts", "run_year"), labels, (LOCALIZABLE, NONE, CENSORED), carried)
    out = base.groupBy("run_id").agg(*(F.max(c).alias(c) for c in carried), *(c.alias(n) for n, c in features.items()))
    return out.withColumns({
        "run_len_log": F.log10(F.col("run_len") + 1),
        "discard_target": F.when(F.col("run_state") == NONE, 1).otherwise(0),
        "route_target": F.col("run_state"),
        "timing_target": bucketize(F.col("first_y_share"), [config.early, config.mid], ["early", "mid", "late"]),
    })


def _location(base: DataFrame, config: LabelConfig) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    share = F.col("offer_rank").cast("double") / F.nullif(F.col("run_len"), F.lit(0))
    hit = (F.col("run_state") == LOCALIZABLE) & (F.col("offer_rank") == F.col("first_y_rank"))
    return base.withColumns({
        "rank_share": share, "location_target": F.when(hit, 1).otherwise(0),
        "timing_bucket": F.when(share <= config.early, "early").when(share <= config.mid, "mid").otherwise("late"),
        "rows_in_run": n, "row_weight": 1.0 / n,
    })


def risk_set(offers: DataFrame, labels: DataFrame, config: LabelConfig) -> DataFrame:
    """Rows of localizable runs up to the first acceptance, which is the target; each run weighs one."""
    rows = _labelled(offers, labels, (LOCALIZABLE,), ["split", "run_state", "run_len", "first_y_rank"])
    return _location(rows.filter("offer_rank <= first_y_rank"), config)


def location_rows(offers: DataFrame, labels: DataFrame, config: LabelConfig) -> DataFrame:
    """The same columns for all rows of supervised runs."""
    return _location(_labelled(offers, labels, (LOCALIZABLE, NONE, CENSORED), ["split", "run_state", "run_len", "first_y_rank"]), config)
