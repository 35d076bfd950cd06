"""Queries on history features, freezing, labels, rollups, segments and combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros, round6
from ..operators import freeze as Z
from ..operators import history as H
from ..operators import joins as J
from ..operators import labels as L
from ..operators import rank as R
from ..operators import rollups as U
from ..operators import runs as N
from ..sources.tables import discard, scratch
from .bindings import CONFIG, SCORE_SQL, WITH, WITH_LABELS, labels, offers, outcomes, query, score, table

DAY = 86_400_000_000
WINDOWS = (30, 90, 150, 365)


def _frame(keys: str, at: str, days: int) -> str:
    return f"(PARTITION BY {keys} ORDER BY {at} RANGE BETWEEN {days * DAY} PRECEDING AND 1 PRECEDING)"


def _sorted_offers(spark, sf_dir, key: str):
    """Offers with ties of a key's timestamps spread by a microsecond each."""
    return R.sort_key(offers(spark, sf_dir), [key], "at_us", ["run_id", "offer_rank"])


def _sorted(key: str) -> str:
    return f"{WITH}, s AS (SELECT *, at_us + row_number() OVER (PARTITION BY {key}, at_us ORDER BY run_id, offer_rank) - 1 AS m FROM offers)"


def _rounded(df, columns):
    return df.withColumns({c: round6(F.col(c)) for c in columns})


def _nudged(sql: str) -> str:
    """Rounding as ``round6`` does it."""
    return sql.replace(", 6)", " + 1e-9, 6)")




@query("wn01_trailing_sum", f"{WITH} SELECT run_id, offer_rank, " + ", ".join(f"coalesce(sum(score_points) OVER {_frame('center', 'at_us', d)}, 0)::DOUBLE AS sum_{d}d" for d in WINDOWS) + " FROM offers")
def wn01(spark, sf_dir):
    o = offers(spark, sf_dir).select("run_id", "offer_rank", "center", "at_us", "score_points")
    return H.trailing_sums(o, ["center"], "at_us", F.col("score_points"), "sum").drop("center", "at_us", "score_points")


@query("wn02_prior_rows", f"{WITH} SELECT run_id, offer_rank, coalesce(sum(score_points) OVER (PARTITION BY run_id ORDER BY offer_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM offers")
def wn02(spark, sf_dir):
    o = offers(spark, sf_dir).select("run_id", "offer_rank", "score_points")
    return H.prior_sum(o, "run_id", ["offer_rank"], F.col("score_points"), "before").select("run_id", "offer_rank", F.col("before").cast("double").alias("before"))


def _decline_sql() -> str:
    out = []
    for d in WINDOWS:
        f = _frame("candidate", "m", d)
        out.append(f"count(*) FILTER (response = 'N') OVER {f} AS decline_count_{d}d")
        for name, e in (("score", "score_points"), ("price", "price"), ("tax", "tax")):
            out.append(f"round(avg({e}) FILTER (response = 'N') OVER {f}, 6) AS declined_{name}_avg_{d}d")
            out.append(f"round(stddev_samp({e}) FILTER (response = 'N') OVER {f}, 6) AS declined_{name}_stddev_{d}d")
        out.append(f"round(avg(dcd) FILTER (response = 'N') OVER {f}, 6) AS declined_dcd_frac_{d}d")
    return ", ".join(out)


@query("wn03_decline_history", _nudged(f"{_sorted('candidate')} SELECT run_id, offer_rank, {_decline_sql()} FROM s"))
def wn03(spark, sf_dir):
    """Real-valued measures: prices of five digits and taxes of hundredths beside each other."""
    o = _sorted_offers(spark, sf_dir, "candidate").select("run_id", "offer_rank", "candidate", "sort_micros", "response", "score_points", "price", "tax", "dcd")
    out = H.decline_history(o, "candidate", "sort_micros", F.col("response") == "N", {"score": F.col("score_points"), "price": F.col("price"), "tax": F.col("tax")}, {"dcd": F.col("dcd")})
    new = [c for c in out.columns if c not in o.columns]
    return _rounded(out.select("run_id", "offer_rank", *new), [c for c in new if "count" not in c])


@query("wn04_last_response", f"""{_sorted('candidate')}, l AS (SELECT *, last_value(CASE WHEN response IN ('Y', 'N') THEN submit_ts END IGNORE NULLS) OVER w AS lts, last_value(CASE WHEN response IN ('Y', 'N') THEN band END IGNORE NULLS) OVER w AS lband
 FROM s WINDOW w AS (PARTITION BY candidate ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT run_id, offer_rank, CASE WHEN year(lts) >= run_year - 1 THEN lband END AS last_answered_band, CASE WHEN year(lts) >= run_year - 1 THEN round((epoch_us(submit_ts) - epoch_us(lts)) / 86400000000.0, 6) END AS days_since_answer FROM l""")
def wn04(spark, sf_dir):
    o = scratch(offers(spark, sf_dir).select("run_id", "offer_rank", "candidate", "at_us", "submit_ts", "response", "band"), "offers")
    rows = scratch(R.sort_key(o, ["candidate"], "at_us", ["run_id", "offer_rank"]).drop("at_us"), "sorted")
    discard(o)
    return H.last_response(rows, "candidate", "sort_micros", "submit_ts", F.col("response").isin("Y", "N"), "band").select("run_id", "offer_rank", "last_answered_band", "days_since_answer")


@query("wn05_prior_decliners", f"""{WITH}, f AS (SELECT *, CASE WHEN response = 'N' AND row_number() OVER (PARTITION BY run_id, candidate, response = 'N' ORDER BY offer_rank) = 1 THEN 1 ELSE 0 END AS fresh FROM offers)
SELECT run_id, offer_rank, coalesce(sum(fresh) OVER (PARTITION BY run_id ORDER BY offer_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_decliners FROM f""")
def wn05(spark, sf_dir):
    return H.prior_decliners(offers(spark, sf_dir), "run_id", ["offer_rank"], "candidate", F.col("response") == "N").select("run_id", "offer_rank", "prior_decliners")


@query("wn06_prior_events", "WITH b AS (SELECT event_id, user_id, epoch_us(ts) AS m, 0 AS e FROM events UNION ALL SELECT NULL, user_id, epoch_us(ts), 1 FROM events WHERE event_type = 'purchase'), c AS (SELECT *, " + ", ".join(f"coalesce(sum(e) OVER {_frame('user_id', 'm', d)}, 0)::BIGINT AS purchases_{d}d" for d in (1, 7, 30)) + " FROM b) SELECT event_id, purchases_1d, purchases_7d, purchases_30d FROM c WHERE e = 0")
def wn06(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("m"))
    return H.prior_event_counts(e, e.filter("event_type = 'purchase'"), "user_id", "m", "purchases", windows=(1, 7, 30)).select("event_id", "purchases_1d", "purchases_7d", "purchases_30d")


_OUTCOMES = """placed AS (SELECT organ_id, run_id, candidate, placed_ts FROM (SELECT run_id * 10 + offer_rank % 2 AS organ_id, run_id, candidate, at_us + offer_rank AS placed_ts,
  row_number() OVER (PARTITION BY run_id * 10 + offer_rank % 2 ORDER BY at_us + offer_rank DESC, candidate) AS n FROM offers WHERE status = 'F' AND response <> 'B') WHERE n = 1),
flagged AS (SELECT *, coalesce(max(CASE WHEN response = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY offer_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bypassed FROM offers),
organs AS (SELECT organ_id, run_id, candidate, center AS accepted_center, seq AS accepted_seq, offer_rank AS accepted_rank, bypassed AS out_of_sequence FROM (
  SELECT p.organ_id, f.*, row_number() OVER (PARTITION BY p.organ_id ORDER BY CASE response WHEN 'Y' THEN 0 WHEN 'Z' THEN 1 ELSE 2 END, seq, offer_rank) AS n FROM placed p JOIN flagged f USING (run_id, candidate)) WHERE n = 1)"""

_SUMMARY = f"""{_OUTCOMES}, firsts AS (SELECT run_id, count(*) AS run_len, max(submit_ts) AS submit_ts, max(at_us) AS at_us, max(org) AS org, min(offer_rank) FILTER (response = 'Y') AS first_accept_rank, max(dcd) AS dcd, max(band) AS band FROM offers GROUP BY 1),
declines AS (SELECT o.run_id, count(*) FILTER (response = 'N') AS declines FROM offers o JOIN firsts f ON o.run_id = f.run_id AND o.offer_rank < f.first_accept_rank GROUP BY 1),
of_run AS (SELECT o.run_id, count(*) AS n_placed, max(out_of_sequence) AS out_of_sequence, round(avg(accepted_seq), 6) AS mean_accepted_seq, round(avg(accepted_seq::DOUBLE / run_len), 6) AS mean_accepted_share,
  round(avg(CASE WHEN accepted_seq::DOUBLE / run_len > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS late_rate FROM organs o JOIN firsts USING (run_id) GROUP BY 1),
summary AS (SELECT f.*, coalesce(n_placed, 0) AS n_placed, coalesce(out_of_sequence, 0) AS out_of_sequence, mean_accepted_seq, mean_accepted_share, late_rate,
  CASE WHEN n_placed >= 2 THEN 1 ELSE 0 END AS placed_both, CASE WHEN n_placed >= 1 THEN 1 ELSE 0 END AS placed_any, CASE WHEN n_placed IS NULL THEN 1 ELSE 0 END AS wasted_both,
  CASE WHEN first_accept_rank IS NOT NULL THEN coalesce(declines, 0) END AS first_accept_declines FROM firsts f LEFT JOIN declines USING (run_id) LEFT JOIN of_run USING (run_id))"""


def _by_run(spark, sf_dir, *columns: str):
    """Columns of the offers, written once in buckets of the run: what groups or joins by it shuffles nothing."""
    return scratch(offers(spark, sf_dir).select("run_id", "offer_rank", *columns), "offers", ["run_id"])


#: What placements and summaries of runs read.
_RUN_COLUMNS = ["submit_ts", "at_us", "seq", "candidate", "center", "org", "response", "dcd", "band", "status"]


def _organs(o):
    placed = o.filter("status = 'F' AND response <> 'B'").select((F.col("run_id") * 10 + F.col("offer_rank") % 2).alias("organ_id"), "run_id", "candidate", (F.col("at_us") + F.col("offer_rank")).alias("placed_ts"))
    return U.organ_outcomes(placed, o, ["offer_rank"])


def _summary(o):
    more = o.groupBy("run_id").agg(F.max("at_us").alias("at_us"), F.max("dcd").alias("dcd"), F.max("band").alias("band"))
    return U.run_summary(o, _organs(o), ["offer_rank"]).join(more, "run_id")


@query("ag14_organ_outcomes", f"{WITH}, {_OUTCOMES} SELECT organ_id, run_id, candidate, accepted_center, accepted_seq, accepted_rank, out_of_sequence FROM organs")
def ag14(spark, sf_dir):
    return _organs(_by_run(spark, sf_dir, *_RUN_COLUMNS)).drop("placed_ts")


_SUMMARY_COLUMNS = ["run_id", "run_len", "org", "first_accept_rank", "first_accept_declines", "n_placed", "out_of_sequence", "mean_accepted_seq", "mean_accepted_share", "late_rate", "placed_any", "placed_both", "wasted_both"]


@query("ag13_run_summary", f"{WITH}, {_SUMMARY} SELECT {', '.join(_SUMMARY_COLUMNS)} FROM summary")
def ag13(spark, sf_dir):
    return _summary(_by_run(spark, sf_dir, *_RUN_COLUMNS)).select(*_SUMMARY_COLUMNS)


def _org_sql() -> str:
    out = []
    for d in WINDOWS:
        f = _frame("org", "at_us", d)
        out += [f"round(avg({c}) OVER {f}, 6) AS org_{c}_frac_{d}d" for c in ("dcd", "placed_any", "placed_both", "wasted_both", "out_of_sequence")]
        out.append(f"round(avg(placed_any) OVER {_frame('org, band', 'at_us', d)}, 6) AS org_stratum_rate_{d}d")
        out.append(f"round(avg(first_accept_declines) FILTER (placed_any = 1) OVER {f}, 6) AS org_mean_declines_{d}d")
        out.append(f"round(avg(run_len) OVER {f}, 6) AS org_mean_run_len_{d}d")
    return ", ".join(out)


@query("wn07_org_history", f"{WITH}, {_SUMMARY} SELECT run_id, {_org_sql()} FROM summary")
def wn07(spark, sf_dir):
    o = _by_run(spark, sf_dir, *_RUN_COLUMNS)
    summary = scratch(_summary(o).select("run_id", "org", "at_us", "band", "dcd", "placed_any", "placed_both", "wasted_both", "out_of_sequence", "first_accept_declines", "run_len"), "summary")
    discard(o)
    out = H.org_history(summary, "org", "at_us", "band")
    return out.select("run_id", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("org_")))


def _rate_sql(keys: str, name: str, count: bool) -> str:
    out = []
    for d in WINDOWS:
        f = _frame(keys, "at_us", d)
        y, n = f"count(*) FILTER (response = 'Y') OVER {f}", f"count(*) FILTER (response = 'N') OVER {f}"
        out.append(f"round(({y})::DOUBLE / nullif(({y}) + ({n}), 0), 6) AS {name}_rate_{d}d")
        if count:
            out.append(f"({y}) + ({n}) AS {name}_count_{d}d")
    return ", ".join(out)


_POS = "response = 'Y'"
_NEG = "response = 'N'"


@query("wn08_rate_history", f"{WITH} SELECT run_id, offer_rank, {_rate_sql('org', 'org', True)} FROM offers")
def wn08(spark, sf_dir):
    o = offers(spark, sf_dir).select("run_id", "offer_rank", "org", "at_us", "response")
    out = H.rate_history(o, ["org"], "at_us", F.expr(_POS), F.expr(_NEG), "org", count=True)
    return out.drop(*o.columns[2:])


def _strata_sql(keys: str, name: str) -> str:
    return ", ".join([_rate_sql(keys, name, True), *(_rate_sql(f"{keys}, {s}", f"{name}_same_{s}", False) for s in ("dcd", "high", "band"))])


@query("wn09_center_rates", f"{WITH} SELECT run_id, offer_rank, {_strata_sql('center', 'center')} FROM offers")
def wn09(spark, sf_dir):
    o = offers(spark, sf_dir).select("run_id", "offer_rank", "center", "at_us", "response", "dcd", "high", "band")
    out = H.strata_rate_history(o, ["center"], ["dcd", "high", "band"], "at_us", F.expr(_POS), F.expr(_NEG), "center")
    return out.drop(*o.columns[2:])


@query("wn10_pair_rates", f"{WITH} SELECT run_id, offer_rank, {_strata_sql('org, center', 'pair')} FROM offers")
def wn10(spark, sf_dir):
    o = offers(spark, sf_dir).select("run_id", "offer_rank", "org", "center", "at_us", "response", "dcd", "high", "band")
    out = H.strata_rate_history(o, ["org", "center"], ["dcd", "high", "band"], "at_us", F.expr(_POS), F.expr(_NEG), "pair")
    return out.drop(*o.columns[2:])


def _acceptance_sql() -> str:
    out = []
    for d in WINDOWS:
        f = _frame("center", "at_us", d)
        out += [f"round(avg(accepted_seq) OVER {f}, 6) AS mean_accepted_seq_{d}d", f"round(avg(accepted_seq::DOUBLE / run_len) OVER {f}, 6) AS mean_accepted_share_{d}d", f"round(avg(CASE WHEN accepted_seq::DOUBLE / run_len > 0.5 THEN 1.0 ELSE 0.0 END) OVER {f}, 6) AS late_rate_{d}d"]
    return ", ".join(out)


@query("wn11_acceptance_history", _nudged(f"""{WITH}, {_OUTCOMES}, lens AS (SELECT run_id, count(*) AS run_len, max(at_us) AS at_us FROM offers GROUP BY 1),
acc AS (SELECT accepted_center AS center, accepted_seq, run_len, at_us FROM organs JOIN lens USING (run_id)), h AS (SELECT DISTINCT center, at_us, {_acceptance_sql()} FROM acc)
SELECT o.run_id, o.offer_rank, h.* EXCLUDE (center, at_us) FROM offers o LEFT JOIN h ON o.center = h.center AND o.at_us = h.at_us"""))
def wn11(spark, sf_dir):
    o = _by_run(spark, sf_dir, *_RUN_COLUMNS)
    lens = o.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_len"), F.max("at_us").alias("at_us"))
    acc = scratch(_organs(o).filter("accepted_center is not null").join(lens, "run_id").select(F.col("accepted_center").alias("center"), "accepted_seq", "run_len", "at_us"), "accepted")
    o = o.select("run_id", "offer_rank", "center", "at_us")
    out = H.acceptance_history(o, acc, ["center"], "at_us", "run_len", "accepted_seq")
    return out.select("run_id", "offer_rank", *(round6(F.col(c)).alias(c) for c in out.columns if c.startswith(("mean_", "late_"))))


@query("wn12_prior_success", f"{WITH}, r AS (SELECT run_id, max(org) AS org, max(at_us) AS m, max(status) AS status FROM offers GROUP BY 1), w AS (SELECT *, count(*) OVER f AS n, coalesce(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER f, 0) AS s FROM r WINDOW f AS (PARTITION BY org ORDER BY m, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT run_id, round(s::DOUBLE / nullif(n, 0), 6) AS prior_success FROM w")
def wn12(spark, sf_dir):
    r = offers(spark, sf_dir).groupBy("run_id").agg(F.max("org").alias("org"), F.max("at_us").alias("m"), F.max("status").alias("status"))
    return H.prior_success_rate(r, "org", ["m", "run_id"], F.col("status") == "F").select("run_id", F.round("prior_success", 6).alias("prior_success"))


@query("wn13_declines_before", f"{WITH} SELECT run_id, offer_rank, count(*) FILTER (response = 'N') OVER (PARTITION BY run_id ORDER BY offer_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS declines_before FROM offers")
def wn13(spark, sf_dir):
    return H.declines_before(offers(spark, sf_dir), "run_id", ["offer_rank"], F.col("response") == "N").select("run_id", "offer_rank", "declines_before")


# freezing


@query("ag04_first_keys", f"{WITH} SELECT run_id, candidate, min(offer_rank) AS offer_rank, count(*) AS n_rows FROM offers GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT run_id, -center, min(offer_rank), count(*) FROM offers GROUP BY 1, 2 HAVING count(*) > 1")
def ag04(spark, sf_dir):
    o = offers(spark, sf_dir)
    return Z.first_keys(o, ["run_id", "candidate"], ["offer_rank"]).unionByName(Z.first_keys(o.withColumn("candidate", -F.col("center")), ["run_id", "candidate"], ["offer_rank"]))


@query("wn15_freeze_first", f"{WITH} SELECT run_id, offer_rank, CASE WHEN center % 3 = 0 THEN score_points ELSE first_value(score_points) OVER w END AS score_points, CASE WHEN center % 3 = 0 THEN discount ELSE first_value(discount) OVER w END AS discount FROM offers WINDOW w AS (PARTITION BY run_id, CASE WHEN center % 3 = 0 THEN NULL ELSE center END ORDER BY offer_rank)")
def wn15(spark, sf_dir):
    o = offers(spark, sf_dir).withColumn("center", F.when(F.col("center") % 3 != 0, F.col("center")))
    return Z.freeze_first(o, ["run_id", "center"], ["offer_rank"], ["score_points", "discount"]).select("run_id", "offer_rank", "score_points", "discount")


@query("wn16_freeze_other_order", f"{WITH} SELECT run_id, offer_rank, first_value(tax) OVER (PARTITION BY run_id ORDER BY score_points DESC, offer_rank) AS tax FROM offers")
def wn16(spark, sf_dir):
    return Z.freeze_first(offers(spark, sf_dir), ["run_id"], ["-score_points", "offer_rank"], ["tax"]).select("run_id", "offer_rank", "tax")


# labels and supervised tables


@query("ag15_match_labels", f"{WITH_LABELS} SELECT * EXCLUDE (submit_ts) FROM labels")
def ag15(spark, sf_dir):
    return labels(spark, sf_dir).drop("submit_ts")


@query("ag01_response_counts", f"{WITH} SELECT status, count(*) AS n_rows, count(*) FILTER (response = 'Y') AS n_accept, count(*) FILTER (response = 'N') AS n_decline, count(*) FILTER (response = 'Z') AS n_provisional, count(*) FILTER (response = 'B') AS n_bypass FROM offers GROUP BY 1")
def ag01(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("status").agg(*(c.alias(n) for n, c in U.response_counts().items()))


@query("ag02_distinct_counts", f"{WITH} SELECT center, count(DISTINCT run_id) AS n_runs, count(DISTINCT candidate) AS n_candidates FROM offers GROUP BY 1")
def ag02(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("center").agg(F.countDistinct("run_id").alias("n_runs"), F.countDistinct("candidate").alias("n_candidates"))


@query("ag03_value_at_extremum", f"{WITH} SELECT run_id, arg_min(candidate, offer_rank) FILTER (response = 'Y') AS first_candidate, arg_max(center, offer_rank) FILTER (response = 'Y') AS last_center FROM offers GROUP BY 1")
def ag03(spark, sf_dir):
    at = F.when((F.col("response") == "Y"), F.col("offer_rank"))
    return offers(spark, sf_dir).groupBy("run_id").agg(F.min_by("candidate", at).alias("first_candidate"), F.max_by("center", at).alias("last_center"))


_SECOND = "second AS (SELECT run_id, offer_rank AS second FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY offer_rank) AS n FROM offers WHERE response = 'Y') WHERE n = 2)"


@query("st1_loss_rows", f"{WITH_LABELS}, {_SECOND} SELECT run_id, offer_rank, split, run_state, CASE WHEN response = 'Y' THEN 1 ELSE 0 END AS target FROM offers JOIN labels USING (run_id) LEFT JOIN second USING (run_id) WHERE split <> 'history' AND run_state IN ('localizable_observed_y', 'none') AND response IN ('Y', 'N') AND (second IS NULL OR offer_rank <= second)")
def st1(spark, sf_dir):
    return L.loss_rows(offers(spark, sf_dir), labels(spark, sf_dir)).select("run_id", "offer_rank", "split", "run_state", "target")


@query("st2_scoring_rows", f"""{WITH_LABELS}, {_SECOND} SELECT run_id, offer_rank, split, run_state, CASE response WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS target,
 CASE WHEN run_state <> 'censored_positive' AND response IN ('Y', 'N') AND (second IS NULL OR offer_rank <= second) THEN 1 ELSE 0 END AS use_for_loss FROM offers JOIN labels USING (run_id) LEFT JOIN second USING (run_id) WHERE split <> 'history' AND run_state <> 'audit_orphan_y'""")
def st2(spark, sf_dir):
    return L.scoring_rows(offers(spark, sf_dir), labels(spark, sf_dir)).select("run_id", "offer_rank", "split", "run_state", "target", "use_for_loss")


def _features():
    near = lambda a, b: F.count_if(F.col("score_points").between(a, b))
    return {"max_score": F.max("score_points"), "mean_discount": F.round(F.avg("discount"), 6), "frac_center": F.avg(F.when(F.col("center").isNotNull(), 1.0).otherwise(0.0)), "n_low": near(0, 10), "n_mid": near(11, 30), "n_high": near(31, 50), "n_dcd": F.count_if(F.col("dcd") == 1)}


_RUN_SQL = """SELECT run_id, max(labels.run_year) AS run_year, max(split) AS split, max(run_state) AS run_state, max(run_len) AS run_len, max(first_y_rank) AS first_y_rank, round(log10(max(run_len) + 1), 6) AS run_len_log,
 max(score_points) AS max_score, round(avg(discount), 6) AS mean_discount, 1.0 AS frac_center, count(*) FILTER (score_points BETWEEN 0 AND 10) AS n_low, count(*) FILTER (score_points BETWEEN 11 AND 30) AS n_mid, count(*) FILTER (score_points BETWEEN 31 AND 50) AS n_high,
 count(*) FILTER (dcd = 1) AS n_dcd, CASE WHEN max(run_state) = 'none' THEN 1 ELSE 0 END AS discard_target, max(run_state) AS route_target,
 CASE WHEN max(first_y_share) <= 0.1 THEN 'early' WHEN max(first_y_share) <= 0.5 THEN 'mid' WHEN max(first_y_share) IS NOT NULL THEN 'late' END AS timing_target
FROM offers JOIN labels USING (run_id) WHERE split <> 'history' AND run_state <> 'audit_orphan_y' GROUP BY run_id"""


@query("st3_run_rows", f"{WITH_LABELS} {_RUN_SQL}")
def st3(spark, sf_dir):
    out = L.run_rows(offers(spark, sf_dir), labels(spark, sf_dir), _features(), CONFIG).withColumn("run_len_log", F.round("run_len_log", 6))
    return out.drop("submit_ts", "y_rows", "has_y", "first_y_share")


@query("ag16_run_features", f"{WITH_LABELS} SELECT run_id, max_score, mean_discount, n_low, n_mid, n_high, run_len_log FROM ({_RUN_SQL})")
def ag16(spark, sf_dir):
    return L.run_rows(offers(spark, sf_dir), labels(spark, sf_dir), _features(), CONFIG).select("run_id", "max_score", "mean_discount", "n_low", "n_mid", "n_high", F.round("run_len_log", 6).alias("run_len_log"))


def _location_sql(where: str) -> str:
    return f"""{WITH_LABELS} SELECT run_id, offer_rank, split, run_state, round(offer_rank::DOUBLE / run_len, 6) AS rank_share, CASE WHEN run_state = 'localizable_observed_y' AND offer_rank = first_y_rank THEN 1 ELSE 0 END AS location_target,
 CASE WHEN offer_rank::DOUBLE / run_len <= 0.1 THEN 'early' WHEN offer_rank::DOUBLE / run_len <= 0.5 THEN 'mid' ELSE 'late' END AS timing_bucket, count(*) OVER (PARTITION BY run_id) AS rows_in_run, round(1.0 / count(*) OVER (PARTITION BY run_id), 6) AS row_weight
FROM offers JOIN labels USING (run_id) WHERE split <> 'history' AND {where}"""


def _location(df):
    return _rounded(df.select("run_id", "offer_rank", "split", "run_state", "rank_share", "location_target", "timing_bucket", "rows_in_run", "row_weight"), ["rank_share", "row_weight"])


@query("st4_risk_set", _nudged(_location_sql("run_state = 'localizable_observed_y' AND offer_rank <= first_y_rank")))
def st4(spark, sf_dir):
    return _location(L.risk_set(offers(spark, sf_dir), labels(spark, sf_dir), CONFIG))


@query("st5_location_rows", _nudged(_location_sql("run_state <> 'audit_orphan_y'")))
def st5(spark, sf_dir):
    return _location(L.location_rows(offers(spark, sf_dir), labels(spark, sf_dir), CONFIG))


@query("wn14_row_weight", f"{WITH} SELECT run_id, offer_rank, count(*) OVER (PARTITION BY run_id) AS n, round(1.0 / count(*) OVER (PARTITION BY run_id), 6) AS weight FROM offers")
def wn14(spark, sf_dir):
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    return offers(spark, sf_dir).select("run_id", "offer_rank", n.alias("n"), F.round(1.0 / n, 6).alias("weight"))


@query("st6_offer_base", f"""{WITH} SELECT run_id, offer_rank, CASE WHEN response = 'Y' THEN 1 ELSE 0 END AS is_positive, CASE WHEN response = 'N' THEN 1 ELSE 0 END AS is_negative, CASE WHEN response IN ('Y', 'N') THEN 1 ELSE 0 END AS is_answered,
 isodow(submit_ts)::INT AS weekday, month(submit_ts)::INT AS month, n_name AS org_name, p_x AS donor_segment FROM offers LEFT JOIN nation ON org = n_nationkey LEFT JOIN (SELECT c_custkey, c_mktsegment AS p_x FROM customer) ON donor = c_custkey""")
def st6(spark, sf_dir):
    from ..functions.columns import iso_weekday

    o = offers(spark, sf_dir)
    is_ = lambda *r: F.when(F.col("response").isin(*r), 1).otherwise(0)
    dims = [(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("org"), F.col("n_name").alias("org_name")), ["org"]), (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("donor"), F.col("c_mktsegment").alias("donor_segment")), ["donor"])]
    base = J.enrich(o, dims)
    return base.select("run_id", "offer_rank", is_("Y").alias("is_positive"), is_("N").alias("is_negative"), is_("Y", "N").alias("is_answered"), iso_weekday(F.col("submit_ts")).alias("weekday"), F.month("submit_ts").alias("month"), "org_name", "donor_segment")


@query("st7_enriched_view", f"{_sorted('candidate')} SELECT run_id, offer_rank, count(*) FILTER (response = 'N') OVER {_frame('candidate', 'm', 365)} AS candidate_declines, coalesce(sum(CASE WHEN response = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY offer_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run_declines FROM s")
def st7(spark, sf_dir):
    """Families on their own keys, joined once by row (JN12)."""
    o = _sorted_offers(spark, sf_dir, "candidate").select("run_id", "offer_rank", "candidate", "sort_micros", "response")
    candidate = H.trailing_counts(o, ["candidate"], "sort_micros", F.col("response") == "N", "candidate_declines", (365,)).select("run_id", "offer_rank", F.col("candidate_declines_365d").alias("candidate_declines"))
    run = H.declines_before(o, "run_id", ["offer_rank"], F.col("response") == "N", "run_declines").select("run_id", "offer_rank", "run_declines")
    return J.assemble_features(o.select("run_id", "offer_rank"), [candidate, run], ["run_id", "offer_rank"])


@query("st8_dimensions", "SELECT s_suppkey AS center, CAST(s_acctbal AS FLOAT)::DOUBLE AS balance, CAST(s_nationkey AS SMALLINT)::INT AS nation FROM supplier")
def st8(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("center"), F.col("s_acctbal").cast("float").cast("double").alias("balance"), F.col("s_nationkey").cast("short").cast("int").alias("nation"))


# rollups

_COUNTS = "count(*) AS n_rows, count(*) FILTER (response = 'Y') AS n_accept, count(*) FILTER (response = 'N') AS n_decline, count(*) FILTER (response = 'Z') AS n_provisional, count(*) FILTER (response = 'B') AS n_bypass"
_POSITIVE = "round(count(*) FILTER (response IN ('Y', 'Z'))::DOUBLE / nullif(count(response), 0), 6) AS positive_rate"


@query("ag05_daily_responses", f"{WITH} SELECT strftime(submit_ts, '%Y-%m-%d') AS day, {_COUNTS}, {_POSITIVE} FROM offers GROUP BY 1")
def ag05(spark, sf_dir):
    return U.daily_responses(offers(spark, sf_dir), "submit_ts").withColumn("day", F.col("day").cast("string"))


@query("ag06_yearly_responses", f"{WITH} SELECT run_year AS year, {_COUNTS}, {_POSITIVE}, round(avg(score_points), 6) AS mean_score, count(DISTINCT run_id) AS n_runs FROM offers GROUP BY 1")
def ag06(spark, sf_dir):
    return U.yearly_responses(offers(spark, sf_dir), "run_year", "score_points")


def _participant(name: str, who: str, distinct: list[str], means: list[str]):
    rate = "round(count(*) FILTER (response = 'Y')::DOUBLE / nullif(count(*) FILTER (response IN ('Y', 'N')), 0), 6) AS accept_rate"
    sql = f"{WITH} SELECT {who}, run_year, {_COUNTS}, {rate}, {', '.join(f'count(DISTINCT {d}) AS n_{d}' for d in distinct)}, {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in means)} FROM offers GROUP BY 1, 2"
    query(name, sql)(lambda spark, sf_dir: U.participant_year(offers(spark, sf_dir), who, "run_year", distinct, means))


_participant("ag07_candidate_year", "candidate", ["run_id", "center"], ["score_points"])
_participant("ag08_donor_year", "donor", ["candidate", "center"], ["score_points", "discount"])
_participant("ag09_org_year", "org", ["run_id", "donor", "candidate"], ["score_points"])
_participant("ag10_center_year", "center", ["run_id", "candidate"], ["score_points", "tax"])


@query("ag11_center_outcomes", f"{WITH} SELECT center, run_year AS year, count(*) AS n_transplants, round(avg(score_points), 6) AS mean_score_points, round(avg(price), 6) AS mean_price FROM offers WHERE response = 'Y' AND status = 'F' GROUP BY 1, 2")
def ag11(spark, sf_dir):
    return U.center_outcomes(offers(spark, sf_dir).filter("response = 'Y' AND status = 'F'"), "center", "submit_ts", ["score_points", "price"])


@query("ag12_score_bins", f"{WITH}, d AS (SELECT donor, org, run_year, CASE WHEN max(score_points) <= 25 THEN '0-25' ELSE '25-50' END AS bin FROM offers GROUP BY donor, org, run_year) SELECT org, run_year AS year, count(*) AS n_donors, count(*) FILTER (bin = '0-25') AS n_bin_0_25, count(*) FILTER (bin = '25-50') AS n_bin_25_50 FROM d GROUP BY 1, 2")
def ag12(spark, sf_dir):
    from ..functions.columns import bucketize

    d = offers(spark, sf_dir).groupBy("donor", "org", "run_year").agg(F.max("submit_ts").alias("ts"), F.max("score_points").alias("s"))
    return U.score_bin_counts(d.withColumn("bin", bucketize(F.col("s"), [25], ["0-25", "25-50"])), "org", "ts", "bin", ["0-25", "25-50"])


# run scores, segments, hazards, combination


@query("ag17_score_summary", f"""{WITH}, s AS (SELECT *, {SCORE_SQL} AS score FROM offers) SELECT run_id, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean,
 {', '.join(f'round(sum(CASE WHEN offer_rank <= {k} THEN score ELSE 0 END), 6) AS score_sum_first{k}' for k in (10, 25, 50))}, round(sum(CASE WHEN offer_rank > 50 THEN score ELSE 0 END), 6) AS score_sum_tail,
 {', '.join(f'round(max(score) FILTER (offer_rank <= {k}), 6) AS score_top{k}_max' for k in (10, 25, 50))}, round(coalesce(avg(score) FILTER (offer_rank <= 25), 0) - coalesce(avg(score) FILTER (offer_rank > 50), 0), 6) AS score_head_minus_tail FROM s GROUP BY 1""")
def ag17(spark, sf_dir):
    out = N.score_summary(offers(spark, sf_dir).withColumn("score", score()))
    return out.select("run_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "run_id"))


def _scored(spark, sf_dir):
    rows = L.location_rows(offers(spark, sf_dir), labels(spark, sf_dir), CONFIG)
    return rows.withColumn("score", score())


_SEG_OF = "CASE WHEN x IS NULL THEN NULL ELSE 1" + "".join(f" + CASE WHEN x > {b} THEN 1 ELSE 0 END" for b in N.SEGMENTS[1:-1]) + " END"
_ROWS = f"""{WITH_LABELS}, scored AS (SELECT offers.*, split, run_state, run_len, first_y_rank, offer_rank::DOUBLE / run_len AS x, {SCORE_SQL} AS score FROM offers JOIN labels USING (run_id) WHERE split <> 'history' AND run_state <> 'audit_orphan_y'),
rows_ AS (SELECT *, {_SEG_OF} AS segment FROM scored),
segs AS (SELECT *, max(CASE WHEN segment_target = 1 THEN segment END) OVER (PARTITION BY run_id) AS true_segment FROM (SELECT run_id, split, run_state, run_len, first_y_rank, segment, min(x) AS share_min, max(x) AS share_max, avg(x) AS share_mean, min(offer_rank) AS rank_min, max(offer_rank) AS rank_max, avg(offer_rank) AS rank_mean, count(*) AS n_rows,
 sum(score) AS score_sum, max(score) AS score_max, avg(score) AS score_mean, avg(discount) AS discount_mean, CASE WHEN run_state = 'localizable_observed_y' AND first_y_rank BETWEEN min(offer_rank) AND max(offer_rank) THEN 1 ELSE 0 END AS segment_target FROM rows_ GROUP BY run_id, split, run_state, run_len, first_y_rank, segment)),
mass AS (SELECT *, CASE WHEN abs(sum(score_sum) OVER (PARTITION BY run_id)) > 1e-12 THEN score_sum / sum(score_sum) OVER (PARTITION BY run_id) ELSE n_rows::DOUBLE / sum(n_rows) OVER (PARTITION BY run_id) END AS mass FROM segs),
profile AS (SELECT *, greatest(0, coalesce(sum(mass) OVER (PARTITION BY run_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS mass_before FROM mass),
hz AS (SELECT *, least(greatest((segment * 13 + run_id % 7) % 10 / 12.0::DOUBLE, 0), 1 - 1e-6) AS h FROM profile),
hm AS (SELECT *, h * exp(coalesce(sum(ln(1 - h)) OVER (PARTITION BY run_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m, exp(sum(ln(1 - h)) OVER (PARTITION BY run_id)) AS survival FROM hz),
probs AS (SELECT *, CASE WHEN sum(m) OVER (PARTITION BY run_id) <= 1e-12 THEN 1.0 / count(*) OVER (PARTITION BY run_id) ELSE m / sum(m) OVER (PARTITION BY run_id) END AS segment_probability FROM hm),
final AS (SELECT run_id, offer_rank, segment, decision, CASE WHEN decision = 'discard' OR p <= 0 THEN 0 WHEN t > 1e-12 THEN p * score / t ELSE p / n END AS row_probability FROM (SELECT r.run_id, r.offer_rank, r.segment, r.score, CASE WHEN run_id % 10 / 10.0 >= 0.5 THEN 'discard' ELSE 'localize' END AS decision, segment_probability AS p,
 sum(r.score) OVER (PARTITION BY r.run_id, r.segment) AS t, count(*) OVER (PARTITION BY r.run_id, r.segment) AS n FROM rows_ r LEFT JOIN (SELECT run_id, segment, segment_probability FROM probs) USING (run_id, segment)))"""


def _segments(spark, sf_dir):
    return N.segment_table(_scored(spark, sf_dir), ["discount"])


_SEG_NUM = ["share_min", "share_max", "share_mean", "rank_mean", "score_sum", "score_max", "score_mean", "discount_mean"]


@query("ag18_segment_table", _nudged(f"{_ROWS} SELECT run_id, segment, n_rows, rank_min, rank_max, segment_target, {', '.join(f'round({c}, 6) AS {c}' for c in _SEG_NUM)} FROM segs"))
def ag18(spark, sf_dir):
    return _rounded(_segments(spark, sf_dir).select("run_id", "segment", "n_rows", "rank_min", "rank_max", "segment_target", *_SEG_NUM), _SEG_NUM)


@query("wn17_true_segment", f"{_ROWS} SELECT run_id, segment, true_segment FROM segs")
def wn17(spark, sf_dir):
    return _segments(spark, sf_dir).select("run_id", "segment", "true_segment")


@query("wn18_mass_profile", _nudged(f"{_ROWS} SELECT run_id, segment, round(mass, 6) AS mass, round(mass_before, 6) AS mass_before, round(greatest(1 - mass_before - mass, 0), 6) AS mass_after FROM profile"))
def wn18(spark, sf_dir):
    return _rounded(N.mass_profile(_segments(spark, sf_dir)).select("run_id", "segment", "mass", "mass_before", "mass_after"), ["mass", "mass_before", "mass_after"])


def _hazards(spark, sf_dir):
    h = ((F.col("segment") * 13 + F.col("run_id") % 7) % 10) / 12.0
    return N.hazard_to_mass(_segments(spark, sf_dir).withColumn("hazard", h), "hazard")


@query("wn19_hazard_to_mass", _nudged(f"{_ROWS} SELECT run_id, segment, round(survival, 6) AS survival, round(segment_probability, 6) AS segment_probability FROM probs"))
def wn19(spark, sf_dir):
    return _rounded(_hazards(spark, sf_dir).select("run_id", "segment", "survival", "segment_probability"), ["survival", "segment_probability"])


@query("jn14_join_scores", f"{WITH} SELECT o.run_id, o.offer_rank, CASE WHEN candidate % 5 = 0 THEN 0 ELSE round({SCORE_SQL}, 6) END AS score, CASE WHEN o.run_id % 2 = 0 THEN round(o.run_id % 10 / 10.0, 6)::DOUBLE END AS discard_probability FROM offers o")
def jn14(spark, sf_dir):
    o = offers(spark, sf_dir)
    rows = o.filter("candidate % 5 <> 0").select("run_id", "offer_rank", F.round(score(), 6).alias("score"))
    runs = o.filter("run_id % 2 = 0").select("run_id", (F.col("run_id") % 10 / 10.0).alias("discard_probability")).distinct()
    return N.join_scores(o.select("run_id", "offer_rank"), rows, runs)


@query("ml09_run_feature_assembly", f"{_ROWS} SELECT run_id, coalesce(s, 0)::DOUBLE AS score_max, 0::DOUBLE AS not_there FROM labels LEFT JOIN (SELECT run_id, round(max(score), 6) AS s FROM rows_ GROUP BY 1) USING (run_id)")
def ml09(spark, sf_dir):
    summary = N.score_summary(_scored(spark, sf_dir))
    return N.run_features(labels(spark, sf_dir).select("run_id"), summary, ["score_max", "not_there"]).select("run_id", F.round("score_max", 6).alias("score_max"), "not_there")


@query("ml10_segment_training", _nudged(f"{_ROWS} SELECT run_id, segment, round(1.0 / count(*) OVER (PARTITION BY run_id), 6) AS sample_weight, ({N.SEGMENTS}::DOUBLE[])[segment] AS segment_lower, ({N.SEGMENTS}::DOUBLE[])[segment + 1] AS segment_upper FROM profile WHERE true_segment IS NOT NULL AND segment <= true_segment"))
def ml10(spark, sf_dir):
    return _rounded(N.segment_training(_segments(spark, sf_dir)).select("run_id", "segment", "sample_weight", "segment_lower", "segment_upper"), ["sample_weight"])


def _final(spark, sf_dir, renormalize: bool = False):
    from ..functions.columns import segment_number

    probs = _hazards(spark, sf_dir).select("run_id", "segment", "segment_probability")
    rows = _scored(spark, sf_dir).withColumn("segment", segment_number(F.col("rank_share"), N.SEGMENTS)).select("run_id", "offer_rank", "score", "segment", (F.col("run_id") % 10 / 10.0).alias("discard_probability"))
    return N.final_rows(rows.join(probs, ["run_id", "segment"], "left"), 0.5, renormalize)


@query("ml12_final_rows", _nudged(f"{_ROWS} SELECT run_id, offer_rank, segment, decision, round(row_probability, 6) AS row_probability FROM final"))
def ml12(spark, sf_dir):
    return _rounded(_final(spark, sf_dir).select("run_id", "offer_rank", "segment", "decision", "row_probability"), ["row_probability"])


@query("ml13_run_predictions", _nudged(f"{_ROWS} SELECT run_id, decision, CASE WHEN decision = 'localize' THEN offer_rank END AS predicted_rank, round(row_probability, 6) AS modal_probability FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(row_probability, 9) DESC, offer_rank) AS n FROM final) WHERE n = 1"))
def ml13(spark, sf_dir):
    final = _final(spark, sf_dir).withColumn("row_probability", F.round("row_probability", 9))
    return _rounded(N.run_predictions(final), ["modal_probability"])


@query("ml14_combine_runs", _nudged(f"""{_ROWS}, first_rows AS (SELECT run_id, segment, max(greatest(coalesce(segment_probability, 0), 0)) AS p FROM rows_ LEFT JOIN (SELECT run_id, segment, segment_probability FROM probs) USING (run_id, segment) WHERE offer_rank % 4 <> 1 GROUP BY 1, 2),
norm AS (SELECT run_id, segment, CASE WHEN sum(p) OVER (PARTITION BY run_id) <= 1e-12 THEN 1.0 / count(*) OVER (PARTITION BY run_id) ELSE p / sum(p) OVER (PARTITION BY run_id) END AS p FROM first_rows)
SELECT run_id, offer_rank, CASE WHEN run_id % 10 / 10.0 >= 0.5 OR p <= 0 THEN 0 ELSE round(p * CASE WHEN sum(score) OVER w > 1e-12 THEN score / sum(score) OVER w ELSE 1.0 / count(*) OVER w END, 6) END AS row_probability FROM rows_ JOIN norm USING (run_id, segment) WHERE offer_rank % 4 <> 1 WINDOW w AS (PARTITION BY run_id, segment)"""))
def ml14(spark, sf_dir):
    """Only some of a run's rows are given, so that the mass of their segments is renormalised."""
    from ..functions.columns import segment_number

    probs = _hazards(spark, sf_dir).select("run_id", "segment", "segment_probability")
    rows = _scored(spark, sf_dir).withColumn("segment", segment_number(F.col("rank_share"), N.SEGMENTS)).filter("offer_rank % 4 <> 1")
    rows = rows.select("run_id", "offer_rank", "score", "segment", (F.col("run_id") % 10 / 10.0).alias("discard_probability")).join(probs, ["run_id", "segment"], "left")
    return _rounded(N.final_rows(rows, 0.5, renormalize=True).select("run_id", "offer_rank", "row_probability"), ["row_probability"])


@query("jn12_assemble_features", f"""{WITH}, l AS (SELECT run_id, count(*) AS run_rows, max(price) AS max_price FROM offers GROUP BY 1), c AS (SELECT center, count(*) AS center_rows FROM offers GROUP BY 1)
SELECT run_id, offer_rank, run_rows, max_price, center_rows FROM offers JOIN l USING (run_id) JOIN c USING (center)""")
def jn12(spark, sf_dir):
    o = offers(spark, sf_dir)
    runs = o.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_rows"), F.max("price").alias("max_price"))
    centers = o.groupBy("center").agg(F.count(F.lit(1)).alias("center_rows"))
    return J.assemble_features(J.assemble_features(o, [runs], ["run_id"]), [centers], ["center"]).select("run_id", "offer_rank", "run_rows", "max_price", "center_rows")
