"""Queries on evaluation tables, sampling and Spark ML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucketize, round6
from ..operators import encoding as C
from ..operators import evaluate as V
from ..operators import joins as J
from ..operators import labels as L
from ..operators import ml as M
from ..operators import rank as R
from ..operators import runs as N
from ..operators import sampling as P
from ..sources.tables import scan, scratch, scratch_path, write_table
from .bindings import CONFIG, SCORE_SQL, WITH, WITH_LABELS, labels, offers, query, score
from .run_queries import _SECOND

_TARGET = "CASE WHEN response = 'Y' THEN 1 ELSE 0 END"
#: Scores with many ties.
_TIED_SQL = "((candidate * 31 + offer_rank * 17) % 21)::DOUBLE / 20.0"


def _scored(spark, sf_dir):
    tied = F.expr("CAST((candidate * 31 + offer_rank * 17) % 21 AS DOUBLE) / 20.0D")
    o = offers(spark, sf_dir)
    return o.select("run_id", "run_year", "offer_rank", "status", "band", F.when(F.col("response") == "Y", 1).otherwise(0).alias("target"), tied.alias("score"), score().alias("fine"))


_SCORED = f"{WITH}, s AS (SELECT run_id, run_year, offer_rank, status, band, {_TARGET} AS target, {_TIED_SQL} AS score, {SCORE_SQL} AS fine FROM offers)"


def _predicted(spark, sf_dir):
    lab = labels(spark, sf_dir).filter("split <> 'history'")
    return lab.select("run_id", "split", "run_year", "run_state", "run_len", "first_y_rank", F.when(F.col("run_id") % 5 != 0, (F.col("run_id") * 7 % F.col("run_len") + 1).cast("int")).alias("predicted_rank"), F.lit(1).alias("rank_one"))


_PREDICTED = f"{WITH_LABELS}, p AS (SELECT run_id, split, run_year, run_state, run_len, first_y_rank, CASE WHEN run_id % 5 <> 0 THEN (run_id * 7 % run_len + 1)::INT END AS predicted_rank, 1 AS rank_one FROM labels WHERE split <> 'history')"
_HITS = lambda p: ", ".join(f"round(avg(CASE WHEN abs({p} - first_y_rank) <= {d} THEN 1.0 ELSE 0.0 END), 6) AS hit_{d}" for d in V.TOLERANCES)


@query("ag19_split_balance", f"{_SCORED} SELECT status, sum(target)::BIGINT AS positives, sum(1 - target)::BIGINT AS negatives FROM s GROUP BY 1")
def ag19(spark, sf_dir):
    return V.split_balance(_scored(spark, sf_dir), "status", "target")


@query("ag20_hit_rates", f"{_PREDICTED} SELECT split, count(*) AS n, {_HITS('predicted_rank')} FROM p WHERE first_y_rank IS NOT NULL GROUP BY 1")
def ag20(spark, sf_dir):
    return V.hit_rates(_predicted(spark, sf_dir).filter("first_y_rank is not null"), ["split"], "predicted_rank", "first_y_rank")


@query("ag21_binary_metrics", f"""{_SCORED}, g AS (SELECT status, run_year, score, sum(target)::DOUBLE AS p, sum(1 - target)::DOUBLE AS q, sum((score - target) ** 2) AS e FROM s GROUP BY 1, 2, 3),
w AS (SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(q) OVER (PARTITION BY status, run_year) AS allq FROM g WINDOW d AS (PARTITION BY status, run_year ORDER BY score DESC))
SELECT status, run_year, (sum(p) + sum(q))::BIGINT AS n, round(sum(e) / (sum(p) + sum(q)), 6) AS brier, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(p * (allq - fp + q / 2)) / (sum(p) * sum(q)), 6) END AS roc_auc,
 CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(p * tp / (tp + fp)) / sum(p), 6) END AS average_precision FROM w GROUP BY 1, 2""")
def ag21(spark, sf_dir):
    return V.binary_metrics(_scored(spark, sf_dir), ["status", "run_year"], "target", "score")


@query("ag22_decision_shares", f"{_PREDICTED} SELECT split, run_state, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM p GROUP BY 1, 2")
def ag22(spark, sf_dir):
    return V.shares(_predicted(spark, sf_dir), ["split"], "run_state")


@query("ag23_score_deciles", f"""{_SCORED}, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM s)
SELECT greatest(len(list_filter(edges, lambda x: x < score)), 1)::INT AS decile, count(*) AS n, round(avg(target), 6) AS positive_rate, min(score) AS least, max(score) AS most FROM s, e GROUP BY 1""")
def ag23(spark, sf_dir):
    return V.score_deciles(_scored(spark, sf_dir), "score", "target")


@query("ag24_class_histogram", f"{_SCORED} SELECT target, least(floor(fine * 30), 29)::INT AS bin, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY target), 6) AS share FROM s GROUP BY 1, 2")
def ag24(spark, sf_dir):
    return V.class_histogram(_scored(spark, sf_dir), "fine", "target")


@query("ag24_box_summary", f"{_SCORED} SELECT target, count(fine) AS n, round(quantile_cont(fine, 0.25), 6) AS lower, round(quantile_cont(fine, 0.5), 6) AS median, round(quantile_cont(fine, 0.75), 6) AS upper FROM s GROUP BY 1")
def ag24_box(spark, sf_dir):
    return V.box_summary(_scored(spark, sf_dir), ["target"], "fine")


_CONTINUOUS = "(run_id * 15485863 + candidate * 7919 + offer_rank * 104729) % 1000003"


def _continuous(spark, sf_dir):
    """Scores that hardly two rows share."""
    o = offers(spark, sf_dir)
    return o.select("run_id", "offer_rank", "status", F.when(F.col("response") == "Y", 1).otherwise(0).alias("target"), (F.expr(_CONTINUOUS) / F.lit(1000003.0)).alias("score"))


_CONTINUOUS_SQL = f"{WITH}, s AS (SELECT run_id, offer_rank, status, {_TARGET} AS target, ({_CONTINUOUS}) / 1000003.0::DOUBLE AS score FROM offers)"


@query("ag21_binary_metrics_continuous", f"""{_CONTINUOUS_SQL}, g AS (SELECT score, sum(target)::DOUBLE AS p, sum(1 - target)::DOUBLE AS q, sum((score - target) ** 2) AS e FROM s GROUP BY 1),
w AS (SELECT *, sum(p) OVER d AS tp, sum(q) OVER d AS fp, sum(q) OVER () AS allq FROM g WINDOW d AS (ORDER BY score DESC))
SELECT (sum(p) + sum(q))::BIGINT AS n, round(sum(e) / (sum(p) + sum(q)), 6) AS brier, round(sum(p * (allq - fp + q / 2)) / (sum(p) * sum(q)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)) / sum(p), 6) AS average_precision FROM w""")
def ag21_continuous(spark, sf_dir):
    return V.binary_metrics(_continuous(spark, sf_dir), [], "target", "score")


@query("ag23_score_deciles_continuous", f"""{_CONTINUOUS_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM s)
SELECT greatest(len(list_filter(edges, lambda x: x < score)), 1)::INT AS decile, count(*) AS n, round(avg(target), 6) AS positive_rate, min(score) AS least, max(score) AS most FROM s, e GROUP BY 1""")
def ag23_continuous(spark, sf_dir):
    return V.score_deciles(_continuous(spark, sf_dir), "score", "target")


def _rank_histogram_sql(value: str) -> str:
    return f"""{WITH_LABELS}, v AS (SELECT ({value})::DOUBLE AS x FROM labels WHERE run_state = '{L.LOCALIZABLE}'), e AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v),
k AS (SELECT least(floor((x - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM v, e WHERE x IS NOT NULL GROUP BY 1)
SELECT bin::INT AS bin, round(lo + bin * ((hi - lo) / 30), 6) AS lower, round(CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 30) END, 6) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(30))::INT AS bin) CROSS JOIN e LEFT JOIN k USING (bin)"""


@query("ag24_rank_histogram", _rank_histogram_sql("first_y_rank"))
def ag24_ranks(spark, sf_dir):
    return V.rank_histogram(labels(spark, sf_dir).filter(F.col("run_state") == L.LOCALIZABLE), "first_y_rank")


@query("ag24_share_histogram", _rank_histogram_sql("first_y_share"))
def ag24_rank_shares(spark, sf_dir):
    return V.rank_histogram(labels(spark, sf_dir).filter(F.col("run_state") == L.LOCALIZABLE), "first_y_share")


@query("ag25_empirical_cdf", f"{_PREDICTED} SELECT split, run_len, round((sum(count(*)) OVER (PARTITION BY split ORDER BY run_len))::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS cdf FROM p GROUP BY 1, 2")
def ag25(spark, sf_dir):
    return V.empirical_cdf(_predicted(spark, sf_dir), "split", "run_len")


_STATES = [L.LOCALIZABLE, L.CENSORED, L.ORPHAN, L.NONE]


@query("ag26_state_by_year", f"{WITH_LABELS} SELECT run_year, {', '.join(f'count(*) FILTER (run_state = {s!r}) AS {s}' for s in _STATES)} FROM labels GROUP BY 1")
def ag26(spark, sf_dir):
    return V.state_by_year(labels(spark, sf_dir), "run_state", "run_year", _STATES)


_TIMING = lambda x: f"CASE WHEN {x}::DOUBLE / run_len <= 0.1 THEN 'early' WHEN {x}::DOUBLE / run_len <= 0.5 THEN 'mid' ELSE 'late' END"


@query("ag27_confusion", f"""{_PREDICTED}, t AS (SELECT {_TIMING('first_y_rank')} AS true_bucket, {_TIMING('predicted_rank')} AS predicted_bucket FROM p WHERE first_y_rank IS NOT NULL AND predicted_rank IS NOT NULL),
g AS (SELECT * FROM (VALUES ('early'), ('mid'), ('late')) a(true_bucket), (VALUES ('early'), ('mid'), ('late')) b(predicted_bucket)), n AS (SELECT g.*, count(t.true_bucket) AS n FROM g LEFT JOIN t USING (true_bucket, predicted_bucket) GROUP BY 1, 2)
SELECT *, coalesce(round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY true_bucket), 0), 6), 0) AS share FROM n""")
def ag27(spark, sf_dir):
    p = _predicted(spark, sf_dir).filter("first_y_rank is not null and predicted_rank is not null")
    of = lambda c: bucketize(F.col(c).cast("double") / F.col("run_len"), [0.1, 0.5], ["early", "mid", "late"])
    return V.confusion(p.select(of("first_y_rank").alias("true_bucket"), of("predicted_rank").alias("predicted_bucket")), "true_bucket", "predicted_bucket", ["early", "mid", "late"])


@query("ag28_recall_precision", f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY fine DESC, offer_rank) AS place FROM s),
a AS (SELECT run_id, k, max(target) AS hit, avg(target) AS share FROM r, (VALUES (1), (3), (5), (10)) v(k) WHERE place <= k GROUP BY 1, 2)
SELECT k, round(avg(hit), 6) AS recall, round(avg(share), 6) AS precision FROM a GROUP BY 1""")
def ag28(spark, sf_dir):
    return V.recall_precision_at(_scored(spark, sf_dir), "run_id", "fine", "offer_rank", "target")


@query("ag29_rate_by_length", f"""{_PREDICTED}, b AS (SELECT CASE WHEN run_len <= 2 THEN '1-2' WHEN run_len <= 5 THEN '3-5' WHEN run_len <= 50 THEN '6-50' ELSE '50+' END AS bucket, predicted_rank, first_y_rank FROM p WHERE first_y_rank IS NOT NULL)
SELECT bucket, count(b.first_y_rank) AS n, round(avg(CASE WHEN b.bucket IS NULL THEN NULL WHEN abs(predicted_rank - first_y_rank) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (VALUES ('1-2'), ('3-5'), ('6-50'), ('50+')) v(bucket) LEFT JOIN b USING (bucket) GROUP BY 1""")
def ag29(spark, sf_dir):
    p = _predicted(spark, sf_dir).filter("first_y_rank is not null")
    names = ["1-2", "3-5", "6-50", "50+"]
    return V.rate_by_bucket(p, bucketize(F.col("run_len"), [2, 5, 50], names), names, F.abs(F.col("predicted_rank") - F.col("first_y_rank")) <= 1)


@query("ag30_compare_baselines", f"""{_PREDICTED}, h AS (SELECT first_y_rank AS r, count(*) AS n FROM labels WHERE split = 'train' AND first_y_rank IS NOT NULL GROUP BY 1),
best AS (SELECT run_id, offer_rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {SCORE_SQL} DESC, offer_rank) AS n FROM offers) WHERE n = 1 AND run_id % 7 <> 0),
l AS (SELECT p.*, coalesce((SELECT r FROM h WHERE r <= run_len ORDER BY n DESC, r LIMIT 1), 1) AS empirical, coalesce(best.offer_rank, 1) AS best_rank FROM p LEFT JOIN best USING (run_id) WHERE first_y_rank IS NOT NULL AND split = 'validation')
""" + " UNION ALL ".join(f"SELECT '{m}' AS model, count(*) AS n, {_HITS(c)}, round(avg(CASE WHEN {c} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM l" for m, c in (("final_pipeline", "predicted_rank"), ("empirical_rank", "empirical"), ("earliest_offer", "rank_one"), ("offerpred_only", "best_rank"))))
def ag30(spark, sf_dir):
    """The pipeline's predictions against the most frequent training rank, the first offer, and the best score alone."""
    lab = labels(spark, sf_dir)
    p = _predicted(spark, sf_dir).filter("first_y_rank is not null and split = 'validation'")
    empirical = J.mode_feasible(lab.filter("split = 'train' AND first_y_rank IS NOT NULL"), p.select("run_id", "run_len"), "first_y_rank", "run_len")
    best = R.best_row(_scored(spark, sf_dir), "run_id", "fine", "offer_rank").filter("run_id % 7 <> 0").select("run_id", F.col("offer_rank").alias("best"))
    rows = p.join(empirical.select("run_id", F.col("predicted_rank").alias("empirical")), "run_id").join(best, "run_id", "left").withColumn("best", F.coalesce("best", F.lit(1)))
    return V.compare_baselines(rows, {"final_pipeline": "predicted_rank", "empirical_rank": "empirical", "earliest_offer": "rank_one", "offerpred_only": "best"}, "first_y_rank")


@query("ag31_scorecard", f"""{_SCORED}, m AS (SELECT status, round(avg(score), 6) AS mean_score, CASE WHEN status = 'P' THEN NULL ELSE round(avg(target), 6) END AS positive_rate FROM s GROUP BY 1)
SELECT status, 'mean_score' AS metric, mean_score AS value FROM m UNION ALL SELECT status, 'positive_rate', positive_rate FROM m WHERE positive_rate IS NOT NULL""")
def ag31(spark, sf_dir):
    m = _scored(spark, sf_dir).groupBy("status").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("target"), 6).alias("positive_rate"))
    return V.scorecard(m.withColumn("positive_rate", F.when(F.col("status") != "P", F.col("positive_rate")).otherwise(F.lit(float("nan")))), ["status"], ["mean_score", "positive_rate"])


# sampling, by a hash that both engines have

_HASH = lambda seed, *keys: f"md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


@query("ml01_downsample", f"""{_SCORED}, n AS (SELECT least(1.0, sum(target)::DOUBLE / greatest(sum(1 - target), 1)) AS share FROM s)
SELECT run_id, offer_rank, target FROM s, n WHERE target = 1 OR substr({_HASH(5, 'run_id', 'offer_rank')}, 1, 10) < format('{{:010x}}', ceil(share * 1099511627776)::BIGINT)""")
def ml01(spark, sf_dir):
    return P.downsample_negatives(_scored(spark, sf_dir), ["run_id", "offer_rank"], "target", 1.0, seed=5).select("run_id", "offer_rank", "target")


@query("ml02_sample_runs", f"""{_SCORED}, r AS (SELECT status, run_id, count(*) AS len FROM s GROUP BY 1, 2), t AS (SELECT status, greatest(floor(500 / avg(len)), 1) AS take FROM r GROUP BY 1),
o AS (SELECT status, run_id, row_number() OVER (PARTITION BY status ORDER BY {_HASH(0, 'run_id')}, run_id) AS n FROM r) SELECT s.run_id, offer_rank, s.status FROM s JOIN o USING (status, run_id) JOIN t USING (status) WHERE n <= take""")
def ml02(spark, sf_dir):
    return P.sample_runs(_scored(spark, sf_dir), "run_id", ["status"], 500).select("run_id", "offer_rank", "status")


@query("sf11_hash_order", f"{_SCORED} SELECT run_id, offer_rank, row_number() OVER (PARTITION BY status ORDER BY {_HASH(0, 'run_id', 'offer_rank')}, run_id, offer_rank) AS place FROM s")
def sf11(spark, sf_dir):
    return P.hash_order(_scored(spark, sf_dir), ["status"], ["run_id", "offer_rank"]).select("run_id", "offer_rank", "place")


# models: fitted trees differ between engines, so these have no SQL

_NUM, _CAT = ["score_points", "discount", "tax", "offer_rank"], ["band", "status", "candidate"]
_ROW = ["run_id", "offer_rank"]


def _training(spark, sf_dir):
    """Loss rows with a validation flag, written once: the learner passes over them many times."""
    rows = L.loss_rows(offers(spark, sf_dir), labels(spark, sf_dir)).select("run_id", "offer_rank", "split", "target", *_NUM[:3], *_CAT)
    path = scratch_path(spark, "training")
    write_table(rows.withColumn("is_validation", F.col("split") == "validation"), path)
    return scan(spark, path)


_CODED = ["candidate", "band", "status"]


@query("ml03_encoder", f"""{WITH_LABELS}, {_SECOND}, s AS (SELECT run_id, offer_rank, split, score_points, CASE WHEN discount <= 0.05 THEN discount END AS discount, offers.submit_ts, candidate::VARCHAR AS candidate, band, CASE WHEN tax > 0.02 THEN status ELSE 'missing' END AS status
 FROM offers JOIN labels USING (run_id) LEFT JOIN second USING (run_id) WHERE split <> 'history' AND run_state IN ('localizable_observed_y', 'none') AND response IN ('Y', 'N') AND (second IS NULL OR offer_rank <= second)),
fit AS (SELECT *, CASE split WHEN 'train' THEN 0 ELSE 1 END AS b FROM s WHERE split IN ('train', 'validation')),
cells AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, {c} AS v, b, run_id, offer_rank FROM fit" for c in _CODED)}),
firsts AS (SELECT f, v, min(row(b, run_id, offer_rank)) AS first FROM cells GROUP BY 1, 2),
codes AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY first, v) - 1 AS code FROM firsts)
SELECT s.run_id, s.offer_rank, round(score_points, 6) AS code_score_points, round(coalesce(discount, (SELECT avg(discount) FROM fit)), 6) AS code_discount, epoch_us(submit_ts) * 1000.0::DOUBLE AS code_submit_ts, 0.0::DOUBLE AS code_absent, {', '.join(f"coalesce(c_{c}.code, -1)::DOUBLE AS code_{c}" for c in _CODED)}
FROM s {' '.join(f"LEFT JOIN codes c_{c} ON c_{c}.f = '{c}' AND c_{c}.v = s.{c}" for c in _CODED)}""")
def ml03(spark, sf_dir):
    """Two batches, training and validation rows; candidates of test rows alone are unseen."""
    rows = L.loss_rows(offers(spark, sf_dir), labels(spark, sf_dir)).select(
        "run_id", "offer_rank", "split", "score_points", F.when(F.col("discount") <= 0.05, F.col("discount")).alias("discount"), "submit_ts",
        F.col("candidate").cast("string").alias("candidate"), "band", F.when(F.col("tax") > 0.02, F.col("status")).alias("status"),
    )
    rows = scratch(rows, "encoder-rows")
    features = ["score_points", "discount", "submit_ts", "absent", *_CODED]
    encoder = None
    for split in ("train", "validation"):
        encoder = C.fit_batch(rows.filter(F.col("split") == split), features, _ROW, encoder)
    out = C.encode(encoder, rows)
    return out.select(*_ROW, *(F.round(f"code_{f}", 6).alias(f"code_{f}") for f in features))


@query("ml03_target_statistics", f"""{WITH_LABELS}, {_SECOND}, s AS (SELECT candidate, CASE response WHEN 'Y' THEN 1.0 ELSE 0.0 END AS y, run_id, offer_rank, split FROM offers JOIN labels USING (run_id) LEFT JOIN second USING (run_id) WHERE split <> 'history' AND run_state IN ('localizable_observed_y', 'none') AND response IN ('Y', 'N') AND (second IS NULL OR offer_rank <= second)),
t AS (SELECT candidate, sum(y) AS total, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1), m AS (SELECT avg(y) AS mean FROM s WHERE split = 'train')
SELECT run_id, offer_rank, round((coalesce(total, 0) + mean * 10) / (coalesce(n, 0) + 10) + 1e-9, 6)::DOUBLE AS stat_candidate FROM s LEFT JOIN t USING (candidate), m WHERE split <> 'train'""")
def ml03_statistics(spark, sf_dir):
    """What validation and test rows get from the training rows' statistics."""
    rows = _training(spark, sf_dir)
    _, statistics = C.ordered_statistics(rows.filter("split = 'train'"), "target", ["candidate"], _ROW)
    return statistics.transform(rows.filter("split <> 'train'")).select(*_ROW, round6(F.col("stat_candidate")).alias("stat_candidate"))


def _row_model(spark, sf_dir, backend: str = "gbt"):
    rows = _training(spark, sf_dir)
    fit = rows.filter("split in ('train', 'validation')")
    return rows, M.fit_binary(fit, "target", _NUM, _CAT, validation="is_validation", backend=backend, iterations=5, depth=3, ids=_ROW)


@query("ml04_row_classifier")
def ml04(spark, sf_dir):
    """Boosting that average precision on the validation rows stops."""
    rows, model = _row_model(spark, sf_dir)
    return model.transform(rows).select("run_id", "offer_rank", "target", F.round("probability_1", 6).alias("score"))


def _runs(spark, sf_dir):
    o, lab = offers(spark, sf_dir), labels(spark, sf_dir)
    features = {"max_points": F.max("score_points"), "mean_discount": F.avg("discount"), "n_dcd": F.sum("dcd")}
    return scratch(L.run_rows(o, lab, features, CONFIG), "runs")


_RUN_FEATURES = ["max_points", "mean_discount", "n_dcd", "run_len"]


@query("ml05_run_classifier")
def ml05(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    model = M.fit_with_fallback(runs.filter("split = 'train'"), "discard_target", _RUN_FEATURES, iterations=10, depth=4)
    return model.transform(runs).select("run_id", "split", "discard_target", F.round("probability_1", 6).alias("discard_probability"))


@query("ml05_timing_classes")
def ml05_timing(spark, sf_dir):
    """Early, middle and late first acceptances, of which middle ones are few; all runs are scored."""
    runs = _runs(spark, sf_dir)
    model = M.fit_classes(runs.filter("split = 'train'"), "timing_target", _RUN_FEATURES, iterations=5, depth=3)
    shares = [F.round(F.col("probabilities")[i], 6).alias(f"p_{c}") for i, c in enumerate(model.classes)]
    return model.transform(runs).select("run_id", "split", "timing_target", *shares, "predicted")


@query("ml06_constant_fallback")
def ml06(spark, sf_dir):
    rows = _scored(spark, sf_dir).filter("target = 1")
    return M.fit_binary(rows, "target", ["score"]).transform(rows).select("run_id", "offer_rank", "probability_1")


@query("ml07_score_rows")
def ml07(spark, sf_dir):
    """Scores for all rows of all splits, also those that are not answered."""
    rows, model = _row_model(spark, sf_dir)
    everything = L.scoring_rows(offers(spark, sf_dir), labels(spark, sf_dir))
    return model.transform(everything).select("run_id", "offer_rank", "split", "run_state", "use_for_loss", F.round("probability_1", 6).alias("score"))


@query("ml08_feature_importance")
def ml08(spark, sf_dir):
    _, model = _row_model(spark, sf_dir, "rf")
    return spark.createDataFrame(M.feature_importance(model), "feature string, importance double")


@query("ml11_segment_hazard")
def ml11(spark, sf_dir):
    """Hazard model on segments of localizable runs up to the true one; its mass for all runs."""
    rows = L.location_rows(offers(spark, sf_dir), labels(spark, sf_dir), CONFIG).withColumn("score", score())
    path = scratch_path(spark, "segments")
    write_table(N.segment_table(rows, ["discount", "score_points"]), path)
    segments = scan(spark, path)
    train = N.segment_training(segments.filter("split = 'train' and run_state = 'localizable_observed_y'"))
    numeric = ["segment", "share_mean", "score_sum", "score_max", "n_rows", "discount_mean", "score_points_mean", "mass", "mass_before"]
    model = M.fit_binary(train, "segment_target", numeric, weight="sample_weight", iterations=5, depth=3)
    scored = model.transform(N.mass_profile(segments)).withColumnRenamed("probability_1", "hazard")
    return N.hazard_to_mass(scored, "hazard").select("run_id", "segment", F.round("hazard", 6).alias("hazard"), F.round("segment_probability", 6).alias("segment_probability"))
