"""Operators against plain Python: running sums over ranges, quantiles, hot keys, clashing names, learner chain, typed dimensions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkruns.operators import base as B
from sparkruns.operators import encoding as C
from sparkruns.operators import evaluate as V
from sparkruns.operators import history as H
from sparkruns.operators import joins as J
from sparkruns.operators import ml as M
from sparkruns.operators import rank as R
from sparkruns.operators import sampling as P
from sparkruns.operators import trailing as R_
from sparkruns.sources.tables import fresh


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab") if rng.random() < 0.9 else None, i, rng.randint(0, 3), rng.random() if rng.random() < 0.7 else 0.5) for i in range(400)]
    return rows, spark.createDataFrame(rows, "k string, i int, v int, x double").repartition(7)


@pytest.mark.parametrize("keys,by,down", [(["k"], "i", False), ([], "i", False), (["k"], "-i", True)])
def test_running_sums(numbers, keys, by, down):
    rows, df = numbers
    out = {r.i: (r.v_to, r.v_all) for r in R.running(df, keys, [by], ["v"]).collect()}
    assert len(out) == len(rows)
    for k, i, _, _ in rows:
        same = [(j, v) for kk, j, v, _ in rows if not keys or kk == k]
        assert out[i] == (sum(v for j, v in same if (j >= i if down else j <= i)), sum(v for _, v in same))


def test_running_sums_have_no_task_for_each_key(numbers, spark):
    _, df = numbers
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange(F.col("k"), F.col("i")).select("k", F.spark_partition_id().alias("p")).distinct()
        assert ranges.count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_order_statistics(numbers):
    rows, df = numbers
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for r in V.order_statistics(df, ["k"], "x", shares).collect():
        x = [v for k, _, _, v in rows if k == r.k]
        assert r.n == len(x) and np.allclose(r.q, np.quantile(x, shares), atol=1e-12)


def test_rank_metrics_of_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3)], "k string, y int, s double")
    out = {r.k: r for r in V.binary_metrics(df, ["k"], "y", "s").collect()}
    assert out["a"].roc_auc == 0.875 and out["a"].average_precision == round((1 + 2 / 3) / 2, 6)
    assert (out["b"].n, out["b"].roc_auc, out["b"].average_precision) == (1, None, None)


def test_recall_counts_runs_without_a_positive(spark):
    rows = [(1, 1, 0.9, 1), (1, 2, 0.5, 0), (2, 1, 0.8, 0), (2, 2, 0.7, 0), (2, 3, 0.6, 0), (2, 4, 0.1, 0)]
    df = spark.createDataFrame(rows, "run int, rank int, s double, y int")
    out = {r.k: (r.recall, r.precision) for r in V.recall_precision_at(df, "run", "s", "rank", "y").collect()}
    assert out == {1: (0.5, 0.5), 3: (0.5, 0.25), 5: (0.5, 0.25), 10: (0.5, 0.25)}


def test_rank_histogram(spark):
    values = [1, 2, 2, 7, 31, 31, None]
    out = V.rank_histogram(spark.createDataFrame([(v,) for v in values], "x int"), "x").orderBy("bin").collect()
    n, edges = np.histogram([v for v in values if v], bins=30)
    assert [r.n for r in out] == n.tolist() and np.allclose([r.lower for r in out], edges[:-1]) and np.allclose([r.upper for r in out], edges[1:])
    one = V.rank_histogram(spark.createDataFrame([(4,), (4,)], "x int"), "x")
    assert one.count() == 30 and one.agg(F.sum("n"), F.min("lower"), F.max("upper")).first() == (2, 3.5, 4.5)
    assert V.rank_histogram(spark.createDataFrame([], "x int"), "x").count() == 0


DAY = 86_400_000_000


def _frames(rows, d):
    """Per row: earlier rows of its key within d days, and those with its stratum too."""
    out = []
    for k, t, x, v, m, _ in rows:
        same = [r for r in rows if k is not None and t is not None and r[0] == k and r[1] is not None and t - d * DAY <= r[1] < t]
        out.append((same, [r for r in same if x is not None and r[2] == x]))
    return out


@pytest.mark.parametrize("hot_rows", [1 << 17, 25])
def test_trailing_counts_and_moments(spark, monkeypatch, hot_rows):
    """Whole keys, and keys cut in slices: ties, edges to the microsecond, nulls in key, time, stratum and measures, repeated rows."""
    rng = random.Random(3)
    rows = []
    for i in range(500):
        t = rng.randint(-40, 60) * DAY + rng.choice([0, 0, 1, -1, 5 * DAY // 2])
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([t, t, t, t, None]) if i % 9 == 0 else t, rng.choice(["x", "y", None]), rng.choice([0, 1, 5, None]), rng.choice([rng.random(), 1e6 + rng.random(), None]), i))
    rows += [(*r[:5], 1000 + r[5]) for r in rows[:40]]
    df = spark.createDataFrame(rows, "k string, at long, `a stratum` string, v int, m double, row int").repartition(5)
    families = [R_.Family([], {"v": F.col("v")}, {"m": F.col("m")}), R_.Family(["a stratum"], {"v": F.col("v")}, {"m": F.col("m")})]
    monkeypatch.setattr(R_, "ROWS_AT_ONCE", 64)
    windows = (5, 20, 35)
    features = {f"{k}{kind}{d}": R_.Feature(kind, k, (m,), d) for d in windows for k in (0, 1) for kind, m in (("count", "v"), ("values", "m"), ("sum", "m"), ("deviation", "m"))}
    out = R_.trailing(df, ["k"], "at", families, features, hot_rows=hot_rows)
    assert out.columns == [*df.columns, *features]
    got = {r["row"]: r for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    for d in windows:
        for (k, t, x, v, m, i), both in zip(rows, _frames(rows, d)):
            assert (got[i].k, got[i]["a stratum"], got[i].m) == (k, x, m)
            for f, same in zip((0, 1), both):
                found = [got[i][f"{f}{kind}{d}"] for kind in ("count", "values", "sum", "deviation")]
                if k is None or t is None or (f and x is None):
                    assert found == [None] * 4
                    continue
                real = [r[4] for r in same if r[4] is not None]
                assert found[:2] == [sum(r[3] or 0 for r in same), len(real)] and np.isclose(found[2], sum(real), rtol=1e-12)
                assert found[3] is None if len(real) < 2 else np.isclose(found[3], np.std(real, ddof=1), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("hot_rows", [1 << 17, 100])
def test_trailing_moments_forget_what_lies_before(spark, hot_rows):
    """The deviation of small values is exact after values of a thousand million, at any offset, and at a great level."""
    rng = random.Random(9)
    values = [rng.random() * (1e9 if day < 2000 else 1) for day in range(3000)]
    level = [1e8 + 0.1 * (day % 3) for day in range(300)]
    df = spark.createDataFrame([("a", i * DAY, v) for i, v in enumerate(values)] + [("b", i * DAY, v) for i, v in enumerate(level)], "k string, at long, v double")
    features = {f"{n}{d}": R_.Feature(kind, 0, ("v",), d) for d in (30, 90, 365) for n, kind in (("mean", "mean"), ("dev", "deviation"))}
    shown = R_.trailing(df, ["k"], "at", [R_.Family(moments={"v": F.col("v")})], features, hot_rows=hot_rows)
    for r in shown.filter(f"at >= {2400 * DAY} or k = 'b'").collect():
        day, of = r["at"] // DAY, values if r.k == "a" else level
        for d in (30, 90, 365):
            seen = of[max(day - d, 0) : day]
            if len(seen) > 1:
                assert np.isclose(r[f"dev{d}"], np.std(seen, ddof=1), rtol=1e-9 if r.k == "a" else 1e-6) and np.isclose(r[f"mean{d}"], np.mean(seen), rtol=1e-12)


def test_hot_key_is_many_tasks(spark):
    """One key with all rows: each task sees some of its slices."""
    df = spark.range(4000).select(F.lit("one").alias("k"), (F.col("id") * (DAY // 4)).alias("at"))
    features = {f"n{d}": R_.Feature("count", 0, ("n",), d) for d in (30, 90)}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R_.trailing(df, ["k"], "at", [R_.Family(counts={"n": F.lit(1)})], features, hot_rows=1000)
        tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(tasks) == 4 and max(t["count"] for t in tasks) < 2000
        assert out.agg(F.max("n30"), F.max("n90")).first() == (120, 360)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("keys", [["k"], []])
def test_carried_states(numbers, keys):
    """Sums, maxima and last values up to and before each row, over ranges."""
    rows, df = numbers
    odd = F.when(F.col("v") != 1, F.struct("v", "i"))
    for inclusive in (True, False):
        out = R.scanned(df, keys, ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("x")), "l": ("last", odd)}, inclusive).collect()
        assert len(out) == len(rows)
        for r in out:
            same = sorted((i, v, x) for k, i, v, x in rows if (not keys or k == r.k) and (i <= r.i if inclusive else i < r.i))
            last = [(v, i) for i, v, _ in same if v != 1][-1:]
            assert (r.s or 0) == sum(v for _, v, _ in same) and r.m == max((x for _, _, x in same), default=None)
            assert (tuple(r.l) if r.l else None) == (last[0] if last else None)


def test_a_key_with_half_of_the_rows_is_no_task(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 4000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = R.scanned(df, ["k"], ["id"], {"n": ("sum", F.lit(1))})
        spread = out.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(spread) > 1 and max(r["count"] for r in spread) < 4000
        assert out.filter("k = 'hot'").agg(F.max("n")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_top_rows_keep_a_column_called_place(spark):
    df = spark.createDataFrame([(1, 1, 0.5, "here"), (1, 2, 0.9, "there"), (1, 3, 0.1, "nowhere")], "run int, rank int, s double, place string")
    assert sorted((r.place, r.place_) for r in R.top_rows(df, "run", "s", "rank", 2).collect()) == [("here", 2), ("there", 1)]


def test_helper_columns_never_hide_the_tables_own(spark):
    names = ["_n", "n", "at", "state", "fact", "last", "mark", "part", "place", "first", "priority", "one", "good", "hash", "range", "before", "length", "take"]
    df = spark.createDataFrame([(1, 1, *names), (1, 2, *names), (2, 1, *names)], "k int, t long, " + ", ".join(f"`{n}` string" for n in names))
    same = lambda out: all([r[n] for n in names] == names for r in out.collect()) and set(df.columns) <= set(out.columns)
    hist = spark.createDataFrame([(1, 0, 5, "v")], "k int, b long, e long, value string")
    assert same(R.latest_per_key(df, ["k"], ["-t"]))
    assert same(R.nth_event(df, "k", F.col("t") > 0, ["t"], 2))
    assert same(R.limit_runs(df, "k", "place", "t", 1))
    assert same(J.valid_at(df, hist, ["k"], "t", "b", "e", ["value"]))
    assert same(J.asof_backward(df, hist.withColumnRenamed("b", "t"), ["k"], "t", "value"))
    assert same(J.enrich_compound(df, spark.createDataFrame([(1, "place", 3)], "k int, place string, value int"), "k", "place"))
    assert same(H.last_response(df.withColumn("ts", F.timestamp_seconds("t")), "k", "t", "ts", F.col("t") > 0, "place"))
    assert same(H.prior_decliners(df, "k", ["t"], "place", F.col("t") > 0))
    assert same(H.prior_event_counts(df, df, "k", "t", "events", windows=(1,)))
    assert same(H.prior_success_rate(df, "k", ["t"], F.col("t") > 0))
    assert same(P.hash_order(df, ["k"], ["t"], "number"))
    assert same(P.sample_runs(df, "k", ["place"], 10))
    assert fresh(df, "N", "x", "x") == ["N_", "x", "x_"]


def test_learner_chain(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(40)], "y int, x double")
    model = M.fit_with_fallback(df, "y", ["x"], iterations=2, depth=2)
    assert (model.backend, model.failures) == ("gbt", [])
    assert M.fit_with_fallback(df, "y", ["x"], backends=("rf",), iterations=2, depth=2).backend == "rf"
    with pytest.raises(M.NoLearner, match="gbt: .*rf: "):
        M.fit_with_fallback(df, "y", ["x"], iterations=2, depth=99)  # too deep for either
    assert M.fit_with_fallback(df.filter("y = 1"), "y", ["x"]).backend == "constant"
    with pytest.raises(ValueError, match="no values"):
        M.fit_with_fallback(df.filter("y > 5"), "y", ["x"])
    with pytest.raises(Exception, match="nothing"):  # what is no refusal of a learner is not swallowed
        M.fit_with_fallback(df, "y", ["nothing"])


def test_a_giveaway_beside_a_hundred_categories_is_learnt(spark):
    rows = [(i % 2, i % 2 + 0.001 * (i % 7), f"c{i % 100}") for i in range(400)]
    df = spark.createDataFrame(rows, "y int, x double, c string")
    out = M.fit_with_fallback(df, "y", ["x"], ["c"], iterations=3, depth=2).transform(df).collect()
    assert all((r.probability_1 > 0.5) == (r.y == 1) for r in out)


def test_encoder_merges_batches(spark):
    """Fills over all batches, first-sight codes, unseen and missing categories, times, absent columns."""
    import datetime as dt

    t = lambda d: dt.datetime(2020, 1, d)
    schema = "i int, x double, t timestamp, c string, code string"
    first = spark.createDataFrame([(3, 1.0, t(1), "b", "own"), (1, float("nan"), None, "a", "own"), (2, 2.0, t(3), None, "own"), (4, None, t(2), "b", "own")], schema).repartition(3)
    second = spark.createDataFrame([(9, 6.0, None, "z", "own"), (8, None, None, "a", "own"), (7, None, None, "y", "own")], schema).repartition(2)
    names = ["x", "t", "c", "gone"]
    one = C.fit_batch(first, names, ["i"])
    both = C.fit_batch(second, names, ["i"], one)
    codes = lambda e: {r.value: r["code"] for r in e.codes.collect()}
    assert codes(one) == {"a": 0, C.MISSING: 1, "b": 2} and codes(both) == codes(one) | {"y": 3, "z": 4}
    assert one.fills()["x"] == 1.5 and both.fills() == {"x": 3.0, "t": 1577923200e9, "gone": 0.0}
    new = spark.createDataFrame([(1, None, t(1), "never", "own"), (2, 7.0, None, None, "own")], schema)
    out = {r.i: r for r in C.encode(both, new).collect()}
    assert (out[1].code_x, out[1].code_t, out[1].code_c, out[1].code_gone) == (3.0, 1577836800e9, -1.0, 0.0)
    assert (out[2].code_x, out[2].code_t, out[2].code_c, out[2]["code"]) == (7.0, 1577923200e9, 1.0, "own")
    assert [r.code_c for r in C.encode(both, new.drop("c")).collect()] == [1.0, 1.0]


def test_statistics_of_ten_thousand_categories_do_not_leak(spark):
    """With labels by chance, a training row's statistic says nothing of its own label; each equals a plain loop's."""
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1]), "hot" if i % 3 == 0 else f"c{rng.randrange(10_000)}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "i int, y int, c string").repartition(5)
    train, stats = C.ordered_statistics(df, "y", ["c"], ["i"], strength=4.0)
    mean = sum(y for _, y, _ in rows) / len(rows)
    order = {r.i: r.h for r in df.select("i", F.xxhash64(F.lit(0), "i").alias("h")).collect()}
    seen, expected = {}, {}
    for i, y, c in sorted(rows, key=lambda r: (order[r[0]], r[0])):
        total, n = seen.get(c, (0, 0))
        expected[i] = (total + 4 * mean) / (n + 4)
        seen[c] = (total + y, n + 1)
    got = {r.i: (r.y, r.stat_c) for r in train.collect()}
    assert all(abs(got[i][1] - v) < 1e-12 for i, v in expected.items()) and len(got) == len(rows)
    assert abs(np.corrcoef([y for y, _ in got.values()], [s for _, s in got.values()])[0, 1]) < 0.05
    later = {r.c: r.stat_c for r in stats.transform(spark.createDataFrame([("hot",), ("new",)], "c string")).collect()}
    assert abs(later["hot"] - (seen["hot"][0] + 4 * mean) / (seen["hot"][1] + 4)) < 1e-12 and abs(later["new"] - mean) < 1e-12


def test_ten_thousand_categories_fit(spark):
    rng = random.Random(6)
    effect = {f"c{k}": rng.random() < 0.5 for k in range(10_000)}
    rows = [(i, int(effect[c] ^ (rng.random() < 0.1)), c) for i in range(40_000) for c in [f"c{rng.randrange(10_000)}"]]
    df = spark.createDataFrame(rows, "i int, y int, c string")
    model = M.fit_binary(df, "y", [], ["c"], iterations=3, depth=3, ids=["i"])
    auc = V.binary_metrics(model.transform(df), [], "y", "probability_1").first().roc_auc
    assert auc > 0.85


def test_stopping_by_average_precision(spark):
    """The chosen number of trees is that of a plain loop over the prefixes; scores are those of the learner's own ensemble of that length."""
    from pyspark.ml.classification import GBTClassifier

    rng = random.Random(8)
    rows = [(i, int(rng.random() < (0.8 if x > 0.7 else 0.2)), x, rng.random(), i % 3 == 0) for i in range(900) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "i int, y int, a double, b double, held boolean")
    model = M.fit_binary(df, "y", ["a", "b"], validation="held", iterations=12, depth=4, rate=0.4, patience=4, ids=["i"])
    held = [r for r in rows if r[4]]
    vectors = M._prepared(df, "y", ["a", "b"], [], ["i"], "held", 7)[1]
    best, at, lengths = -1.0, 0, []
    for n in range(1, 13):
        scores = {r.i: r.probability_1 for r in M.BinaryModel(model.features, model.fitted, n).transform(df).collect()}
        ranked = sorted(held, key=lambda r: -scores[r[0]])
        ap, tp, k = 0.0, 0, 0
        while k < len(ranked):
            tie = [r for r in ranked if scores[r[0]] == scores[ranked[k][0]]]
            k, tp = k + len(tie), tp + sum(r[1] for r in tie)
            ap += sum(r[1] for r in tie) * tp / k
        lengths.append(ap / sum(r[1] for r in held))
        if lengths[-1] > best + 1e-12:
            best, at = lengths[-1], n
        elif n - at >= 4:
            break
    assert model.trees == at and np.allclose(model.precisions[: len(lengths)], lengths)
    own = GBTClassifier(labelCol="y", featuresCol=vectors.columns[-1], maxDepth=4, seed=7, maxBins=64, maxIter=at, stepSize=0.4).fit(vectors)
    theirs = {r.i: r.p for r in own.transform(model.features.vectors(df, "v_").withColumnRenamed("v_", vectors.columns[-1])).select("i", M.vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(theirs[r.i] - r.probability_1) < 1e-9 for r in model.transform(df).collect())


@pytest.mark.parametrize("backends", [("gbt",), ("rf",)])
def test_three_classes(spark, backends):
    """Probabilities sum to one, a rare class is found through balance, weights of zero take rows out."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        c = "rare" if i % 30 == 0 else rng.choice(["early", "late"])
        rows.append((i, c if i % 50 else None, {"early": 0.0, "late": 5.0, "rare": 10.0}[c] + rng.random(), 1.0))
    rows += [(1000 + i, "noise", 0.5, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, c string, x double, w double")
    model = M.fit_classes(df.filter("w > 0"), "c", ["x"], weight="w", backends=backends, iterations=4, depth=3)
    assert (model.classes, model.backend) == (["early", "late", "rare"], backends[0])
    out = model.transform(df.filter("w > 0")).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and min(r.probabilities) >= 0 for r in out)
    assert all(r.predicted == r.c for r in out if r.c)
    two = M.fit_classes(df.filter("c in ('early', 'late')"), "c", ["x"], iterations=2, depth=2).transform(df.limit(20)).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.predicted in ("early", "late") for r in two)
    assert M.fit_classes(df.filter("c = 'rare'"), "c", ["x"]).transform(df.limit(1)).first().predicted == "rare"
    with pytest.raises(M.NoLearner):
        M.fit_classes(df, "c", ["x"], backends=backends, depth=99)


def test_dimensions_are_typed(spark):
    source = spark.createDataFrame([("7", "2020-01-01", 3.0), ("7", "2021-01-01", 4.0), (None, "2021-01-01", 5.0)], "PX_ID string, CAN_LISTING_DT string, CAN_AGE_AT_LISTING double")
    out = B.dimension("candidate", source)
    assert out.columns == list(B.columns_of("candidate")) and dict(out.dtypes)["px_id"] == "bigint"
    assert [(r.px_id, r.can_age_at_listing, r.can_abo) for r in out.collect()] == [(7, 4.0, None)]
    assert sum(len(B.columns_of(d)) for d in B.DIMENSIONS) == 18 + 28 + 20 + 36 + 11 + 6 + 15 + 11


def test_null_features_and_select_except(spark):
    out = B.null_features(spark.range(2), {"id": "long", "rate": "double", "bin": "string"})
    assert out.dtypes == [("id", "bigint"), ("rate", "double"), ("bin", "string")] and out.filter("rate is null and bin is null").count() == 2
    assert B.select_except(out, ["rate"]).columns == ["id", "bin"]
    with pytest.raises(ValueError, match="nothing"):
        B.select_except(out, ["nothing"])


def test_table_functions_are_in_order(spark):
    rows = [(1, 2, 1, 9, 5, 3), (1, 1, 1, 9, 5, 2), (2, 1, 1, 9, 6, 1), (3, 1, 1, 8, 6, 0)]
    df = spark.createDataFrame(rows, "match_id int, ptr_sequence_num int, ptr_row_order int, px_id int, donor_id int, day int").withColumn("match_submit_dt", F.timestamp_seconds(F.col("day") * 86_400))
    assert [r.ptr_sequence_num for r in B.lookup_match(df, 1).collect()] == [1, 2]
    assert [r.match_id for r in B.px_history(df, 9).collect()] == [2, 1, 1]
    assert [r.match_id for r in B.donor_history_enriched(df, 6).collect()] == [3, 2]
    assert isinstance(B.lookup_match(df, 1).toPandas(), pd.DataFrame)
