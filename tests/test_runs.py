"""Golden counts and invariants on a small synthetic set of runs: seven kinds in each of three years, ten rows each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkruns.operators import labels as L
from sparkruns.operators import runs as N
from sparkruns.sources import tables as T

KINDS = {"early": (1, "LKI"), "mid": (3, "LKI"), "late": (8, "LKI"), "none": (None, None), "censored": (None, "EKI"), "audit_nonkidney": (2, "LI"), "audit_missing": (2, None)}
CONFIG = L.LabelConfig("2010-01-01", "2015-01-01", "2023-01-01", "2024-01-01", "2025-12-31")


@pytest.fixture(scope="module")
def fixture(spark):
    offers, outcomes, run = [], [], 100
    for year in (2022, 2023, 2024):
        for yes, organ in KINDS.values():
            for rank in range(1, 11):
                response = "B" if rank == 9 else "Z" if rank == 10 else "Y" if rank == yes else "N"
                offers.append((run, dt.datetime(year, 6, 1), year, rank, rank, run * 1000 + rank, response, rank, rank / 10))
            if organ:
                outcomes.append((run, organ, 6))
            run += 1
    o = spark.createDataFrame(offers, "run_id long, submit_ts timestamp, run_year int, row_order int, seq int, candidate long, response string, offer_rank int, score double")
    p = spark.createDataFrame(outcomes, "run_id long, organ string, disposition int")
    placed = (F.col("disposition") == 6) & F.col("organ").isin("LKI", "RKI", "EKI")
    return o, L.match_labels(o, p, CONFIG, placed).cache()


def _counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def test_labels(fixture):
    _, labels = fixture
    assert labels.count() == 21
    assert _counts(labels, "run_state") == {L.LOCALIZABLE: 9, L.NONE: 3, L.CENSORED: 3, L.ORPHAN: 6}
    assert _counts(labels.filter("audit_reason is not null"), "audit_reason") == {"missing_saf_link": 3, "non_kidney_only_saf_outcome": 3}
    assert _counts(labels, "split") == {"train": 7, "validation": 7, "test": 7}


def test_supervised_tables(fixture):
    offers, labels = fixture
    assert L.loss_rows(offers, labels).count() == 96
    scoring = L.scoring_rows(offers, labels)
    assert scoring.count() == 150
    assert scoring.filter("response in ('B', 'Z')").count() == 30
    assert scoring.filter("use_for_loss = 1").count() == 96
    assert scoring.filter("use_for_loss = 1 and response in ('B', 'Z')").count() == 0
    runs = L.run_rows(offers, labels, {}, CONFIG)
    assert _counts(runs, "discard_target") == {1: 3, 0: 12}
    assert runs.agg(F.min("run_len"), F.max("run_len")).first() == (10, 10)
    risk = L.risk_set(offers, labels, CONFIG)
    assert risk.count() == 36 and L.location_rows(offers, labels, CONFIG).count() == 150
    assert risk.groupBy("run_id").agg(F.sum("row_weight").alias("w")).filter("abs(w - 1) > 1e-9").isEmpty()


def test_final_mass(fixture, spark):
    offers, labels = fixture
    rows = L.location_rows(offers, labels, CONFIG)
    segments = N.hazard_to_mass(N.segment_table(rows, []).withColumn("hazard", F.lit(0.3)), "hazard")
    assert segments.groupBy("run_id").agg(F.sum("segment_probability").alias("p")).filter("abs(p - 1) > 1e-9").isEmpty()
    joined = rows.withColumn("segment", N.segment_number(F.col("rank_share"), N.SEGMENTS)).join(segments.select("run_id", "segment", "segment_probability"), ["run_id", "segment"])
    final = N.final_rows(joined.withColumn("discard_probability", (F.col("run_id") % 2).cast("double")))
    by_run = final.groupBy("run_id", "decision").agg(F.sum("row_probability").alias("p")).collect()
    assert all(abs(r.p - (r.decision == "localize")) < 1e-9 for r in by_run)


@pytest.mark.parametrize("discard,decision,rank,mass", [(0.49, "localize", 4, 1.0), (0.5, "discard", None, 0.0)])
def test_single_run_combination(spark, discard, decision, rank, mass):
    data = [(1, 1, 0.1, 1, 0.25, discard), (1, 2, 0.3, 1, 0.25, discard), (1, 3, 0.2, 2, 0.75, discard), (1, 4, 0.4, 2, 0.75, discard)]
    rows = spark.createDataFrame(data, "run_id int, offer_rank int, score double, segment int, segment_probability double, discard_probability double")
    final = N.final_rows(rows, renormalize=True)
    assert abs(final.agg(F.sum("row_probability")).first()[0] - mass) < 1e-12
    best = N.run_predictions(final).first()
    assert (best.decision, best.predicted_rank) == (decision, rank)


def test_hazards_without_mass_are_uniform(spark):
    segments = spark.createDataFrame([(1, 1, 0.0), (1, 2, None), (1, 3, 0.0)], "run_id int, segment int, hazard double")
    assert [round(r.segment_probability, 9) for r in N.hazard_to_mass(segments, "hazard").collect()] == [round(1 / 3, 9)] * 3


def test_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "x int, year int")
    path = f"file://{tmp_path}/t"
    T.write_partitioned(df, path, ["year"])
    with pytest.raises(Exception):
        T.write_partitioned(df, path, ["year"])
    T.write_partitioned(spark.createDataFrame([(3, 2021)], "x int, year int"), path, ["year"], replace=True)
    assert sorted(r.x for r in T.scan(spark, path).collect()) == [1, 3]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(T.MissingColumns, match="b, c"):
        T.require_columns(df, ["c", "a", "b"])


def test_reconcile(spark):
    from sparkruns.operators import profile as P

    a, b = spark.range(5), spark.range(4)
    assert [tuple(r) for r in P.reconcile(a, b, ["id"]).collect()] == [(4, 1, 0)]
    with pytest.raises(P.RowCountMismatch):
        P.assert_reconciled(a, b, ["id"])


def test_valid_at_of_overlapping_intervals(spark):
    """Nested, equal-begin, open, empty and disjoint intervals against all pairs."""
    from sparkruns.operators import joins as J

    history = [(1, 0, 100, "outer"), (1, 10, 20, "inner"), (2, 0, 10, "short"), (2, 0, 50, "long"), (3, 0, None, "open"), (3, 5, 8, "a"), (3, 6, 7, "b"), (3, 9, 9, "empty")]
    history += [(4, 0, 10, "first"), (4, 10, 20, "second"), (4, 30, None, "third"), (5, 0, 20, "x"), (5, 10, 30, "y"), (6, 0, 9, None), (6, 2, 4, "z"), (6, None, 90, "no begin")]
    facts = [(k, t) for k in range(1, 8) for t in range(-1, 105)]
    h = spark.createDataFrame(history, "k int, b long, e long, state string").repartition(3)
    f = spark.createDataFrame(facts, "k int, t long")

    def expected(k, t):
        held = [(b, float("inf") if e is None else e, s) for x, b, e, s in history if x == k and b is not None and b <= t and (e is None or t < e)]
        return max(held, key=lambda x: x[:2])[2] if held else None

    out = {(r.k, r.t): r.state for r in J.valid_at(f, h, ["k"], "t", "b", "e", ["state"]).collect()}
    assert out == {(k, t): expected(k, t) for k, t in facts}
    stamps = lambda df, *names: df.withColumns({n: F.timestamp_seconds(n) for n in names})
    out = J.valid_at(stamps(f, "t"), stamps(h, "b", "e"), ["k"], "t", "b", "e", ["state"])
    assert {(r.k, r.t): r.state for r in out.withColumn("t", F.unix_seconds("t")).collect()} == {(k, t): expected(k, t) for k, t in facts}


def test_valid_at_of_many_random_intervals(spark):
    """A key with most of the intervals, deep nesting, ties in begin and end, null keys and times; neither a Python group nor one task."""
    import random

    from sparkruns.operators import joins as J

    rng = random.Random(4)
    history, facts = [], []
    for i in range(400):
        b = rng.randint(0, 120)
        history.append((rng.choice(["hot", "hot", "hot", "a", None]), b if i % 17 else None, rng.choice([b + rng.randint(0, 90), None]) if rng.random() < 0.95 else None, i % 7, f"s{i}"))
    facts = [(rng.choice(["hot", "hot", "a", "nobody", None]), rng.randint(-2, 230) if i % 13 else None, i) for i in range(500)]
    h = spark.createDataFrame(history, "k string, b long, e long, rank int, state string").repartition(3)
    f = spark.createDataFrame(facts, "k string, t long, i int").repartition(4)
    out = J.valid_at(f, h, ["k"], "t", "b", "e", ["rank", "state"])
    got = {r.i: (r["rank"], r.state) for r in out.collect()}
    for k, t, i in facts:
        held = [(b, e is None, e or 0, rank, s) for x, b, e, rank, s in history if None not in (k, t, b) and x == k and b <= t and (e is None or t < e)]
        assert got[i] == (max(held)[3:] if held else (None, None)), (k, t)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_asof_and_exists_before_over_ranges(spark):
    import random

    from sparkruns.operators import joins as J

    rng = random.Random(6)
    events = [(rng.choice("aab"), 3 * i, i if i % 3 else None) for i in range(120)]
    facts = [(rng.choice(["a", "b", "c"]), rng.randint(-5, 400) if i % 11 else None, i) for i in range(200)]
    out = J.asof_backward(spark.createDataFrame(facts, "k string, t long, i int"), spark.createDataFrame(events, "k string, t long, v int"), ["k"], "t", "v", lag=7)
    for r in out.collect():
        seen = [v for k, t, v in events if r.t is not None and k == r.k and t + 7 <= r.t]
        assert r.v == (seen[-1] if seen else None)
    df = spark.createDataFrame([("r", i, "B" if i == 40 else "N") for i in range(90)] + [("s", 1, "B")], "run string, n int, code string").repartition(5)
    assert {(r.run, r.n): r.flag for r in J.exists_before(df, "run", ["n"], F.col("code") == "B", "flag").collect()} == {("r", i): int(i > 40) for i in range(90)} | {("s", 1): 0}


@pytest.mark.parametrize("radius", [3.0, 250.0, 1500.0, 3700.0])
def test_neighbours_equal_the_full_matrix(spark, radius):
    """Poles, date line, equal sites, missing coordinates; cells instead of a cross join."""
    import random

    from sparkruns.operators import joins as J

    rng = random.Random(7)
    spots = [(90.0, 0.0), (-90.0, 10.0), (89.99, 170.0), (89.99, -20.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.99), (60.0, -179.99), (60.0, 179.9), (None, 1.0), (1.0, None), (0.0, 0.0), (0.0, 0.02)]
    spots += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(120)]
    spots += [(40 + rng.uniform(-3, 3), -75 + rng.uniform(-3, 3)) for _ in range(60)] + [(rng.choice([-1, 1]) * rng.uniform(80, 90), rng.uniform(-180, 180)) for _ in range(60)]
    a = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "a_id int, a_lat double, a_lon double")
    b = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "b_id int, b_lat double, b_lon double")
    full = {(r.a_id, r.b_id) for r in J.distance_matrix(a, b, radius).filter("within = 1").collect()}
    near = J.neighbours(a, b, radius)
    assert sorted(tuple(r) for r in near.select("a_id", "b_id").collect()) == sorted(full)
    assert "CartesianProduct" not in (plan := near._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    counts = {r.a_id: r.n_within for r in J.count_within(a, b, radius).collect()}
    assert counts == {i: sum(x == i for x, _ in full) for i in range(len(spots))}


@pytest.fixture
def shown_buckets(spark):
    """Plans name the buckets that a scan reads, which it also leaves out where plans do not name them."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_lookup_store_reads_one_bucket(spark, tmp_path, shown_buckets):
    """A lookup scans one of the buckets, with the key in the scan's filters; rows are those of a plain filter, nulls and hot keys included."""
    from sparkruns.operators import base as B

    rows = [(i, (i * 7) % 90 if i % 10 else None, i % 5, i % 3, i) for i in range(2000)] + [(5000 + i, 1234, i, 0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "match_id long, px_id long, ptr_sequence_num int, ptr_row_order int, day int").withColumn("match_submit_dt", F.timestamp_seconds(F.col("day") * 86_400))
    B.store(df, B.px_history, "lookup_test", f"file://{tmp_path}/store", buckets=16)
    for value in (7, 1234, 999_999):
        found = B.px_history(spark.table("lookup_test"), value)
        assert [r.match_id for r in found.collect()] == [r.match_id for r in B.px_history(df, value).collect()]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 16" in plan and f"EqualTo(px_id,{value})" in plan
    assert spark.table("lookup_test").filter("px_id is null").count() == 200 and spark.table("lookup_test").count() == len(rows)
    assert len(list((tmp_path / "store").glob("*.parquet"))) <= 16
    spark.sql("DROP TABLE lookup_test")


def test_table_functions_build_their_view_once(spark, sf_dir, monkeypatch, shown_buckets):
    from sparkruns.plans import base_queries as Q
    from sparkruns.plans import catalogue

    built = []
    real = Q.outcome
    monkeypatch.setattr(Q, "outcome", lambda *a: built.append(a) or real(*a))
    monkeypatch.setattr(Q, "_STORES", {})
    plans = [catalogue.queries()[n](spark, sf_dir)._jdf.queryExecution().executedPlan().toString() for n in ("tf02_match_opo_history", "tf02_listing_center_history")]
    assert len(built) == 1 and all("SelectedBucketsCount: 1 out of 8" in p and "Window" not in p for p in plans)
