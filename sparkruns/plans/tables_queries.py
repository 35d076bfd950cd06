"""Queries on scans, sinks, profiles, projections, ranking and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import profile as P
from ..operators import rank as R
from ..operators import score as S
from ..sources import tables as T
from ..sources.lookup import write_lookup
from .bindings import OFFERS, WITH, WITH_LABELS, labels, offers, query, table

_ORDERS_97 = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997"


@query("io01_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def io01(spark, sf_dir):
    return T.scan(spark, f"{sf_dir}/orders.parquet").filter("o_totalprice > 100000 AND o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("io02_write_partitioned", "SELECT o_orderkey, o_custkey, o_totalprice, 1997 AS order_year FROM orders WHERE year(o_orderdate) = 1997")
def io02(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    path = T.scratch_path(spark, "io02")
    T.write_partitioned(o.select("o_orderkey", "o_custkey", "o_totalprice", "order_year"), path, ["order_year"])
    return T.scan(spark, path).filter("order_year = 1997")


@query("io03_sorted_export", _ORDERS_97)
def io03(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    path = T.scratch_path(spark, "io03")
    T.write_partitioned(o.select("o_orderkey", "o_custkey", "o_totalprice", "order_year"), path, ["order_year"], replace=True, sort=["o_custkey", "o_orderkey"])
    return T.scan(spark, path).filter("order_year = 1997").drop("order_year")


@query("io04_write_table", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def io04(spark, sf_dir):
    path = T.scratch_path(spark, "io04")
    T.write_table(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    return T.scan(spark, path)


@query("io05_normalize_names", 'SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY" FROM nation')
def io05(spark, sf_dir):
    return T.normalize_names(table(spark, sf_dir, "nation"), "upper")


@query("io06_canonicalize", "SELECT l_orderkey AS match_id, l_partkey AS px_id, l_linenumber AS offer_rank FROM lineitem")
def io06(spark, sf_dir):
    aliases = {"match_id": ["run", "l_orderkey"], "px_id": ["l_partkey", "candidate"], "offer_rank": ["l_linenumber"]}
    return T.canonicalize(table(spark, sf_dir, "lineitem"), aliases).select("match_id", "px_id", "offer_rank")


_RAW = """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE CAST(event_id % 1000 AS VARCHAR) END AS a,
 CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS b, CASE WHEN event_id % 3 = 0 THEN 'never' ELSE CAST(ts AS VARCHAR) END AS c FROM events"""


@query("io07_coerce", f"SELECT event_id, TRY_CAST(a AS BIGINT) AS a, round(TRY_CAST(b AS DOUBLE), 6) AS b, strftime(TRY_CAST(c AS TIMESTAMP), '%H:%M:%S') AS c FROM ({_RAW})")
def io07(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "event_id")).otherwise((F.col("event_id") % 1000).cast("string")).alias("a"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("b"), F.when(F.col("event_id") % 3 == 0, "never").otherwise(F.col("ts").cast("string")).alias("c"),
    )
    return T.coerce(raw, {"a": "int", "b": "float", "c": "time"}).withColumn("b", F.round("b", 6))


_PERIOD = "SELECT o_orderkey, year(o_orderdate)::INT AS period, year(o_orderdate) = 1995 + o_custkey % 7 AS in_nominal FROM orders"


def _period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("source_year", F.lit(1995) + F.col("o_custkey") % 7)
    return T.with_period(o, "o_orderdate", "source_year")


@query("io08_with_period", _PERIOD)
def io08(spark, sf_dir):
    return _period(spark, sf_dir).select("o_orderkey", "period", "in_nominal")


@query("io09_split_overlap", f"SELECT o_orderkey, CASE WHEN in_nominal THEN 'in' ELSE 'out' END AS side FROM ({_PERIOD})")
def io09(spark, sf_dir):
    inside, outside = T.split_overlap(_period(spark, sf_dir))
    side = lambda d, s: d.select("o_orderkey", F.lit(s).alias("side"))
    return side(inside, "in").unionByName(side(outside, "out"))


@query("io10_period_slice", f"SELECT o_orderkey FROM ({_PERIOD}) WHERE period = 1998")
def io10(spark, sf_dir):
    return T.period_slice(_period(spark, sf_dir), "period", 1998, "orders_1998").select("o_orderkey")


@query("io11_lookup_table", f"{WITH} SELECT run_id, candidate, offer_rank, response FROM offers")
def io11(spark, sf_dir):
    """Kept in buckets of its key, and read back as a table."""
    name = f"lookup_{uuid.uuid4().hex}"
    rows = T.lookup_table(offers(spark, sf_dir), ["run_id"], ["candidate", "offer_rank", "response"])
    write_lookup(rows, name, "run_id", ["offer_rank"], T.scratch_path(spark, name))
    return spark.table(name)


@query("io12_require_columns", "SELECT c_custkey, c_name FROM customer")
def io12(spark, sf_dir):
    return T.require_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"]).select("c_custkey", "c_name")


@query("io13_explode_labels", """
WITH raw AS (SELECT 'fmt' || n_regionkey AS fmt, n_regionkey, CASE WHEN n_nationkey % 6 = 0 THEN '.' || n_name WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS k, ' ' || n_name || ' ' AS v, n_nationkey FROM nation)
SELECT fmt, (row_number() OVER (PARTITION BY fmt ORDER BY n_nationkey) - 1)::INT AS place, k AS raw_text, TRY_CAST(k AS DOUBLE) AS raw_number,
 CASE WHEN TRY_CAST(k AS DOUBLE) IS NULL THEN 'string' ELSE 'number' END AS kind, starts_with(k, '.') AS is_missing, trim(v) AS label FROM raw""")
def io13(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("."), "n_name")).when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string"))
    entries = F.sort_array(F.collect_list(F.struct("n_nationkey", key.alias("k"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("v"))))
    catalogue = n.groupBy(F.concat(F.lit("fmt"), "n_regionkey").alias("fmt")).agg(entries.alias("e"))
    catalogue = catalogue.select("fmt", F.map_from_arrays(F.col("e.k"), F.col("e.v")).alias("labels"))
    return T.explode_labels(catalogue, "fmt", "labels")


@query("io14_scan_optional", "SELECT r_regionkey, r_name FROM region")
def io14(spark, sf_dir):
    schema = "r_regionkey int, r_name string"
    there = T.scan_optional(spark, f"{sf_dir}/region.parquet", schema).select("r_regionkey", "r_name")
    return there.unionByName(T.scan_optional(spark, f"{sf_dir}/no_such_table.parquet", schema))


@query("dq01_profile_partitions", """
SELECT p, count(*) AS n_rows, count(*) FILTER (y = p) AS in_period, count(*) FILTER (y = p - 1) AS prior_period, count(*) FILTER (y = p + 1) AS next_period,
 0 AS null_o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_ts, strftime(max(o_orderdate), '%Y-%m-%d') AS last_ts
FROM (SELECT *, year(o_orderdate)::INT AS y, (1995 + o_custkey % 7)::INT AS p FROM orders) GROUP BY p""")
def dq01(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", (F.lit(1995) + F.col("o_custkey") % 7).cast("int"))
    out = P.profile_partitions(o, "p", "o_orderdate", ["o_custkey"])
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_ts", "last_ts")})


@query("dq02_profile_tables", "SELECT 'nation' AS table_name, count(*) AS n_rows, 3 AS n_columns FROM nation UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem")
def dq02(spark, sf_dir):
    return P.profile_tables({t: table(spark, sf_dir, t) for t in ("nation", "orders", "lineitem")})


@query("dq03_reconcile", """
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS left_rows, coalesce(b.n, 0)::BIGINT AS right_rows
FROM (SELECT o_custkey % 50 AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer WHERE c_custkey % 50 < 40 GROUP BY 1) b ON a.k = b.k
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def dq03(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"))
    right = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("k")).filter("k < 40")
    return P.reconcile(left, right, ["k"])


@query("dq04_drift_groups", "SELECT l_orderkey, min(l_returnflag) AS least, max(l_returnflag) AS most, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND min(l_returnflag) IS DISTINCT FROM max(l_returnflag)")
def dq04(spark, sf_dir):
    return P.drift_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("dq05_verify_first_keys", """
SELECT least(1000, count(*)) AS checked, least(1000, count(*)) AS agreeing FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 1)""")
def dq05(spark, sf_dir):
    from ..operators.freeze import first_keys

    o = offers(spark, sf_dir)
    first = first_keys(o, ["run_id", "candidate"], ["seq", "offer_rank"], least_rows=1)
    return P.verify_first_keys(first, o, ["run_id", "candidate"], ["seq", "offer_rank"], 1000)


@query("dq06_state_counts", f"{WITH_LABELS} SELECT run_state, count(*) AS n FROM labels GROUP BY 1")
def dq06(spark, sf_dir):
    return P.state_counts(labels(spark, sf_dir), "run_state")


@query("dq07_audit_runs", f"{WITH_LABELS} SELECT run_id, audit_reason, y_rows FROM labels WHERE run_state = 'audit_orphan_y'")
def dq07(spark, sf_dir):
    from ..operators.labels import audit_runs

    return audit_runs(labels(spark, sf_dir)).select("run_id", "audit_reason", "y_rows")


@query("pr03_flag", "SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN v > 50 THEN 1 ELSE 0 END AS high FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS v FROM events)")
def pr03(spark, sf_dir):
    v = F.when(F.col("event_id") % 11 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.flag(v, v > 50).alias("high"))


@query("pr05_component_sum", """
SELECT l_orderkey, l_linenumber, l_partkey, t AS total, CASE WHEN t BETWEEN 0 AND 6 THEN CAST(t AS VARCHAR) END AS bucket
FROM (SELECT *, (CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_linenumber % 3 END + l_partkey % 3 + l_suppkey % 4)::BIGINT AS t FROM lineitem)""")
def pr05(spark, sf_dir):
    a = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linenumber") % 3)
    total = C.component_sum(a, F.col("l_partkey") % 3, F.col("l_suppkey") % 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", total.alias("total"), C.whole_bucket(total, 0, 6).alias("bucket"))


@query("pr06_bucketize", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 10 THEN '0-10' WHEN l_quantity <= 25 THEN '10-25' WHEN l_quantity <= 45 THEN '25-45' END AS bin,
 CASE WHEN l_discount <= 0.02 THEN 'early' WHEN l_discount <= 0.06 THEN 'mid' ELSE 'late' END AS timing FROM lineitem""")
def pr06(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", C.bucketize(F.col("l_quantity"), [10, 25, 45], ["0-10", "10-25", "25-45"]).alias("bin"),
        C.bucketize(F.col("l_discount"), [0.02, 0.06], ["early", "mid", "late"]).alias("timing"),
    )


@query("pr07_assign_split", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'history' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split FROM orders")
def pr07(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.assign_split(F.col("o_orderdate").cast("timestamp"), "1997-01-01", "1999-01-01", "2000-01-01").alias("split"))


@query("pr09_rate", f"{WITH} SELECT center, round(count(*) FILTER (response = 'Y') * 1.0 / nullif(count(*) FILTER (response IN ('Y', 'N')), 0), 6) AS rate FROM offers GROUP BY 1")
def pr09(spark, sf_dir):
    yes, no = F.count_if(F.col("response") == "Y"), F.count_if(F.col("response") == "N")
    return offers(spark, sf_dir).groupBy("center").agg(C.rate(yes, no).alias("rate"))


@query("pr10_row_id")
def pr10(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = R.instance_ordinal(table(spark, sf_dir, "lineitem"), keys, ["l_orderkey"])
    return rows.select("l_orderkey", "l_linenumber", C.row_id(*(F.col(k) for k in [*keys, "instance"])).alias("row_id"))


def _donors(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    gap = lambda n, v: F.when(k % n != 0, v)
    return c.select(
        k.alias("donor"), (F.lit(2010) + k % 17).cast("int").alias("year"), (k % 80).cast("double").alias("age"), (F.lit(140) + k % 60).cast("double").alias("height"), (F.lit(40) + k % 70).cast("double").alias("weight"),
        gap(6, k % 2).alias("htn"), gap(9, F.lit(1) + k % 5).alias("diab"), (F.lit(1) + k % 4).alias("cod"), gap(5, (k % 100) / 10.0).alias("creat"), gap(7, (k % 50) / 10.0).alias("final_creat"), F.lit(None).cast("double").alias("peak_creat"),
        F.when(k % 13 == 0, "").when(k % 3 == 0, "BLACK").otherwise("WHITE").alias("race"), F.when(k % 10 == 0, "P").otherwise("N").alias("anti_hcv"), F.lit("N").alias("hcv_nat"), (k % 12).alias("hcv_stat"), F.when(k % 4 == 0, "Y").otherwise("N").alias("dcd"),
    )


def _scales(spark):
    return spark.range(2012, 2026).select(F.col("id").cast("int").alias("year"), (F.lit(0.3) + (F.col("id") - 2012) * 0.01).alias("htn_scale"), (F.lit(0.1) + (F.col("id") - 2012) * 0.005).alias("diab_scale"), (F.lit(1.2) + (F.col("id") - 2012) * 0.02).alias("risk_scale"))


_DONORS = """donors AS (SELECT c_custkey AS k, (2010 + c_custkey % 17)::INT AS year, (c_custkey % 80)::DOUBLE AS age, (140 + c_custkey % 60)::DOUBLE AS height, (40 + c_custkey % 70)::DOUBLE AS weight,
 CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 2 END AS htn, CASE WHEN c_custkey % 9 <> 0 THEN 1 + c_custkey % 5 END AS diab, 1 + c_custkey % 4 AS cod,
 least(8.0::DOUBLE, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 100)::DOUBLE / 10 END, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 50)::DOUBLE / 10 END)) AS cr,
 CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'BLACK' ELSE 'WHITE' END AS race, c_custkey % 10 = 0 OR c_custkey % 12 = 1 AS hcv, c_custkey % 4 = 0 AS dcd FROM customer
), scales AS (SELECT y::INT AS year, 0.3::DOUBLE + (y - 2012) * 0.01::DOUBLE AS hs, 0.1::DOUBLE + (y - 2012) * 0.005::DOUBLE AS ds, 1.2::DOUBLE + (y - 2012) * 0.02::DOUBLE AS rs FROM range(2012, 2026) t(y)
), terms AS (SELECT donors.*, hs, ds, rs, CASE WHEN cr IS NULL THEN NULL WHEN cr > 1.5 THEN cr - 1.5 ELSE 0 END AS over FROM donors LEFT JOIN scales USING (year)
), sums AS (SELECT *,
 0.0128 * (age - 40) + CASE WHEN age > 50 THEN 0.0107 * (age - 50) WHEN age < 18 THEN -0.0194 * (age - 18) ELSE 0 END - 0.0464 * (height - 170) / 10 + CASE WHEN weight < 80 THEN -0.0199 * (weight - 80) / 5 ELSE 0 END
 + CASE WHEN race = '' THEN NULL WHEN race = 'BLACK' THEN 0.1790 ELSE 0 END + CASE WHEN htn IS NULL THEN 0.1260 * hs WHEN htn = 1 THEN 0.1260 ELSE 0 END + CASE WHEN diab IS NULL THEN 0.13 * ds WHEN diab = 1 THEN 0 ELSE 0.13 END
 + CASE WHEN cod = 2 THEN 0.0881 ELSE 0 END + CASE WHEN cr IS NULL THEN 0 ELSE 0.22 * (cr - 1) - 0.2090 * over END + CASE WHEN hcv THEN 0.24 ELSE 0 END + CASE WHEN dcd THEN 0.1330 ELSE 0 END AS early,
 0.0092 * (age - 40) + CASE WHEN age > 50 THEN 0.0067 * (age - 50) WHEN age < 18 THEN 0.0113 * (age - 18) ELSE 0 END - 0.0557 * (height - 170) / 10 + CASE WHEN weight < 80 THEN -0.0333 * (weight - 80) / 5 ELSE 0 END
 + CASE WHEN htn IS NULL THEN 0.1106 * hs WHEN htn = 1 THEN 0.1106 ELSE 0 END + CASE WHEN diab IS NULL THEN 0.2577 * ds WHEN diab = 1 THEN 0 ELSE 0.2577 END + CASE WHEN cod = 2 THEN 0.0743 ELSE 0 END
 + CASE WHEN cr IS NULL THEN 0 ELSE 0.2128 * (cr - 1) - 0.2199 * over END + CASE WHEN dcd THEN 0.1966 ELSE 0 END AS late FROM terms
), risks AS (SELECT *, CASE WHEN year BETWEEN 2012 AND 2022 THEN exp(early::DOUBLE) WHEN year BETWEEN 2023 AND 2025 THEN exp(late::DOUBLE) END AS risk FROM sums)"""


@query("pr12_risk_score", f"WITH {_DONORS} SELECT k AS donor, round(risk, 6) AS risk, round(risk / rs, 6) AS scaled_risk FROM risks")
def pr12(spark, sf_dir):
    out = S.risk_score(_donors(spark, sf_dir), _scales(spark))
    return out.select("donor", F.round("risk", 6).alias("risk"), F.round("scaled_risk", 6).alias("scaled_risk"))


@query("pr13_threshold_rank", f"""WITH {_DONORS} SELECT k AS donor, p AS percentile, CASE WHEN p < 0 THEN NULL WHEN p <= 20 THEN '0-20' WHEN p <= 40 THEN '20-40' WHEN p <= 60 THEN '40-60' WHEN p <= 80 THEN '60-80' WHEN p <= 100 THEN '80-100' END AS bin
FROM (SELECT k, CASE WHEN risk / rs > 0 THEN least(101, greatest(0, (SELECT count(*) FROM range(0, 101) t(i) WHERE 0.35::DOUBLE + i * 0.025::DOUBLE < risk / rs)))::INT END AS p FROM risks)""")
def pr13(spark, sf_dir):
    bounds = spark.range(2012, 2026).select(F.col("id").cast("int").alias("year"), F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: F.lit(0.35) + i * F.lit(0.025)).alias("bounds"))
    scored = S.risk_score(_donors(spark, sf_dir), _scales(spark))
    out = S.threshold_rank(scored, bounds, "scaled_risk", "year", "bounds", "percentile")
    return out.select("donor", "percentile", C.bucketize(F.col("percentile"), [20, 40, 60, 80, 100], S.SCORE_BINS, lower=0).alias("bin"))


# ranking


@query("rk01_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1")
def rk01(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["-ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("rk02_preferred_type", "SELECT c_nationkey, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'HOUSEHOLD' THEN 1 ELSE 2 END, c_name, c_custkey) AS n FROM customer) WHERE n = 1")
def rk02(spark, sf_dir):
    return R.preferred_type(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", ["MACHINERY", "HOUSEHOLD"], ["c_name", "c_custkey"]).select("c_nationkey", "c_custkey", "c_mktsegment")


@query("rk03_instance_ordinal", "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice))::INT AS instance FROM lineitem")
def rk03(spark, sf_dir):
    return R.instance_ordinal(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "instance")


@query("rk04_offer_rank", f"{WITH} SELECT run_id, candidate, center, offer_rank FROM offers")
def rk04(spark, sf_dir):
    return offers(spark, sf_dir).select("run_id", "candidate", "center", "offer_rank")


@query("rk05_sort_key", f"{WITH} SELECT run_id, offer_rank, (at_us + row_number() OVER (PARTITION BY center, at_us ORDER BY run_id, offer_rank) - 1)::BIGINT AS sort_micros FROM offers")
def rk05(spark, sf_dir):
    return R.sort_key(offers(spark, sf_dir), ["center"], "at_us", ["run_id", "offer_rank"]).select("run_id", "offer_rank", "sort_micros")


@query("rk06_nth_event", f"{WITH} SELECT run_id, offer_rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY offer_rank) AS n FROM offers WHERE response = 'Y') WHERE n = 2")
def rk06(spark, sf_dir):
    return R.nth_event(offers(spark, sf_dir), "run_id", F.col("response") == "Y", ["offer_rank"], 2).select("run_id", "offer_rank")


@query("rk07_first_row_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def rk07(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("rk08_best_row", f"{WITH} SELECT run_id, offer_rank, score_points FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score_points DESC, offer_rank) AS n FROM offers) WHERE n = 1")
def rk08(spark, sf_dir):
    return R.best_row(offers(spark, sf_dir), "run_id", "score_points", "offer_rank").select("run_id", "offer_rank", "score_points")


@query("rk09_top_rows", f"{WITH} SELECT * FROM (SELECT run_id, offer_rank, (row_number() OVER (PARTITION BY run_id ORDER BY score_points DESC, offer_rank))::INT AS place FROM offers) WHERE place <= 3")
def rk09(spark, sf_dir):
    return R.top_rows(offers(spark, sf_dir), "run_id", "score_points", "offer_rank", 3).select("run_id", "offer_rank", "place")


@query("rk10_limit_runs", f"""{WITH}, firsts AS (SELECT status, run_id, row_number() OVER (PARTITION BY status ORDER BY min(at_us), run_id) AS n FROM offers GROUP BY 1, 2)
SELECT run_id, offer_rank, status FROM offers SEMI JOIN (SELECT * FROM firsts WHERE n <= 40) f USING (status, run_id)""")
def rk10(spark, sf_dir):
    return R.limit_runs(offers(spark, sf_dir), "run_id", "status", "at_us", 40).select("run_id", "offer_rank", "status")


@query("rk11_distinct_on", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def rk11(spark, sf_dir):
    return R.distinct_on(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("rk12_priority_match", f"""{WITH} SELECT run_id, offer_rank, center FROM (SELECT o.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE response WHEN 'Y' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, seq, offer_rank) AS n
 FROM orders JOIN offers o ON o_orderkey = run_id WHERE o_orderstatus = 'F') WHERE n = 1""")
def rk12(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    priority = F.when(F.col("response") == "Y", 0).when(F.col("response") == "N", 1).otherwise(2)
    return R.priority_match(facts, offers(spark, sf_dir), ["run_id"], "run_id", priority, ["seq", "offer_rank"]).select("run_id", "offer_rank", "center")


@query("pr10_row_id_full", "SELECT count(*) AS n_rows, count(*) AS n_ids, 14 AS n_columns FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def pr10_full(spark, sf_dir):
    """Row ids of fourteen columns and the instance ordinal tell all offers apart."""
    from ..operators.base import ID_COLUMNS
    from .base_queries import base

    ids = base(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("match_run_rowid").alias("n_ids"))
    return ids.withColumn("n_columns", F.lit(len(ID_COLUMNS)))


# joins


@query("jn01_enrich", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn01(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return J.enrich(c, [(table(spark, sf_dir, "nation"), ["n_nationkey"]), (r, ["n_regionkey"])]).select("c_custkey", "n_name", "r_name")


@query("jn02_enrich_compound", """
WITH f AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS kind FROM customer),
 d AS (SELECT c_nationkey, CASE WHEN g % 2 = 0 THEN NULL ELSE 'MACHINERY' END AS kind, g AS value FROM (SELECT n_nationkey AS c_nationkey, unnest([0, 1]) AS g FROM nation))
SELECT c_custkey, value FROM f LEFT JOIN d ON f.c_nationkey = d.c_nationkey AND coalesce(f.kind, '') = coalesce(d.kind, '')""")
def jn02(spark, sf_dir):
    fact = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("kind"))
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("value"))
    dim = dim.withColumn("kind", F.when(F.col("value") % 2 != 0, "MACHINERY"))
    return J.enrich_compound(fact, dim, "c_nationkey", "kind").select("c_custkey", "value")


@query("jn03_valid_at", """
WITH h AS (SELECT user_id, ts AS b, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, event_type AS state FROM events),
 f AS (SELECT event_id, user_id, ts + INTERVAL 90 SECOND AS t FROM events)
SELECT event_id, state FROM (SELECT f.event_id, h.state, row_number() OVER (PARTITION BY f.event_id ORDER BY h.b DESC NULLS LAST) AS n FROM f LEFT JOIN h ON f.user_id = h.user_id AND h.b <= f.t AND (h.e IS NULL OR f.t < h.e)) WHERE n = 1""")
def jn03(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("b", C.micros(F.col("ts")))
    history = e.select("user_id", "b", F.lead("b").over(Window.partitionBy("user_id").orderBy("b", "event_id")).alias("e"), F.col("event_type").alias("state"))
    facts = e.select("event_id", "user_id", (F.col("b") + 90_000_000).alias("t"))
    return J.valid_at(facts, history, ["user_id"], "t", "b", "e", ["state"]).select("event_id", "state")


_NESTED = """WITH h AS (SELECT user_id, epoch_us(ts) AS b, CASE WHEN event_id % 9 <> 0 THEN epoch_us(ts) + (1 + event_id % 5) * 20000000000 END AS e, event_type AS state, event_id AS n FROM events)"""


@query("jn03_valid_at_nested", f"""{_NESTED}, f AS (SELECT event_id, user_id, epoch_us(ts) + 15000000000 AS t FROM events)
SELECT f.event_id, h.state FROM f LEFT JOIN h ON f.user_id = h.user_id AND h.b <= f.t AND (h.e IS NULL OR f.t < h.e) QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY h.b DESC NULLS LAST, h.e DESC NULLS FIRST) = 1""")
def jn03_nested(spark, sf_dir):
    """Intervals of a user that overlap and nest: of those that hold the fact, the latest-begun counts."""
    e = table(spark, sf_dir, "events").withColumn("b", C.micros(F.col("ts")))
    history = e.select("user_id", "b", F.when(F.col("event_id") % 9 != 0, F.col("b") + (1 + F.col("event_id") % 5) * 20_000_000_000).alias("e"), F.col("event_type").alias("state"))
    facts = e.select("event_id", "user_id", (F.col("b") + 15_000_000_000).alias("t"))
    return J.valid_at(facts, history, ["user_id"], "t", "b", "e", ["state"]).select("event_id", "state")


@query("jn04_asof_backward", """
SELECT f.event_id, p.value AS last_value FROM (SELECT event_id, user_id, ts - INTERVAL 1 HOUR AS t FROM events) f ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON f.user_id = p.user_id AND f.t >= p.ts""")
def jn04(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", C.micros(F.col("ts")))
    purchases = e.filter("event_type = 'purchase'").select("user_id", "at", F.col("value").alias("last_value"))
    return J.asof_backward(e.select("event_id", "user_id", "at"), purchases, ["user_id"], "at", "last_value", lag=3_600_000_000).select("event_id", "last_value")


@query("jn05_exists_flag", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 1 ELSE 0 END AS has_placed FROM customer")
def jn05(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.exists_flag(table(spark, sf_dir, "customer"), keys, ["c_custkey"], "has_placed").select("c_custkey", "has_placed")


@query("jn06_exists_before", f"{WITH} SELECT run_id, offer_rank, CASE WHEN EXISTS (SELECT 1 FROM offers b WHERE b.run_id = o.run_id AND b.offer_rank < o.offer_rank AND b.response = 'B') THEN 1 ELSE 0 END AS bypassed FROM offers o")
def jn06(spark, sf_dir):
    return J.exists_before(offers(spark, sf_dir), "run_id", ["offer_rank"], F.col("response") == "B", "bypassed").select("run_id", "offer_rank", "bypassed")


_SITES = "SELECT {k} AS id, 25.0::DOUBLE + {n} AS lat, -120.0::DOUBLE + 2 * {n} AS lon FROM {t}"
_DIST = f"""WITH a AS ({_SITES.format(k='s_suppkey', n='(s_nationkey + s_suppkey % 7)', t='supplier')}), b AS ({_SITES.format(k='n_nationkey', n='n_nationkey', t='nation')}),
d AS (SELECT a.id AS a_id, b.id AS b_id, 2 * 3440.065 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS nm FROM a CROSS JOIN b)"""


def _sites(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    at = F.col("s_nationkey") + F.col("s_suppkey") % 7
    a = s.select(F.col("s_suppkey").alias("a_id"), (F.lit(25.0) + at).alias("a_lat"), (F.lit(-120.0) + 2 * at).alias("a_lon"))
    b = n.select(F.col("n_nationkey").alias("b_id"), (F.lit(25.0) + F.col("n_nationkey")).alias("b_lat"), (F.lit(-120.0) + 2 * F.col("n_nationkey")).alias("b_lon"))
    return a, b


@query("jn07_distance_matrix", f"{_DIST} SELECT a_id, b_id, round(nm, 4) AS distance_nm, CASE WHEN nm <= 250 THEN 1 ELSE 0 END AS within FROM d")
def jn07(spark, sf_dir):
    return J.distance_matrix(*_sites(spark, sf_dir), 250.0).withColumn("distance_nm", F.round("distance_nm", 4))


@query("jn07_count_within", f"{_DIST} SELECT a_id, sum(CASE WHEN nm <= 250 THEN 1 ELSE 0 END)::BIGINT AS n_within FROM d GROUP BY 1")
def jn07_count(spark, sf_dir):
    return J.count_within(*_sites(spark, sf_dir), 250.0)


_CODE = "lpad(CAST(CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 50000000 ELSE c_custkey END AS {t}), 9, '0')"


@query("jn08_geocode", f"""
WITH s AS (SELECT c_custkey AS site, CASE WHEN c_custkey % 11 <> 0 THEN {_CODE.format(t='VARCHAR')} END AS zip, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 = 0 THEN concat('far ', c_custkey % 90) ELSE concat(c_mktsegment, c_nationkey) END AS city FROM customer),
 p AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS zip, CASE WHEN c_custkey % 3 = 0 THEN concat('far ', c_custkey % 60) ELSE concat(c_mktsegment, c_nationkey) END AS city, 20.0::DOUBLE + c_custkey % 30 AS lat, -70.0::DOUBLE - c_custkey % 40 AS lon FROM customer),
 f AS (SELECT s.*, p.lat AS zlat, p.lon AS zlon FROM s LEFT JOIN p ON s.zip = p.zip),
 o AS (SELECT city, avg(zlat) AS olat, avg(zlon) AS olon FROM f WHERE zlat IS NOT NULL GROUP BY 1), c AS (SELECT city, avg(lat) AS clat, avg(lon) AS clon FROM p GROUP BY 1)
SELECT site, round(coalesce(zlat, olat, clat), 6) AS lat, round(coalesce(zlon, olon, clon), 6) AS lon, CASE WHEN zlat IS NOT NULL THEN 'zip' WHEN olat IS NOT NULL THEN 'sites_of_city' WHEN clat IS NOT NULL THEN 'city' END AS geo_source
FROM f LEFT JOIN o USING (city) LEFT JOIN c USING (city)""")
def jn08(spark, sf_dir):
    """Sites and codes are as many as customers; some sites have no code or one that is not listed, and some cities no coded site."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    home, far = F.concat("c_mktsegment", "c_nationkey"), lambda n: F.concat(F.lit("far "), k % n)
    sites = c.select(k.alias("site"), F.when(k % 11 != 0, F.expr(_CODE.format(t="STRING"))).alias("zip"), F.when((k % 5 == 0) & (k % 7 == 0), far(90)).otherwise(home).alias("city"))
    postal = c.select(F.lpad(k.cast("string"), 9, "0").alias("zip"), F.when(k % 3 == 0, far(60)).otherwise(home).alias("city"), (F.lit(20.0) + k % 30).alias("lat"), (F.lit(-70.0) - k % 40).alias("lon"))
    return J.geocode(sites, postal).withColumns({x: F.round(x, 6) for x in ("lat", "lon")})


@query("jn09_update_from", "SELECT c_custkey, t AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def jn09(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("c_acctbal"))
    return J.update_from(table(spark, sf_dir, "customer"), new, ["c_custkey"], "c_acctbal").select("c_custkey", "c_acctbal")


_BRIDGE = f"""{WITH}, disposition AS (SELECT DISTINCT donor, candidate FROM offers WHERE response = 'Y'), transplants AS (SELECT donor, candidate, min(run_id) AS transplant FROM offers WHERE response = 'Y' AND dcd = 1 GROUP BY 1, 2),
 followups AS (SELECT run_id AS transplant, offer_rank AS followup_id, at_us + offer_rank % 3 AS followup_ts, score_points AS creat FROM offers),
 bridge AS (SELECT d.donor, d.candidate, t.transplant, c_mktsegment AS donor_kind, f.creat FROM disposition d LEFT JOIN transplants t USING (donor, candidate) LEFT JOIN customer ON d.donor = c_custkey
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transplant ORDER BY followup_ts DESC, followup_id DESC) AS n FROM followups) WHERE n = 1) f ON t.transplant = f.transplant)"""


def _bridge(spark, sf_dir):
    o = offers(spark, sf_dir)
    yes = o.filter("response = 'Y'")
    transplants = yes.filter("dcd = 1").groupBy("donor", "candidate").agg(F.min("run_id").alias("transplant"))
    donors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("donor"), F.col("c_mktsegment").alias("donor_kind"))
    followups = o.select(F.col("run_id").alias("transplant"), F.col("offer_rank").alias("followup_id"), (F.col("at_us") + F.col("offer_rank") % 3).alias("followup_ts"), F.col("score_points").alias("creat"))
    return J.bridge(yes.select("donor", "candidate").distinct(), transplants, donors, followups).select("donor", "candidate", "transplant", "donor_kind", "creat")


@query("jn10_bridge", f"{_BRIDGE} SELECT * FROM bridge")
def jn10(spark, sf_dir):
    return _bridge(spark, sf_dir)


@query("jn11_offers_with_outcome", f"{_BRIDGE} SELECT run_id, offer_rank, transplant, creat FROM offers LEFT JOIN bridge USING (donor, candidate)")
def jn11(spark, sf_dir):
    return J.offers_with_outcome(offers(spark, sf_dir), _bridge(spark, sf_dir), ["donor", "candidate"]).select("run_id", "offer_rank", "transplant", "creat")


@query("jn13_key_values", f"{WITH} SELECT run_id, center, min(offer_rank) AS offer_rank, arg_min(score_points, offer_rank) AS score_points FROM offers GROUP BY 1, 2 HAVING count(*) > 1")
def jn13(spark, sf_dir):
    from ..operators.freeze import first_keys, key_values

    o = offers(spark, sf_dir)
    return key_values(first_keys(o, ["run_id", "center"], ["offer_rank"]), o, ["run_id", "center", "offer_rank"], ["score_points"]).drop("n_rows")


@query("jn15_mode_feasible", f"""{WITH_LABELS}, h AS (SELECT first_y_rank AS r, count(*) AS n FROM labels WHERE split = 'train' AND first_y_rank IS NOT NULL GROUP BY 1)
SELECT run_id, run_len, coalesce((SELECT r FROM h WHERE r <= run_len ORDER BY n DESC, r LIMIT 1), 1)::BIGINT AS predicted_rank FROM labels WHERE split = 'test'""")
def jn15(spark, sf_dir):
    lab = labels(spark, sf_dir)
    return J.mode_feasible(lab.filter("split = 'train' AND first_y_rank IS NOT NULL"), lab.filter("split = 'test'").select("run_id", "run_len"), "first_y_rank", "run_len").select("run_id", "run_len", "predicted_rank")


@query("so01_union_streams", "SELECT o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT event_id, value, event_type FROM events")
def so01(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("so02_concat_splits", f"{WITH_LABELS} SELECT split, count(*) AS n, sum(run_len)::BIGINT AS n_rows FROM labels WHERE split <> 'history' GROUP BY 1")
def so02(spark, sf_dir):
    """One grouped query for all splits takes the place of a loop over them."""
    return labels(spark, sf_dir).filter("split <> 'history'").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("run_len").alias("n_rows"))


@query("sf01_calendar_parts", "SELECT event_id, isodow(ts)::INT AS weekday, (1 + floor((day(ts) - 1) / 7.0))::INT AS week_of_month, month(ts)::INT AS month, hour(ts)::INT AS hour FROM events")
def sf01(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", C.iso_weekday(ts).alias("weekday"), C.week_of_month(ts).alias("week_of_month"), F.month(ts).alias("month"), F.hour(ts).alias("hour"))


@query("sf02_age_and_elapsed", "SELECT o_orderkey, round((o_custkey % 80)::DOUBLE + greatest(epoch_us(o_orderdate) // 1000000 - 852076800, 0) / 31556952.0, 6) AS age, round((epoch_us(o_orderdate) // 1000000 - 788918400) / 86400.0, 6) AS days FROM orders")
def sf02(spark, sf_dir):
    ts, base = F.col("o_orderdate"), F.lit("1997-01-01").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.age_at((F.col("o_custkey") % 80).cast("double"), base, ts).alias("age"), C.elapsed_days(F.lit("1995-01-01").cast("timestamp"), ts).alias("days"))


@query("sf04_text_keys", r"""
SELECT c_custkey, nullif(nullif(regexp_extract(c_name, '(\d{5})', 1), ''), '99999') AS code,
 nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(p), '[^A-Z0-9 ]', ' ', 'g'), '\bST\b', 'SAINT', 'g'), '\bFT\b', 'FORT', 'g'), '\bMT\b', 'MOUNT', 'g'), '\s+', ' ', 'g')), '') AS place
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'St. ' WHEN 1 THEN 'Ft ' WHEN 2 THEN 'mt.-' ELSE '' END || c_mktsegment || ' ' || c_nationkey AS p FROM customer)""")
def sf04(spark, sf_dir):
    k = F.col("c_custkey") % 4
    p = F.concat(F.when(k == 0, "St. ").when(k == 1, "Ft ").when(k == 2, "mt.-").otherwise(""), "c_mktsegment", F.lit(" "), "c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", C.five_digits(F.col("c_name")).alias("code"), C.place_key(p).alias("place"))


@query("sf07_number_text", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity_text FROM lineitem")
def sf07(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.number_text(F.col("l_quantity")).alias("quantity_text"))


@query("tf01_lookup_run", f"WITH {OFFERS} SELECT run_id, offer_rank, response FROM offers WHERE run_id = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def tf01(spark, sf_dir):
    from ..operators.rollups import history_of

    o = offers(spark, sf_dir)
    return history_of(o, "run_id", o.agg(F.max("run_id")).first()[0], ["offer_rank"]).select("run_id", "offer_rank", "response")


@query("tf02_outcome_history", f"{_BRIDGE} SELECT run_id, offer_rank, center, transplant FROM offers LEFT JOIN bridge USING (donor, candidate) WHERE center = (SELECT min(center) FROM offers)")
def tf02(spark, sf_dir):
    from ..operators.rollups import history_of

    o = offers(spark, sf_dir)
    both = J.offers_with_outcome(o, _bridge(spark, sf_dir), ["donor", "candidate"])
    return history_of(both, "center", o.agg(F.min("center")).first()[0], ["at_us", "run_id", "offer_rank"]).select("run_id", "offer_rank", "center", "transplant")
