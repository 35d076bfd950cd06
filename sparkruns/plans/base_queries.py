"""Queries on typed dimensions, the composed offer base, its views, and histories of one participant.

Registry tables are bound to the test tables by expressions that both engines read alike.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import micros, round6
from ..operators import base as B
from ..operators import history as H
from ..operators import joins as J
from ..operators import labels as L
from ..sources.lookup import BUCKET_ROWS
from ..sources.tables import scan, scratch, scratch_path, scratch_scope
from .bindings import CONFIG, outcomes, placed, query, table

DUCK = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP"}
DAY = 86_400_000_000
WINDOWS = (30, 365)

_DATE = lambda n, *dates: f"CASE {n} " + " ".join(f"WHEN {i} THEN CAST('{d}' AS TIMESTAMP)" for i, d in enumerate(dates)) + " END"

#: (tables, columns) of each source; several sources of a dimension are put together.
SOURCES: dict[str, list[tuple[str, dict[str, str]]]] = {
    "offer": [("lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", {
        "match_id": "l_orderkey", "ptr_row_order": "l_linenumber", "ptr_sequence_num": "l_linenumber", "ptr_offer_id": "CASE WHEN l_partkey % 11 <> 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) END",
        "px_id": "l_partkey", "donor_id": "o_custkey", "wlreg_audit_id": "l_suppkey", "match_submit_dt": "CAST(o_orderdate AS TIMESTAMP)", "match_year": "year(o_orderdate)", "source_year": "year(o_orderdate)",
        "match_org": "'KI'", "match_opo_ctr_cd": "concat('O', c_nationkey)", "match_opo_ctr_ty": "'O'", "ptr_class_alloc_cat": "l_linestatus", "ptr_tot_score": "l_quantity",
        "ptr_offer_acpt": "CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'N' THEN 'N' WHEN l_partkey % 5 = 0 THEN 'Z' ELSE 'B' END", "ptr_org_placed": "CASE WHEN o_orderstatus = 'F' THEN 'LKI' END",
        "ptr_stat_cd": "CAST(l_linenumber * 10 AS INT)", "ptr_chg_process_cd": "CAST(l_suppkey % 4 AS INT)", "ptr_txc_refusal_cd": "CASE WHEN l_returnflag = 'N' THEN CAST(l_suppkey % 9 AS INT) END", "ptr_hla_group_match_flg": "CASE WHEN l_partkey % 2 = 0 THEN 'Y' END",
        "ptr_a1_mm": "CAST(l_partkey % 2 AS INT)", "ptr_a2_mm": "CAST(l_suppkey % 2 AS INT)", "ptr_b1_mm": "CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_linenumber % 2 AS INT) END", "ptr_b2_mm": "CAST(l_orderkey % 2 AS INT)",
        "ptr_dr1_mm": "CAST((l_partkey + l_suppkey) % 2 AS INT)", "ptr_dr2_mm": "CASE WHEN l_suppkey % 4 <> 0 THEN CAST(1 AS INT) END",
    })],
    "center": [
        ("supplier", {"ctr_id": "s_suppkey", "ctr_cd": "concat('C', s_suppkey)", "ctr_ty": "CASE WHEN s_suppkey % 3 <> 0 THEN 'TX' END", "region": "s_nationkey", "entire_name": "s_name", "primary_state": "concat('S', s_nationkey)", "latitude": "25.0 + s_nationkey % 20", "longitude": "-120.0 + 2 * (s_suppkey % 20)", "geo_source": "'zip'", "optn_mbr": "1"}),
        ("nation", {"ctr_id": "n_nationkey + 1000000000", "ctr_cd": "concat('O', n_nationkey)", "ctr_ty": "'AA'", "region": "n_regionkey", "entire_name": "'another'", "primary_state": "'XX'"}),
        ("nation", {"ctr_id": "n_nationkey + 2000000000", "ctr_cd": "concat('O', n_nationkey)", "ctr_ty": "'O'", "region": "n_regionkey", "entire_name": "n_name", "primary_state": "concat('S', n_nationkey)", "latitude": "26.0 + n_nationkey", "longitude": "-118.0 + n_nationkey"}),
    ],
    "candidate": [
        ("part", {"px_id": "p_partkey", "pers_id": "p_partkey + 7", "wl_org": "'KI'", "can_gender": "CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'M' END", "can_abo": "p_type", "can_race_srtr": "p_brand", "can_listing_ctr_cd": "concat('C', p_partkey % 12)", "can_listing_ctr_ty": "CASE WHEN p_partkey % 12 % 3 <> 0 THEN CASE WHEN p_partkey % 10 = 9 THEN 'ZZ' ELSE 'TX' END END",
                  "can_listing_dt": _DATE("p_partkey % 4", "1994-03-01", "1996-07-15", "1999-02-03"), "can_age_at_listing": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 80 AS DOUBLE) END", "can_dgn": "p_size", "can_prev_ki": "p_partkey % 2", "can_most_recent_wgt_kg": "p_retailprice / 10"}),
        ("part", {"px_id": "CASE WHEN p_partkey % 17 <> 0 THEN p_partkey END", "pers_id": "p_partkey", "wl_org": "'KP'", "can_listing_dt": "CAST('1990-01-01' AS TIMESTAMP)", "can_listing_ctr_cd": "'C1'"}),
    ],
    "status_history": [
        ("part", {"px_id": "p_partkey", "canhx_begin_dt": "CAST('1994-01-01' AS TIMESTAMP)", "canhx_cpra": "CAST(p_partkey % 100 AS DOUBLE)", "canhx_stat_cd": "4010", "wl_org": "'KI'"}),
        ("part", {"px_id": "p_partkey", "canhx_begin_dt": "CAST('1994-01-01' AS TIMESTAMP)", "canhx_begin_dt_tm": _DATE("p_partkey % 3", "1996-05-01", "1997-05-01", "1995-05-01"), "canhx_end_dt": "CAST('1998-02-01' AS TIMESTAMP)", "canhx_cpra": "CAST(p_partkey * 7 % 101 AS DOUBLE)"}),
        ("part", {"px_id": "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END", "canhx_begin_dt": _DATE("p_partkey % 3", "1996-08-01", "1997-06-01", "1999-05-01"), "canhx_end_dt": "CAST('2000-01-01' AS TIMESTAMP)", "canhx_end_dt_tm": _DATE("p_partkey % 2", "1997-09-01"), "canhx_cpra": "CAST(p_partkey * 3 % 100 AS DOUBLE)"}),
    ],
    "donor": [("customer", {
        "donor_id": "c_custkey", "pers_id": "c_custkey + 5", "don_ty": "'C'", "don_opo_ctr_id": "c_nationkey + 2000000000", "don_recov_dt": _DATE("c_custkey % 5", "1995-02-01", "1996-02-01", "1996-02-01", "1998-07-01"), "don_gender": "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END", "don_abo": "c_mktsegment",
        "don_age": "c_custkey % 75", "don_hgt_cm": "CAST(150 + c_custkey % 40 AS DOUBLE)", "don_creat": "c_acctbal / 1000", "don_hist_diab": "c_custkey % 4", "don_anti_hbc": "CASE WHEN c_custkey % 3 = 0 THEN 'Y' WHEN c_custkey % 3 = 1 THEN 'N' END", "don_anti_hcv": "CASE WHEN c_custkey % 6 = 0 THEN 'Y' WHEN c_custkey % 6 < 5 THEN 'N' END",
        "dcd_ind": "c_custkey % 2", "tx_center_count_250nm": "c_nationkey", "kdpi": "CASE WHEN c_custkey % 19 <> 0 THEN c_custkey % 101 END", "kdpi_bin": "CASE WHEN c_custkey % 101 < 50 THEN '0-50' ELSE '50-100' END",
    })],
    "disposition": [("lineitem JOIN orders ON l_orderkey = o_orderkey", {
        "donor_id": "o_custkey", "match_id": "l_orderkey", "px_id": "CASE WHEN l_linenumber = 1 THEN l_partkey END", "don_org": "CASE WHEN o_orderstatus = 'F' THEN 'LKI' ELSE 'LI' END", "don_disposition": "CASE WHEN l_returnflag = 'R' THEN 6 ELSE 5 END", "don_tx_ctr_id": "l_suppkey", "don_reason_cd": "l_linenumber", "don_share_ty": "l_linenumber % 3",
    })],
    "opo_center_history": [("supplier", {"txc_ctr_cd": "concat('C', s_suppkey)", "txc_ctr_ty": "'TX'", "served_opo_cd": "concat('O', s_nationkey)", "served_opo_ty": "'O'", "start_dt": "CAST('1990-01-01' AS TIMESTAMP)"})],
    "transplant": [("orders JOIN (SELECT l_orderkey, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) AS first ON o_orderkey = l_orderkey", {
        "trr_id": "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END", "px_id": "p", "donor_id": "o_custkey", "rec_tx_dt": "CAST(o_orderdate AS TIMESTAMP)", "rec_ctr_cd": "concat('C', s)", "rec_ctr_ty": "'TX'", "rec_opo_id": "s % 25", "don_age": "o_custkey % 75", "don_creat": "o_totalprice / 100000", "don_non_hr_beat": "CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END",
    })],
    "followup": [("lineitem", {
        "trr_fol_id": "l_orderkey * 10 + l_linenumber", "trr_id": "l_orderkey", "px_id": "l_partkey", "tfl_fol_cd": "CAST(round(l_extendedprice * 100) AS BIGINT)", "tfl_px_stat": "l_returnflag", "tfl_px_stat_dt": "CAST(l_shipdate AS TIMESTAMP)", "tfl_creat": "l_discount * 10",
    })],
}


#: The same joins with the largest table last, so that its rows move once.
_JOINED = {"lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey": "orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"}


def source(spark, sf_dir: str, name: str) -> DataFrame:
    """A raw table of the registry."""
    parts = []
    for tables, columns in SOURCES[name]:
        tables = _JOINED.get(tables, tables)
        for t in ("lineitem", "orders", "customer", "supplier", "part", "nation"):
            if t in tables:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        parts.append(spark.sql(f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {tables}"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dim(spark, sf_dir: str, name: str) -> DataFrame:
    return B.dimension(name, source(spark, sf_dir, name))


_LATEST = {"candidate": ("px_id", "can_listing_dt DESC, can_activate_dt DESC, pers_id DESC")}


def _dim_sql(name: str) -> str:
    """The rows of a dimension in DuckDB."""
    types = B.columns_of(name)
    parts = [f"SELECT {', '.join(f'CAST({columns.get(c, 'NULL')} AS {DUCK[t]}) AS {c}' for c, t in types.items())} FROM {tables}" for tables, columns in SOURCES[name]]
    sql = f"SELECT * FROM ({' UNION ALL '.join(parts)})"
    if name in B.REQUIRED:
        sql += f" WHERE {B.REQUIRED[name]} IS NOT NULL"
    if name in _LATEST:
        key, order = _LATEST[name]
        sql += f" QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order.replace('DESC', 'DESC NULLS LAST')}) = 1"
    if name == "transplant":
        sql = f"SELECT *, CASE WHEN don_non_hr_beat = 'Y' THEN 1 ELSE 0 END AS dcd_ind FROM ({sql})"
    return sql


def _shown(df: DataFrame) -> DataFrame:
    """Timestamps as days, small numbers as long ones."""
    day = lambda c: F.col(c).cast("date").cast("string")
    kinds = dict(df.dtypes)
    return df.select(*(day(c).alias(c) if t.startswith("timestamp") else F.col(c).cast("bigint").alias(c) if t in ("tinyint", "int") else F.col(c) for c, t in kinds.items()))


def _shown_sql(columns: dict[str, str], of: str) -> str:
    as_ = {"timestamp": "CAST(CAST({c} AS DATE) AS VARCHAR)", "int": "CAST({c} AS BIGINT)", "tinyint": "CAST({c} AS BIGINT)"}
    return f"SELECT {', '.join(as_.get(t, '{c}').format(c=c) + f' AS {c}' for c, t in columns.items())} FROM {of}"


def _register_dimensions():
    for name in B.DIMENSIONS:
        types = B.columns_of(name) | ({"dcd_ind": "int"} if name == "transplant" else {})
        query(f"st8_{name}_dim", _shown_sql(types, f"({_dim_sql(name)})"))(lambda spark, sf_dir, name=name: _shown(dim(spark, sf_dir, name)))


_register_dimensions()

_CODES_SQL = "SELECT * FROM centers QUALIFY row_number() OVER (PARTITION BY ctr_cd ORDER BY CASE WHEN ctr_ty IN ('O', 'TX', 'TXC', 'HOSP', 'KI') THEN 0 ELSE 1 END, entire_name) = 1"


@query("st8_center_code_dim", f"WITH centers AS ({_dim_sql('center')}) {_shown_sql(B.columns_of('center'), f'({_CODES_SQL})')}")
def st8_codes(spark, sf_dir):
    return _shown(B.center_codes(dim(spark, sf_dir, "center")))


@query("rk01_latest_followups", f"WITH f AS ({_dim_sql('followup')}) {_shown_sql(B.columns_of('followup'), '(SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY trr_id ORDER BY tfl_px_stat_dt DESC NULLS LAST, tfl_fol_cd DESC NULLS LAST) = 1)')}")
def rk01_followups(spark, sf_dir):
    return _shown(B.latest_followups(dim(spark, sf_dir, "followup")))


def _distances(centers: DataFrame) -> DataFrame:
    a = centers.filter("ctr_ty = 'O'").select(F.col("ctr_id").alias("a_id"), F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"))
    b = centers.filter("ctr_ty = 'TX' or ctr_ty is null").select(F.col("ctr_id").alias("b_id"), F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"))
    return J.distance_matrix(a, b, 250.0).select(F.col("a_id").alias("don_opo_ctr_id"), F.col("b_id").alias("tx_ctr_id"), F.round("distance_nm", 3).alias("distance_nm"))


def _success(spark, sf_dir: str, donors: DataFrame) -> DataFrame:
    """Share of earlier donors of the organisation with a placed organ, by the day of recovery."""
    had = source(spark, sf_dir, "offer").filter("ptr_org_placed is not null").select("donor_id")
    rows = J.exists_flag(donors.select("donor_id", "don_opo_ctr_id", F.coalesce("don_recov_dt", F.lit("1900-01-01").cast("timestamp")).alias("at")), had, ["donor_id"], "had")
    return H.prior_success_rate(rows, "don_opo_ctr_id", ["at", "donor_id"], F.col("had") == 1, "success").select("donor_id", F.round("success", 6).alias("don_opo_success_rate_historical"))


def _there(spark, sf_dir: str, name: str, columns) -> DataFrame:
    """A dimension without the columns that its source lacks, and of the others only those asked for."""
    have = {c for _, cs in SOURCES[name] for c in cs} & ({*columns, *_NEEDED[name]} if columns else set(B.columns_of(name)))
    return dim(spark, sf_dir, name).select(*(c for c in B.columns_of(name) if c in have))


#: What the base itself reads of a dimension.
_NEEDED = {
    "candidate": "px_id pers_id don_ty can_source can_listing_ctr_cd can_listing_ctr_ty can_listing_dt can_age_at_listing".split(),
    "donor": "donor_id pers_id don_ty don_opo_ctr_id kdpi don_anti_hcv don_anti_hbc".split(),
}


def base(spark, sf_dir: str, columns=None) -> DataFrame:
    """The base; of dimensions only ``columns`` travel, if given. What the sources lack becomes null at the end."""
    centers, donors = dim(spark, sf_dir, "center"), _there(spark, sf_dir, "donor", columns)
    out = B.offer_base(
        scratch(source(spark, sf_dir, "offer"), "facts", ["match_id"]), _there(spark, sf_dir, "candidate", columns), centers, dim(spark, sf_dir, "status_history"), donors,
        _success(spark, sf_dir, dim(spark, sf_dir, "donor")), _distances(centers),
    )
    return B.null_features(out, {c: t for n in _NEEDED for c, t in B.columns_of(n).items() if not columns or c in columns})


_MM = " + ".join(f"coalesce({c}, 0)" for c in B.MISMATCHES)
_PERSON = [c for c in B.columns_of("candidate") if c not in ("px_id", "pers_id", "don_ty", "can_source")]
_DONOR = [c for c in B.columns_of("donor") if c not in ("donor_id", "pers_id", "don_ty")]
_OFFER = list(SOURCES["offer"][0][1])
BASE_SQL = f"""WITH raw AS (SELECT {', '.join(f'{e} AS {c}' for c, e in SOURCES['offer'][0][1].items())} FROM {SOURCES['offer'][0][0]}),
centers AS ({_dim_sql('center')}), candidates AS ({_dim_sql('candidate')}), statuses AS ({_dim_sql('status_history')}), donors AS ({_dim_sql('donor')}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY match_id, ptr_row_order ORDER BY coalesce(ptr_offer_id, -1), ptr_sequence_num, px_id, donor_id, wlreg_audit_id, ptr_stat_cd, coalesce(ptr_txc_refusal_cd, -1), ptr_class_alloc_cat, ptr_offer_acpt, coalesce(ptr_org_placed, ''))::INT AS offer_row_instance_ordinal FROM raw),
ranked AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ptr_sequence_num, ptr_row_order, offer_row_instance_ordinal)::INT AS offer_rank,
 epoch_us(match_submit_dt) + row_number() OVER (PARTITION BY match_submit_dt ORDER BY match_id, ptr_sequence_num, ptr_row_order, offer_row_instance_ordinal) - 1 AS offer_sort_us FROM numbered),
sh AS (SELECT px_id, coalesce(canhx_begin_dt_tm, canhx_begin_dt, can_listing_dt) AS b, coalesce(canhx_end_dt_tm, canhx_end_dt, TIMESTAMP '2262-01-01') AS e, canhx_cpra FROM statuses),
at_time AS (SELECT r.match_id, r.offer_rank, arg_max(canhx_cpra, row(b, e, canhx_cpra)) AS canhx_cpra FROM ranked r JOIN sh ON r.px_id = sh.px_id AND b <= match_submit_dt AND e > match_submit_dt GROUP BY 1, 2),
succ AS (SELECT donor_id, round(sum(had) OVER w / nullif(count(*) OVER w, 0), 6) AS don_opo_success_rate_historical FROM (SELECT donor_id, don_opo_ctr_id, coalesce(don_recov_dt, TIMESTAMP '1900-01-01') AS day, CASE WHEN donor_id IN (SELECT donor_id FROM raw WHERE ptr_org_placed IS NOT NULL) THEN 1.0::DOUBLE ELSE 0 END AS had FROM donors) WINDOW w AS (PARTITION BY don_opo_ctr_id ORDER BY day, donor_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dist AS (SELECT a.ctr_id AS opo, b.ctr_id AS tx, round(2 * 3440.065 * asin(least(1.0, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))), 3) AS distance_nm
 FROM centers a, centers b WHERE a.ctr_ty = 'O' AND (b.ctr_ty = 'TX' OR b.ctr_ty IS NULL)),
base AS (SELECT {', '.join(f'r.{c}' for c in _OFFER)}, r.offer_row_instance_ordinal, r.offer_rank, r.offer_sort_us,
 (coalesce(ptr_a1_mm, 0) + coalesce(ptr_a2_mm, 0)) AS mm_a, (coalesce(ptr_b1_mm, 0) + coalesce(ptr_b2_mm, 0)) AS mm_b, (coalesce(ptr_dr1_mm, 0) + coalesce(ptr_dr2_mm, 0)) AS mm_dr, {_MM} AS mm_total, CASE WHEN {_MM} BETWEEN 0 AND 6 THEN CAST({_MM} AS VARCHAR) END AS mm_total_bucket,
 isodow(match_submit_dt)::INT AS match_day_of_week, (1 + floor((day(match_submit_dt) - 1) / 7.0))::INT AS match_week_of_month, month(match_submit_dt)::INT AS match_month_of_year, hour(match_submit_dt)::INT AS match_hour_of_day,
 (ptr_offer_acpt = 'Y')::INT AS is_positive_response, (ptr_offer_acpt = 'N')::INT AS is_negative_response, (ptr_offer_acpt IN ('Y', 'N'))::INT AS is_yn_response,
 c.pers_id AS candidate_pers_id, {', '.join(f'c.{x}' for x in _PERSON)}, ctr.ctr_id AS can_listing_ctr_id, t.canhx_cpra, {', '.join(f'd.{x}' for x in _DONOR)}, don_opo_success_rate_historical, distance_nm,
 CASE WHEN can_age_at_listing IS NULL OR can_listing_dt IS NULL THEN NULL ELSE round(can_age_at_listing + greatest(epoch_us(match_submit_dt) // 1000000 - epoch_us(can_listing_dt) // 1000000, 0) / 31556952.0, 6) END AS can_current_age_years,
 CASE WHEN can_age_at_listing IS NULL OR can_listing_dt IS NULL THEN NULL WHEN can_age_at_listing + greatest(epoch_us(match_submit_dt) // 1000000 - epoch_us(can_listing_dt) // 1000000, 0) / 31556952.0 >= 18 THEN 1 ELSE 0 END AS can_is_adult,
 CASE WHEN distance_nm IS NULL THEN NULL WHEN distance_nm > 250 THEN 1 ELSE 0 END AS long_distance_flg, CASE WHEN kdpi IS NULL THEN NULL WHEN kdpi >= 85 THEN 1 ELSE 0 END AS high_kdpi_flg,
 CASE WHEN don_anti_hcv IS NULL THEN NULL WHEN don_anti_hcv = 'Y' THEN 1 ELSE 0 END AS hcv_positive_flg, CASE WHEN don_anti_hbc IS NULL THEN NULL WHEN don_anti_hbc = 'Y' THEN 1 ELSE 0 END AS hbc_positive_flg
 FROM ranked r LEFT JOIN candidates c ON r.px_id = c.px_id LEFT JOIN centers ctr ON c.can_listing_ctr_cd = ctr.ctr_cd AND coalesce(c.can_listing_ctr_ty, '') = coalesce(ctr.ctr_ty, '')
 LEFT JOIN at_time t ON r.match_id = t.match_id AND r.offer_rank = t.offer_rank LEFT JOIN donors d ON r.donor_id = d.donor_id LEFT JOIN succ ON r.donor_id = succ.donor_id LEFT JOIN dist ON d.don_opo_ctr_id = dist.opo AND ctr.ctr_id = dist.tx)"""

_KINDS = B.columns_of("candidate") | B.columns_of("donor") | {"match_submit_dt": "timestamp", "ptr_tot_score": "double", "canhx_cpra": "double", "don_opo_success_rate_historical": "double", "distance_nm": "double", "can_current_age_years": "double", "offer_sort_us": "bigint", "candidate_pers_id": "bigint", "can_listing_ctr_id": "bigint"}
_TEXT = ["match_org", "match_opo_ctr_cd", "match_opo_ctr_ty", "ptr_class_alloc_cat", "ptr_offer_acpt", "ptr_org_placed", "ptr_hla_group_match_flg", "mm_total_bucket"]
_DERIVED = "mm_a mm_b mm_dr mm_total mm_total_bucket match_day_of_week match_week_of_month match_month_of_year match_hour_of_day is_positive_response is_negative_response is_yn_response".split()
_LAST = "can_current_age_years can_is_adult long_distance_flg high_kdpi_flg hcv_positive_flg hbc_positive_flg".split()
BASE_COLUMNS = {c: "string" if c in _TEXT else _KINDS.get(c, "int") for c in [*_OFFER, "offer_row_instance_ordinal", "offer_rank", "offer_sort_us", *_DERIVED, "candidate_pers_id", *_PERSON, "can_listing_ctr_id", "canhx_cpra", *_DONOR, "don_opo_success_rate_historical", "distance_nm", *_LAST]}


@query("st6_offer_base_full", f"{BASE_SQL} {_shown_sql(BASE_COLUMNS, 'base')}")
def st6_full(spark, sf_dir):
    """All columns but the row's hash."""
    return _shown(base(spark, sf_dir).select(*BASE_COLUMNS))


# feature families on the base, as the enriched view joins them


ROW = ["match_id", "offer_rank"]
#: Strata of rates by their keys.
_RATES = {"center": (["can_listing_ctr_cd"], ["dcd_ind", "high_kdpi_flg", "hcv_positive_flg", "long_distance_flg", "mm_total_bucket"]), "pair": (["match_opo_ctr_cd", "can_listing_ctr_cd"], ["dcd_ind"])}

def _families(b: DataFrame, columns) -> list[tuple[DataFrame, list[str]]]:
    """Those of which a column is asked for, each of a few columns of the base, and written by its keys before the next begins."""
    spark, n = b.sparkSession, int(b.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    declined, yes = F.col("ptr_offer_acpt") == "N", F.col("ptr_offer_acpt") == "Y"
    asked = lambda name: [c for c in columns if c.startswith(name)]
    spans = lambda cs: [d for d in WINDOWS if any(c.endswith(f"_{d}d") for c in cs)]
    out = []

    def written(df: DataFrame, keys: list[str]) -> None:
        # what the windows shuffled is freed before the result is dealt by runs
        out.append((scratch(scratch(df, "past").repartition(n, "match_id"), "family", ["match_id"], outer=True), keys))

    if new := asked("opo_hist_"):
        with scratch_scope(spark):
            first = b.groupBy("match_id").agg(F.min(F.when(yes, F.col("offer_rank"))).alias("first"))
            runs = b.join(first, "match_id").groupBy("match_id").agg(
                F.max("match_opo_ctr_cd").alias("org"), micros(F.max("match_submit_dt")).alias("at"), F.max("dcd_ind").alias("dcd"), F.max("kdpi_bin").alias("bin"), F.count(F.lit(1)).alias("run_len"),
                F.max(F.when(F.col("ptr_org_placed").isNotNull(), 1).otherwise(0)).alias("placed_any"), F.lit(0).alias("placed_both"), F.lit(0).alias("out_of_sequence"),
                F.count_if(declined & (F.col("offer_rank") < F.col("first"))).alias("first_accept_declines"),
            ).withColumn("wasted_both", 1 - F.col("placed_any"))
            names = {"org_dcd_frac": "dcd_frac", "org_placed_any_frac": "any_placed_frac", "org_wasted_both_frac": "both_wasted_frac", "org_stratum_rate": "kdpi_bin_placement_rate", "org_mean_declines": "mean_first_accept_declines", "org_mean_run_len": "mean_run_len"}
            past = H.org_history(scratch(runs, "runs"), "org", "at", "bin", windows=spans(new))
            written(past.select("match_id", *(F.round(F.col(f"{a}_{d}d"), 6).alias(c) for d in WINDOWS for a, z in names.items() if (c := f"opo_hist_{z}_{d}d") in new)), ["match_id"])

    if new := asked("decline"):
        measures, shares = {"kdpi": F.col("kdpi"), "mm_total": F.col("mm_total")}, {"dcd": F.col("dcd_ind"), "hcv": F.col("hcv_positive_flg")}
        some = lambda of: {m: c for m, c in of.items() if asked(f"declined_{m}_")}
        with scratch_scope(spark):
            past = H.decline_history(b, "px_id", "offer_sort_us", declined, some(measures), some(shares), windows=spans(new), keep=ROW)
            written(past.select(*ROW, *(F.col(c) if "count" in c else round6(F.col(c)).alias(c) for c in new)), ROW)

    for name, (keys, strata) in _RATES.items():
        if new := asked(f"{name}_"):
            with scratch_scope(spark):
                past = H.strata_rate_history(b, keys, [s for s in strata if asked(f"{name}_same_{s}_")], "offer_sort_us", yes, declined, name, windows=spans(new), keep=ROW)
                written(past.select(*ROW, *new), ROW)
    return out


#: What each kind of family reads of the base, besides its strata.
_READ = {
    "opo_hist_": "match_submit_dt match_opo_ctr_cd ptr_offer_acpt ptr_org_placed dcd_ind kdpi_bin".split(),
    "decline": "px_id offer_sort_us ptr_offer_acpt kdpi mm_total dcd_ind hcv_positive_flg".split(),
    "center_": "offer_sort_us ptr_offer_acpt can_listing_ctr_cd".split(), "pair_": "offer_sort_us ptr_offer_acpt match_opo_ctr_cd can_listing_ctr_cd".split(),
    "match_opo_": ["match_opo_ctr_cd"], "can_listing_center_": ["can_listing_ctr_cd", "can_listing_ctr_ty"],
}


def enriched(spark, sf_dir: str, columns=None) -> DataFrame:
    """The enriched view, of which only ``columns`` and their families are made, if given; the base is written once, in buckets of the run."""
    columns = list(columns or ENRICHED_COLUMNS)
    read = {*ROW, *columns, *(c for name, cs in _READ.items() for c in cs if any(x.startswith(name) for x in columns))}
    read |= {s for name, (_, strata) in _RATES.items() for s in strata if any(x.startswith(f"{name}_same_{s}_") for x in columns)}
    with scratch_scope(spark):
        rows = base(spark, sf_dir, read)
        # by candidate first: the shuffle by run begins when that by candidate is freed
        slices = 1 + len(read) // 20
        rows = scratch(rows.select(*(c for c in rows.columns if c in read)), "offers", slices=slices, sliced_by="match_id")
        b = scratch(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "match_id"), "base", ["match_id"], outer=True, slices=slices, sliced_by="match_id")
    # base and families lie by run: joins by more keys than that need not deal them again
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return B.enriched_view(b, dim(spark, sf_dir, "center"), _families(b, columns), columns)


def _over(keys: str, days: int, at: str = "offer_sort_us") -> str:
    return f"(PARTITION BY {keys} ORDER BY {at} RANGE BETWEEN {days * DAY} PRECEDING AND 1 PRECEDING)"


def _family_sql() -> tuple[list[str], list[str]]:
    row, org, y, n = [], [], "ptr_offer_acpt = 'Y'", "ptr_offer_acpt = 'N'"
    for d in WINDOWS:
        f = _over("px_id", d)
        row.append(f"count(*) FILTER ({n}) OVER {f} AS decline_count_{d}d")
        for m in ("kdpi", "mm_total"):
            row += [f"round({g}({m}) FILTER ({n}) OVER {f} + 1e-9, 6) AS declined_{m}_{g[:3] if g == 'avg' else 'stddev'}_{d}d" for g in ("avg", "stddev_samp")]
        row += [f"round(avg({m}) FILTER ({n}) OVER {f} + 1e-9, 6) AS declined_{name}_frac_{d}d" for name, m in (("dcd", "dcd_ind"), ("hcv", "hcv_positive_flg"))]
        o = _over("org", d, "at_us")
        org += [f"round(avg({c}) OVER {o}, 6) AS opo_hist_{z}_{d}d" for c, z in (("dcd", "dcd_frac"), ("placed_any", "any_placed_frac"), ("1 - placed_any", "both_wasted_frac"), ("run_len", "mean_run_len"))]
        org += [f"round(avg(placed_any) OVER {_over('org, bin', d, 'at_us')}, 6) AS opo_hist_kdpi_bin_placement_rate_{d}d", f"round(avg(first_accept_declines) FILTER (placed_any = 1) OVER {o}, 6) AS opo_hist_mean_first_accept_declines_{d}d"]
        for name, keys, strata in (("center", "can_listing_ctr_cd", ["dcd_ind", "high_kdpi_flg", "hcv_positive_flg", "long_distance_flg", "mm_total_bucket"]), ("pair", "match_opo_ctr_cd, can_listing_ctr_cd", ["dcd_ind"])):
            for s in ("", *strata):
                w = _over(keys + (f", {s}" if s else ""), d)
                a, b = f"count(*) FILTER ({y}) OVER {w}", f"count(*) FILTER ({n}) OVER {w}"
                null = f"can_listing_ctr_cd IS NULL{f' OR {s} IS NULL' if s else ''}"
                row.append(f"CASE WHEN {null} THEN NULL ELSE round(({a})::DOUBLE / nullif(({a}) + ({b}), 0), 6) END AS {name}{f'_same_{s}' if s else ''}_rate_{d}d")
                if not s:
                    row.append(f"CASE WHEN {null} THEN NULL ELSE ({a}) + ({b}) END AS {name}_count_{d}d")
    return row, org


_ROW_SQL, _ORG_SQL = _family_sql()
ENRICHED_SQL = f"""{BASE_SQL}, codes AS ({_CODES_SQL}), firsts AS (SELECT match_id, min(offer_rank) FILTER (ptr_offer_acpt = 'Y') AS first FROM base GROUP BY 1),
run_rows AS (SELECT match_id, max(match_opo_ctr_cd) AS org, epoch_us(max(match_submit_dt)) AS at_us, max(dcd_ind) AS dcd, max(kdpi_bin) AS bin, count(*) AS run_len, max(CASE WHEN ptr_org_placed IS NOT NULL THEN 1 ELSE 0 END) AS placed_any, count(*) FILTER (ptr_offer_acpt = 'N' AND offer_rank < first) AS first_accept_declines FROM base JOIN firsts USING (match_id) GROUP BY 1),
of_org AS (SELECT match_id, {', '.join(_ORG_SQL)} FROM run_rows), of_row AS (SELECT match_id, offer_rank, {', '.join(_ROW_SQL)} FROM base),
enriched AS (SELECT base.* EXCLUDE (offer_sort_us, can_listing_ctr_id, is_positive_response, is_negative_response, is_yn_response), o.entire_name AS match_opo_name, o.primary_state AS match_opo_state, l.entire_name AS can_listing_center_name, l.primary_state AS can_listing_center_state,
 of_org.* EXCLUDE (match_id), of_row.* EXCLUDE (match_id, offer_rank) FROM base LEFT JOIN codes o ON match_opo_ctr_cd = o.ctr_cd LEFT JOIN centers l ON can_listing_ctr_cd = l.ctr_cd AND coalesce(can_listing_ctr_ty, '') = coalesce(l.ctr_ty, '')
 JOIN of_org USING (match_id) JOIN of_row USING (match_id, offer_rank))"""
_NEW = [x.rsplit(" AS ", 1)[1] for x in (*_ROW_SQL, *_ORG_SQL)]
ENRICHED_COLUMNS = {c: t for c, t in BASE_COLUMNS.items() if c not in B.INTERNAL} | {c: "string" for c in ("match_opo_name", "match_opo_state", "can_listing_center_name", "can_listing_center_state")} | {c: "bigint" if "count" in c else "double" for c in _NEW}


@query("st7_enriched_full", f"{ENRICHED_SQL} {_shown_sql(ENRICHED_COLUMNS, 'enriched')}")
def st7_full(spark, sf_dir):
    return _shown(enriched(spark, sf_dir)).select(*ENRICHED_COLUMNS)


def bridge(spark, sf_dir: str) -> DataFrame:
    return B.transplant_bridge(dim(spark, sf_dir, "disposition").filter("px_id is not null"), dim(spark, sf_dir, "transplant"), dim(spark, sf_dir, "followup"))


OUTCOME_SQL = f"""{ENRICHED_SQL}, disposition AS ({_dim_sql('disposition')}), transplants AS ({_dim_sql('transplant')}), followups AS ({_dim_sql('followup')}),
last AS (SELECT * FROM followups QUALIFY row_number() OVER (PARTITION BY trr_id ORDER BY tfl_px_stat_dt DESC NULLS LAST, tfl_fol_cd DESC NULLS LAST) = 1),
bridge AS (SELECT d.match_id, d.donor_id, d.px_id, don_disposition, don_reason_cd, don_tx_ctr_id, don_discard_cd, don_share_ty, t.trr_id, t.rec_tx_dt, t.rec_ctr_cd, t.rec_ctr_ty, t.rec_opo_id, tfl_px_stat AS latest_tfl_px_stat, tfl_px_stat_dt AS latest_tfl_px_stat_dt, tfl_creat AS latest_tfl_creat
 FROM disposition d LEFT JOIN transplants t ON d.donor_id = t.donor_id AND d.px_id = t.px_id LEFT JOIN last ON t.trr_id = last.trr_id WHERE d.px_id IS NOT NULL),
outcome AS (SELECT e.*, b.* EXCLUDE (match_id, donor_id, px_id) FROM enriched e LEFT JOIN bridge b ON e.match_id = b.match_id AND e.donor_id = b.donor_id AND e.px_id = b.px_id)"""
_BRIDGE_KINDS = B.columns_of("disposition") | B.columns_of("transplant") | {f"latest_{c}": t for c, t in B.columns_of("followup").items()}
OUTCOME_COLUMNS = {c: BASE_COLUMNS[c] for c in ("match_id", "offer_rank", "px_id", "donor_id", "match_opo_ctr_cd", "can_listing_ctr_cd", "match_submit_dt")} | {c: _BRIDGE_KINDS[c] for c in B.BRIDGE_COLUMNS}
OUTCOME_COLUMNS |= {c: ENRICHED_COLUMNS[c] for c in ("decline_count_365d", "center_rate_365d", "opo_hist_mean_run_len_365d", "match_opo_name")}


def outcome(spark, sf_dir: str) -> DataFrame:
    """The outcome view's columns that its queries return, and the order of rows in time."""
    mine = [c for c in OUTCOME_COLUMNS if c not in B.BRIDGE_COLUMNS]
    rows = enriched(spark, sf_dir, [*mine, "ptr_sequence_num", "ptr_row_order"])
    return B.outcome_view(rows.select(*mine, "ptr_sequence_num", "ptr_row_order"), bridge(spark, sf_dir))


@query("st7_outcome_view", f"{OUTCOME_SQL} {_shown_sql(OUTCOME_COLUMNS, 'outcome')}")
def st7_outcome(spark, sf_dir):
    return _shown(outcome(spark, sf_dir).select(*OUTCOME_COLUMNS))


# table functions

_FACT = ["match_id", "ptr_row_order", "ptr_sequence_num", "px_id", "donor_id", "ptr_offer_acpt"]
#: Lookup stores of this application: (session, tables' files, what, column) to a table's name.
_STORES: dict[tuple, str] = {}


def _stored(spark, sf_dir: str, what: str, build, f) -> DataFrame:
    """The table of ``build``, kept by the column of a table function; built once in a session for the same input files.

    All functions over one view share its rows, which are written once before they are dealt by a column.
    """
    files = tuple(sorted(x for t in ("lineitem", "orders", "customer", "supplier") for x in table(spark, sf_dir, t).inputFiles()))

    def kept(column: str, make):
        key = (spark.sparkContext.applicationId, files, what, column)
        if key not in _STORES:
            _STORES[key] = make()
        return _STORES[key]

    def by_column() -> str:
        rows = scan(spark, kept("", written))
        name = f"lookup_{uuid.uuid4().hex}"
        B.store(rows, f, name, scratch_path(spark, name), buckets=max(8, -(-rows.count() // BUCKET_ROWS)))
        return name

    def written() -> str:
        with scratch_scope(spark):
            return scratch(build(), what, outer=True)._scratch

    return spark.table(kept(f.column, by_column))


def _register_functions():
    raw = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in SOURCES['offer'][0][1].items())} FROM {SOURCES['offer'][0][0]})"
    for name, f in (("tf01_lookup_match", B.lookup_match), ("tf01_px_history", B.px_history), ("tf01_donor_history", B.donor_history)):

        def run(spark, sf_dir, f=f):
            facts = source(spark, sf_dir, "offer")
            rows = _stored(spark, sf_dir, "facts", lambda: facts.select(*_FACT, "match_submit_dt"), f)
            return f(rows, facts.agg(F.max(f.column)).first()[0]).select(*_FACT)

        query(name, f"SELECT {', '.join(_FACT)} FROM {raw} AS f WHERE {f.column} = (SELECT max({f.column}) FROM {raw} AS g)")(run)
    for name, f in (
        ("tf02_candidate_history_enriched", B.candidate_history_enriched), ("tf02_donor_history_enriched", B.donor_history_enriched),
        ("tf02_match_opo_history", B.match_opo_history), ("tf02_listing_center_history", B.listing_center_history),
    ):

        def run(spark, sf_dir, f=f):
            facts = source(spark, sf_dir, "offer") if f.column in SOURCES["offer"][0][1] else dim(spark, sf_dir, "candidate")
            rows = _stored(spark, sf_dir, "outcomes", lambda: outcome(spark, sf_dir), f)
            return _shown(f(rows, facts.agg(F.max(f.column)).first()[0]).select(*OUTCOME_COLUMNS))

        query(name, f"{OUTCOME_SQL} {_shown_sql(OUTCOME_COLUMNS, f'outcome WHERE {f.column} = (SELECT max({f.column}) FROM {"raw" if f.column in SOURCES["offer"][0][1] else "candidates"})')}")(run)


_register_functions()


# run features


def _roles(df: DataFrame) -> DataFrame:
    """Names of the base as the label operators know them."""
    return df.withColumnsRenamed({"match_id": "run_id", "match_submit_dt": "submit_ts", "match_year": "run_year", "ptr_row_order": "row_order", "ptr_sequence_num": "seq", "px_id": "candidate", "ptr_offer_acpt": "response"})


_COUNTS = {f"count_distance_le_{d}": f"distance_nm <= {d}" for d in (10, 100, 250)} | {"count_mm_total_0": "mm_total = 0"} | {f"count_mm_total_{a}_{b}": f"mm_total BETWEEN {a} AND {b}" for a, b in ((1, 2), (3, 4), (5, 6))}
_COUNTS |= {f"count_cpra_ge_{p}": f"canhx_cpra >= {p}" for p in (80, 98)} | {"count_dcd_offer_rows": "dcd_ind = 1", "count_hcv_positive_offer_rows": "hcv_positive_flg = 1"}


@query("ag16_run_features_full", f"""{ENRICHED_SQL}, links AS (SELECT o_orderkey AS match_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS kidney FROM orders WHERE o_orderstatus <> 'O'),
labels AS (SELECT match_id, max(match_submit_dt) AS ts, count(*) AS run_len, max(CASE WHEN ptr_offer_acpt = 'Y' THEN 1 ELSE 0 END) AS has_y FROM base GROUP BY 1)
SELECT match_id AS run_id, max(run_len) AS run_len, round(log10(max(run_len) + 1), 6) AS run_len_log, round(avg(CASE WHEN can_listing_ctr_cd IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS frac_center_linked,
 {', '.join(f'max({c})::DOUBLE AS {c}' for c in B.RUN_CONSTANTS)}, {', '.join(f'count(*) FILTER ({w}) AS {c}' for c, w in _COUNTS.items())}, CASE WHEN max(has_y) = 0 AND coalesce(max(kidney), 0) = 0 THEN 1 ELSE 0 END AS discard_target
FROM enriched JOIN labels USING (match_id) LEFT JOIN links USING (match_id) WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '2001-12-31' AND NOT (has_y = 1 AND coalesce(kidney, 0) = 0) GROUP BY match_id""")
def ag16_full(spark, sf_dir):
    read = [*B.RUN_CONSTANTS, "match_id", "match_submit_dt", "match_year", "ptr_row_order", "ptr_sequence_num", "px_id", "ptr_offer_acpt", "offer_rank", "can_listing_ctr_cd", "distance_nm", "mm_total", "canhx_cpra", "hcv_positive_flg"]
    rows = _roles(enriched(spark, sf_dir, read).select(*read))
    labels = L.match_labels(rows, outcomes(spark, sf_dir), CONFIG, placed())
    out = L.run_rows(rows, labels, B.static_run_features(), CONFIG)
    return out.select("run_id", "run_len", F.round("run_len_log", 6).alias("run_len_log"), F.round("frac_center_linked", 6).alias("frac_center_linked"), *(F.col(c).cast("double").alias(c) for c in B.RUN_CONSTANTS), *_COUNTS, "discard_target")


@query("pr01_select_except", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def pr01(spark, sf_dir):
    return B.select_except(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"])


@query("pr02_null_features", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS pair_rate_30d, CAST(NULL AS BIGINT) AS pair_count_30d, CAST(NULL AS VARCHAR) AS last_bin FROM orders")
def pr02(spark, sf_dir):
    return B.null_features(table(spark, sf_dir, "orders").select("o_orderkey"), {"pair_rate_30d": "double", "pair_count_30d": "bigint", "last_bin": "string"})
