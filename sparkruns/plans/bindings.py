"""Roles of the test tables in ranked-offer queries, for Spark and for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators.labels import LabelConfig
from ..operators.rank import offer_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CONFIG = LabelConfig(history_start="1995-01-01", train="1997-01-01", validation="1999-01-01", test="2000-01-01", end="2001-12-31")
TOTAL_ORDER = ["seq", "candidate", "center", "price"]


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per offer: a line of an order."""
    lines, orders, people = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    # lines, the largest, move once, and by their run
    joined = orders.join(people, orders.o_custkey == people.c_custkey).join(lines, lines.l_orderkey == orders.o_orderkey)
    ts = F.col("o_orderdate").cast("timestamp")
    response = F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "N", "N").otherwise("B")
    rows = joined.select(
        F.col("l_orderkey").alias("run_id"), ts.alias("submit_ts"), micros(ts).alias("at_us"), F.year(ts).alias("run_year"),
        F.col("l_linenumber").alias("row_order"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("candidate"),
        F.col("l_suppkey").alias("center"), F.col("o_custkey").alias("donor"), F.col("c_nationkey").alias("org"), response.alias("response"),
        F.col("l_quantity").alias("score_points"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("dcd"),
        F.when(F.col("l_quantity") >= 40, 1).otherwise(0).alias("high"), F.when(F.col("l_linenumber") <= 2, "near").when(F.col("l_linenumber") <= 5, "mid").otherwise("far").alias("band"),
        F.col("o_orderstatus").alias("status"),
    )
    return offer_rank(rows, "run_id", TOTAL_ORDER)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked outcomes of runs: F placed a kidney, P linked something else, O has none."""
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "LKI").otherwise("LI").alias("organ"), F.lit(6).alias("disposition"))


def placed():
    return (F.col("disposition") == 6) & F.col("organ").isin("LKI", "RKI", "EKI")


#: The rows of ``offers`` in DuckDB, as the first table of a WITH clause.
OFFERS = """offers AS (
  SELECT l_orderkey AS run_id, o_orderdate AS submit_ts, epoch_us(o_orderdate) AS at_us, year(o_orderdate)::INT AS run_year,
         l_linenumber AS row_order, l_linenumber AS seq, l_partkey AS candidate, l_suppkey AS center, o_custkey AS donor,
         c_nationkey AS org, CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'N' THEN 'N' ELSE 'B' END AS response,
         l_quantity AS score_points, l_discount AS discount, l_tax AS tax, l_extendedprice AS price,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS dcd, CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS high,
         CASE WHEN l_linenumber <= 2 THEN 'near' WHEN l_linenumber <= 5 THEN 'mid' ELSE 'far' END AS band, o_orderstatus AS status,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS offer_rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

LABELS = """runs AS (
  SELECT run_id, max(submit_ts) AS submit_ts, max(run_year) AS run_year, count(*) AS run_len, count(*) FILTER (response = 'Y') AS y_rows,
         max(CASE WHEN response = 'Y' THEN 1 ELSE 0 END) AS has_y, arg_min(row_order, offer_rank) FILTER (response = 'Y') AS first_y_row_order,
         arg_min(seq, offer_rank) FILTER (response = 'Y') AS first_y_seq, arg_min(candidate, offer_rank) FILTER (response = 'Y') AS first_y_candidate,
         min(offer_rank) FILTER (response = 'Y') AS first_y_rank
  FROM offers WHERE submit_ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31' GROUP BY run_id
), links AS (
  SELECT o_orderkey AS run_id, 1 AS linked, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS placed_count FROM orders WHERE o_orderstatus <> 'O'
), labels AS (
  SELECT runs.*, coalesce(linked, 0) AS linked, coalesce(placed_count, 0) AS placed_count, coalesce(placed_count, 0) AS placed_any,
         CASE WHEN submit_ts < TIMESTAMP '1997-01-01' THEN 'history' WHEN submit_ts < TIMESTAMP '1999-01-01' THEN 'train'
              WHEN submit_ts < TIMESTAMP '2000-01-01' THEN 'validation' ELSE 'test' END AS split,
         first_y_rank::DOUBLE / run_len AS first_y_share,
         CASE WHEN has_y = 1 AND coalesce(placed_count, 0) = 1 THEN 'localizable_observed_y' WHEN has_y = 0 AND coalesce(placed_count, 0) = 1 THEN 'censored_positive'
              WHEN has_y = 1 THEN 'audit_orphan_y' ELSE 'none' END AS run_state,
         CASE WHEN has_y = 1 AND coalesce(placed_count, 0) = 0 AND linked IS NULL THEN 'missing_saf_link'
              WHEN has_y = 1 AND coalesce(placed_count, 0) = 0 THEN 'non_kidney_only_saf_outcome' END AS audit_reason
  FROM runs LEFT JOIN links USING (run_id)
)"""

WITH = f"WITH {OFFERS}\n"
WITH_LABELS = f"WITH {OFFERS}, {LABELS}\n"

#: Scores from row keys.
SCORE = "((candidate * 31 + offer_rank * 17) % 101) / 101.0"
SCORE_SQL = "((candidate * 31 + offer_rank * 17) % 101)::DOUBLE / 101.0"


def score():
    return F.expr("CAST((candidate * 31 + offer_rank * 17) % 101 AS DOUBLE) / 101.0D")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import match_labels

    return match_labels(offers(spark, sf_dir), outcomes(spark, sf_dir), CONFIG, placed())
