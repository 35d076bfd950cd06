"""What queries put on disk, shuffles and scratch tables, as a multiple of the tables that they read."""

import os

import pytest

import __spark_entry__ as entry
from sparkruns.sources import tables

BIG = "/root/testdata/sf0.01"
TABLES = ("lineitem", "orders", "customer", "part", "supplier")


def _under(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def _shuffled(spark):
    """Bytes of shuffle files that are there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def written_by(spark, run):
    """Bytes of all shuffles, freed or not, and of scratch tables that are left."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def so_far():
        bus.waitUntilEmpty(30_000)
        return store.executorList(False).apply(0).totalShuffleWrite() + _under(folder)

    before = so_far()
    run().write.format("noop").mode("overwrite").save()
    return so_far() - before


def test_scratch_leaves_no_shuffle_files(spark):
    before = _shuffled(spark)
    rows = tables.scratch(spark.range(200_000).repartition(3, "id"), "dealt", ["id"])
    assert _shuffled(spark) - before < 100_000 and rows.count() == 200_000
    assert "Exchange hashpartitioning" not in rows.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    path = rows._scratch.removeprefix("file://")
    assert os.path.isdir(path)
    tables.discard(rows)
    assert not os.path.exists(path)


@pytest.mark.parametrize(("name", "most"), [("wn07_org_history", 5), ("wn11_acceptance_history", 5), ("wn04_last_response", 6), ("st6_offer_base_full", 15), ("ag16_run_features_full", 18)])
def test_disk_of_queries(spark, name, most):
    read = sum(os.path.getsize(f"{BIG}/{t}.parquet") for t in TABLES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        used = written_by(spark, lambda: entry.queries()[name](spark, BIG))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert used < most * read, used / read
