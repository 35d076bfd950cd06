"""A lookup store: rows kept in buckets of a key and sorted by it, so that a lookup reads one bucket and few row groups of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shuffles_freed

#: Rows of a bucket; with files of that size a lookup of one key is a task of a second.
BUCKET_ROWS = 1_000_000


def write_lookup(df: DataFrame, table: str, key: str, order: list[str], path: str | None = None, buckets: int | None = None, replace: bool = False) -> None:
    """Writes ``df`` as a table of the catalog in buckets of ``key``, each one file sorted by key and ``order``.

    A Bloom filter on the key lets readers skip row groups that cannot hold it. The number of buckets follows the rows
    unless it is given; a key with more rows than a bucket fills one bucket with others. Rows without a key are kept in
    the bucket of null. ``path`` is where the files go, else the warehouse.
    """
    buckets = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    # one file a bucket: rows are dealt as the table's buckets are
    rows = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    writer = rows.write.mode("overwrite" if replace else "errorifexists").bucketBy(buckets, key).sortBy(key, *order)
    writer = writer.option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", "100000")
    with shuffles_freed(df.sparkSession):
        (writer.option("path", path) if path else writer).format("parquet").saveAsTable(table)


def lookup(spark: SparkSession, table: str, key: str, value, order: list[str]) -> DataFrame:
    """Rows of one key in an order: the bucket of the value alone is scanned."""
    return spark.table(table).filter(F.col(key) == F.lit(value)).orderBy(*order)
