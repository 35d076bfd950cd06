"""Scans, partitioned sinks, name and type normalisation, and column contracts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch tables written within it are removed at its end, but for those of ``scratch(..., outer=True)``."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        _remove(spark, mine)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new folder in the cluster's shared checkpoint folder; a temporary one only in local mode, if the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-2:-1] if outer else _scopes[-1:]:
        scope.append(folder)
    return folder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of the table's columns has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Spark's own setting: shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written within leaves no shuffle files behind."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def scratch(df: DataFrame, name: str, by: list[str] | None = None, outer: bool = False, slices: int = 1, sliced_by: str | None = None) -> DataFrame:
    """The table written to the shared scratch folder and read again: computed once, and safe from lost executors.

    What was shuffled to compute it is freed. With ``by`` it lies in buckets of these columns, as a shuffle would deal
    it, so that what groups or joins by them reads it without an exchange; the rows should come dealt by them. With
    ``outer`` the table belongs to the scope around the current one. With ``slices`` the rows are written in so many
    parts, one after another, by a hash of a column, so that only one part at a time is being shuffled.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outer)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        for i in range(slices):
            rows = df.filter(F.pmod(F.xxhash64(sliced_by), F.lit(slices)) == i) if slices > 1 else df
            writer = rows.write.mode("append" if i else "errorifexists").option("compression", "zstd")
            if by:
                writer.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(table)
            else:
                writer.parquet(path)
    out = spark.table(table) if by else spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, [t._scratch])


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with united schemas; folders ``key=value`` become columns that filters prune."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def scan_optional(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table if it is there, else an empty one of the given schema."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return scan(spark, path) if there else spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], replace: bool = False, sort: list[str] | None = None, files: int | None = None) -> None:
    """One folder for each value of ``by``. ``replace`` swaps only the partitions that occur in ``df``; else existing output is refused.

    With ``sort``, rows are ranged by the partition columns and the sort keys, so that files are ordered and hot
    partitions spread over several tasks.
    """
    if sort:
        keys = [*by, *sort]
        df = (df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    writer = df.write.partitionBy(*by).option("compression", "zstd")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def normalize_names(df: DataFrame, case: str = "lower") -> DataFrame:
    return df.toDF(*(getattr(c, case)() for c in df.columns))


def canonicalize(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Renames the first alias present to its canonical name; names that exist already stay."""
    renames = {}
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((o for o in others if o in df.columns), None)
            if found:
                renames[found] = name
    return df.withColumnsRenamed(renames)


def coerced(column: Column, kind: str) -> Column:
    """A value as int, float, timestamp or time of day (``HH:mm:ss``); what cannot be read is null."""
    if kind == "time":
        return F.date_format(F.try_to_timestamp(column.cast("string")), "HH:mm:ss")
    if kind == "timestamp":
        return F.try_to_timestamp(column.cast("string"))
    return column.cast("string").try_cast({"int": "long", "float": "double"}.get(kind, kind))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({c: coerced(F.col(c), kind) for c, kind in types.items() if c in df.columns})


def with_period(df: DataFrame, ts: str, source_year: str) -> DataFrame:
    """Adds the year of a timestamp, and whether it is the nominal one."""
    year = F.year(ts)
    return df.withColumns({"period": year, "in_nominal": year == F.col(source_year)})


def split_overlap(df: DataFrame, mark: str = "in_nominal") -> tuple[DataFrame, DataFrame]:
    """Rows within their nominal period, and the rest; null counts as outside."""
    inside = F.coalesce(F.col(mark), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def period_slice(df: DataFrame, column: str, value, view: str | None = None) -> DataFrame:
    """One period; on a partition column the scan is pruned."""
    out = df.filter(F.col(column) == value)
    if view:
        out.createOrReplaceTempView(view)
    return out


def lookup_table(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Narrow projection for lookups; ``lookup.write_lookup`` keeps it by a key."""
    return df.select(*keys, *columns)


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def explode_labels(catalogue: DataFrame, name: str, labels: str) -> DataFrame:
    """A map of raw value to label as rows: place, raw text and number, kind, whether it marks a missing value, trimmed label."""
    entries = catalogue.select(name, F.posexplode(F.map_entries(labels)).alias("place", "entry"))
    raw = F.col("entry.key")
    number = raw.try_cast("double")
    return entries.select(
        name, "place", raw.alias("raw_text"), number.alias("raw_number"),
        F.when(number.isNotNull(), "number").otherwise("string").alias("kind"),
        raw.startswith(".").alias("is_missing"), F.trim("entry.value").alias("label"),
    )
