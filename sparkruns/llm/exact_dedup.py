"""Exact deduplication with disk-backed streaming state (DataFrame and SQL functions only).

Rows are staged as (digest, identifier, text) in a shared inbox; a stateful
streaming aggregation keyed by digest, without watermark and so without expiry,
keeps for each text its digest, the identifier of the row that stays, its content
locator (the staged file that holds its bytes) and the number of copies in a
RocksDB state store. A digest seen again, in the same batch or a later one, is a
hit: the full bytes of all its rows, of every batch, are compared before they
count as copies. Digests that turn out to be of several texts are remembered.

Defined results: null text counts as the empty text, and empty texts are copies
of each other; a null identifier loses against any other; of rows that repeat
identifier and text exactly one stays; very long texts are compared whole; an
empty table gives an empty result; other columns, whatever their names, are not
touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_names, lower_az, materialize, scratch_dir, scratch_scope, session_of

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # each of many small stores would take 4 MB of disk ahead of need
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Digests of hits are broadcast up to this number (some 40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_HITS = 100_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class StreamingExactDedup:
    """Keyed state in ``folder``; each ``ingest`` adds a batch of rows, and state never expires."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_dir(spark, "exact-dedup")
        self.inbox, self.checkpoint, self.clashes = (f"{self.folder}/{x}" for x in ("inbox", "checkpoint", "clashes"))

    def ingest(self, keyed: DataFrame) -> DataFrame:
        """Add rows (digest, id, text) to the state; returns the staged rows of all batches, each with its own row number."""
        batch = f"{self._parts(self.inbox):010d}"
        staged = keyed.select(
            "digest", F.col("id").cast("long").alias("id"), "text",
            F.concat_ws(":", F.lit(batch), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("row"),
        )
        staged.write.mode("append").parquet(self.inbox)
        previous = {k: self.spark.conf.get(k, None) for k in _STATE}
        for k, v in _STATE.items():
            self.spark.conf.set(k, v)
        try:
            rows = self.spark.readStream.schema(staged.schema).parquet(self.inbox)
            best = F.struct("id", "row")
            state = rows.withColumn("locator", F.col("_metadata.file_path")).groupBy("digest").agg(
                F.max(best).alias("keep"), F.max_by("locator", best).alias("locator"), F.count(F.lit(1)).alias("group_size")
            )
            query = (
                state.writeStream.outputMode("update").format("noop")
                .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            )
            query.awaitTermination()
        finally:
            for k, v in previous.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        rows = self.spark.read.schema(staged.schema).parquet(self.inbox)
        self._compare_bytes(rows, rows.filter(F.col("row").startswith(batch)), first=int(batch) == 0)
        return rows

    def _parts(self, folder: str) -> int:
        """How many files a folder has; none if there is no folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    def _compare_bytes(self, rows: DataFrame, batch: DataFrame, first: bool) -> None:
        """Remembers the digests of the batch that several texts have, of whatever batch.

        Grouping by digest and text compares whole texts and sums up copies before the shuffle.
        """
        hits = self.state().filter("group_size > 1").select("digest")
        if not first:
            hits = hits.join(batch.select("digest").distinct(), "digest", "left_semi")
        hits = materialize(hits, "exact-hits")
        side = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
        texts = rows.join(side, "digest", "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
        found = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "exact-clashes")
        if not found.isEmpty():
            found.write.mode("append").parquet(self.clashes)

    def clashing(self) -> DataFrame | None:
        """Digests that more than one text has; None if there are none."""
        return self.spark.read.parquet(self.clashes).distinct() if self._parts(self.clashes) else None

    def state(self) -> DataFrame:
        """digest, keep_id, keep_row, locator, group_size of every text so far, read from the state store."""
        raw = self.spark.read.format("statestore").load(self.checkpoint)
        key, value = raw.schema["key"].dataType.names[0], raw.schema["value"].dataType.names
        # the buffers, in the order of the aggregates: the largest (id, row), max_by's value and order, the count
        keep, locator, count = value[0], value[1], value[-1]
        return raw.select(
            F.col("key")[key].alias("digest"),
            F.col("value")[keep]["id"].alias("keep_id"),
            F.col("value")[keep]["row"].alias("keep_row"),
            F.col("value")[locator].alias("locator"),
            F.col("value")[count].alias("group_size"),
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_digest, folder: str | None = None) -> DataFrame:
    """One row per row, of this and all earlier batches of ``folder``: id, digest, keep_id, group_size, kept.

    Texts are equal if they are identical after lower-casing A-Z.
    """
    norm = lower_az(docs[text_col])
    dedup = StreamingExactDedup(session_of(docs), folder)
    rows = dedup.ingest(docs.select(digest(norm).alias("digest"), docs[id_col].alias("id"), norm.alias("text")))
    state = materialize(dedup.state(), "exact-state")
    # the state has a row for each digest, and skewed digests of the other side are split by adaptive execution
    plain = rows.select("id", "digest", "row").join(state, "digest").select(
        "id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept")
    )
    clashes = dedup.clashing()
    if clashes is None:
        return plain
    same = Window.partitionBy("digest", "text")
    best = F.max(F.struct("id", "row")).over(same)
    apart = rows.join(clashes, "digest", "left_semi").select(
        "id", "digest", best["id"].alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"),
        (F.col("row") == best["row"]).alias("kept"),
    )
    return plain.join(clashes, "digest", "left_anti").unionByName(apart)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns, whatever their names, unchanged."""
    i, d, mark = fresh_names(docs, "id", "digest", "row_number")
    with scratch_scope(session_of(docs)):
        groups = exact_groups(docs, id_col, text_col).filter("kept")
        kept = materialize(groups.select(F.col("id").alias(i), F.col("digest").alias(d)), "exact-kept", outer=True)
    key = sha256_digest(lower_az(docs[text_col]))
    rows = docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col(i)) & (key == F.col(d)), "left_semi")
    groups = docs.groupBy(docs[id_col].alias(i), key.alias(d)).agg(F.count(F.lit(1)).alias(mark))
    if groups.filter(F.col(mark) > 1).isEmpty():
        return rows
    # rows that repeat identifier and text: one of each
    order = Window.partitionBy(id_col, sha256_digest(lower_az(F.col(text_col)))).orderBy(F.lit(1))
    return rows.withColumn(mark, F.row_number().over(order)).filter(F.col(mark) == 1).drop(mark)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = """
WITH norm AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), keyed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM norm)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM keyed
"""
