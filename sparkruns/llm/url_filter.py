"""URL rules: a blocked Bloom filter before an exact hash join.

A rule is a host and the beginning of a path. It fits urls of that host and its
subdomains whose path begins so. A page's possible rules are its host's
suffixes with beginnings of its path, of the lengths that rules have. Each such
canonical url is tested against a blocked Bloom filter (one 512-bit block for
each url, a few bits in it); possible hits go on to an exact join with the rules,
which removes the false positives. The longest rule wins; pages without a rule
get the verdict that the filter gives unlisted urls, ``allow``, and are not
shuffled.

Executors build the filter, each a range of its blocks. Up to ``MAX_BYTES``, which
the number of rules proves, its parts are put together and broadcast; a larger
one stays in its parts, and the distinct possible urls are dealt to them.

Defined results: a null url, or one without ``://``, has an empty host and path
and fits no rule; rules with equal host and path count as one that blocks if any
of them does; very long urls are judged whole; repeated pages are judged each; an
empty table gives an empty result, and no rules leave every page allowed; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize, mix64, session_of

#: Bits of the filter for each rule, and the most bytes of it that are broadcast; a larger one stays in its parts.
BITS = 16
MAX_BYTES = 64 << 20
#: Blocks of a part (64 bytes each).
PART = 1 << 16
_BLOCK = 512
_HASHES = 6
DEFAULT = "allow"


def block_numbers(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix64(h) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


class BlockedBloom:
    """A filter of so many blocks, or the range of them that begins at ``first``."""

    def __init__(self, blocks: int, words: np.ndarray | None = None, first: int = 0):
        self.blocks, self.first = max(1, blocks), first
        self.words = np.zeros((self.blocks, _BLOCK // 64), np.uint64) if words is None else words

    @staticmethod
    def _bits(h: np.ndarray):
        for i in range(_HASHES):
            bit = mix64(h + np.uint64(i + 1)) >> np.uint64(55)
            yield (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        block = block_numbers(h, self.blocks) - self.first
        for word, bit in self._bits(h):
            np.bitwise_or.at(self.words, (block, word), bit)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        block = block_numbers(h, self.blocks) - self.first
        out = np.ones(len(h), bool)
        for word, bit in self._bits(h):
            out &= (self.words[block, word] & bit) != 0
        return out


def _to_parts(urls: DataFrame, blocks: int) -> DataFrame:
    """(part, h, url) of canonical urls."""

    def run(batches):
        for batch in batches:
            h = batch.column("h").to_numpy()
            part = block_numbers(h.view(np.uint64), blocks) // PART
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(h, pa.int64()), batch.column("url")], ["part", "h", "url"])

    return urls.select(F.xxhash64("url").alias("h"), "url").mapInArrow(run, "part long, h long, url string")


def _range_of(part: int, blocks: int, words: bytes | None = None) -> BlockedBloom:
    n = min(PART, blocks - part * PART)
    held = np.zeros((n, _BLOCK // 64), np.uint64) if words is None else np.frombuffer(words, np.uint64).reshape(n, -1)
    return BlockedBloom(blocks, held, part * PART)


def _built(listed: DataFrame, blocks: int) -> DataFrame:
    """(part, words): the filter of the rules, in ranges of blocks."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        bloom = _range_of(part, blocks)
        bloom.add(table.column("h").to_numpy().view(np.uint64))
        return pa.table({"part": pa.array([part], pa.int64()), "words": pa.array([bloom.words.tobytes()], pa.binary())})

    return _to_parts(listed.select("url"), blocks).groupBy("part").applyInArrow(run, "part long, words binary")


def _possible(urls: DataFrame, parts: DataFrame, blocks: int) -> DataFrame:
    """The urls that the filter's parts may hold."""

    def run(table: pa.Table, filters: pa.Table) -> pa.Table:
        if not len(table) or not len(filters):
            return pa.table({"url": pa.array([], pa.string())})
        bloom = _range_of(filters.column("part")[0].as_py(), blocks, filters.column("words")[0].as_py())
        return pa.table({"url": table.column("url").filter(pa.array(bloom.may_hold(table.column("h").to_numpy().view(np.uint64))))})

    return _to_parts(urls, blocks).groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(run, "url string")


def split_url(url):
    """(host, path) columns: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _candidates(host, path, labels: int, lengths: list[int]):
    """Canonical urls (suffix of the host, beginning of the path) that rules of so many labels and these path lengths can have."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), ".")
    )
    starts = F.array_distinct(F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda s: s.isNotNull()))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, F.lit("\n"), p))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; rules: host, path, verdict (allow or block)."""
    spark = session_of(pages)
    host, path = split_url(pages[url_col])
    listed = (
        rules.select(F.translate("host", UPPER, UPPER.lower()).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
        .filter(F.col("h").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("h", "p").agg(F.max("verdict").alias("verdict"))
        .select(F.concat("h", F.lit("\n"), "p").alias("url"), F.concat("h", "p").alias("rule"), "verdict", F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("length"))
    )
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.max("labels").alias("labels"), F.collect_set("length").alias("lengths")).first()
    judged = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    possible = _candidates(F.col("host"), F.col("path"), shape["labels"], sorted(shape["lengths"]))
    judged = judged.withColumn("urls", possible)
    exact = listed.select("url", "rule", "verdict")
    blocks = -(-shape["n"] * BITS // _BLOCK)
    parts = _built(listed, blocks)
    if blocks * _BLOCK // 8 <= MAX_BYTES:
        bloom = BlockedBloom(blocks)
        for row in parts.collect():
            some = np.frombuffer(row.words, np.uint64).reshape(-1, _BLOCK // 64)
            bloom.words[row.part * PART : row.part * PART + len(some)] = some
        shared = spark.sparkContext.broadcast(bloom)

        @F.pandas_udf("array<boolean>")
        def may_hold(lists):
            n = lists.map(len).to_numpy()
            flat = np.concatenate(lists.to_list()).astype(np.int64).view(np.uint64) if n.sum() else np.zeros(0, np.uint64)
            return pd.Series([x.tolist() for x in np.split(shared.value.may_hold(flat), np.cumsum(n)[:-1])] if len(n) else [], dtype=object)

        # so called, it is a step of its own, into which no later filter is pushed
        hit = may_hold.asNondeterministic()(F.transform("urls", lambda u: F.xxhash64(u)))
        judged = judged.withColumn("hits", hit)
        judged = judged.withColumn("urls", F.transform(F.filter(F.arrays_zip("urls", "hits"), lambda x: x["hits"]), lambda x: x["urls"]))
    else:
        # the filter is too large for a task: what it passes, and the rules confirm, is joined
        urls = judged.select(F.explode("urls").alias("url")).distinct()
        exact = materialize(_possible(urls, parts, blocks).join(exact, "url"), "url-hits")
    misses = judged.filter(F.size("urls") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(DEFAULT).alias("verdict"))
    # each page keeps its row; the winning rule is the longest of its exact hits
    rows = judged.filter(F.size("urls") > 0).withColumn("row", F.monotonically_increasing_id())
    found = rows.select("id", "host", "path", "row", F.explode("urls").alias("url")).join(exact, "url", "left")
    won = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))))
    out = found.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), won.alias("won"))
    return misses.union(out.select("id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(DEFAULT)).alias("verdict")))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).withColumnRenamed("id", "page_id")


OP6_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, v DESC) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hits WHERE n = 1
"""
