"""Helpers shared by the corpus operators: shared scratch tables and vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_S33 = np.uint64(33)

#: A-Z to a-z, and the white space \x09-\x0D to a space, on UTF-8 bytes.
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders asked for within it are removed at its end, but for those of ``materialize(..., outer=True)``.

    Whatever is used after the scope must have been written by then.
    """
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, name: str, outer: bool = False) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a session
    that names none gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkruns-")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-2:-1] if outer else _scopes[-1:]:
        scope.append(folder)
    return folder


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back: cuts lineage, survives lost executors.

    With ``outer`` the table belongs to the scope around the current one, if any.
    """
    spark = session_of(df)
    path = scratch_dir(spark, name, outer)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker process keeps from one task to the next, by operator; each value has ``clear``.
WORKER_CACHES: dict[str, dict] = {}


def forget(*but: str) -> None:
    """Empties what this worker keeps for other operators than ``but``: workers live through many stages and runs."""
    for name, cache in WORKER_CACHES.items():
        if name not in but:
            cache.clear()


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """How many buckets a shuffle is dealt into; follows the session, as the cluster's user sets it for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_az(col):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h = h * _MIX
    return h ^ (h >> _S33)


def _byte_table() -> np.ndarray:
    return mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULT) | np.uint64(1)


BYTE_HASH = _byte_table()


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand within a worker."""

    _inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            up = np.full(size, _MULT, np.uint64)
            down = np.full(size, cls._inverse, np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def text_blocks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], fold: bytes = _FOLD, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts (A-Z lower-cased), and each word's text number.

    ``fold`` maps bytes first; those that it maps to a space divide words. The
    hashes of the first n bytes of longer words, for each n in ``prefixes``,
    follow those of the words.

    A word's hash is a range of one running polynomial over the block, so no
    Python code runs per word.
    """
    joined = b" ".join(texts).translate(fold) + b" "
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = b == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(b) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    up, down = Powers.to(len(b) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[b] * up[: len(b)], dtype=np.uint64)])
    of = np.searchsorted(ends, start, side="right")
    hashes, texts_of = [], []
    for n in (0, *prefixes):
        at = (stop - start > n) if n else slice(None)
        a = start[at]
        z = a + n if n else stop
        hashes.append(mix64((run[z] - run[a]) * down[a] + (z - a).astype(np.uint64) + np.uint64(n << 32)))
        texts_of.append(of[at])
    return (hashes[0], of) if not prefixes else (np.concatenate(hashes), np.concatenate(texts_of))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct ``size``-word shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    out: list[np.ndarray] = []
    none = np.zeros(0, np.uint64)
    for lo, hi in text_blocks(texts):
        words, of = word_hashes(texts[lo:hi])
        bounds = np.searchsorted(of, np.arange(hi - lo + 1))
        full = none
        if len(words) >= size:
            full = words[: len(words) - size + 1]
            for k in range(1, size):
                full = mix64(full * _MULT + words[k : len(words) - size + 1 + k])
        for i in range(hi - lo):
            a, z = bounds[i], bounds[i + 1]
            if z - a >= size:
                out.append(np.unique(full[a : z - size + 1]))
            elif z > a:
                h = words[a : a + 1]
                for k in range(a + 1, z):
                    h = mix64(h * _MULT + words[k : k + 1])
                out.append(mix64(h + np.uint64(z - a)))
            else:
                out.append(none)
    return out


#: As above, and all other ASCII characters but letters and digits to a space.
TERMS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER_AZ)


def text_column(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def held_out(id_col):
    """Whether crc32 of the identifier as text leaves the remainder 0 modulo 5; false for a null identifier."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


#: Bytes of the longest text that a classifier is fitted on (scoring has no such bound).
FIT_BYTES = 1 << 17


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, text, y) of at most ``rows`` labelled documents of at most FIT_BYTES outside the held-out fold, in an order by hash.

    Both bounds hold whatever repeats: of rows with one identifier the text that sorts first counts. The sample of
    labels is bounded, and so is its broadcast; the texts come from one scan.
    """
    some = (
        labels.select(labels[id_col].alias("i"), labels[label].cast("int").alias("y"))
        .filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
        .orderBy(F.xxhash64("i"), "i", "y").limit(rows)
    )
    texts = docs.select(docs[id_col].alias("i"), docs[text_col].alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_BYTES)
    return texts.join(F.broadcast(some), "i").groupBy("i").agg(F.min("text").alias("text"), F.max("y").alias("y"))
