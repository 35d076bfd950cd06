"""Token files as wavelet matrices.

A shard holds the ids of consecutive documents as one bit plane for each bit of
an id, most significant first; each plane is in the order that a stable split by
the plane before leaves. A directory of ones before each 512 bits makes rank
direct and select a search, so that single tokens, counts and occurrences are
found in place: ``tokens_at``, ``token_counts`` and ``token_occurrences`` decode
nothing. A shard takes about as many bits for an id as the largest has, and its
value is used as it is::

    magic "WVM1", uint32 bits, uint64 ids, uint64 documents,
    int64 identifier and uint64 first id of each document (and one past the last),
    for each plane: uint64 zeros, the packed bits, uint32 ones before each 512 bits

Shards are written by Spark's own writer as values of a Parquet table (columns
``part``, ``place``, ``n_ids``, ``n_docs``, ``shard``), so that any store that
Spark writes to can hold them, and failed tasks leave nothing behind.

Defined results: null text counts as empty and leaves the end id alone; a null
identifier comes first and is read back as null; rows with one identifier stay
apart, ordered by text; a document is never split, so that one whose shard passes
the two gigabytes of a binary value (about 900 million ids) fails; an empty table
gives no shard and an empty result; other columns, whatever their names, are not
read. Tokens that do not occur count zero; places beyond a document give null.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch_dir, session_of
from .word_tokens import encoded_blocks

END_ID = 1
#: Ids after which a shard is closed; documents are not split.
SHARD_IDS = 1 << 18
_WORD = 512
_NULL = -(1 << 63)


class WaveletMatrix:
    """Succinct sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        planes, zeros, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes.append(packed)
            zeros.append(len(ids) - int(np.count_nonzero(one)))
            ranks.append(cls._directory(packed))
            ids = np.concatenate([ids[~one], ids[one]])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, 8).sum(1)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        word, rest = divmod(i, _WORD)
        part = self.planes[level][word * 64 : word * 64 + -(-rest // 8)]
        n = int(np.bitwise_count(part).sum()) if len(part) else 0
        if rest % 8 and len(part):
            n -= (int(part[-1]) >> (rest % 8)).bit_count()
        return int(self.ranks[level][word]) + n

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often an id occurs before place i."""
        if value >> len(self.planes):
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(len(self.planes)):
            a, z = self._ones(level, lo), self._ones(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + z
            else:
                lo, hi = lo - a, hi - z
        return hi - lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id; -1 if there are not so many."""
        if k < 0 or k >= self.rank(value, self.n):
            return -1
        lo, path = 0, []
        for level in range(len(self.planes)):
            bit, ones = value >> (len(self.planes) - 1 - level) & 1, self._ones(level, lo)
            lo = self.zeros[level] + ones if bit else lo - ones
            path.append(bit)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            at = self._place(level, path[level], at - self.zeros[level] if path[level] else at)
        return at

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th bit of a kind in a plane, by bisection of its ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane on, each puts the lower bits of its zeros and ones back in their places."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(value)
            before[~one] = value[:zeros]
            before[one] = value[zeros:] | kind(1 << level)
            value = before
        return value.astype(np.uint32)


def write_shard(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """starts: the first id of each document, and one past the last."""
    matrix = WaveletMatrix.build(ids)
    parts = [b"WVM1", struct.pack("<IQQ", len(matrix.planes), len(ids), len(doc_ids)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for zeros, plane, ranks in zip(matrix.zeros, matrix.planes, matrix.ranks, strict=True):
        parts += [struct.pack("<Q", zeros), plane.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


def read_shard(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' identifiers and their starts (one more), as views of the value."""
    if raw[:4] != b"WVM1":
        raise ValueError("not a token shard")
    bits, n, docs = struct.unpack_from("<IQQ", raw, 4)
    at = 24
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    starts = np.frombuffer(raw, "<u8", docs + 1, at).astype(np.int64)
    at += 8 * (docs + 1)
    zeros, planes, ranks = [], [], []
    size = -(-n // 8)
    for _ in range(bits):
        zeros.append(struct.unpack_from("<Q", raw, at)[0])
        planes.append(np.frombuffer(raw, np.uint8, size, at + 8))
        at += 8 + size
        words = -(-size // 64) + 1
        ranks.append(np.frombuffer(raw, "<u4", words, at))
        at += 4 * words
    return WaveletMatrix(n, planes, zeros, ranks), doc_ids, starts


_SHARDS = "part int, place int, n_ids long, n_docs long, shard binary"


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encodes all texts into shards in ascending order of the identifier; texts move once, by range."""
    spark = session_of(docs)
    ordered = (
        docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
        .repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    )

    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        held_ids: list[int] = []
        size = 0

        def shard():
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            data = write_shard(np.concatenate(held), np.asarray(held_ids, np.int64), starts)
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "n_ids": size, "n_docs": len(held), "shard": data}], pa.schema([("part", pa.int32()), ("place", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            keys = batch.column("id").fill_null(_NULL).to_pylist()
            for lo, ids in encoded_blocks(tokenizer, batch, "text", end_id):
                for k, x in enumerate(ids):
                    held.append(x)
                    held_ids.append(keys[lo + k])
                    size += len(x)
                    if size >= SHARD_IDS:
                        yield shard()
                        held, held_ids, size, place = [], [], 0, place + 1
        if held:
            yield shard()

    ordered.mapInArrow(run, _SHARDS).write.mode("overwrite").parquet(folder)


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, from the shards; start counts all ids of documents before it."""
    shards = spark.read.schema(_SHARDS).parquet(folder)

    def run(batches):
        for batch in batches:
            for part, place, data in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "shard")), strict=True):
                matrix, doc_ids, starts = read_shard(data)
                ids = matrix.decode()
                n = len(doc_ids)
                for lo in range(0, n, 500):
                    hi = min(lo + 500, n)
                    flat = pa.array(ids[starts[lo] : starts[hi]], pa.uint32()).cast(pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(starts[lo : hi + 1] - starts[lo], pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (hi - lo), pa.int32()), pa.array([place] * (hi - lo), pa.int32()), pa.array(doc_ids[lo:hi], pa.int64(), mask=doc_ids[lo:hi] == _NULL), pa.array(starts[lo:hi], pa.int64()), pa.array(np.diff(starts[lo : hi + 1]), pa.int64()), lists],
                        ["part", "place", "id", "within", "n_tokens", "ids"],
                    )

    docs = shards.mapInArrow(run, "part int, place int, id long, within long, n_tokens long, ids array<int>")
    return _with_start(docs, shards).select("id", "start", "n_tokens", "ids")


def _with_start(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds the ids of all earlier shards: of earlier parts, summed by a row for each part, and within the part."""
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("parts_before"))
    within = shards.select("part", "place", earlier(Window.partitionBy("part").orderBy("place")).alias("part_before"))
    offsets = within.join(parts, "part").select("part", "place", (F.col("parts_before") + F.col("part_before")).alias("before"))
    return docs.join(offsets, ["part", "place"]).withColumn("start", F.col("before") + F.col("within"))


def _shard_map(spark: SparkSession, folder: str, found, schema: str) -> DataFrame:
    """Rows that ``found`` yields of each shard: (part, place, matrix, identifiers, starts)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part, place, data in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "shard")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found(part, place, *read_shard(data))], names)

    return spark.read.schema(_SHARDS).parquet(folder).mapInArrow(run, schema)


def token_counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each id occurs in all documents, by rank."""

    def found(part, place, matrix, ids, starts):
        return np.asarray(tokens, np.int64), np.asarray([matrix.rank(t, matrix.n) for t in tokens], np.int64)

    counts = _shard_map(spark, folder, found, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    asked = spark.createDataFrame([(t,) for t in sorted(set(tokens))], "token long")
    return asked.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def token_occurrences(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, id, position): each place of an id, as its document and the place in it, by select."""

    def found(part, place, matrix, ids, starts):
        at = [(t, matrix.select(t, k)) for t in sorted(set(tokens)) for k in range(matrix.rank(t, matrix.n))]
        token, where = (np.asarray([x[i] for x in at], np.int64) for i in (0, 1))
        doc = np.searchsorted(starts, where, side="right") - 1
        return token, pa.array(ids[doc], pa.int64(), mask=ids[doc] == _NULL), where - starts[doc]

    return _shard_map(spark, folder, found, "token long, id long, position long")


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(id, position, token) of the rows (id, position) of ``wanted``, by access; each shard is read once, with its own rows."""

    def heads(part, place, matrix, ids, starts):
        n = len(ids)
        return np.full(n, part, np.int32), np.full(n, place, np.int32), pa.array(ids, pa.int64(), mask=ids == _NULL), starts[:-1], np.diff(starts)

    def run(rows: pa.Table, shards: pa.Table) -> pa.Table:
        if not len(rows) or not len(shards):
            return pa.table({"id": pa.array([], pa.int64()), "position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        matrix, _, _ = read_shard(shards.column("shard")[0].as_py())
        token = [matrix.access(i) for i in rows.column("at").to_pylist()]
        return pa.table({"id": rows.column("id"), "position": rows.column("position"), "token": pa.array(token, pa.int64())})

    docs = _shard_map(spark, folder, heads, "part int, place int, id long, within long, n_tokens long")
    places = wanted.select("id", "position").join(docs, "id").filter("position >= 0 and position < n_tokens")
    places = places.select("part", "place", "id", "position", (F.col("within") + F.col("position")).alias("at"))
    shards = spark.read.schema(_SHARDS).parquet(folder).select("part", "place", "shard")
    got = places.groupBy("part", "place").cogroup(shards.groupBy("part", "place")).applyInArrow(run, "id long, position long, token long")
    return wanted.select("id", "position").join(got, ["id", "position"], "left")


def shard_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    shards = spark.read.schema(_SHARDS).parquet(folder)

    def run(batches):
        for batch in batches:
            for part, place, data in zip(*(batch.column(c).to_pylist() for c in ("part", "place", "shard")), strict=True):
                matrix, doc_ids, starts = read_shard(data)
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([place] * n, pa.int32()), pa.array(doc_ids, pa.int64(), mask=doc_ids == _NULL), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "place", "id", "within", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(run, "part int, place int, id long, within long, n_tokens long, ids_crc32 long")
    return _with_start(docs, shards).select("id", "start", "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "token-shards")
    write_token_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return shard_digests(spark, folder).withColumnRenamed("id", "doc_id")
