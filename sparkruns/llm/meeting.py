"""Which keys of documents occur in several documents: packed arrays meet in buckets, and answers go back by block.

Texts are written once as blocks: packed rows of some megabytes of consecutive
texts, whose number follows the bytes of the input. A block asks the bucket of a
key (the hash of a piece of text) once, whatever the number of its documents
that have the key, and the bucket answers with the key's number of documents
(rows, that is: rows that repeat an identifier count each).
The number of buckets follows the bytes as well, so that no group grows with the
table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, mix64, partitions, session_of

#: Bytes and rows of a block: a row's handle is its block's number and its place there.
BLOCK_BYTES = 4 << 20
ROW_BITS = 16
#: Bytes of text whose keys go to one bucket.
BUCKET_BYTES = 8 << 20
LOWEST = -(1 << 63)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; numbers are stored byte plane by byte plane."""
    parts = [np.asarray([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(a.dtype.str.encode().ljust(4))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"")
    return zstandard.compress(b"".join(parts), level)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    lengths = np.frombuffer(raw, np.int64, n, 8)
    at, out = 8 + 8 * n, []
    for length in lengths.tolist():
        kind = np.dtype(raw[at : at + 4].decode().strip())
        at += 4
        size = length * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += size
    return out


def joined(tables: list[list[np.ndarray]], kinds: list) -> list[np.ndarray]:
    return [np.concatenate([t[i] for t in tables]) if tables else np.zeros(0, k) for i, k in enumerate(kinds)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix64(h) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def split_by(key: np.ndarray, buckets: int):
    """(bucket, places) for each bucket that occurs; places keep their order."""
    order = np.argsort(key, kind="stable")
    cuts = np.searchsorted(key[order], np.arange(buckets + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


ROW = "key long, kind int, data binary"


def rows(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())],
        ["key", "kind", "data"],
    )


def key48(h: np.ndarray) -> np.ndarray:
    """48 bits of a hash; a collision only lets a key pass for one of several documents."""
    return h >> np.uint64(16)


def _blocks_of(batches) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 24
    number = size = 0
    held: list[tuple[int, int, bytes]] = []
    forget()

    def flush():
        ids, hashes = (np.asarray([x[i] for x in held], np.int64) for i in (0, 1))
        lengths = np.asarray([len(x[2]) for x in held], np.int64)
        data = pack(ids, hashes, lengths, np.frombuffer(b"".join(x[2] for x in held), np.uint8), level=3)
        return pa.RecordBatch.from_arrays([pa.array([first + number]), pa.array([size]), pa.array([data], pa.binary())], ["block", "size", "data"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("id", "hash", "text")), strict=True):
            if held and (size + len(row[2]) > BLOCK_BYTES or len(held) >= 1 << ROW_BITS):
                yield flush()
                held, size, number = [], 0, number + 1
            held.append(row)
            size += len(row[2])
    if held:
        yield flush()


def blocked(docs: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, int]:
    """(block, size, data) of all rows, written once, and the number of buckets that their bytes ask for.

    A null identifier is the lowest number, a null text is empty.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    plain = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(docs[text_col]).alias("hash"), text.cast("binary").alias("text")
    )
    blocks = materialize(plain.mapInArrow(_blocks_of, "block long, size long, data binary"), name)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    return blocks, max(partitions(session_of(docs)), -(-size // BUCKET_BYTES))


class Block:
    """The rows of a block: ``ids``, ``hashes`` of the texts, and ``texts`` in UTF-8."""

    def __init__(self, number: int, data: bytes):
        self.number = number
        self.ids, self.hashes, lengths, buffer = unpack(data)
        raw, ends = buffer.tobytes(), np.cumsum(lengths).tolist()
        self.texts = [raw[a:z] for a, z in zip([0, *ends], ends)]

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        return cls(table.column("block")[0].as_py(), table.column("data")[0].as_py())


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives through many groups and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def frugal(run):
    """``run``, a function of one or two tables, that gives back memory after each group."""

    @wraps(run)
    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    @wraps(run)
    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        out = run(table, other)
        give_back()
        return out

    return two if run.__code__.co_argcount == 2 else one


def grouped(df: DataFrame, key: str, buckets: int):
    return df.repartition(buckets, key).groupBy(key)


def by_block(blocks: DataFrame, other: DataFrame, buckets: int):
    """Blocks with what ``other`` has for them (column ``block``)."""
    return grouped(blocks, "block", buckets).cogroup(grouped(other, "block", buckets))


def _ask(extract, buckets: int):
    """Of each block: its distinct keys and the number of rows of each, to the keys' buckets."""

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                of, keys = extract(Block(number, data).texts)
                order = np.lexsort((of, keys))
                keys, of = keys[order], of[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])) if len(keys) else np.zeros(0, bool)
                keys = keys[new]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(keys))).astype(np.uint32)
                keys = keys[first]
                me = np.asarray([number], np.int64)
                yield rows((bucket, 0, pack(keys[at], count[at], me)) for bucket, at in split_by(bucket_of(keys, buckets), buckets))
                del keys, of, order, new, first, count
                give_back()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """To each block that asked: the keys that several rows have, with their numbers of rows."""
    asked = [unpack(d) for d in table.column("data").to_pylist()]
    keys, count = joined([a[:2] for a in asked], [np.uint64, np.uint32])
    asker = np.repeat(np.arange(len(asked)), [len(a[0]) for a in asked])
    found = []
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys, count, asker = keys[order], count[order], asker[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        total = np.minimum(np.add.reduceat(count.astype(np.int64), first), 0xFFFFFFFF).astype(np.uint32)
        total = np.repeat(total, size)
        pick = total > 1
        keys, total, asker = keys[pick], total[pick], asker[pick]
        found = [(int(asked[a][2][0]), 1, pack(keys[at], total[at])) for a, at in split_by(asker, len(asked))]
    return pa.Table.from_batches([rows(found)])


def shared_keys(blocks: DataFrame, extract, buckets: int) -> DataFrame:
    """Answers (block, data): the block's keys that occur in several documents, and in how many.

    ``extract`` gives of texts the (text number, 48-bit key) pairs.
    """
    asked = blocks.select("block", "data").mapInArrow(_ask(extract, buckets), ROW)
    return grouped(asked, "key", buckets).applyInArrow(frugal(_answer), ROW).select(F.col("key").alias("block"), "data")


def documents_of(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The number of documents of each key by a block's answers; 1 where they do not name it."""
    known, total = joined([unpack(x) for x in answers.column("data").to_pylist()], [np.uint64, np.uint32])
    if not len(known):
        return np.ones(len(keys), np.int64)
    order = np.argsort(known)
    known, total = known[order], total[order]
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, total[at].astype(np.int64), 1)


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x
