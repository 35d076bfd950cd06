"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Equal vectors are merged first and keep their smallest identifiers, enough for
any answer whichever identifier asks, so that no leaf fills up with copies. The tree is fitted on a
bounded sample of vectors, lifted by one coordinate so that the largest inner
product is the least distance; every vector is indexed in a leaf. A query takes
leaves from a priority queue, nearest branch first. How many leaves it visits is
calibrated: for a bounded sample of queries the exact answers over all vectors
are computed, and visits are widened until these are found to the wanted share.
Leaves are dealt in blocks of bounded size, and (leaf, query) pairs travel as
packed arrays.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, as candidates or as
queries; ties go to the smaller identifier; rows that repeat an identifier are
candidates each, but none for its own identifier; rows with a null identifier
take no part; with fewer candidates than wanted all are returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions, session_of
from .meeting import joined, pack, split_by, unpack

#: Bounds on what the driver gets: vectors for the tree, queries for the calibration.
TREE_SAMPLE = 20_000
CALIBRATION = 128
RECALL = 0.96
BRANCHES = 8
#: Vectors of a block of a leaf.
BLOCK = 20_000


@dataclass
class KMeansTree:
    """children[i]: the nodes below node i; leaf[i]: its leaf number, or -1; centres: one row for each node."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    leaves: int
    longest: float

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, longest: float, seed: int = 3) -> KMeansTree:
        rng = np.random.default_rng(seed)
        least = max(1, len(x) // max(leaves, 1))
        centres, children, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = min(BRANCHES, max(1, round(len(rows) / least)))
            if parts < 2:
                continue
            found, of = _kmeans(x[rows], parts, rng)
            kept = [k for k in range(parts) if (of == k).any()]
            if len(kept) < 2:
                continue
            for k in kept:
                children[node].append(len(centres))
                todo.append((len(centres), rows[of == k]))
                centres.append(found[k])
                children.append([])
        leaf = np.full(len(centres), -1)
        ends = [i for i, c in enumerate(children) if not c]
        leaf[ends] = np.arange(len(ends))
        return cls(np.asarray(centres), children, leaf, len(ends), longest)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        x = self.lift(x)
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[below]
                near = (x[rows] @ c.T * -2 + (c * c).sum(1)).argmin(1)
                todo += [(child, rows[near == k]) for k, child in enumerate(below)]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves for one query, in the order of the priority queue."""
        q = np.append(q * (self.longest / np.sqrt((q * q).sum())), 0.0)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                out.append(int(self.leaf[node]))
                continue
            d = ((self.centres[below] - q) ** 2).sum(1)
            for far, child in zip(d.tolist(), below, strict=True):
                heapq.heappush(queue, (far, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    of = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        of = (x @ centres.T * -2 + (centres * centres).sum(1)).argmin(1)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres, of


def _enough(ids: list[int], k: int) -> list[int]:
    """Places of the candidates, given best first, that the best ``k`` without one identifier can need, whichever it is; 2 * k at most."""
    if len(set(ids[: k + 1])) == k + 1:
        return list(range(k + 1))
    kept, times, most = [], {}, 0
    for place, i in enumerate(ids):
        if len(kept) - most >= k:
            break
        n = times.get(i, 0) + 1
        if n <= k:
            kept.append(place)
            times[i] = n
            most = max(most, n)
    return kept


def _smallest(ids: list[int], k: int) -> list[int]:
    ids = sorted(ids)
    return [ids[place] for place in _enough(ids, k)]


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def _sound(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their common length (that of most rows)."""
    v = vectors[vector_col].cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    return rows.filter(F.size("v") == dim), dim


def _distinct(rows: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """One row for each different vector: key, vector (bytes of doubles), its smallest identifiers, whether it is a query.

    Copies meet within tasks first, so that a vector travels once for each task.
    """
    buckets = partitions(session_of(rows))

    def local(batches):
        held: dict[bytes, list] = {}
        for batch in batches:
            x = _matrix(batch.column("v"), dim) + 0.0  # no negative zero
            for i, raw in zip(batch.column("id").to_pylist(), (r.tobytes() for r in x), strict=True):
                entry = held.setdefault(raw, [[], False])
                entry[1] |= i % every == 0
                entry[0].append(i)
                if len(entry[0]) > 4 * k + 4:
                    entry[0] = _smallest(entry[0], k)
            if len(held) > 100_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held):
        keys = [_key(raw) for raw in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([int.from_bytes(key[:6], "little") % buckets for key in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array(list(held), pa.binary()), pa.array([_smallest(e[0], k) for e in held.values()], pa.list_(pa.int64())), pa.array([e[1] for e in held.values()])],
            ["bucket", "key", "vector", "ids", "query"],
        )

    def merged(table: pa.Table) -> pa.Table:
        held: dict[bytes, list] = {}
        for key, raw, ids, query in zip(*(table.column(c).to_pylist() for c in ("key", "vector", "ids", "query")), strict=True):
            entry = held.setdefault(raw, [key, [], False])
            entry[1] = _smallest(entry[1] + ids, k)
            entry[2] |= query
        return pa.table({"key": pa.array([e[0] for e in held.values()], pa.binary()), "vector": pa.array(list(held), pa.binary()), "ids": pa.array([e[1] for e in held.values()], pa.list_(pa.int64())), "query": pa.array([e[2] for e in held.values()], pa.bool_())})

    schema = "key binary, vector binary, ids array<long>, query boolean"
    return rows.mapInArrow(local, f"bucket int, {schema}").groupBy("bucket").applyInArrow(merged, schema)


def _rows_of(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1) if data else np.zeros((0, 1))


def _calibrated(tree: KMeansTree, indexed: DataFrame, queries: np.ndarray, keys: list[bytes], k: int, recall: float) -> int:
    """Leaves to visit so that the sample's exact neighbours are found to the wanted share."""
    shared = session_of(indexed).sparkContext.broadcast((queries, keys))

    def exact(batches):
        q, own = shared.value
        for batch in batches:
            x = _rows_of(batch.column("vector"))
            score = q @ x.T
            index = {key: i for i, key in enumerate(batch.column("key").to_pylist())}
            for i, key in enumerate(own):
                if key in index:
                    score[i, index[key]] = -np.inf
            n = min(k, len(x))
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            leaf = batch.column("leaf").to_numpy()
            of = np.repeat(np.arange(len(q)), n)
            found = score[of, best.ravel()]
            real = np.isfinite(found)
            yield pa.RecordBatch.from_arrays([pa.array(of[real], pa.int32()), pa.array(found[real], pa.float64()), pa.array(leaf[best.ravel()][real], pa.int32())], ["q", "score", "leaf"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
    top = indexed.select("key", "vector", "leaf").mapInArrow(exact, "q int, score double, leaf int")
    top = top.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("q", "leaf").collect()  # CALIBRATION * k rows at most
    if not top:
        return tree.leaves
    place = {}
    for i, q in enumerate(queries):
        for n, leaf in enumerate(tree.visits(q, tree.leaves)):
            place[i, leaf] = n + 1
    needed = np.sort([place[r.q, r.leaf] for r in top])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose identifier is divisible by ``every``."""
    spark = session_of(vectors)
    buckets = partitions(spark)
    rows, dim = _sound(vectors, id_col, vector_col)
    result = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], result)
    distinct = materialize(_distinct(rows, dim, k, every), "nearest-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm)).first()[0]
    total = distinct.count()
    order = F.xxhash64("key")
    sample = distinct.orderBy(order, "key").limit(TREE_SAMPLE).select("vector").toArrow()
    x = _rows_of(sample.column("vector"))
    tree = KMeansTree(np.zeros((1, dim + 1)), [[]], np.zeros(1, np.int64), 1, longest)
    leaves = min(max(1, round(total**0.5 / 2)), max(1, len(x) // 16))
    tree = KMeansTree.fit(tree.lift(x), leaves, longest)
    shared = spark.sparkContext.broadcast(tree)

    def assigned(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(shared.value.assign(_rows_of(batch.column("vector"))), pa.int32()))

    indexed = materialize(distinct.mapInArrow(assigned, "key binary, vector binary, ids array<long>, query boolean, leaf int"), "nearest-index")
    queries = indexed.filter("query").select("key", "vector")
    some = queries.orderBy(order, "key").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return spark.createDataFrame([], result)
    visits = _calibrated(tree, indexed, _rows_of(some.column("vector")), some.column("key").to_pylist(), k, recall)

    # blocks of a leaf; the number of leaves is bounded by the sample
    sizes = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    blocks = {leaf: -(-n // BLOCK) for leaf, n in sizes.items()}
    first, at = {}, 0
    for leaf in sorted(blocks):
        first[leaf], at = at, at + blocks[leaf]

    def vectors_to_blocks(batches):
        for batch in batches:
            block = [first[leaf] + int.from_bytes(key[8:14], "little") % blocks[leaf] for leaf, key in zip(batch.column("leaf").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column("vector"), batch.column("ids")], ["block", "vector", "ids"])

    def queries_to_blocks(batches):
        for batch in batches:
            x, keys = _rows_of(batch.column("vector")), batch.column("key").to_pylist()
            goes: dict[int, list[int]] = {}
            for i in range(len(x)):
                for leaf in shared.value.visits(x[i], visits):
                    for block in range(first.get(leaf, 0), first.get(leaf, 0) + blocks.get(leaf, 0)):
                        goes.setdefault(block, []).append(i)
            data = [pack(np.frombuffer(b"".join(keys[i] for i in rows), np.uint64), x[rows].ravel()) for rows in goes.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(goes), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    def search(some: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(some) and len(asked):
            x = _rows_of(some.column("vector"))
            ids = some.column("ids").to_pylist()
            keys, q = joined([unpack(d) for d in asked.column("data").to_pylist()], [np.uint64, np.float64])
            keys, q = keys.reshape(-1, 2), q.reshape(-1, dim)
            for lo in range(0, len(q), 512):
                score = q[lo : lo + 512] @ x.T
                n = min(k + 1, len(x))
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
                for i in range(len(score)):
                    bound, wide = least[i], n
                    while True:
                        near = np.flatnonzero(score[i] >= bound - 1e-12 * abs(bound))
                        exact = (x[near] * q[lo + i]).sum(1)
                        found = sorted((-s, v) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[j])
                        own = max(Counter(v for _, v in found).values())
                        if len(found) - own >= k or wide == len(x):
                            break
                        # an identifier with several vectors: others are needed
                        wide = min(2 * wide, len(x))
                        bound = -np.partition(-score[i], wide - 1)[wide - 1]
                    out.append((keys[lo + i], [found[place] for place in _enough([v for _, v in found], k)]))
        bucket = (mix64(np.asarray([key[0] for key, _ in out], np.uint64)) % np.uint64(buckets)).astype(np.int64) if out else np.zeros(0, np.int64)
        to, data = [], []
        for b, rows in split_by(bucket, buckets):
            n = [len(out[i][1]) for i in rows]
            pairs = [p for i in rows for p in out[i][1]]
            to.append(b)
            data.append(pack(np.repeat(np.asarray([out[i][0] for i in rows], np.uint64), n, 0).ravel(), np.asarray([v for _, v in pairs], np.int64), np.asarray([-s for s, _ in pairs], np.float64)))
        return pa.table({"bucket": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary())})

    def best(table: pa.Table) -> pa.Table:
        keys, ids, score = joined([unpack(d) for d in table.column("data").to_pylist()], [np.uint64, np.int64, np.float64])
        keys = keys.reshape(-1, 2)
        order = np.lexsort((ids, -score, keys[:, 1], keys[:, 0]))
        keys, ids, score = keys[order], ids[order], score[order]
        start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)
        stop = np.append(start[1:], len(keys))
        found = [[{"vec_id": int(ids[a + place]), "score": float(score[a + place])} for place in _enough(ids[a:z].tolist(), k)] for a, z in zip(start, stop, strict=True)]
        return pa.table({"key": pa.array([keys[a].tobytes() for a in start], pa.binary()), "found": pa.array(found, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})

    held = indexed.select("key", "leaf", "vector", "ids").mapInArrow(vectors_to_blocks, "block int, vector binary, ids array<long>")
    asked = queries.mapInArrow(queries_to_blocks, "block int, data binary")
    met = held.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(search, "bucket int, data binary")
    answers = met.groupBy("bucket").applyInArrow(best, "key binary, found array<struct<vec_id:long,score:double>>")

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dim) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([_key(r.tobytes()) for r in x], pa.binary())], ["query_id", "key"])

    asking = rows.filter(F.col("id") % every == 0).mapInArrow(keyed, "query_id long, key binary")
    found = asking.join(answers, "key").select("query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    ranked = found.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "near"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
