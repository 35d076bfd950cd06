"""N-gram Jaccard self-join by prefixes of token combinations, and its components.

Tokens are the distinct word shingles of a document, in one order for all
documents: by the number of documents that have them, then by hash. Of a document
with n tokens, a partner with Jaccard similarity s or more lacks at most
``n - ceil(s n)``. Its prefix is extended until its signatures cannot all be lost
with that many tokens. Tokens fall in classes by their number of documents:

* of a single document: a signature that nobody else has, so that it need not be sent;
* rare (``RARE`` documents at most): the token alone is a signature;
* frequent (``COMMON`` at most): pairs of tokens of one part of the class;
* very frequent: triples of tokens of one part of the class.

A class is split in parts by hash; a part with m tokens and combinations of k has
m - k + 1 to lose. The number of parts depends on the band of sizes; a document
takes part in its own band and the next, which covers all partners. Two documents
above the threshold share a signature in their prefixes. Documents that share one
are verified on their whole token sets.

Signatures meet in buckets as packed arrays. A list of n documents makes at most
n - 1 edges, and equal edges of several lists count once; the components of
these edges hold every pair to verify. In components beyond ``CLUSTER`` documents
the edges themselves are verified first. Documents that this connects need not be
compared with each other; what is left is dealt in parts, and each pair of parts
that may hold unconnected documents is a group of its own: no task gets an
unbounded group, no pairs are emitted, and a group of n near copies of one
document costs n comparisons. Groups verify with an inverted index and skip pairs
that are already connected.

Defined results: null or empty text has no tokens and no links; a document of
fewer words has its whole word sequence as its one token; very long texts count
whole (one text is a block by itself if need be, up to the two gigabytes of a
binary value); repeated rows are linked with each other if they have tokens; a
null identifier is handled as the lowest number and given back as null; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, materialize, mix64, scratch_scope, session_of, shingle_sets
from .components import connected_components
from .meeting import (
    LOWEST, ROW, ROW_BITS, Block, blocked, bucket_of, by_block, documents_of, frugal, grouped, joined, key48, pack, rows, shared_keys, split_by, unpack,
)

#: Tokens of at most RARE documents count singly, of at most COMMON in pairs, others in triples.
RARE = 16
COMMON = 1024
#: Documents of a candidate component that one group takes whole.
CLUSTER = 512


class Signatures:
    """Signatures of token sets for a threshold in whole percent."""

    def __init__(self, percent: int, rare: int, common: int):
        self.percent, self.rare, self.common = percent, rare, common
        edges = [1]
        while edges[-1] < 1 << 40:  # sizes within a band and the next cover all partners
            edges.append(max(edges[-1] + 1, edges[-1] * 100 // percent))
        self.edges = np.asarray(edges)

    def lost(self, n: int) -> int:
        return n - -(-n * self.percent // 100)

    def of(self, tokens: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """tokens: the hashes of one document; documents: how many have each, the same number for all that have it."""
        n = len(tokens)
        need = self.lost(n) + 1
        shared = documents > 1
        single = n - int(shared.sum())
        if single >= need:
            return tokens[:0]
        tokens, documents = tokens[shared], documents[shared]
        order = np.lexsort((tokens, documents))
        tokens, documents = tokens[order], documents[order]
        size = 1 + (documents > self.rare).astype(np.int64) + (documents > self.common)
        band = int(np.searchsorted(self.edges, n, side="right"))
        return np.concatenate([self._combinations(tokens, size, need - single, b) for b in (band, band + 1)])

    def _combinations(self, tokens: np.ndarray, size: np.ndarray, need: int, band: int) -> np.ndarray:
        salt = np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
        least = int(self.edges[max(band - 2, 0)])
        # pairs lose one token for each part, triples two: what the parts lose must leave enough of the smallest document
        spare = least - self.lost(least) - 1
        if spare < 3 or size[-1] == 1:  # sizes ascend
            return self._singles(tokens[:need], salt)
        parts = max(1, min(self.lost(least) // 2, spare // 3))
        part = np.where(size > 1, (mix64(tokens ^ salt) % np.uint64(parts)).astype(np.int64) + size * parts, -1)
        order = np.argsort(part, kind="stable")
        first = np.append(True, part[order][1:] != part[order][:-1])
        place = np.empty(len(part), np.int64)
        place[order] = np.arange(len(part)) - np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))
        end = int(np.searchsorted(np.cumsum((size == 1) | (place >= size - 1)), need)) + 1
        tokens, size, part = tokens[:end], size[:end], part[:end]
        out = [self._singles(tokens[size == 1], salt)]
        for k in (2, 3):
            mine, of = tokens[size == k], part[size == k]
            order = np.lexsort((mine, of))
            out += self._together(mine[order], of[order], k, salt)
        return np.concatenate(out)

    @staticmethod
    def _singles(tokens: np.ndarray, salt: np.uint64) -> np.ndarray:
        return mix64(tokens ^ salt)

    @staticmethod
    def _together(tokens: np.ndarray, part: np.ndarray, k: int, salt: np.uint64) -> list[np.ndarray]:
        """All pairs (k = 2) or triples (k = 3) of tokens within a part."""
        out = []
        for far in range(k - 1, len(tokens)):
            same = np.flatnonzero(part[far:] == part[:-far])
            if not len(same):
                break
            ends = mix64(mix64(tokens[same] ^ salt) + tokens[same + far])
            out += [ends] if k == 2 else [mix64(ends + tokens[same + near]) for near in range(1, far)]
        return out


def _send_signatures(size: int, percent: int, buckets: int, rare: int, common: int):
    """Of a block: its rows' identifiers, hashes and sizes (kind 1), the links between equal sets (kind 2); signatures to buckets (kind 0).

    Links are between handles of rows.
    """

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.of(table)
        sets = shingle_sets(block.texts, size)
        n = np.fromiter((len(s) for s in sets), np.int64, len(sets))
        handles = (block.number << ROW_BITS) + np.arange(len(sets))
        found = [(block.number, 1, pack(handles, block.ids, block.hashes, n))]
        # equal sets of the block send their signatures once
        lead: dict[bytes, int] = {}
        leader = np.fromiter((lead.setdefault(s.tobytes(), i) for i, s in enumerate(sets)), np.int64, len(sets))
        copies = np.flatnonzero((leader != np.arange(len(sets))) & (n > 0))
        if len(copies):
            found.append((block.number, 2, pack(handles[leader[copies]], handles[copies])))
        some = np.flatnonzero((leader == np.arange(len(sets))) & (n > 0))
        if len(some) and len(answers):
            tokens = np.concatenate([sets[i] for i in some])
            documents = documents_of(key48(tokens), answers)
            make = Signatures(percent, rare, common)
            at = np.concatenate([[0], np.cumsum(n[some])])
            signatures = [make.of(tokens[a:z], documents[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
            of = np.repeat(some, [len(s) for s in signatures])
            key = np.concatenate(signatures)
            for bucket, i in split_by(bucket_of(key, buckets), buckets):
                found.append((bucket, 0, pack(key[i], handles[of[i]], n[of[i]])))
        return pa.Table.from_batches([rows(found)])

    return run


def _meet_signatures(percent: int, buckets: int):
    """Hands on kinds 1 and 2, and ties the documents of each signature together (kind 3).

    In order of size, documents follow each other as long as a neighbour could
    be similar; each such row of documents is tied to its first. Lists of the
    same documents mostly have the same first, so that their edges are equal,
    and go to one bucket.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds, data, key = table.column("kind").to_pylist(), table.column("data").to_pylist(), table.column("key")
        found = [(key[i].as_py(), k, data[i]) for i, k in enumerate(kinds) if k]
        signature, ids, n = joined([unpack(d) for d, k in zip(data, kinds, strict=True) if k == 0], [np.uint64, np.int64, np.int64])
        if len(signature):
            order = np.lexsort((ids, n, signature))
            signature, ids, n = signature[order], ids[order], n[order]
            follows = np.append(False, (signature[1:] == signature[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            first = ids[np.maximum.accumulate(np.where(follows, 0, np.arange(len(ids))))]
            pair = np.unique(np.stack([first, ids], 1)[first != ids], axis=0)
            a, b = np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])
            to = bucket_of(mix64(a.view(np.uint64)) ^ b.view(np.uint64), buckets)
            found += [(k, 3, pack(a[i], b[i])) for k, i in split_by(to, buckets)]
        return pa.Table.from_batches([rows(found)])

    return run


def _unique_edges(table: pa.Table) -> pa.Table:
    """Hands on kinds 1 and 2, and leaves each edge (kind 3) once."""
    kinds, data, key = table.column("kind").to_pylist(), table.column("data").to_pylist(), table.column("key")
    found = [(key[i].as_py(), k, data[i]) for i, k in enumerate(kinds) if k != 3]
    a, b = joined([unpack(d) for d, k in zip(data, kinds, strict=True) if k == 3], [np.int64, np.int64])
    if len(a):
        pair = np.unique(np.stack([a, b], 1), axis=0)
        found.append((key[0].as_py(), 3, pack(np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))))
    return pa.Table.from_batches([rows(found)])


def _opened(packed: DataFrame, kind: int, *names: str) -> DataFrame:
    """Packed arrays of numbers as rows."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in unpack(data)], list(names))

    return packed.filter(F.col("kind") == kind).select("data").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _send_sets(size: int):
    """Of a block: the token sets of candidates; those of small clusters together, by the key of their group, others alone, by their handle."""

    def run(table: pa.Table, members: pa.Table) -> pa.Table:
        out: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        alone: list[tuple[int, bytes]] = []
        if len(table) and len(members):
            block = Block.of(table)
            handles, keys, clusters, large = (members.column(c).to_pylist() for c in ("id", "key", "cluster", "large"))
            some = [block.texts[h & ((1 << ROW_BITS) - 1)] for h in handles]
            for handle, key, cluster, one, tokens in zip(handles, keys, clusters, large, shingle_sets(some, size), strict=True):
                if one:
                    alone.append((handle, pack(tokens)))
                else:
                    out.setdefault(key, []).append((cluster, handle, tokens))
        data = [
            pack(*(np.asarray([e[k] for e in entries], np.int64) for k in (0, 1)), np.asarray([len(e[2]) for e in entries], np.int64), np.concatenate([e[2] for e in entries]))
            for entries in out.values()
        ]
        return pa.table({
            "key": pa.array([*out, *(h for h, _ in alone)], pa.int64()), "large": pa.array([False] * len(out) + [True] * len(alone), pa.bool_()),
            "data": pa.array([*data, *(d for _, d in alone)], pa.binary()),
        })

    return run


def verified_links(tied: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (place, place) that connect all documents above the threshold within a group.

    An inverted index over the group's tokens counts overlaps; a link between
    documents that are already connected, as by the same number in ``tied``, is
    left out.
    """
    n = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    order = np.argsort(n, kind="stable")
    tokens, owner = np.concatenate([sets[i] for i in order]), np.repeat(np.arange(len(order)), n[order])
    size = n[order]
    _, code, df = np.unique(tokens, return_inverse=True, return_counts=True)
    start = np.concatenate([[0], np.cumsum(size)])
    by_token = np.argsort(code, kind="stable")
    token_at = np.concatenate([[0], np.cumsum(df)])
    lead: dict[int, int] = {}
    parent = [lead.setdefault(t, i) for i, t in enumerate(tied[order].tolist())]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for y in range(1, len(order)):
        mine = code[start[y] : start[y + 1]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        length = df[mine]
        skip = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        others = owner[by_token[np.repeat(token_at[mine], length) + skip]]
        overlap = np.bincount(others[others < y], minlength=y)
        union = size[:y] + size[y] - overlap
        for x in np.flatnonzero(100 * overlap >= percent * union).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[b] = a
                links.append((int(order[x]), int(order[y])))
    return links


_LINKS = "a long, b long"


def _links(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _by_cluster(cluster: np.ndarray, ids: np.ndarray):
    order = np.lexsort((ids, cluster))
    return np.split(order, np.flatnonzero(cluster[order][1:] != cluster[order][:-1]) + 1)


def _verify_clusters(percent: int):
    """The links within each of a group's small clusters, given as packed sets."""

    def run(table: pa.Table) -> pa.Table:
        cluster, ids, n, tokens = joined([unpack(d) for d in table.column("data").to_pylist()], [np.int64] * 3 + [np.uint64])
        at = np.concatenate([[0], np.cumsum(n)])
        a, b = [], []
        for part in _by_cluster(cluster, ids):
            for x, y in verified_links(ids[part], [tokens[at[i] : at[i + 1]] for i in part], percent) if len(part) > 1 else []:
                a.append(ids[part[x]])
                b.append(ids[part[y]])
        return _links(a, b)

    return run


def _rows_of(table: pa.Table):
    return *(table.column(c).to_numpy() for c in ("id", "tied")), [unpack(d)[0] for d in table.column("data").to_pylist()]


def _verify_parts(percent: int):
    """The links within a group of rows (id, tied, data) that connect what ``tied`` does not."""

    def run(table: pa.Table) -> pa.Table:
        ids, tied, sets = _rows_of(table)
        found = verified_links(tied, sets, percent) if len(ids) > 1 else []
        return _links([ids[x] for x, _ in found], [ids[y] for _, y in found])

    return run


def _verify_stars(percent: int):
    """The links between the document ``tied`` of a group and the group's others."""

    def run(table: pa.Table) -> pa.Table:
        ids, tied, sets = _rows_of(table)
        mine = sets[int(np.flatnonzero(ids == tied)[0])]
        shared = [len(np.intersect1d(mine, s, assume_unique=True)) for s in sets]
        near = [i for i, s in enumerate(sets) if ids[i] != tied[i] and 100 * shared[i] >= percent * (len(mine) + len(s) - shared[i])]
        return _links([tied[i] for i in near], [ids[i] for i in near])

    return run


#: Rows of a component meet its least identifier in so many places.
_SALTS = 32


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, hash of the text, n_shingles, component) of every row; null identifiers are LOWEST."""
    with scratch_scope(session_of(docs)):
        blocks, buckets = blocked(docs, id_col, text_col, "ngram-blocks")

        def tokens(some: list[bytes]):
            sets = shingle_sets(some, size)
            of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            return of, key48(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)

        answers = shared_keys(blocks, tokens, buckets)
        sent = by_block(blocks, answers, buckets).applyInArrow(frugal(_send_signatures(size, percent, buckets, RARE, COMMON)), ROW)
        tied = grouped(sent, "key", buckets).applyInArrow(frugal(_meet_signatures(percent, buckets)), ROW)
        met = materialize(grouped(tied, "key", buckets).applyInArrow(_unique_edges, ROW), "ngram-signatures")
        edges = _opened(met, 3, "a", "b")

        clusters = connected_components(edges).withColumnRenamed("component", "cluster")
        large = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CLUSTER)
        large = materialize(large, "ngram-large")
        beyond = F.col("n").isNotNull()
        members = clusters.join(large, "cluster", "left").select(
            "id", F.shiftright("id", ROW_BITS).alias("block"), F.when(beyond, F.col("id")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets))).alias("key"),
            "cluster", beyond.alias("large"),
        )
        sets = by_block(blocks.select("block", "data"), members, buckets).applyInArrow(frugal(_send_sets(size)), "key long, large boolean, data binary")
        sets = materialize(sets, "ngram-sets")
        links = grouped(sets.filter("not large"), "key", buckets).applyInArrow(frugal(_verify_clusters(percent)), _LINKS)
        if not large.isEmpty():
            alone = sets.filter("large").select(F.col("key").alias("id"), "data")
            links = links.union(_large_links(clusters.join(large, "cluster"), edges, alone, percent, buckets))
        groups = connected_components(links.union(_opened(met, 2, "a", "b")))

        named = _opened(met, 1, "handle", "id", "hash", "n_shingles").join(groups.withColumnRenamed("id", "handle"), "handle", "left")
        named = materialize(named, "ngram-named", outer=True)
    linked = named.filter("component is not null")
    least = linked.groupBy("component").agg(F.min("id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    linked = linked.withColumn("salt", F.pmod("handle", F.lit(_SALTS)).cast("int")).join(least, ["component", "salt"])
    single = named.filter("component is null").select("id", "hash", "n_shingles", F.col("id").alias("component"))
    return linked.select("id", "hash", "n_shingles", F.col("least").alias("component")).union(single)


def _large_links(members: DataFrame, edges: DataFrame, sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Links within large clusters (id, cluster, n): along the edges, then between parts of what these leave unconnected.

    ``sets`` has the packed tokens of each member.
    """
    # stars in parts of about so many documents, each with its first document
    stars = members.select(F.col("id").alias("a"), "n").join(edges, "a")
    stars = stars.select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CLUSTER))).alias("key"))
    ends = stars.select(F.col("a").alias("id"), F.col("a").alias("tied"), "key").distinct().union(stars.select(F.col("b").alias("id"), F.col("a").alias("tied"), "key"))
    near = grouped(ends.join(sets, "id"), "key", buckets).applyInArrow(_verify_stars(percent), _LINKS)
    near = materialize(near, "ngram-stars")
    tied = connected_components(near).withColumnRenamed("component", "tied")
    members = members.join(tied, "id", "left").withColumn("tied", F.coalesce("tied", "id"))

    # connected documents stand together, in parts of about half a group; parts of one connected set need not meet
    half = CLUSTER // 2
    sizes = materialize(members.groupBy("cluster", "tied").agg(F.count(F.lit(1)).alias("k")), "ngram-sizes")
    whole = F.col("k") >= half
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("k") / half))
    spread = F.pmod(F.xxhash64("tied", F.lit(7)), F.ceil(F.col("n") / half))
    placed = members.join(sizes, ["cluster", "tied"]).select(
        "id", "cluster", "tied", F.when(whole, F.xxhash64("tied", share, F.lit(1))).otherwise(F.xxhash64("cluster", spread, F.lit(2))).alias("part"),
        F.when(whole, F.col("tied")).alias("one"),
    )
    placed = materialize(placed, "ngram-placed")
    units = placed.select("cluster", "part", "one").distinct()
    other = units.select("cluster", F.col("part").alias("part2"), F.col("one").alias("one2"))
    # each pair of parts, and a part with itself where it holds several connected sets
    meet = units.join(other, "cluster").filter("part <= part2 and not (one is not null and one <=> one2)")
    meet = meet.select("part", "part2", F.xxhash64("part", "part2").alias("key"))
    ends = meet.select("part", "key").union(meet.filter("part <> part2").select(F.col("part2").alias("part"), "key"))
    rest = placed.join(ends, "part").select("id", "tied", "key").join(sets, "id")
    return near.union(grouped(rest, "key", buckets).applyInArrow(_verify_parts(percent), _LINKS))


def _null(name: str):
    return F.when(F.col(name) != LOWEST, F.col(name)).alias(name)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) of every row; ``percent``: the least similarity, in whole percent."""
    return _similar_rows(docs, id_col, text_col, size, percent).select(_null("id"), "n_shingles", _null("component"))


#: Dropped rows are broadcast up to this number; beyond it they are joined by a shuffle.
BROADCAST_DROPPED = 500_000


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a smaller identifier; all columns, whatever their names, unchanged.

    Rows that repeat identifier and text stay or go together; of a repeated
    identifier only the rows whose own text is linked go.
    """
    i, h = fresh_names(docs, "id", "hash")
    with scratch_scope(session_of(docs)):
        groups = _similar_rows(docs, id_col, text_col, size, percent).filter("id <> component")
        dropped = materialize(groups.select(F.col("id").alias(i), F.col("hash").alias(h)).distinct(), "ngram-dropped", outer=True)
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_DROPPED else dropped
    return docs.join(side, (F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)) == F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(h)), "left_anti")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_groups(docs, size=4, percent=85).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
