"""Merkle manifest of a dataset with incremental witnesses.

A tree's leaves stand in an order; two consecutive nodes become their hash, a
last single one the hash of itself, until one remains. Leaves are appended in
their order, as a stream: whatever was appended stands as a stack of complete
aligned subtrees, and each leaf below an open one holds its witness so far, the
siblings from the leaf up. When a subtree's sibling is completed, both become
one subtree, and the witnesses below each take the other's node. Nothing
appended is hashed again.

On a cluster, ranges of the order are cut in chunks of some thousand leaves.
Each chunk is such a stream from its own place on; the roots of its subtrees
are appended in turn to trees of many chunks, as subtrees of their level, and
the witnesses of chunk roots extend those of their leaves. So a tree of any
size is many tasks, and the texts are read once, for their leaf digests. A
manifest keeps chunks and chunk roots; later rows are appended without
touching earlier ones.

Defined results: a null tree name differs from the empty one and comes first, a
null identifier comes before others, rows with one identifier stand in the
order of their leaves, and equal leaves are interchangeable; an empty table has
no trees. Null and empty texts have digests of their own, very long ones are
hashed whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_scope

#: Leaves of a chunk are two to this; a tree of chunk roots covers two to ``STEP_BITS`` times as many leaves, and so on.
CHUNK_BITS = 13
STEP_BITS = 12
DIGEST = 64


def digest(*nodes: bytes) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


class Append:
    """A stream of subtrees in their order, from any place of a tree.

    ``open`` holds (level, index, node, members); ``witness[m]`` the siblings that member ``m`` has met so far.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, int, bytes, list[int]]] = []
        self.witness: list[list[bytes]] = []

    def add(self, level: int, index: int, node: bytes) -> None:
        self.witness.append([])
        self.open.append((level, index, node, [len(self.witness) - 1]))
        while len(self.open) > 1 and self.open[-1][1] & 1 and self.open[-2][:2] == (self.open[-1][0], self.open[-1][1] - 1):
            self._complete()

    def _complete(self) -> None:
        level, index, right, of_right = self.open.pop()
        _, _, left, of_left = self.open.pop()
        for m in of_left:
            self.witness[m].append(right)
        for m in of_right:
            self.witness[m].append(left)
        self.open.append((level + 1, index >> 1, digest(left, right), of_left + of_right))

    def close(self, level: int) -> None:
        """At a tree's end: what is open becomes one subtree of the level."""
        while len(self.open) > 1 or self.open[-1][0] < level:
            at, index, node, members = self.open[-1]
            if index & 1:
                self._complete()
            else:
                self.open[-1] = (at + 1, index >> 1, digest(node), members)


def fold(leaf: bytes, siblings: bytes, position: int, total: int) -> bytes:
    """The root that a leaf and its siblings give at a position of a tree of ``total`` leaves."""
    at = 0
    while total > 1:
        if position ^ 1 < total:
            other = siblings[at : at + DIGEST]
            at += DIGEST
            leaf = digest(other, leaf) if position & 1 else digest(leaf, other)
        else:
            leaf = digest(leaf)
        position, total = position >> 1, (total + 1) >> 1
    return leaf


def witness_size(position: int, total: int) -> int:
    """Bytes of the siblings of a position."""
    n = 0
    while total > 1:
        n += position ^ 1 < total
        position, total = position >> 1, (total + 1) >> 1
    return n * DIGEST


def height(total: int) -> int:
    return max(total - 1, 0).bit_length()


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields: ``-`` for null, else the number of bytes in UTF-8, a colon, and the value."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(framed(c) for c in fields)).cast("binary"), 256)


def _chunked(size: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        number = held_rows = 0
        held: list[pa.RecordBatch] = []
        tree = None

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for piece in held:
                    out.write_batch(piece)
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([tree]), pa.array([held_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "tree", "n", "data"])

        for batch in batches:
            codes = np.asarray(batch.column("tree").dictionary_encode().indices)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            rest = batch.drop_columns(["tree"])
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                name = batch.column("tree")[a].as_py()
                if held and name != tree:
                    yield flush()
                    held, held_rows, number = [], 0, number + 1
                tree = name
                while a < z:
                    take = min(z - a, size - held_rows)
                    held.append(rest.slice(a, take))
                    held_rows, a = held_rows + take, a + take
                    if held_rows == size:
                        yield flush()
                        held, held_rows, number = [], 0, number + 1
        if held:
            yield flush()

    return run


def _leaves(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _streamed(start: int, leaves: pa.Table) -> Append:
    stream = Append()
    for i, leaf in enumerate(leaves.column("leaf").to_pylist()):
        stream.add(0, start + i, leaf.encode())
    return stream


_NODE = "chunk string, tree string, level int, index long, node string"


def _chunk_roots(batches):
    for batch in batches:
        rows = []
        for chunk, tree, start, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "tree", "start", "data")), strict=True):
            rows += [(chunk, tree, level, index, node.decode()) for level, index, node, _ in _streamed(start, _leaves(data)).open]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["chunk", "tree", "level", "index", "node"])


@dataclass
class Manifest:
    """Chunks of leaves (chunk, tree, start, n, data) and the roots of their subtrees (chunk, tree, level, index, node)."""

    chunks: DataFrame
    nodes: DataFrame
    chunk_bits: int = CHUNK_BITS


def append(rows: DataFrame, order: list, manifest: Manifest | None = None, chunk_bits: int = CHUNK_BITS) -> Manifest:
    """Appends rows (tree, leaf, others) in an order within their trees, behind all that the manifest holds."""
    rows = rows.select("tree", *(c for c in rows.columns if c != "tree"))
    spread = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    packed = materialize(spread.mapInArrow(_chunked(1 << chunk_bits), "part long, number long, tree string, n long, data binary"), "merkle-chunks")
    # places of chunks: few numbers for each range of each tree
    narrow = packed.select("part", "number", "tree", "n")
    ranges = narrow.groupBy("tree", "part").agg(F.sum("n").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("tree", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = narrow.withColumn("within", within).join(ranges.select("tree", "part", ahead.alias("ahead")), ["tree", "part"])
    starts = starts.select("part", "number", (F.col("ahead") + F.col("within")).alias("start"))
    chunks = packed.join(starts, ["part", "number"])
    if manifest:
        before = manifest.chunks.groupBy("tree").agg(F.max(F.col("start") + F.col("n")).alias("before"))
        chunks = chunks.join(before, "tree", "left").withColumn("start", F.col("start") + F.coalesce("before", F.lit(0)))
    batch = uuid.uuid4().hex
    chunks = chunks.select(F.format_string(f"{batch}-%d-%d", "part", "number").alias("chunk"), "tree", "start", "n", "data")
    nodes = materialize(chunks.mapInArrow(_chunk_roots, _NODE), "merkle-nodes")
    if manifest:
        chunks, nodes = manifest.chunks.unionByName(chunks), manifest.nodes.unionByName(nodes)
    return Manifest(chunks, nodes, chunk_bits)


def _combined(top: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("level", "index", "node")), strict=True), key=lambda r: r[1] << r[0])
        tree, total, block = (table.column(c)[0].as_py() for c in ("tree", "total", "block"))
        stream = Append()
        for level, index, node in rows:
            stream.add(level, index, node.encode())
        if (block + 1) << top >= total:
            stream.close(min(top, height(total)))
        (level, _, node, _) = stream.open[0]
        out = [(0, tree, total, lv, ix, b"".join(w)) for (lv, ix, _), w in zip(rows, stream.witness, strict=True)]
        out.append((1, tree, total, level, block, node))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["kind", "tree", "total", "level", "index", "bytes"])

    return run


def climbed(manifest: Manifest, step_bits: int = STEP_BITS) -> tuple[DataFrame, DataFrame]:
    """Witnesses (tree, level, index, siblings) of the chunk roots up to their tree's root, and the roots (tree, total, node)."""
    totals = manifest.chunks.groupBy("tree").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    nodes = manifest.nodes.select("tree", "level", "index", "node").join(totals, "tree")
    most = totals.agg(F.max("total")).first()[0] or 0
    top, tables = manifest.chunk_bits, []
    while True:
        top += step_bits
        grouped = nodes.withColumn("block", F.expr(f"shiftright(`index`, {top} - `level`)")).groupBy("tree", "block")
        out = materialize(grouped.applyInArrow(_combined(top), "kind int, tree string, total long, level int, index long, bytes binary"), "merkle-climbed")
        tables.append((top, out.filter("kind = 0")))
        roots = out.filter("kind = 1")
        if most <= 1 << top:
            break
        nodes = roots.select("tree", "level", "index", F.col("bytes").cast("string").alias("node"), "total")
    # what a block's root meets above it extends the witnesses below it
    above = None
    for top, table in reversed(tables):
        found = table.select("tree", "level", "index", F.col("bytes").alias("siblings"))
        if above is not None:
            upper = above.select("tree", F.col("level").alias("top"), F.col("index").alias("block"), F.col("siblings").alias("more"))
            found = found.withColumns({"block": F.expr(f"shiftright(`index`, {top} - `level`)"), "top": F.lit(top)}).join(upper, ["tree", "top", "block"], "left")
            found = found.select("tree", "level", "index", F.concat("siblings", F.coalesce("more", F.lit(b""))).alias("siblings"))
        above = found
    return above, roots.select("tree", "total", F.col("bytes").cast("string").alias("node"))


def _proved(batches):
    """Leaves of chunks with their whole witnesses, and the root that their (replaced) leaf folds to."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i, data in enumerate(columns["data"]):
            leaves, start, total = _leaves(data), columns["start"][i], columns["total"][i]
            stream = _streamed(start, leaves)
            known = {(w["level"], w["index"]): w["siblings"] for w in columns["above"][i]}
            upper, upper_at, upper_total = columns["upper"][i] or b"", columns["upper_position"][i], columns["upper_total"][i]
            siblings: list[bytes] = [b""] * len(leaves)
            for level, index, _, members in stream.open:
                for m in members:
                    siblings[m] = b"".join(stream.witness[m]) + known[level, index] + upper
            other = leaves.column("other").to_pylist() if "other" in leaves.schema.names else [None] * len(leaves)
            folded = []
            for k, (leaf, instead) in enumerate(zip(leaves.column("leaf").to_pylist(), other, strict=True)):
                own = len(siblings[k]) - len(upper)
                node = fold((instead or leaf).encode(), siblings[k][:own], start + k, total)
                folded.append(fold(node, siblings[k][own:], upper_at, upper_total).decode())
            n = len(leaves)
            out = leaves.combine_chunks()
            for name, values in (
                ("tree", pa.array([columns["tree"][i]] * n, pa.string())), ("position", pa.array(range(start, start + n), pa.int64())), ("total", pa.array([total] * n, pa.int64())),
                ("subroot", pa.array([columns["subroot"][i]] * n, pa.string())), ("root", pa.array([columns["root"][i]] * n, pa.string())),
                ("siblings", pa.array(siblings, pa.binary())), ("folded", pa.array(folded, pa.string())),
            ):
                out = out.append_column(name, values)
            yield from out.to_batches()


def proved(manifest: Manifest, payload: str, upper: DataFrame | None = None, step_bits: int = STEP_BITS) -> DataFrame:
    """Each leaf with tree, position, total, subroot, root, siblings up to the root, and the root folded from it.

    ``payload`` names the columns that the leaves were appended with; where one is called ``other``, a value in it is
    folded instead of the leaf. ``upper`` (tree, upper, upper_position, upper_total, root) goes on from the trees' roots.
    """
    witnesses, roots = climbed(manifest, step_bits)
    return _joined(manifest, witnesses, roots, payload, upper)


def _joined(manifest: Manifest, witnesses: DataFrame, roots: DataFrame, payload: str, upper: DataFrame | None) -> DataFrame:
    if upper is None:
        upper = roots.select("tree", F.lit(None).cast("binary").alias("upper"), F.lit(0).cast("long").alias("upper_position"), F.lit(1).cast("long").alias("upper_total"), F.col("node").alias("root"))
    trees = roots.select("tree", "total", F.col("node").alias("subroot")).join(upper, "tree")
    # a chunk has few subtrees: at most two of each level
    above = manifest.nodes.join(witnesses, ["tree", "level", "index"]).groupBy("chunk").agg(F.collect_list(F.struct("level", "index", "siblings")).alias("above"))
    rows = manifest.chunks.join(above, "chunk").join(trees, "tree")
    return rows.mapInArrow(_proved, f"{payload}, tree string, position long, total long, subroot string, root string, siblings binary, folded string")


def manifest_of(leaves: DataFrame, order: list, payload: str, chunk_bits: int = CHUNK_BITS, step_bits: int = STEP_BITS, manifest: Manifest | None = None) -> DataFrame:
    """Proofs of leaves (tree, leaf, others) from their tree's root up to one root over all trees in the order of their names.

    With a manifest, the leaves are appended to it first.
    """
    docs = append(leaves, order, manifest, chunk_bits)
    witnesses, roots = climbed(docs, step_bits)
    # the trees' roots are leaves of one more tree
    top = append(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node").alias("leaf")), ["name"], chunk_bits=chunk_bits)
    of_trees = proved(top, "name string, leaf string", step_bits=step_bits)
    upper = of_trees.select(F.col("name").alias("tree"), F.col("siblings").alias("upper"), F.col("position").alias("upper_position"), F.col("total").alias("upper_total"), "root")
    return _joined(docs, witnesses, roots, payload, materialize(upper, "merkle-trees"))


def tree_name(c: Column) -> Column:
    """A name for every value, null included and first."""
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``, a tree for each lang; where 7 divides crc32(doc_id), the row is folded with n_chars + 1.

    A null doc_id has no crc32 and is not tampered with; other odd rows as the module says.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = leaf_digest(*fields[:3], d["n_chars"] + 1, d["text"])
    other = F.when((F.crc32(d["doc_id"].cast("string").cast("binary")) % 7 == 0) & d["n_chars"].isNotNull(), tampered)
    leaves = d.select(tree_name(d["lang"]).alias("tree"), d["doc_id"].alias("id"), leaf_digest(*fields).alias("leaf"), other.alias("other"))
    with scratch_scope(spark):
        proofs = manifest_of(leaves, ["id", "leaf"], "id long, leaf string, other string")
        out = proofs.select(
            F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
        )
        return materialize(out, "merkle-proofs", outer=True)


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
f AS (SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
  || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, crc),
l AS (SELECT *, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
  CASE WHEN h % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other, coalesce('1' || lang, '0') AS tree FROM f),
leaves AS (SELECT doc_id, tree, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (SELECT tree, 0 AS level, p, leaf AS node, n FROM leaves
  UNION ALL SELECT tree, level + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), max((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, p // 2),
subroots AS (SELECT tree, node AS subroot, level AS height FROM nodes WHERE n = 1),
tops AS (SELECT tree AS name, subroot, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM subroots),
upper_nodes AS (SELECT 0 AS level, p, subroot AS node, n FROM tops
  UNION ALL SELECT level + 1, p // 2, sha256(string_agg(node, '' ORDER BY p)), max((n + 1) // 2) FROM upper_nodes WHERE n > 1 GROUP BY level, p // 2),
top AS (SELECT node AS root, level AS height FROM upper_nodes WHERE n = 1),
steps AS (SELECT tree, p, 0 AS k, coalesce(other, leaf) AS node, '' AS proof, p AS i FROM leaves
  UNION ALL SELECT s.tree, s.p, k + 1, CASE WHEN o.node IS NULL THEN sha256(s.node) WHEN s.i % 2 = 1 THEN sha256(o.node || s.node) ELSE sha256(s.node || o.node) END, proof || coalesce(o.node, ''), s.i // 2
  FROM steps s JOIN subroots u ON s.tree = u.tree AND k < u.height LEFT JOIN nodes o ON o.tree = s.tree AND o.level = k AND o.p = xor(s.i, 1)),
lower_done AS (SELECT s.tree, s.p, s.node, s.proof FROM steps s JOIN subroots u ON s.tree = u.tree AND k = u.height),
more AS (SELECT d.tree, d.p, 0 AS k, d.node, d.proof, t.p AS i FROM lower_done d JOIN tops t ON t.name = d.tree
  UNION ALL SELECT s.tree, s.p, k + 1, CASE WHEN o.node IS NULL THEN sha256(s.node) WHEN s.i % 2 = 1 THEN sha256(o.node || s.node) ELSE sha256(s.node || o.node) END, proof || coalesce(o.node, ''), s.i // 2
  FROM more s JOIN top ON k < top.height LEFT JOIN upper_nodes o ON o.level = k AND o.p = xor(s.i, 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM leaves JOIN more USING (tree, p) JOIN subroots USING (tree), top WHERE k = top.height
"""
