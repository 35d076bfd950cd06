"""Benchmark decontamination by suffix arrays over shards of the training texts.

Texts are folded (A-Z to a-z) and read as words of letters and digits (ASCII
ones, and all characters beyond ASCII). Each shard, some megabytes of
consecutive documents within a task, becomes one array of word numbers and a
suffix array over it: all suffixes sorted by their first words, and those that
some suffix of a benchmark item reaches sorted on to the full depth. Every
suffix of the benchmark is searched in it by bisection, which gives its longest
verbatim match with its place, and the interval of all occurrences of the
window that it starts with. A document never lies in two shards, so nothing is
shuffled.

The benchmark is broadcast in parts of ``PART_BYTES`` of text at most (one item
at least); a benchmark of several parts is searched in as many passes, each
handing its finds to the next.

Defined results: a null text or item has no words and matches nothing; a null
item identifier is the empty string; items that repeat an identifier count as
one item, with the windows of all its rows; repeated documents are judged each;
very long texts are searched whole; empty tables give empty results or no
finds; other columns, whatever their names, are not read by the report and
handed through by ``drop_contaminated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_HASH, TERMS, Powers, materialize, mix64, scratch_scope, session_of, text_blocks, text_column

#: Consecutive words of an item that count as a leak; a shorter item counts whole.
WINDOW = 10
#: Bytes of text of one shard, and of the benchmark that one pass searches.
SHARD_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: Words to which suffixes are sorted; longer matches are followed word by word.
DEPTH = 64


class Words:
    """The words of texts: bytes, places, text numbers and 64-bit hashes."""

    def __init__(self, texts: list[bytes], salt: int = 0):
        self.raw = b" ".join(texts).translate(TERMS) + b" "
        b = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        space = b == 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.bytes, self.start, self.stop = b, edge[0::2], edge[1::2]
        self.of = np.searchsorted(ends, self.start, side="right")
        up, down = Powers.to(len(b) + 1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[b] * up[: len(b)], dtype=np.uint64)])
        self.hash = mix64((run[self.stop] - run[self.start]) * down[self.start] + (self.stop - self.start).astype(np.uint64) + np.uint64(salt << 40))

    def __len__(self) -> int:
        return len(self.start)

    def differ(self, at: np.ndarray, other: Words, there: np.ndarray) -> np.ndarray:
        """Which of the words ``at`` are not, byte for byte, the other's words ``there``."""
        size = self.stop[at] - self.start[at]
        out = size != other.stop[there] - other.start[there]
        same = np.flatnonzero(~out)
        n = size[same]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wrong = self.bytes[np.repeat(self.start[at[same]], n) + step] != other.bytes[np.repeat(other.start[there[same]], n) + step]
        out[np.repeat(same, n)[wrong]] = True
        return out


class Benchmark:
    """One part of the benchmark: its words, the suffixes of its items, and their windows without repeats.

    ``window_ids[w]`` to ``window_ids[w + 1]`` are the items of window ``w`` in ``window_items``.
    """

    def __init__(self, names: list[str], texts: list[bytes], window: int = WINDOW):
        salt = 0
        while True:
            words = Words(texts, salt)
            self.hashes, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
            if not words.differ(np.arange(len(words)), words, first[ids]).any():
                break
            salt += 1  # two words of the benchmark share a hash: another one tells them apart
        self.salt, self.words, self.first = salt, words, first
        self.bits = max(1, int(len(self.hashes)).bit_length())
        self.per = max(1, 62 // self.bits)
        self.names = sorted(set(names))
        number = {n: i for i, n in enumerate(self.names)}
        self.item = np.asarray([number[names[i]] for i in words.of.tolist()], np.int64)
        lengths = np.bincount(words.of, minlength=len(texts))
        ends = np.cumsum(lengths)[words.of]
        left = ends - np.arange(len(words))  # words from a suffix to its item's end
        self.depth = max(window, min(DEPTH, int(left.max(initial=0))))
        self.ids = np.append(ids.reshape(-1).astype(np.int64) + 1, np.zeros(self.depth + self.per, np.int64))
        self.offset = np.arange(len(words)) - (ends - lengths[words.of])
        self.left = left
        width = np.minimum(lengths[words.of], window)
        starts = np.flatnonzero(left >= width)
        width = width[starts]
        rows = self.ids[starts[:, None] + np.arange(window)] * (np.arange(window) < width[:, None])
        rows, inverse = np.unique(rows, axis=0, return_inverse=True) if len(starts) else (rows, np.zeros(0, np.int64))
        self.width = (rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse.reshape(-1), self.item[starts]], axis=1), axis=0)
        self.window_items = pairs[:, 1]
        self.window_ids = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.low, self.high = self._packed_rows(rows, 0), self._packed_rows(rows, (1 << self.bits) - 1)

    def _packed_rows(self, rows: np.ndarray, fill: int) -> np.ndarray:
        """Word numbers of windows as packed columns to the full depth, filled up beyond each window's end."""
        columns = -(-self.depth // self.per)
        wide = np.full((len(rows), columns * self.per), fill, np.int64)
        wide[:, : rows.shape[1]] = np.where(rows > 0, rows, fill)
        return self._pack(wide.reshape(len(rows), columns, self.per))

    def _pack(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(words.shape[:-1], np.int64)
        for i in range(self.per):
            out = (out << self.bits) | words[..., i]
        return out

    def suffix_rows(self, of: np.ndarray) -> np.ndarray:
        """The suffixes ``of`` as packed columns, zero beyond their item's end."""
        columns = -(-self.depth // self.per)
        step = np.arange(columns * self.per)
        rows = self.ids[np.minimum(of[:, None] + step, len(self.ids) - 1)] * (step < self.left[of][:, None])
        return self._pack(rows.reshape(len(of), columns, self.per))


def _bisect(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked row the number of sorted rows before it."""
    low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(keys), np.int64)
    every = np.arange(len(asked))
    while len(keys) and (low < high).any():
        mid = np.minimum((low + high) >> 1, len(keys) - 1)
        rows = keys[mid]
        at = (rows != asked).argmax(axis=1)
        less = (rows[every, at] < asked[every, at]) & (low < high)
        low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
    return low


class Shard:
    """Suffix array over the words of some documents, as far as suffixes of a benchmark part reach into it."""

    def __init__(self, texts: list[bytes], bench: Benchmark):
        self.bench, self.count = bench, len(texts)
        self.words = Words(texts, bench.salt)
        w = self.words
        ids = np.minimum(np.searchsorted(bench.hashes, w.hash), max(len(bench.hashes) - 1, 0))
        known = bench.hashes[ids] == w.hash if len(bench.hashes) else np.zeros(len(w), bool)
        #: place of each word: a zero parts documents
        self.place = np.arange(len(w)) + w.of
        self.ids = np.zeros(len(w) + len(texts) + bench.depth + bench.per, np.int64)
        self.ids[self.place] = np.where(known, ids + 1, 0)
        self.word_at = np.full(len(self.ids), -1, np.int64)
        self.word_at[self.place] = np.arange(len(w))
        self._sort()

    def _sort(self) -> None:
        bench, n = self.bench, len(self.words) + self.count
        packed = np.zeros(len(self.ids), np.int64)
        for i in range(bench.per):
            packed[:-i or None] |= self.ids[i:] << (bench.bits * (bench.per - 1 - i))
        starts = np.flatnonzero(self.ids[:n])
        first = packed[starts]
        order = np.argsort(first, kind="stable")
        first, starts = first[order], starts[order]
        # intervals of the windows by their first words; only these suffixes are sorted on
        low, high = np.searchsorted(first, bench.low[:, 0], "left"), np.searchsorted(first, bench.high[:, 0], "right")
        reach = np.zeros(len(starts) + 1, np.int64)
        np.add.at(reach, low, 1)
        np.add.at(reach, high, -1)
        self.suffixes = starts[np.cumsum(reach)[:-1] > 0]
        columns = bench.low.shape[1]
        keys = packed[np.minimum(self.suffixes[:, None] + bench.per * np.arange(columns), len(packed) - 1)]
        order = np.lexsort(keys.T[::-1]) if len(keys) else np.zeros(0, np.int64)
        self.suffixes, self.keys = self.suffixes[order], keys[order]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, word) of every occurrence of a window; exact, as the words that are hit are compared byte by byte."""
        bench = self.bench
        while True:
            low, high = _bisect(self.keys, bench.low), _bisect(self.keys, bench.high + _top(bench.high))
            n = np.maximum(high - low, 0)
            window = np.repeat(np.arange(len(n)), n)
            at = self.suffixes[np.repeat(low, n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)]
            hit = self._covered(at, bench.width[window])
            words = np.flatnonzero(hit)
            wrong = self.words.differ(words, bench.words, bench.first[self.ids[self.place[words]] - 1])
            if not wrong.any():
                return window, self.word_at[at]
            self.ids[self.place[words[wrong]]] = 0  # a word that only shares a hash is none of the benchmark's
            self._sort()

    def _covered(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + width, -1)
        return np.cumsum(change)[self.place] > 0

    def hits(self, window: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which words lie in an occurrence."""
        return self._covered(self.place[word], self.bench.width[window])

    def longest(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, word, length): for each benchmark suffix its longest match of ``least`` words or more, and where it is."""
        bench = self.bench
        of = np.flatnonzero(bench.left >= least)
        if not len(self.keys) or not len(of):
            return (np.zeros(0, np.int64),) * 3
        at = _bisect(self.keys, bench.suffix_rows(of))
        best, where = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.keys) - 1)):
            place = self.suffixes[near]
            length, alive = np.zeros(len(of), np.int64), np.arange(len(of))
            while len(alive):
                n = length[alive]
                more = (n < bench.left[of[alive]]) & (self.ids[place[alive] + n] == bench.ids[of[alive] + n])
                alive = alive[more]
                length[alive] += 1
            better = length > best
            best, where = np.where(better, length, best), np.where(better, self.word_at[place], where)
        keep = best >= least
        return of[keep], where[keep], best[keep]


def _top(high: np.ndarray) -> np.ndarray:
    """One in the last column: the bisection then counts equal rows too."""
    out = np.zeros_like(high)
    out[:, -1:] = 1
    return out


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES):
    """The benchmark in parts of bounded bytes, one at a time: (names, texts).

    Items are dealt to parts by an order, so that no more than one part is ever in the driver's memory.
    """
    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("name"), F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    names: list[str] = []
    texts: list[bytes] = []
    size = 0
    for row in rows.orderBy("name", "text").toLocalIterator():
        text = row.text.encode()
        if names and size + len(text) > part_bytes:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(row.name)
        texts.append(text)
        size += len(text)
    if names:
        yield names, texts


_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _judged(texts: list[bytes], bench: Benchmark, before: list | None) -> list[dict]:
    """Per text its words, the runs of words that are hit (start, end, start, ...), and the items; joined to what an earlier pass found."""
    out = []
    for lo, hi in text_blocks(texts, SHARD_BYTES):
        shard = Shard(texts[lo:hi], bench)
        window, word = shard.occurrences()
        count = np.bincount(shard.words.of, minlength=hi - lo)
        first = np.cumsum(count) - count
        hit = shard.hits(window, word)
        for i, found in enumerate(before[lo:hi] if before else []):
            for a, z in zip(found["runs"][0::2], found["runs"][1::2], strict=True):
                hit[first[i] + a : first[i] + z] = True
        # runs of hit words that end with their document
        of = shard.words.of
        edge = np.append(True, (hit[1:] != hit[:-1]) | (of[1:] != of[:-1])) if len(hit) else np.zeros(0, bool)
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(hit))
        begin, end = begin[hit[begin]], end[hit[begin]]
        runs: list[list[int]] = [[] for _ in range(lo, hi)]
        for d, a, z in zip(of[begin].tolist(), (begin - first[of[begin]]).tolist(), (end - first[of[begin]]).tolist(), strict=True):
            runs[d] += [a, z]
        pairs = np.unique(np.stack([of[word], window], axis=1), axis=0)
        n = bench.window_ids[pairs[:, 1] + 1] - bench.window_ids[pairs[:, 1]]
        at = np.repeat(bench.window_ids[pairs[:, 1]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        leaks = np.unique(np.stack([np.repeat(pairs[:, 0], n), bench.window_items[at]], axis=1), axis=0)
        items: list[list[str]] = [list(before[lo + i]["items"]) if before else [] for i in range(hi - lo)]
        for d, i in leaks.tolist():
            items[d].append(bench.names[i])
        out += [{"n_words": c, "runs": r, "items": x} for c, r, x in zip(count.tolist(), runs, items, strict=True)]
    return out


def _pass(bench, text: str, found: str, known: bool):
    def run(batches):
        for batch in batches:
            before = batch.column(found).to_pylist() if known else None
            judged = pa.array(_judged(text_column(batch, text), bench.value, before), _FOUND)
            if known:
                batch = batch.set_column(batch.schema.names.index(found), found, judged)
            else:
                batch = batch.append_column(found, judged)
            yield batch

    return run


def searched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", found: str = "found", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with a struct ``found``: number of words, runs of hit words (start, end, ...), and identifiers of leaked items.

    One pass over the texts for each part of the benchmark; with one part, nothing is written or shuffled.
    """
    spark = session_of(docs)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{found}` struct<n_words: bigint, runs: array<bigint>, items: array<string>>"])
    known = False
    for names, texts in parts_of(benchmark, part_bytes=part_bytes):
        if known:
            docs = materialize(docs, "searched")
        bench = spark.sparkContext.broadcast(Benchmark(names, texts, window))
        docs = docs.mapInArrow(_pass(bench, text_col, found, known), schema)
        known = True
    if not known:
        docs = docs.mapInArrow(_pass(spark.sparkContext.broadcast(Benchmark([], [], window)), text_col, found, False), schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, n_words, n_hit, runs, items) of each document: words, words within windows of items, their runs, and those items in order."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = searched(plain, benchmark, window=window, part_bytes=part_bytes)
    pairs = F.transform(F.sequence(F.lit(0), F.size("found.runs") - 2, F.lit(2)), lambda i: F.get("found.runs", i + 1) - F.get("found.runs", i))
    n_hit = F.when(F.size("found.runs") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return out.select("id", F.col("found.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("found.runs").alias("runs"), F.array_sort(F.array_distinct("found.items")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    name = "found"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    out = searched(docs, benchmark, text_col, name, window)
    return out.filter(F.size(F.col(name)["items"]) == 0).drop(name)


def _longest(bench, least: int):
    def run(batches):
        for batch in batches:
            texts, ids = text_column(batch, "text"), batch.column("id")
            b = bench.value
            for lo, hi in text_blocks(texts, SHARD_BYTES):
                shard = Shard(texts[lo:hi], b)
                shard.occurrences()  # drops words that only share a hash
                of, word, length = shard.longest(least)
                doc = shard.words.of[word]
                first = np.searchsorted(shard.words.of, doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.names[i] for i in b.item[of].tolist()], pa.string()), pa.array(b.offset[of]), pa.array(length), ids.take(pa.array(doc + lo)), pa.array(word - first)],
                    ["item", "item_word", "length", "id", "word"],
                )

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(item, item_word, length, id, word): for each suffix of an item its longest verbatim match in the texts, and one place of it.

    Matches of fewer than ``least`` words are left out. Of equally long ones the smallest document, then the first word counts.
    """
    spark = session_of(docs)
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    schema = "item string, item_word long, length long, id long, word long"
    out = spark.createDataFrame([], schema)
    for names, texts in parts_of(benchmark, part_bytes=part_bytes):
        out = out.unionByName(plain.mapInArrow(_longest(spark.sparkContext.broadcast(Benchmark(names, texts, least)), least), schema))
    best = F.min(F.struct((-F.col("length")).alias("neg"), "id", "word")).alias("best")
    return out.groupBy("item", "item_word").agg(best).select("item", "item_word", (-F.col("best.neg")).alias("length"), "best.id", "best.word")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word windows of ``benchmark`` in each row of ``documents``; odd rows as the module says."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    with scratch_scope(spark):
        found = contamination(docs, benchmark)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM items)),
widths AS (SELECT DISTINCT n FROM items),
places AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, widths WHERE len(w) >= n)),
found AS (SELECT r, p, n, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
leaks AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN leaks USING (r)
"""
