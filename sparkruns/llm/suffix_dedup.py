"""Suffix-array deduplication: depth-limited radix sort of the suffixes that can repeat.

A suffix is a start within a document, and only its first ``min_bytes`` bytes
count. Suffixes are ordered through that depth by passes on the most significant
digit first, eight bytes a pass, on the bytes themselves; groups that are equal
at full depth are exactly the repeated windows, and groups within one document
leave the sort at once. Hashes never decide a repeat, they only choose where
suffixes are sorted:

* The *anchor* of a window is the smallest hash of its ``k``-byte pieces. Equal
  windows have equal anchors, and neighbours mostly share theirs, so that
  windows travel as runs. Anchors of a single document end here.
* Each block of texts sorts its runs first: runs of one anchor and length through
  their whole bytes. A run that equals one of a smaller document of the block is
  settled for all its windows; one of each group goes on.
* What is left goes, with its bytes, to the bucket of its anchor, where whole runs
  and then their single windows are sorted. Windows of anchors that more documents
  have than a bucket takes are dealt on by further digits, their first and last
  eight bytes, once the block has sorted them, so that no bucket gets all contexts
  of a frequent passage. Such windows travel one by one, with fifty bytes each.

Texts are written once as blocks; all else is packed arrays. Defined results: a
byte goes if a window that covers it also starts in a document with a smaller
identifier, as judged on the input; null text counts as empty; a null identifier
counts as smaller than any other; rows with the same identifier never take bytes
from each other; texts shorter than ``min_bytes`` stay; very long texts are
judged whole (one text is a block by itself if need be, up to the two gigabytes
of a binary value); an empty table gives an empty result; other columns, whatever
their names, are ignored (``trim_repeats`` hands them through).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, Powers, fresh_names, materialize, mix64, scratch_scope, session_of
from .meeting import LOWEST, ROW, Block, blocked, bucket_of, by_block, documents_of, frugal, grouped, joined, key48, pack, rows, shared_keys, split_by, unpack

MIN_BYTES = 50
#: Windows of anchors of at least so many documents are dealt on by further digits. The runs of fewer
#: documents take under a megabyte, a fraction of a bucket; each window alone would take ten times that.
HOT_DOCUMENTS = 1 << 13
_BLOCK = 1 << 20
_LONGEST_RUN = 255


def _range_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k``-byte piece."""
    up, down = Powers.to(len(b) + 1)
    run = np.empty(len(b) + 1, np.uint64)
    run[0] = 0
    np.cumsum(BYTE_HASH[b] * up[: len(b)], out=run[1:])
    return mix64((run[k:] - run[:-k]) * down[: len(run) - k])


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    m = 1
    while 2 * m <= width:
        a = np.minimum(a[:-m], a[m:])
        m *= 2
    return np.minimum(a[: len(a) - (width - m)], a[width - m :]) if m < width else a


def piece_bytes(min_bytes: int) -> int:
    """Bytes of an anchor's piece: about half a window, 20 at most."""
    return max(1, min(20, min_bytes // 2))


def anchor_runs(texts: list[bytes], min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: text number, first start, number of windows, anchor hash."""
    k = piece_bytes(min_bytes)
    out: list[list[np.ndarray]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _BLOCK):
            size += len(texts[hi])
            hi += 1
        if size >= min_bytes:
            b = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
            ends = np.cumsum(np.fromiter((len(t) for t in texts[lo:hi]), np.int64, hi - lo))
            least = _sliding_min(_range_hashes(b, k), min_bytes - k + 1)
            valid = np.ones(len(b) + 1, bool)
            fresh = np.ones(len(b) + 1, bool)
            fresh[1 : len(least)] = least[1:] != least[:-1]
            fresh[ends] = True
            for end in ends.tolist():  # windows do not cross documents
                valid[max(0, end - min_bytes + 1) : end] = False
            at = np.flatnonzero(valid[: len(least)] & fresh[: len(least)])
            if len(at):
                stop = np.append(at[1:], len(least))
                of = np.searchsorted(ends, at, side="right")
                n = np.minimum(stop, ends[of] - min_bytes + 1) - at
                start = at - np.concatenate([[0], ends])[of]
                anchor = least[at]
                if n.max() > _LONGEST_RUN:
                    parts = -(-n // _LONGEST_RUN)
                    skip = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    of, anchor = np.repeat(of, parts), np.repeat(anchor, parts)
                    start = np.repeat(start, parts) + skip * _LONGEST_RUN
                    n = np.minimum(np.repeat(n, parts) - skip * _LONGEST_RUN, _LONGEST_RUN)
                out.append([of + lo, start, n, anchor])
        lo = hi
    return tuple(joined(out, [np.int64, np.int64, np.int64, np.uint64]))


def _digits(words: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Big-endian number of the ``size`` bytes (8 at most) at each place."""
    value = words[np.minimum(at, len(words) - 1)].astype(np.uint64)
    return value >> (8 * (8 - np.asarray(size))).astype(np.uint64)


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of a buffer that ends with eight spare bytes."""
    return np.ndarray(len(buffer) - 7, ">u8", buffer, strides=(1,))


def radix_repeats(groups: tuple[np.ndarray, ...], owner: np.ndarray, buffer: np.ndarray, at: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """Suffixes (starts ``at`` in ``buffer``) whose first ``depth`` bytes also start in a smaller owner, within their group.

    Most significant digit first, eight bytes a pass; groups stand together, and
    all of a group have one depth. A group of one digit needs no order, and a
    group of one owner leaves.
    """
    done = np.zeros(len(at), bool)
    words, depth = _words(buffer), np.broadcast_to(depth, at.shape)
    alive = np.lexsort(groups)
    border = np.zeros(len(alive), bool)
    border[:1] = True
    for g in groups:
        border[1:] |= g[alive][1:] != g[alive][:-1]
    d = 0
    while len(alive):
        first = np.flatnonzero(border)
        size = np.diff(np.append(first, len(alive)))
        own = owner[alive]
        least, most = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        stay, sorted_out = np.repeat(least != most, size), depth[alive] <= d
        done[alive[stay & sorted_out & (own > np.repeat(least, size))]] = True
        stay &= ~sorted_out
        alive, border = alive[stay], border[stay]
        if not len(alive):
            break
        digit = _digits(words, at[alive] + d, np.minimum(8, depth[alive] - d))
        first = np.flatnonzero(border)
        mixed = np.logical_or.reduceat(np.append(False, digit[1:] != digit[:-1]) & ~border, first)
        part = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(alive)))))
        if len(part):
            order = part[np.lexsort((digit[part], np.cumsum(border)[part]))]
            alive[part], digit[part] = alive[order], digit[order]
        border[1:] |= digit[1:] != digit[:-1]
        d += 8
    return done


def _gather(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    """The ranges of a byte array, joined."""
    skip = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return buffer[np.repeat(start, length) + skip].tobytes()


def _message(numbers: list[np.ndarray], text: bytes) -> bytes:
    """Numbers and text, each compressed by itself, as they share no statistics."""
    head = pack(*numbers, level=3)
    return len(head).to_bytes(4, "little") + head + zstandard.compress(text, 3)


def _read(message: bytes) -> list[np.ndarray]:
    end = 4 + int.from_bytes(message[:4], "little")
    return [*unpack(message[4:end]), np.frombuffer(zstandard.decompress(message[end:]), np.uint8)]


def _expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) for each of ``n`` items of each place."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _send_runs(min_bytes: int, buckets: int):
    """Of a block: the runs that may repeat, with their bytes, to buckets (kind 0); settled ones to itself (kind 1)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(table) and len(answers):
            block = Block.of(table)
            ids, texts = block.ids, block.texts
            of, start, n, anchor = anchor_runs(texts, min_bytes)
            documents = documents_of(key48(anchor), answers)
            several = documents > 1
            of, start, n, anchor, hot = of[several], start[several], n[several], anchor[several], documents[several] >= HOT_DOCUMENTS
            buffer = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
            base = np.concatenate([[0], np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))])

            def settle(copy):
                if copy.any():
                    found.append((block.number, 1, pack(of[copy], start[copy], n[copy])))
                return tuple(x[~copy] for x in (of, start, n, key, hot))

            key = anchor
            of, start, n, key, hot = settle(radix_repeats((n, key), ids[of], buffer, base[of] + start, n + min_bytes - 1))
            if hot.any():  # each window on its own
                at, skip = _expand(np.where(hot, n, 1))
                of, start, n, key, hot = of[at], start[at] + skip * hot[at], np.where(hot[at], 1, n[at]), key[at], hot[at]
                at, words, digit = (base[of] + start)[hot], _words(buffer), min(8, min_bytes)
                ends = mix64(_digits(words, at, digit) * np.uint64(3) + mix64(_digits(words, at + min_bytes - digit, digit)))
                key = key.copy()
                key[hot] = mix64(key[hot] ^ ends)
                copy = np.zeros(len(of), bool)
                copy[hot] = radix_repeats((key[hot],), ids[of[hot]], buffer, at, min_bytes)
                of, start, n, key, hot = settle(copy)
            at, length = base[of] + start, n + min_bytes - 1
            lead = _digits(_words(buffer), at, min(8, min_bytes))
            for bucket, i in split_by(bucket_of(key, buckets), buckets):
                i = i[np.lexsort((lead[i], key[i]))]
                text = _gather(buffer, at[i], length[i])
                me = np.full(len(i), block.number, np.int64)
                numbers = [(key[i] >> np.uint64(40)).astype(np.uint32), ids[of[i]], me, of[i].astype(np.uint32), start[i].astype(np.uint32), n[i].astype(np.uint8)]
                found.append((bucket, 0, _message(numbers, text)))
        return pa.Table.from_batches([rows(found)])

    return run


def _meet_runs(min_bytes: int, windows: int = 1 << 19):
    """Spans of a bucket's runs that start in a smaller document, to their blocks (kind 1)."""

    def resolve(key, ids, n, at, text):
        """(run, window in it) that start in a smaller document."""
        copy = radix_repeats((n, key), ids, text, at, n + min_bytes - 1)
        whole, left = np.flatnonzero(copy), np.flatnonzero(~copy)
        place, skip = _expand(n[left])
        of = left[place]
        done = radix_repeats((key[of],), ids[of], text, at[of] + skip, min_bytes)
        place, every = _expand(n[whole])
        of, skip = np.concatenate([of[done], whole[place]]), np.concatenate([skip[done], every])
        order = np.lexsort((skip, of))
        return of[order], skip[order]

    def run(table: pa.Table) -> pa.Table:
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        found = [(table.column("key")[i].as_py(), 1, data[i]) for i, k in enumerate(kinds) if k == 1]
        kind = [np.uint32, np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8]  # 24 bits of a key will do, as bytes decide
        key, ids, block, row, start, n, text = joined([_read(d) for d, k in zip(data, kinds, strict=True) if k == 0], kind)
        if len(key):
            n, start = n.astype(np.int64), start.astype(np.int64)
            text = np.append(text, np.zeros(8, np.uint8))
            length = n + min_bytes - 1
            at = np.cumsum(length) - length
            order = np.argsort(key, kind="stable")
            key, ids, block, row, start, n, at = (x[order] for x in (key, ids, block, row, start, n, at))
            # whole keys at a time, of about so many windows
            last = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            total = np.concatenate([[0], np.cumsum(n)])
            lo, spans = 0, []
            while lo < len(key):
                fit = np.searchsorted(total[last], total[lo] + windows, side="right")
                hi = int(last[min(max(fit - 1, np.searchsorted(last, lo, side="right")), len(last) - 1)])
                part = slice(lo, hi)
                of, skip = resolve(key[part], ids[part], n[part], at[part], text)
                spans.append([of + lo, skip])
                lo = hi
            of, skip = joined(spans, [np.int64, np.int64])
            # neighbouring windows of a run as one span
            new = np.append(True, (of[1:] != of[:-1]) | (skip[1:] != skip[:-1] + 1)) if len(of) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(of)))
            of, skip = of[first], skip[first]
            blocks, place = np.unique(block[of], return_inverse=True)
            found += [(int(blocks[b]), 1, pack(row[of[i]].astype(np.int64), start[of[i]] + skip[i], count[i])) for b, i in split_by(place, len(blocks))]
        return pa.Table.from_batches([rows(found)])

    return run


_RESULT = "id long, text_hash long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def _whole_characters(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while start < stop and text[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def _cut(min_bytes: int, characters: bool = False):
    """Remaining bytes and removed spans of a block's documents; with ``characters``, spans keep to whole ones."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.of(table)
        ids, texts, hashes = block.ids, block.texts, block.hashes
        row, start, n = joined([unpack(d) for d in answers.column("data").to_pylist()], [np.int64] * 3)
        by_row = np.lexsort((start, row))
        row, start, stop = row[by_row], start[by_row], (start + n)[by_row] + min_bytes - 1
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        spans, kept = [], []
        for i, text in enumerate(texts):
            merged: list[list[int]] = []
            for a, z in zip(start[bounds[i] : bounds[i + 1]].tolist(), stop[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            if characters:
                merged = [list(_whole_characters(text, a, z)) for a, z in merged]
            edges = [0, *(x for s in merged for x in s), len(text)]
            kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if merged else text)
            spans.append([{"start": a, "stop": z} for a, z in merged])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table({
            "id": pa.array(ids, pa.int64(), mask=ids == LOWEST), "text_hash": pa.array(hashes, pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary()),
        })

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, characters: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, the removed spans (maximal, in bytes) and the remaining bytes."""
    blocks, buckets = blocked(docs, id_col, text_col, "suffix-blocks")

    def anchors(some: list[bytes]):
        of, _, _, anchor = anchor_runs(some, min_bytes)
        return of, key48(anchor)

    answers = shared_keys(blocks, anchors, buckets)
    runs = by_block(blocks, answers, buckets).applyInArrow(frugal(_send_runs(min_bytes, buckets)), ROW)
    spans = grouped(runs, "key", buckets).applyInArrow(frugal(_meet_runs(min_bytes)), ROW).select(F.col("key").alias("block"), "data")
    return by_block(blocks, spans, buckets).applyInArrow(frugal(_cut(min_bytes, characters)), _RESULT)


def trim_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of ``docs`` without their repeated spans (whole characters); other columns, and texts without such spans, are unchanged."""
    # rows may repeat an identifier, so that the hash of the text is part of the key
    i, h, kept = fresh_names(docs, "id", "hash", "kept")
    with scratch_scope(session_of(docs)):
        spans = repeated_spans(docs, id_col, text_col, min_bytes, characters=True).filter(F.size("spans") > 0)
        changed = spans.select(F.col("id").alias(i), F.col("text_hash").alias(h), F.col("kept").cast("string").alias(kept)).dropDuplicates([i, h])
        changed = materialize(changed, "suffix-changed", outer=True)
    text = docs[text_col]
    out = docs.join(changed, docs[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    return out.select(*(F.coalesce(F.col(kept), text).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return repeated_spans(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
