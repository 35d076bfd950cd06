"""Vector bin packing of tokenised documents into training sequences.

Each sequence has a capacity in tokens, in segments (pieces) and in loss-bearing
tokens. The loss mask is that of instruction data: the first ``prompt`` share of
a document's ids is what the model is given, and the others bear loss. Of the
pieces that fit all three remaining capacities, the one whose demand has the
largest dot product with them goes next; if none fits, the piece of which most
fits is cut, and the last segment of a sequence is cut from a piece that fills
it. So whole stretches of loss-bearing tokens share a sequence with prompts of
other documents. A sequence that nothing can fill is padded; at the end of a task
it is cut into sequences of powers of two, which need no padding.

Every task packs its own documents as they stream in, a bounded number of them
at a time, so nothing is shuffled. Sequence ids hold the task's number in their
upper bits. Defined results: null text counts as empty and gives the end id
alone; very long texts are cut into as many pieces as they need; repeated rows are
packed each; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meeting import give_back
from .word_tokens import BLOCK, MEMO, encoded_blocks

END_ID = 1
TOKENS = 2048
SEGMENTS = 16
#: Loss-bearing tokens of a sequence, below its tokens, and the share of a document that bears no loss.
LOSS = 1792
PROMPT = 0.25
#: Tokens that are packed together; the rest of them goes on to the next round.
ROUND = 1 << 20


class Packer:
    """Packs documents given as (key, ids); yields (key, start, length, crc32, tokens of the document, sequence, offset, loss-bearing tokens)."""

    def __init__(self, first_sequence: int = 0, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt: float = PROMPT):
        self.capacity = np.asarray([tokens, segments, loss], float)
        self.sequence, self.tokens, self.prompt = first_sequence, tokens, prompt
        # held pieces (key, ids, start), and in columns what they ask for: tokens, one segment, loss-bearing tokens
        self.held: list[tuple] = []
        self.demand = np.ones((3, 1024))
        self.size = 0
        self.open: list[tuple] = []
        self.left = self.capacity.copy()

    def _prompt(self, ids: np.ndarray) -> int:
        return int(len(ids) * self.prompt)

    def _free(self, ids: np.ndarray, start: int, length: int) -> int:
        """Tokens of a piece, at its start, that bear no loss."""
        return min(max(self._prompt(ids) - start, 0), length)

    def _hold(self, key, ids: np.ndarray, start: int, length: int) -> None:
        if len(self.held) == self.demand.shape[1]:
            self.demand = np.concatenate([self.demand, np.ones_like(self.demand)], 1)
        self.demand[:, len(self.held)] = length, 1, length - self._free(ids, start, length)
        self.held.append((key, ids, start))
        self.size += length

    def _take(self, i: int) -> tuple:
        """Piece (key, ids, start, length); the last one takes its place."""
        length, last = int(self.demand[0, i]), len(self.held) - 1
        piece = self.held[i]
        self.held[i] = self.held[last]
        self.held.pop()
        self.demand[:, i] = self.demand[:, last]
        self.size -= length
        return *piece, length

    def _piece(self, key, ids: np.ndarray, start: int, length: int, offset: int) -> tuple:
        crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        return key, start, length, crc, len(ids), self.sequence, offset, length - self._free(ids, start, length)

    def _close(self):
        offset = 0
        for key, ids, start, length in self.open:
            yield self._piece(key, ids, start, length, offset)
            offset += length
        self.sequence += 1
        self.open, self.left = [], self.capacity.copy()

    def add(self, key, ids: np.ndarray):
        """Takes a document, in pieces that fit an empty sequence."""
        ids, start = np.array(ids), 0  # a held piece keeps its document's ids, not those of the block
        while start < len(ids):
            length = int(min(self.tokens, len(ids) - start, max(self._prompt(ids) - start, 0) + self.capacity[2]))
            self._hold(key, ids, start, length)
            start += length
        if self.size >= ROUND:
            yield from self.pack(ROUND // 8)

    def _next(self) -> tuple[int, int]:
        """The piece to place, and how many of its tokens; 0 if nothing fits."""
        demand = self.demand[:, : len(self.held)]
        free = demand[0] - demand[2]
        if self.left[1] == 1:
            fills = (demand[0] >= self.left[0]) & (self.left[0] - free <= self.left[2])
            if fills.any():
                return int(np.where(fills, demand[0], 0).argmax()), int(self.left[0])
        fits = (demand[0] <= self.left[0]) & (demand[2] <= self.left[2])
        if fits.any():
            gain = (self.left / self.capacity**2) @ demand
            i = int(np.where(fits, gain, -1.0).argmax())
            return i, int(demand[0, i])
        room = np.minimum(np.minimum(demand[0], self.left[0]), free + self.left[2])
        i = int(room.argmax())
        return i, int(room[i])

    def pack(self, rest: int = 0, split: bool = False):
        """Places held pieces until about ``rest`` of their tokens are left, for better fits with those that come.

        With ``split`` sequences that stay short become several, of powers of two.
        """
        while self.size > rest:
            i, n = self._next()
            if n:
                key, ids, start, length = self._take(i)
                self.open.append((key, ids, start, n))
                self.left -= (n, 1, n - self._free(ids, start, n))
                if n < length:
                    self._hold(key, ids, start + n, length - n)
            if not n or self.left[0] < 1 or self.left[1] < 1:
                yield from self._split() if split else self._close()

    def _split(self):
        """Cuts the open sequence into powers of two."""
        pieces, self.open = self.open, []
        total = sum(p[3] for p in pieces)
        if total == self.tokens:
            self.open = pieces
            yield from self._close()
            return
        for power in (1 << b for b in range(total.bit_length() - 1, -1, -1)):
            room = power if total & power else 0
            while room:
                key, ids, start, length = pieces.pop(0)
                n = min(room, length)
                self.open.append((key, ids, start, n))
                if n < length:
                    pieces.insert(0, (key, ids, start + n, length - n))
                room -= n
            if self.open:
                yield from self._close()
        self.left = self.capacity.copy()

    def finish(self):
        """Places all that is left."""
        yield from self.pack(split=True)
        yield from self._split()


_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def packed_sequences(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, prompt: float = PROMPT, memo: int = MEMO, block: int = BLOCK) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``memo`` bounds the chunks that a worker remembers, ``block`` the bytes of text that it encodes at once, and both its memory.
    """
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, prompt)
        out: list[tuple] = []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for lo, ids in encoded_blocks(tokenizer, batch, "text", end_id, block, memo):
                for k, x in enumerate(ids):
                    out.extend(packer.add(keys[lo + k], x))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        out.extend(packer.finish())
        if out:
            yield batch_of(out)
        del packer, out
        give_back()

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, _PIECES)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )
