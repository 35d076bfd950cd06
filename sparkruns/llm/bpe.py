"""Byte-level BPE by backtracking over longest matches, and decoding.

The bytes of a piece are mapped to Latin-1, so that an Aho-Corasick automaton of
all vocabulary entries reads them one character for each byte. Encoding takes
the longest entry at the current place; two neighbours are *compatible* if the
merges of their joined bytes end in just these two, which is memoised. Where no
entry at a place is compatible with its predecessor, it goes back to the
predecessor and takes the next shorter one there. The one sequence of pairwise
compatible entries is the result of the merges, found in linear time.

Defined results: null text counts as empty and has no ids; repeated rows give
the same ids; very long pieces and texts are handled whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, text_column

#: Bound on the pieces that a worker remembers.
MEMO = 300_000
#: Characters of the longest piece that is remembered.
LONGEST = 64
#: Bound on the pairs of neighbours that it remembers.
PAIRS = 400_000


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.size_of = {r: len(b) for b, r in ranks.items()}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.automaton = automaton
        self.compatible: dict[int, bool] = {}
        self.shorter: dict[int, int | None] = {}

    def _merge(self, b: bytes) -> list[int]:
        """Merges by rank, lowest and then leftmost first."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _shorter(self, token: int) -> int | None:
        """The longest entry that is a proper prefix of an entry."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((r for k in range(len(b) - 1, 0, -1) if (r := self.ranks.get(b[:k])) is not None), None)
        return self.shorter[token]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size_of = self.size_of
        longest = [0] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # later ends at a start are longer
            longest[end + 1 - size_of[token]] = token
        ids: list[int] = []
        dead = bytearray(len(piece) + 1)  # places from which no rest can be encoded after what led there
        at, token, total = 0, longest[0], len(piece)
        while True:
            end = at + size_of[token]
            if not dead[end] and (not ids or self._fits(ids[-1], token)):
                ids.append(token)
                if end == total:
                    return ids
                at, token = end, longest[end]
                continue
            token = self._shorter(token)
            while token is None:  # nothing fits here: what led here was wrong
                dead[at] = 1
                token = ids.pop()
                at -= size_of[token]
                token = self._shorter(token)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Splits texts by the pattern and encodes each match by itself; frequent pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.bpe = BacktrackingBPE(ranks)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.room = memo

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for piece in self.find(text):
            got = memo.get(piece)
            if got is None:
                got = tuple(self.bpe.encode(piece.encode()))
                if len(memo) < self.room and len(piece) <= LONGEST:
                    memo[piece] = got
            ids += got
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_encoders: dict[tuple[str, str], TextEncoder] = {}


def worker_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each worker process; the vocabulary file is installed on every machine."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(read_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row."""

    def run(batches):
        encoder = worker_encoder(path, pattern)
        for batch in batches:
            ids = [encoder.encode(t.decode()) for t in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, bytes) of every row of (id, ids)."""

    def run(batches):
        bpe = worker_encoder(path, pattern).bpe
        for batch in batches:
            data = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, bytes binary")


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, and decodes what it encoded, without moving ids."""

    def run(batches):
        encoder = worker_encoder(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in text_column(batch, "text"):
                ids = encoder.encode(text.decode())
                n.append(len(ids))
                of_ids.append(sha(",".join(map(str, ids)).encode()))
                of_bytes.append(sha(encoder.bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded_digests(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")
