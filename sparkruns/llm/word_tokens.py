"""Word-level memo around a tokenizer of the tokenizers library.

The tokenizer's pieces never span a space or a line feed, so that a text's ids
are those of its chunks between them, in order; a chunk's final punctuation
after a letter or digit is a piece of its own; and A-Z count as a-z. A worker
remembers chunks up to a bound and sends all unknown ones of a block of texts
through the library at once. A tokenizer that treats a probe otherwise encodes
whole texts instead, and so does any for a text with the string of a special
token in it, which the library takes for that token unless ``plain`` says that
it is ordinary text.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER_AZ, WORKER_CACHES, mix64, text_blocks, text_column

#: Bounds on the chunks that a worker remembers: their number, and bytes of one.
MEMO = 700_000
LONGEST = 48
_FINAL = b".,;:!?|#$%&*"
_TABLE = bytes(32 if c == 10 else c for c in LOWER_AZ)
_MASK = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class ChunkEncoder:
    def __init__(self, path: str, memo: int = MEMO, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        # as they would show in folded text
        self.marks = [] if plain else sorted({t.content.encode().translate(_TABLE) for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[bytes, bytes] = {}
        self.room = memo
        self.by_chunks = self._suits()
        self.ends = self._word_ends()

    @property
    def whole(self):
        """The library's tokenizer as whole texts need it; there is one vocabulary in memory for them and for chunks."""
        self.tokenizer.encode_special_tokens = self.plain
        return self.tokenizer

    def _suits(self) -> bool:
        """Whether case folds and pieces end at white space and before final punctuation."""
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or pieces is None:
            return False
        return [p for p, _ in pieces.pre_tokenize_str(normal.normalize_str("Ab. cD\tx9\ny,"))] == ["ab", ".", "cd", "x", "9", "y", ","]

    def _word_ends(self) -> np.ndarray | None:
        """Whether each id ends a word, if the vocabulary marks such tokens by a suffix."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _encode(self, text: str):
        self.tokenizer.encode_special_tokens = True  # chunks hold no special token
        return self.tokenizer.encode(text, add_special_tokens=False)

    def _whole(self, text: bytes, end: int | None) -> np.ndarray:
        return np.asarray(self.whole.encode(text.decode(), add_special_tokens=False).ids + ([] if end is None else [end]), self.dtype)

    def _unknown(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each chunk, from a few calls for all."""
        found: dict[bytes, bytes] = {}
        words, others = [], []
        for c in chunks:
            text = c.decode()
            (words if self.ends is not None and text.isalpha() else others).append((c, text))
        for some, cut_of in ((words, self._cuts_by_ends), (others, self._cuts_by_offsets)):
            for lo in range(0, len(some), 20_000):
                part, texts = zip(*some[lo : lo + 20_000], strict=True)
                got = self._encode(" ".join(texts))
                ids = np.asarray(got.ids, self.dtype)
                cut = cut_of(texts, ids, got).tolist()
                raw = ids.tobytes()
                w = self.dtype.itemsize
                for c, a, z in zip(part, cut[:-1], cut[1:], strict=True):
                    found[c] = raw[a * w : z * w]
        return found

    def _cuts_by_ends(self, texts: tuple[str, ...], ids: np.ndarray, got) -> np.ndarray:
        """Of chunks that are one word each: a word's last token is of the vocabulary's kind for that."""
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(texts) or cut[-1] != len(ids):  # some chunk is not one word after all
            return self._cuts_by_offsets(texts, ids, got)
        return np.append(0, cut)

    def _cuts_by_offsets(self, texts: tuple[str, ...], ids: np.ndarray, got) -> np.ndarray:
        """Offsets tell which chunk a token is of."""
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(size) - size
        of = np.searchsorted(starts, np.asarray([s for s, _ in got.offsets], np.int64), side="right") - 1
        return np.searchsorted(of, np.arange(len(texts) + 1))

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, by the memo and the library."""
        memo = self.memo
        out = list(map(memo.get, chunks))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        apart, fresh = {}, set()
        for i in missing:
            c = chunks[i]
            stem = c.rstrip(_FINAL)
            if len(stem) < len(c) and stem and (stem[-1:].isalnum() or stem.decode()[-1].isalnum()):
                apart[c] = stem, c[len(stem) :]
                fresh.update(apart[c])
            else:
                fresh.add(c)
        fresh = sorted(c for c in fresh if c not in memo)  # the work follows the block, not what is remembered
        found = self._unknown(fresh)
        for c, (stem, final) in apart.items():
            found[c] = (found[stem] if stem in found else memo[stem]) + (found[final] if final in found else memo[final])
        for i in missing:
            out[i] = found[chunks[i]]
        room = self.room - len(memo)
        for c, ids in found.items():  # stems before chunks
            if room <= 0:
                break
            if len(c) <= LONGEST:
                memo[c] = ids
                room -= 1
        return out

    def encode(self, texts: list[bytes], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text (UTF-8), followed by the end id; each different chunk of the texts is looked up once."""
        if not self.by_chunks:
            return [self._whole(t, end) for t in texts]
        joined = (b" " * 8 + b" ".join(texts) + b" " * 8).translate(_TABLE)
        if any(m in joined for m in self.marks):
            marked = {i for i, t in enumerate(texts) for folded in [t.translate(_TABLE)] if any(m in folded for m in self.marks)}
            if marked:
                rest = iter(self.encode([t for i, t in enumerate(texts) if i not in marked], end))
                return [self._whole(t, end) if i in marked else next(rest) for i, t in enumerate(texts)]
        b = np.frombuffer(joined, np.uint8)
        ends = 8 + np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        space = b == 32
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, stop = edge[0::2], edge[1::2]
        n = stop - start
        at = np.ndarray((len(b) - 7,), "<u8", joined, 0, (1,))  # eight bytes from each place
        head = at[start] & _MASK[np.minimum(n, 8)]
        last = at[np.maximum(stop - 8, 0)]
        rest = mix64(last * _ODD + n.astype(np.uint64))
        rest[n < 8] = 0  # a short chunk's last bytes are not its own
        h = mix64(head * _ODD + rest + n.astype(np.uint64))
        long, k = np.flatnonzero(n > 16), 8
        while len(long):  # the bytes between
            h[long] = mix64(h[long] * _ODD + at[start[long] + k])
            k += 8
            long = long[n[long] > k + 8]
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        lead = first[inverse]
        clash = bool((n != n[lead]).any() or (head != head[lead]).any() or ((last != last[lead]) & (n >= 8)).any())
        long, k = np.flatnonzero((n > 16) & (lead != np.arange(len(n)))), 8
        while len(long) and not clash:  # the bytes between, too
            clash = bool((at[start[long] + k] != at[start[lead[long]] + k]).any())
            k += 8
            long = long[n[long] > k + 8]
        if clash:  # two chunks with one hash
            first = inverse = np.arange(len(n))
        ids = self._known([joined[a:z] for a, z in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
        bounds = np.searchsorted(start, np.concatenate([[0], ends]))
        if end is not None:
            ids.append(self.dtype.type(end).tobytes())
            inverse = np.insert(inverse, bounds[1:], len(ids) - 1)
            bounds = bounds + np.arange(len(bounds))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        begin = (np.cumsum(size) - size)[inverse]
        size = size[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        cut = total[bounds].tolist()
        return [flat[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]


_encoders: dict[tuple, ChunkEncoder] = WORKER_CACHES.setdefault("word_tokens", {})


def worker_encoder(path: str, memo: int = MEMO, plain: bool = False) -> ChunkEncoder:
    """One encoder for each worker process and setting; the vocabulary file is installed on every machine."""
    if (path, memo, plain) not in _encoders:
        _encoders[path, memo, plain] = ChunkEncoder(path, memo, plain)
    return _encoders[path, memo, plain]


#: Rows of an Arrow batch that become Python values at once, and bytes of their texts that are encoded at once.
ROWS_AT_ONCE = 512
BLOCK = 2 << 20


def encoded_blocks(path: str, batch, column: str, end_id: int | None, limit: int = BLOCK, memo: int = MEMO, plain: bool = False):
    """(number of the first row, ids of each text with the end id) for blocks of a batch's texts of about ``limit`` bytes."""
    encoder = worker_encoder(path, memo, plain)
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        texts = text_column(batch.slice(at, ROWS_AT_ONCE), column)
        for lo, hi in text_blocks(texts, limit):
            yield at + lo, encoder.encode(texts[lo:hi], end_id)
