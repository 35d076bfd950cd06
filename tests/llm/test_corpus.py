"""Corpus operators against brute force, exact round trips and held-out accuracy, with the odd cases of their docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from sparkruns.llm import bpe, exact_dedup, meeting, nearest, ngram_join, packing, quality, suffix_dedup, toxicity, url_filter, wavelet, word_tokens  # noqa: E402
from sparkruns.llm.common import scratch_dir  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, block int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, and columns whose names clash with the operators' own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeßé") for _ in range(rng.randint(1, 9)))
    base = [word() for _ in range(400)]
    passage = " ".join(word() for _ in range(40))
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "one two"), (6, "One Two"), (7, " \t\n"), (None, "no identifier " * 9), (None, "no identifier " * 9), (8, " ".join(base)), (8, " ".join(base))]
    rows += [(9, " ".join(word() for _ in range(30_000)))]
    for i in range(10, 40):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(400)] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, f"{word()} {word()} {passage} {word()}") for i in range(40, 60)]
    rows += [(i, "same copy of a longer text, é, " * 5) for i in range(60, 90)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(odd):
    return [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]


def test_exact_dedup(odd):
    groups = defaultdict(list)
    for i, t in _rows(odd):
        groups[hashlib.sha256(t.translate(LOWER).encode()).hexdigest()].append(i)
    out = exact_dedup.exact_groups(odd).select("id", F.lower(F.hex("digest")).alias("h"), "keep_id", "group_size", "kept").collect()
    assert Counter((r.id, r.h) for r in out) == Counter((i, h) for h, ids in groups.items() for i in ids)
    for r in out:
        ids = groups[r.h]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known) if known else None, len(ids))
    assert Counter(r.h for r in out if r.kept) == Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_compares_bytes_when_digests_clash(odd):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 3), 8, "0"))
    out = exact_dedup.exact_groups(odd, digest=weak)
    assert out.filter("kept").count() == len({t.translate(LOWER) for _, t in _rows(odd)})
    assert out.count() == len(_rows(odd))


def test_state_does_not_expire(spark):
    state = exact_dedup.StreamingExactDedup(spark)
    keyed = lambda rows: spark.createDataFrame(rows, "digest binary, id long, text string")
    state.ingest(keyed([(b"a", 1, "x"), (b"b", 2, "y")]))
    state.ingest(keyed([(b"a", 5, "x")]))
    found = {bytes(r.digest): r for r in state.state().collect()}
    assert {d: (r.keep_id, r.group_size) for d, r in found.items()} == {b"a": (5, 2), b"b": (2, 1)}
    # the locator is the staged file that holds the text
    for r in found.values():
        assert (r.keep_id, r.keep_row) in {(x.id, x.row) for x in spark.read.parquet(r.locator).collect()}
    assert state.clashing() is None


def test_exact_dedup_across_batches(spark):
    """Clashing digests within a batch and across batches, and copies of earlier batches."""
    weak = lambda text: F.unhex(F.lpad(F.hex(F.length(text) % 2), 8, "0"))
    batches = [[(1, "aaa"), (2, "bb"), (None, "bb")], [(3, "ccc"), (4, "AAA")], [(5, "ccc"), (6, "e"), (7, "dddd"), (8, "bb")]]
    folder, seen = scratch_dir(spark, "batches"), []
    for batch in batches:
        seen += batch
        out = exact_dedup.exact_groups(spark.createDataFrame(batch, "doc_id long, text string"), digest=weak, folder=folder)
        groups = defaultdict(list)
        for i, t in seen:
            groups[t.lower()].append(i)
        best = {t: max(x for x in ids if x is not None) for t, ids in groups.items()}
        want = Counter((i, best[t.lower()], len(groups[t.lower()]), i == best[t.lower()]) for i, t in seen)
        assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in out.collect()) == want


def test_drop_exact_duplicates(odd, empty):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({t.translate(LOWER) for _, t in _rows(odd)})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def _repeats(rows, width):
    key = lambda i: -(1 << 63) if i is None else i
    least = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < key(i):
                gone[p : p + width] = b"\x01" * width
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), len(re.findall(b"\x01+", bytes(gone)))))
    return out


@pytest.mark.parametrize("width,hot", [(50, 256), (50, 3), (17, 4), (1, 256)])
def test_suffix_dedup(odd, monkeypatch, width, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", hot)
    some = odd.filter("length(text) < 5000 or text is null")
    out = suffix_dedup.repeated_spans(some, min_bytes=width).collect()
    assert Counter((r.id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in out) == Counter(_repeats(_rows(some), width))


def test_encoder_asks_offsets_of_few_chunks(monkeypatch):
    """Words are cut by their last tokens: offsets, a tuple for each token, are for what is not one word."""
    import public_tokenizers

    encoder = word_tokens.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), memo=20)
    asked = []

    class Watched:
        def __init__(self, got):
            self.ids, self.got = got.ids, got

        @property
        def offsets(self):
            asked.append(len(self.ids))
            return self.got.offsets

    plain = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda text: Watched(plain(text)))
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) + "\u00e9" * (i % 2) for i in range(500)]
    odd = ["don't", "x9y", "a.b,c", "\u0958\u0915 \u0958", "\ufb01ne \u01c4", "\u00aa\u00ba", "\u4e2d\u6587\u3002"]
    for texts in (words, words[:9] + odd, [" ".join(words), *odd]):
        asked.clear()
        got = encoder.encode([t.encode() for t in texts], 1)
        assert [x.tolist() for x in got] == [encoder.whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert texts is not words or not asked
    assert len(encoder.memo) == 20


def test_suffix_runs_of_frequent_passages_travel_whole():
    """Passages of some thousand documents go to their buckets as runs; one by one, their windows would take over ten times the bytes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 5000, np.uint8)) for _ in range(3)]
    data = meeting.pack(np.arange(3), np.arange(3), np.asarray([len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8))
    block = pa.table({"block": [7], "size": [15000], "data": pa.array([data], pa.binary())})
    _, start, n, anchor = suffix_dedup.anchor_runs(texts, 50)
    keys = np.unique(meeting.key48(anchor))
    answers = pa.table({"data": pa.array([meeting.pack(keys, np.full(len(keys), 5000, np.uint32))], pa.binary())})
    sent = suffix_dedup._send_runs(50, 4)(block, answers)
    read = [suffix_dedup._read(x) for x in sent.column("data").to_pylist()]
    assert sum(len(x[0]) for x in read) == len(n)
    assert sum(len(x[-1]) for x in read) == int((n + 49).sum()) < 50 * int(n.sum()) / 8
    assert sorted(int(s) for x in read for s in x[4]) == sorted(start.tolist())


def test_suffix_dedup_of_periodic_and_empty(spark, empty):
    docs = spark.createDataFrame([(1, "ab" * 500), (2, "x" + "ab" * 400), (3, "ba" * 30)], "doc_id long, text string")
    out = suffix_dedup.repeated_spans(docs).collect()
    assert Counter((r.id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in out) == Counter(_repeats([(r.doc_id, r.text) for r in docs.collect()], 50))
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_trim_repeats_keeps_characters_and_columns(odd):
    out = suffix_dedup.trim_repeats(odd, min_bytes=50)
    assert out.columns == odd.columns and out.count() == odd.count()
    cut = {r.id: bytes(r.kept) for r in suffix_dedup.repeated_spans(odd, characters=True).collect() if r.id is not None and len(r.spans)}
    assert cut
    for r in out.filter("doc_id is not null and doc_id <> 8").collect():
        if r.doc_id in cut:
            assert (r.text or "").encode() == cut[r.doc_id]


def _links(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    ids = [-(1 << 63) if i is None else i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    back = lambda x: None if x == -(1 << 63) else x
    return Counter((back(i), len(s), back(find(i))) for i, s in zip(ids, sets))


@pytest.mark.parametrize("size,percent,rare,common,cluster", [(4, 85, 16, 1024, 512), (5, 80, 2, 12, 8), (1, 60, 3, 8, 6), (2, 70, 1, 1, 4)])
def test_ngram_join(odd, monkeypatch, size, percent, rare, common, cluster):
    """Also with limits that put the same tokens in classes of singles, pairs and triples, and clusters in many parts."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "COMMON", common)
    monkeypatch.setattr(ngram_join, "CLUSTER", cluster)
    out = ngram_join.similar_groups(odd, size=size, percent=percent).collect()
    assert Counter((r.id, r.n_shingles, r.component) for r in out) == _links(_rows(odd), size, percent)


def test_ngram_join_of_nothing(empty):
    assert ngram_join.similar_groups(empty).count() == 0
    assert ngram_join.drop_similar(empty).columns == empty.columns


@pytest.mark.parametrize("percent", [50, 60, 80, 85, 95])
def test_signatures_are_shared_above_the_threshold(percent):
    """Whatever the classes of the tokens, a pair at the threshold has a signature in common."""
    rng = np.random.default_rng(percent)
    make = ngram_join.Signatures(percent, 16, 1024)
    tried = 0
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 40, 300):
        for _ in range(40):
            x = rng.integers(0, 1 << 62, n).astype(np.uint64)
            y = x[rng.permutation(n)[: -(-n * percent // 100)]]
            y = np.concatenate([y, rng.integers(0, 1 << 62, max(len(y) * 100 // percent - n, 0)).astype(np.uint64)])
            classes = rng.choice([[2, 2], [20, 2000], [2000, 2000], [2, 2000], [20, 20]])
            documents = {int(t): int(rng.choice(classes)) for t in np.intersect1d(x, y)}
            o = len(documents)
            if 100 * o >= percent * (len(x) + len(y) - o):
                tried += 1
                a, b = (make.of(s, np.asarray([documents.get(int(t), 1) for t in s])) for s in (x, y))
                assert np.intersect1d(a, b).size
    assert tried > 300


def test_very_frequent_tokens_are_sent_in_triples():
    make = ngram_join.Signatures(80, 16, 1024)
    tokens = np.random.default_rng(3).integers(0, 1 << 62, 100).astype(np.uint64)
    one, two, three = (len(make.of(tokens, np.full(100, n))) for n in (2, 100, 5000))
    assert one == 2 * 21 and len({one, two, three}) == 3


@pytest.fixture(scope="module")
def byte_encoder():
    return bpe.TextEncoder(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


def test_byte_bpe_equals_merges(byte_encoder, odd):
    tiktoken = pytest.importorskip("tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_encoder.bpe.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 70))) for k in ("the in gat", "aab", "éèüß th", "中文مرح", " \n\t.,!'s", "0123", "\U0001f600‍❤") for _ in range(300)]
    texts += [t for _, t in _rows(odd)] + ["a" * 5000]
    for t in texts:
        ids = byte_encoder.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert byte_encoder.bpe.decode(ids) == t.encode()


def test_byte_bpe_round_trip(odd, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.decode_ids(bpe.encode_texts(odd, path, P.PATTERN), path, P.PATTERN)
    assert Counter((r.id, bytes(r.bytes)) for r in back.collect()) == Counter((i, t.encode()) for i, t in _rows(odd))
    assert bpe.encoded_digests(empty, path, P.PATTERN).count() == 0


WORDS = P.path("word_bpe_49k.json")


@lru_cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def _word_ids(text):
    return [*_library().encode(text, add_special_tokens=False).ids, 1]


def test_chunk_encoder(odd):
    rng = random.Random(3)
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 40))) for k in ("abc the in's", "AÀẞİΣς ", "中文 ̈́a", " \n\t.,!?-#*'s", "01 23", " \x85\x1c a", "é ́x") for _ in range(200)]
    texts += [t for _, t in _rows(odd)]
    encoder = word_tokens.ChunkEncoder(WORDS, memo=100)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts], 1)] == [_word_ids(t) for t in texts]


def test_other_tokenizers_encode_whole_texts(monkeypatch):
    """A tokenizer that keeps case or spaces is not cut in chunks."""
    from tokenizers import normalizers

    assert word_tokens.ChunkEncoder(WORDS).by_chunks
    encoder = word_tokens.ChunkEncoder(WORDS)
    encoder.tokenizer.normalizer = normalizers.NFC()
    assert not encoder._suits()
    encoder.by_chunks = False
    assert [x.tolist() for x in encoder.encode([b"Ab cd", b""], 1)] == [[*encoder.whole.encode("Ab cd", add_special_tokens=False).ids, 1], [1]]


def test_strings_of_special_tokens_follow_the_plain_call():
    """As the library takes them with ``add_special_tokens=False`` alone; with ``plain`` they are ordinary text."""
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> there", "A<|endoftext|>b\n<|startoftext|><|startoftext|> c.", "<|ENDOFTEXT|> stays text", "plain, text", "", "<|endoftext|>", "x <|endof text|>"] * 3
    for plain in (False, True):
        library = Tokenizer.from_file(WORDS)
        library.encode_special_tokens = plain
        got = word_tokens.ChunkEncoder(WORDS, plain=plain).encode([t.encode() for t in texts], 1)
        assert [x.tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert word_tokens.ChunkEncoder(WORDS).encode([b"hello <|endoftext|> there"])[0].tolist() == [3306, 49407, 997]


def test_whole_texts_and_chunks_share_one_vocabulary():
    """A worker holds one tokenizer, whichever kind of text came last."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    encoder = word_tokens.ChunkEncoder(WORDS)
    for t in ("first words", "a <|endoftext|> b", "other words <|endoftext", "<|endoftext|>", "last, new ones <|endoftext|>x"):
        assert [x.tolist() for x in encoder.encode([t.encode()])] == [library.encode(t, add_special_tokens=False).ids]
    assert encoder.whole is encoder.tokenizer


def test_workers_forget_what_other_stages_kept():
    from sparkruns.llm.common import WORKER_CACHES, forget

    encoder = word_tokens.worker_encoder(WORDS, 10)
    assert encoder in WORKER_CACHES["word_tokens"].values()
    forget("word_tokens")
    assert word_tokens.worker_encoder(WORDS, 10) is encoder
    forget()
    assert not word_tokens._encoders and word_tokens.worker_encoder(WORDS, 10) is not encoder


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 513, 3000):
        ids = rng.integers(0, 300, n).astype("<u2")
        m, docs, starts = wavelet.read_shard(wavelet.write_shard(ids, np.asarray([4], np.int64), np.asarray([0, n])))
        assert (m.decode() == ids).all() and docs.tolist() == [4] and starts.tolist() == [0, n]
        for i in range(0, n, 97):
            v = int(ids[i])
            where = np.flatnonzero(ids == v)
            assert m.access(i) == v and m.rank(v, i) == int((ids[:i] == v).sum()) and m.rank(v, n) == len(where)
            assert m.select(v, len(where) - 1) == where[-1] and m.select(v, 0) == where[0] and m.select(v, len(where)) == -1
        assert m.rank(70_000, n) == 0


def test_token_shards(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_IDS", 500)
    folder = f"file://{tmp_path}/shards"
    wavelet.write_token_shards(odd, folder, WORDS)
    out = wavelet.read_token_shards(spark, folder).collect()
    expected = sorted(_rows(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    total, by_start = 0, sorted(out, key=lambda r: r.start)
    assert len(by_start) == len(expected)
    for r, (i, t) in zip(by_start, expected):
        assert (r.id, r.start, list(r.ids)) == (i, total, _word_ids(t))
        total += r.n_tokens
    crc = {(r.start, r.ids_crc32) for r in wavelet.shard_digests(spark, folder).collect()}
    assert crc == {(r.start, zlib.crc32(np.asarray(r.ids, "<u4").tobytes())) for r in out}
    # lookups in place: rank, select and access without decoding
    monkeypatch.setattr(wavelet.WaveletMatrix, "decode", None)
    everything = Counter(t for _, x in expected for t in _word_ids(x))
    some = [1, *(t for t, _ in everything.most_common(3)), 48_999]
    assert {r.token: r.n for r in wavelet.token_counts(spark, folder, some).collect()} == {t: everything[t] for t in some}
    rare = [t for t, n in everything.items() if n == 2][:2] + [48_999]
    places = Counter((t, i, k) for i, x in expected for k, t in enumerate(_word_ids(x)) if t in rare)
    assert Counter((r.token, r.id, r.position) for r in wavelet.token_occurrences(spark, folder, rare).collect()) == places
    once = [(i, x) for i, x in expected if i is not None and i != 8]
    wanted = spark.createDataFrame([(i, k) for i, x in once for k in (0, 2, len(_word_ids(x)) - 1, 10**6)] + [(12345, 0)], "id long, position long").distinct()
    ids = {i: _word_ids(x) for i, x in once}
    for r in wavelet.tokens_at(spark, folder, wanted).collect():
        assert r.token == (ids[r.id][r.position] if r.position < len(ids.get(r.id, [])) else None)
    monkeypatch.undo()
    wavelet.write_token_shards(empty, f"{folder}-empty", WORDS)
    assert wavelet.shard_digests(spark, f"{folder}-empty").count() == 0


@pytest.mark.parametrize("tokens,segments,loss,prompt", [(2048, 256, 2048, 0.25), (packing.TOKENS, packing.SEGMENTS, packing.LOSS, packing.PROMPT), (64, 3, 64, 0.0), (32, 8, 20, 0.5), (32, 4, 7, 0.1)])
def test_packing(odd, tokens, segments, loss, prompt):
    out = packing.packed_sequences(odd, WORDS, tokens=tokens, segments=segments, loss=loss, prompt=prompt).toPandas()
    ids = defaultdict(list)
    for i, t in _rows(odd):
        ids[-1 if i is None else i].append(_word_ids(t))
    for key, g in out.fillna({"id": -1}).groupby("id"):
        assert g["length"].sum() == sum(map(len, ids[int(key)]))
        for r in g.itertuples():
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.asarray(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[int(key)])
            assert r.loss_tokens == sum(p >= int(r.doc_tokens * prompt) for p in range(r.start, r.start + r.length))
    padding = 0
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= tokens and len(g) <= segments
        assert g["loss_tokens"].sum() <= loss
        n = int(g["length"].sum())
        padding += 0 if n & (n - 1) == 0 else tokens - n
    if tokens == 2048:
        assert padding == 0


def test_dot_product_fills_what_the_longest_piece_would_waste():
    """Two pieces of prompt and two that bear loss: the longest first leaves the loss-bearing ones to sequences of their own."""
    p = packing.Packer(tokens=9, segments=3, loss=4)
    ids = np.arange(100)
    for key, start, length in (("a", 0, 5), ("b", 50, 4), ("c", 0, 5), ("d", 60, 4)):
        p._hold(key, ids, start, length)
    out = list(p.finish())
    assert [(r[0], r[2], r[5], r[7]) for r in out] == [("b", 4, 0, 4), ("a", 5, 0, 0), ("d", 4, 1, 4), ("c", 5, 1, 0)]


def test_default_limits_bind():
    """On documents of all sizes each of the three limits stops some sequence."""
    rng = np.random.default_rng(0)
    p, out = packing.Packer(), []
    for i, n in enumerate(np.concatenate([rng.integers(1, 40, 3000), rng.integers(100, 6000, 200)])):
        out += p.add(i, np.arange(n))
    out += p.finish()
    by = defaultdict(list)
    for r in out:
        by[r[5]].append(r)
    tokens, segments, loss = (Counter(x) for x in zip(*((sum(r[2] for r in s), len(s), sum(r[7] for r in s)) for s in by.values())))
    assert max(tokens) == 2048 and max(segments) == packing.SEGMENTS and max(loss) == packing.LOSS
    assert segments[packing.SEGMENTS] and loss[packing.LOSS] and sum(k * n for k, n in tokens.items()) == sum(r[2] for r in out)


def test_held_pieces_do_not_keep_the_block():
    p, block = packing.Packer(), np.arange(1 << 16, dtype=np.uint16)
    assert list(p.add(1, block[:5000])) == [] and list(p.add(2, block[5000:5010])) == []
    assert len(p.held) == 4 and not any(np.shares_memory(ids, block) for _, ids, _ in p.held)
    assert sum(r[2] for r in p.finish()) == 5010


def test_packing_by_smaller_blocks_keeps_every_token(odd):
    """The bytes that are encoded at once change no id and no piece."""
    one, other = (sorted(map(str, packing.packed_sequences(odd, WORDS, **x).collect())) for x in ({}, {"block": 100, "memo": 10}))
    assert one == other


def test_toxicity_is_scored_in_parts(monkeypatch):
    """Memory follows the part, not the batch; scores do not follow either."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ".join(words * 400)] + [" ".join(rng.choice(words, rng.integers(1, 500))) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    terms = np.arange(0, 1 << toxicity.BITS, 3)
    model = toxicity.FactorizationMachine(0.1, terms, rng.normal(size=len(terms)), rng.normal(0, 0.1, (len(terms), toxicity.FACTORS)))
    whole = model.score([(t or "").encode() for t in texts])
    tracemalloc.start()
    try:
        parts = [(rows.column(0).to_pylist(), rows.column(1).nbytes, score) for rows, score in toxicity.scored_parts(model, batch, 1)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [i for rows, _, _ in parts for i in rows] == list(range(len(texts)))
    assert max(len(rows) for rows, _, _ in parts) <= toxicity.ROWS_AT_ONCE
    assert np.array_equal(np.concatenate([s for _, _, s in parts]), whole)
    assert peak < 250e6, peak


def test_packing_of_nothing(empty):
    assert packing.packed_sequences(empty, WORDS).count() == 0


@pytest.mark.parametrize("module,label,low", [(toxicity, "toxic", 0.93), (quality, "quality", 0.93)])
def test_classifiers_on_held_out_rows(spark, module, label, low):
    folder = "/root/testdata/sf0.1"
    query = toxicity.op4_toxicity if label == "toxic" else quality.op3_quality
    out = query(spark, folder).toPandas()
    assert len(out) == 10_000 and out["score"].between(0, 1).all()
    expected = [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]
    assert out["held_out"].tolist() == expected
    both = out[out["held_out"]].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    ranks, y = both["score"].rank(), both[label] == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > low


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(8, 1, 1), (9, 0, 0), (None, 1, 1), (10, None, None)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    for docs in (odd, empty):
        for lab in (labels, none):
            a = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, lab)).collect()
            b = quality.score_quality(docs, quality.fit_quality(docs, lab)).collect()
            assert len(a) == len(b) == docs.count() and all(0 <= r.score <= 1 for r in (*a, *b))
    kept = toxicity.drop_toxic(odd, toxicity.fit_toxicity(odd, none), threshold=2.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_factorization_machine_learns_pairs():
    """Two terms that are harmless alone: no sum of weights can tell their meeting."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 2000), rng.integers(0, 2, 2000)
    texts = [" ".join(w for w, on in (("alpha", x), ("omega", y), ("filler", 1)) if on).encode() for x, y in zip(a, b)]
    docs, buckets = toxicity.term_buckets(texts)
    model = toxicity.fit(docs, buckets, (a ^ b).astype(float), epochs=60)
    assert (((model.score(texts) > 0.5) == (a ^ b)).mean()) > 0.95


def test_factorization_machine_learns_pairs_among_noise():
    """The two terms do not correlate with the label at all, and thousands of noise terms do by chance."""

    def rows(seed):
        rng = np.random.default_rng(seed)
        a, b = np.tile([0, 0, 1, 1], 500), np.tile([0, 1, 0, 1], 500)
        noise = rng.integers(0, 4000, (2000, 20))
        return [" ".join([*(w for w, on in (("alpha", x), ("omega", y)) if on), *(f"w{k}" for k in own)]).encode() for x, y, own in zip(a, b, noise)], a ^ b

    texts, y = rows(1)
    docs, buckets = toxicity.term_buckets(texts)
    model = toxicity.fit(docs, buckets, y.astype(float))
    assert set(model.terms) == set(buckets)
    texts, y = rows(2)
    assert ((model.score(texts) > 0.5) == y).mean() > 0.95


def test_nearest(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 600)] + 0.3 * rng.normal(size=(600, 16))).round(3)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd_rows = [(1000, None), (1020, [0.0] * 16), (1040, [None] + [1.0] * 15), (1060, [float("nan")] * 16), (1080, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<double>").repartition(6)
    out = nearest.nearest_neighbours(df).toPandas()
    found = total = 0
    for q in range(0, 600, 20):
        score = (x * x[q]).sum(1)
        order = sorted((-s, i) for i, s in enumerate(score) if i != q)[:20]
        mine = out[out["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine["vec_id"])
        assert np.allclose(mine["score"], score[mine["vec_id"]], atol=1e-12)
        assert sorted(zip(-mine["score"], mine["vec_id"])) == list(zip(-mine["score"], mine["vec_id"]))
        found += len({i for _, i in order} & set(mine["vec_id"]))
        total += 20
    assert found / total >= 0.9 and set(out["query_id"]) == set(range(0, 600, 20))


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")
    out = nearest.nearest_neighbours(df).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 2, 2.0), (0, 2, 1, 0.5)]
    assert nearest.nearest_neighbours(df.limit(0)).count() == 0
    assert nearest.nearest_neighbours(df.filter("vec_id = 1")).count() == 0


@pytest.mark.parametrize("times", [2, 25])
@pytest.mark.parametrize("same", [True, False])
def test_nearest_of_repeated_identifiers(spark, times, same):
    """Rows that repeat the asking identifier, with one vector or several, leave all other neighbours."""
    own = [(0, [1.0, 0.0 if same else 0.001 * j]) for j in range(times)]
    rows = [*own, *((1, [0.9, 0.0]) for _ in range(times)), *((i, [1.0, 0.0]) for i in range(2, 8)), *((i, [0.5 - i / 1000, 0.1]) for i in range(8, 60) if i % 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = nearest.nearest_neighbours(df, recall=1.0).collect()
    want = {}
    for _, q in own:
        best = sorted((-(v[0] * q[0] + v[1] * q[1]), i) for i, v in rows if i != 0)[:20]
        for rank, (s, i) in enumerate(best, 1):
            want.setdefault((rank, i, round(-s, 9)), []).append(0)
    assert Counter((r["rank"], r.vec_id, round(r.score, 9)) for r in got) == {x: len(n) for x, n in want.items()}


def _judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = max(((len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, "allow", None))
    return host, path, best[2], best[1]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_url_filter(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_BYTES", limit)
    urls = [None, "", "nothing", "http://", "https://ORG/x", "http://a.org", "http://a.org/es/1", "http://Sub.Example.org/es/x?y#z", "http://example.org/en/17/", "http://example.org/en/2", "https://x.com/fr/#a", "https://x.com/de/a?b", "ftp://notexample.org/es/", "http://example.org/en/1?://x.com/de/", "http://a.b.c.d.e.com/de/"] * 2
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(pages, rules).collect()
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: _judge(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert len(out) == len(urls)
    none = url_filter.judge_urls(pages, rules.limit(0))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_blocked_bloom_has_no_false_negatives():
    h = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    bloom = url_filter.BlockedBloom(10_000 * 16 // 512)
    bloom.add(h[:10_000])
    assert bloom.may_hold(h[:10_000]).all() and bloom.may_hold(h[10_000:]).mean() < 0.02
