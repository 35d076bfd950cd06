"""The registered corpus queries on the smallest tables: contract columns and types, SQL, and brute force on whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from sparkruns.llm import packing, quality, registry, suffix_dedup, toxicity  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = {
    "op1_exact_dedup": "doc_id:bigint keep_id:bigint group_size:bigint kept:boolean text_sha256:string",
    "op2_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op3_quality": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op4_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op5_nearest": "query_id:bigint rank:int vec_id:bigint score:double",
    "op6_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op7_token_files": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op8_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op9_ngram_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op10_byte_bpe": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op11_merkle_manifest": "doc_id:bigint leaf:string subroot:string root:string proof_sha256:string folded_root:string verified:boolean",
    "op12_spelling_variants": "word:string form:string root:string n:bigint n_near:bigint form_n:bigint",
    "op13_benchmark_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    return {n: q(spark, sf_dir) for n, q in registry.queries().items()}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_columns_and_types(results):
    assert set(results) == set(COLUMNS)
    for name, df in results.items():
        kinds = dict(df.dtypes)
        for c in COLUMNS[name].split():
            column, kind = c.split(":")
            assert kinds[column] == kind, (name, c)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(results, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    theirs = con.sql(registry.oracle_sql()[name]).fetchall()
    names = [c.split(":")[0] for c in COLUMNS[name].split()]
    order = [d[0] for d in con.sql(registry.oracle_sql()[name]).description]
    assert Counter(tuple(r[n] for n in order) for r in results[name].collect()) == Counter(theirs) and set(order) == set(names)


def test_op2_against_brute_force_with_very_long_texts(spark):
    """Whole texts of hundreds of kilobytes that share passages and repeat themselves."""
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh "), 150_000))
    rows = [(1, long), (2, long[70_000:] + " new end"), (3, "xyz " * 40_000), (4, "start " + "xyz " * 30_000), (5, long[10:75] + "tail"), (6, None)]
    out = {r.id: r for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        assert bytes(out[i].kept) == bytes(x for x, g in zip(b, gone) if not g)
        assert len(out[i].spans) == len(re.findall(b"\x01+", bytes(gone)))


def test_op2_query(results, texts):
    least = {}
    for i in sorted(texts):
        b = texts[i].encode()
        for p in range(len(b) - 49):
            least.setdefault(b[p : p + 50], i)
    for r in results["op2_suffix_dedup"].collect():
        b = texts[r.doc_id].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < r.doc_id:
                gone[p : p + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_op5_query(spark, results, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    column = next(c for c in rows[0].asDict() if c != "vec_id")
    x = {r.vec_id: np.asarray(r[column], float) for r in rows if r[column] is not None and np.isfinite(np.asarray(r[column], float)).all() and np.any(r[column])}
    mine = defaultdict(list)
    for r in sorted(results["op5_nearest"].collect(), key=lambda r: r["rank"]):
        mine[r.query_id].append((r.vec_id, r.score))
    found = total = 0
    assert set(mine) == {i for i in x if i % 20 == 0}
    for q, got in mine.items():
        score = {i: float(v @ x[q]) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert len(got) == len(best) and all(abs(s - score[i]) < 1e-9 for i, s in got)
        found, total = found + len(set(best) & {i for i, _ in got}), total + len(best)
    assert found / total >= 0.9


def test_op7_and_op8_queries(results, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.asarray([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}
    start = 0
    for r in sorted(results["op7_token_files"].collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in results["op8_packing"].collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for i, p in pieces.items():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1]] and sum(n for _, n in p) == len(ids[i])
    assert set(pieces) == set(ids)
    for s in sequences.values():
        s.sort()
        n = sum(x[1] for x in s)
        assert [x[0] for x in s] == [0, *np.cumsum([x[1] for x in s])[:-1]] and n <= 2048 and n & (n - 1) == 0
        assert sum(x[2] for x in s) <= packing.LOSS and len(s) <= packing.SEGMENTS


def test_op9_query(results, texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b]) if a < b else 0
            if o and 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in results["op9_ngram_join"].collect()} == {(i, len(sets[i]), find(i)) for i in ids}


def test_op10_query(results, texts):
    tiktoken = pytest.importorskip("tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in results["op10_byte_bpe"].collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _plain_score(net, text: bytes) -> float:
    """The network's probability, chunk by chunk and filter by filter."""
    hops = max(2, -(-len(text) // quality.HOP))
    b = text + bytes(hops * quality.HOP - len(text) + quality.STRIDE)
    pooled = []
    for h in range(hops):
        best = np.zeros(quality.FILTERS)
        for p in range(h * quality.HOP, (h + 1) * quality.HOP, quality.STRIDE):
            x = np.concatenate([net.embed[c] for c in b[p : p + 2 * quality.STRIDE]]).astype(float)
            half = quality.STRIDE * quality.EMBED
            best = np.maximum(best, x[:half] @ net.near + x[half:] @ net.far + net.shift)
        pooled.append(best)
    chunks = [np.maximum(a, z) for a, z in zip(pooled, pooled[1:])]
    logit = np.mean(chunks, 0) @ net.weights[: quality.FILTERS] + np.max(chunks, 0) @ net.weights[quality.FILTERS :] + net.bias
    return 1 / (1 + np.exp(-logit))


def test_byte_network_against_plain_loops_and_differences():
    net = quality._initial(np.random.default_rng(1), 0.2)
    rng = np.random.default_rng(2)
    texts = [b"", b"short", bytes(rng.integers(97, 123, 700).astype(np.uint8)), bytes(rng.integers(97, 123, 2600).astype(np.uint8))]
    assert np.allclose(net.score(texts), [_plain_score(net, t) for t in texts], atol=1e-5)
    # the last bytes of a long text count
    long = b"a" * 40_000
    assert net.score([long])[0] != net.score([long[:-8] + b"ZQ(x9~Z7"])[0]
    # and a text's score does not depend on those beside it
    assert np.allclose(net.score([long, b"Z" * 600, b"a"]), [net.score([t])[0] for t in (long, b"Z" * 600, b"a")], atol=1e-6)
    y = np.asarray([0.0, 1.0, 1.0, 0.0])
    net = quality.ByteNetwork(*(p.astype(float) for p in (net.embed, net.near, net.far, net.shift, net.weights)), net.bias)
    net.shift[:] = rng.normal(0, 0.1, quality.FILTERS)  # at zero the rectifier has a kink, where positions without bytes lie
    loss = lambda: float(-np.mean(np.where(y == 1, np.log(net.score(texts)), np.log(1 - net.score(texts)))))
    grads, bias = quality._gradient(net, texts, y)
    for p, g in zip((net.near, net.far, net.shift, net.weights), grads[1:]):
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), tuple(0 for _ in g.shape)]:
            old, step = p[at], 1e-6
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_factorization_logits_against_a_double_loop():
    rng = np.random.default_rng(3)
    fm = toxicity.FactorizationMachine(0.3, np.arange(30), rng.normal(size=30), rng.normal(size=(30, toxicity.FACTORS)))
    docs = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 5, 12)]
    flat = np.asarray([t for d in docs for t in d]), np.repeat(np.arange(4), [len(d) for d in docs])
    plain = [0.3 + sum(fm.weights[t] for t in d) + sum(float(fm.factors[a] @ fm.factors[b]) for k, a in enumerate(d) for b in d[:k]) for d in docs]
    assert np.allclose(fm.logits(flat[1], flat[0], 4), plain)


def test_classifiers_read_the_end_of_a_long_text(spark):
    words = ["filler"] * 30_000
    rows = [(i, ("good day " if i % 2 else "vile scum ") * 3) for i in range(1, 200)]
    docs = spark.createDataFrame([*rows, (1000, " ".join([*words, "vile scum"])), (1001, " ".join([*words, "good day"]))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, toxic int")
    score = {r.id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).filter(F.col("id") >= 1000).collect()}
    assert score[1000] > score[1001]


def test_fitted_samples_are_bounded(spark):
    from sparkruns.llm import common

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x" * (common.FIT_BYTES + 1)), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (4, 1)], "doc_id long, toxic int")
    out = {r.i: (r.text, r.y) for r in common.labelled_sample(docs, labels, "toxic", 10).collect()}
    fold = {i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5}
    assert out == {i: v for i, v in {1: ("text 0", 1), 3: (None, 0), 4: ("d", 1)}.items() if i in fold}
