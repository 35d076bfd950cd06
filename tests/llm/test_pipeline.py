"""The pipeline's stages on their own inputs, against brute force on the smallest tables, and its odd cases."""

import hashlib
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sparkruns.llm.common import materialize  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def _texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "suffix_dedup", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = _texts(stages[0]), _texts(stages[1])
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.97 * len(clean)
    toxic = [i for i in before if labels.get(i) == 1]
    assert toxic and sum(i not in after for i in toxic) >= 0.7 * len(toxic)


def test_exact_copies_go(stages):
    before, after = _texts(stages[1]), _texts(stages[2])
    best = {}
    for i, t in before.items():
        h = hashlib.sha256(t.translate(LOWER).encode()).digest()
        best[h] = max(best.get(h, i), i)
    assert set(after) == set(best.values())


def test_near_copies_go(stages):
    before, after = _texts(stages[2]), _texts(stages[3])
    sets = {}
    for i, t in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b]) if a < b else 0
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {i for i in ids if find(i) == i}


def test_repeated_passages_are_cut(stages):
    before, after = _texts(stages[3]), _texts(stages[4])
    width = corpus_pipeline.PASSAGE_BYTES
    least = {}
    for i, t in before.items():
        b = t.encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            least[w] = min(least.get(w, i), i)
    assert set(after) == set(before)
    for i, t in before.items():
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < i:
                gone[p : p + width] = b"\x01" * width
        left = bytes(x for x, g in zip(b, gone) if not g)
        # whole characters stay, so that a cut may leave up to three bytes more at each end
        assert after[i].encode() == left if not any(c >= 128 for c in b) else len(left) <= len(after[i].encode()) <= len(left) + 6 * gone.count(1)
        if not any(gone):
            assert after[i] == t


def test_all_that_stays_is_packed(stages):
    packed = Counter()
    for r in stages[5].collect():
        packed[r.doc_id] += r.length
    assert set(packed) == set(_texts(stages[4]))


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()


NAMES = ["id", "hash", "kept", "digest", "row_number", "block", "data", "key", "component", "locator", "__kept", "__id", "__hash", "__dropped", "row", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    word = lambda i: f"word{i * 7919 % 1000}"
    base = " ".join(word(i) for i in range(200))
    passage = " ".join(word(i) for i in range(300, 380))
    rows = [(1, None), (2, ""), (3, " "), (None, base), (4, base.upper()), (4, base.upper()), (5, base + " more"), (6, "own words " + " ".join(word(i) for i in range(400, 470)) + " " + passage), (7, passage + " at the end of others " + " ".join(word(i) for i in range(500, 570))), (8, " ".join(word(i * i) for i in range(40_000))), (9, "x"), (9, "another text")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *NAMES) for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "ngram_join", "suffix_dedup"])
def test_stages_on_odd_rows(spark, odd, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf_dir)
    assert out.columns == odd.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    given = Counter((r.doc_id, r.text) for r in odd.collect())
    assert all([r[n] for n in NAMES] == NAMES for r in out.select(*NAMES).collect())
    base = next(t for i, t in given if i is None)
    if name == "toxicity":
        assert got == given
    if name == "exact_dedup":  # empty texts, and a text in lower and upper case
        assert got == given - Counter({(1, None): 1, (None, base): 1, (4, base.upper()): 1})
    if name == "ngram_join":  # the null identifier is the smallest; of identifier 9 no text is linked
        assert got == given - Counter({(4, base.upper()): 2, (5, base + " more"): 1})
    if name == "suffix_dedup":
        texts = {i: t for i, t in got}
        assert sum(got.values()) == sum(given.values()) and texts[1] is None and texts[2] == "" and "own words" in texts[6]
        assert texts[7].startswith(" at the end")
        assert all(r.n_chars == len(r.text or "") for r in out.filter("text is not null").collect())
    nothing = stage(spark, odd.limit(0), sf_dir)
    assert nothing.columns == odd.columns and nothing.count() == 0


def test_packing_of_odd_rows(spark, odd, sf_dir):
    packed = corpus_pipeline.packing(spark, odd, sf_dir)
    ends = Counter((r.doc_id, r.doc_tokens) for r in packed.collect() if r.start + r.length == r.doc_tokens)
    assert sum(ends.values()) == odd.count() and ends[1, 1] == ends[2, 1] == 1
    assert corpus_pipeline.packing(spark, odd.limit(0), sf_dir).count() == 0


def test_shared_passages_of_51_short_words_are_cut(spark, sf_dir):
    """The shortest passage of over fifty words: one letter each."""
    passage = " ".join("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyabc"[:51])
    rows = [(1, f"first {passage} one"), (2, f"second {passage} two"), (3, "a clean text of its own")]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    assert out == {1: rows[0][1], 2: "secondtwo", 3: rows[2][1]}
