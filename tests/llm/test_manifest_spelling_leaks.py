"""Merkle manifests, spelling variants and decontamination against plain loops, with the odd cases of their docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkruns.llm import decontaminate, merkle, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels, p):
    out = []
    for level in levels[:-1]:
        if p ^ 1 < len(level):
            out.append(level[p ^ 1])
        p >>= 1
    return out


# Merkle manifests


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(t, i, _h(t, str(i))) for t, n in (("0", 1), ("1", 2), ("1a", 77), ("1b", 256), ("1c", 3), ("1é", 130)) for i in range(n)]
    rows += [("1a", 5, _h("1a", "5")), ("1a", None, _h("none"))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, "x") for r in rows], "tree string, id long, leaf string, chunk string").repartition(7)


def _expected(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r.tree].append((r.id is not None, r.id or 0, r.leaf))
    of = {t: _levels([x[2] for x in sorted(v)]) for t, v in trees.items()}
    names = sorted(of)
    top = _levels([of[t][-1][0] for t in names])
    return {(t, p): (level[0][p], level[-1][0], top[-1][0], _siblings(level, p) + _siblings(top, names.index(t))) for t, level in of.items() for p in range(len(level[0]))}


@pytest.mark.parametrize("chunk_bits,step_bits", [(13, 12), (3, 2), (2, 1)])
def test_manifest_in_chunks_and_levels(leaves, chunk_bits, step_bits):
    expected = _expected(leaves.collect())
    out = merkle.manifest_of(leaves.select("tree", "id", "leaf"), ["id", "leaf"], "id long, leaf string", chunk_bits, step_bits).collect()
    got = {(r.tree, r.position): (r.leaf, r.subroot, r.root, [bytes(r.siblings)[i : i + 64].decode() for i in range(0, len(r.siblings), 64)]) for r in out}
    assert got == expected and len(out) == len(expected)
    assert all(r.folded == r.root for r in out)


def test_later_rows_extend_witnesses(spark, leaves):
    """Rows appended behind give the manifest of all rows at once; a replaced leaf does not fold to the root."""
    rows = leaves.filter("id is not null").dropDuplicates(["tree", "id"]).select("tree", "id", "leaf", F.when(F.col("id") % 5 == 0, F.lit(_h("forged"))).alias("other"))
    payload = "id long, leaf string, other string"
    first = merkle.append(rows.filter("id < 100"), ["id"], chunk_bits=3)
    second = merkle.manifest_of(rows.filter("id >= 100"), ["id"], payload, 3, 2, first)
    whole = merkle.manifest_of(rows, ["id"], payload, 4, 3)
    columns = ["tree", "id", "position", "total", "subroot", "root", "siblings", "folded"]
    a, b = ({tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in t.select(*columns).collect()} for t in (second, whole))
    assert a == b and len(a) == rows.count()
    for r in whole.collect():
        assert (r.folded == r.root) == (r.other is None)


def test_manifest_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "tree string, id long, leaf string")
    assert merkle.manifest_of(empty, ["id"], "id long, leaf string").count() == 0


def test_leaf_digests_tell_null_from_text(spark):
    out = spark.createDataFrame([(1, None, "é"), (1, "-", "é"), (None, "", None)], "a long, b string, c string").select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c")).alias("d")).collect()
    assert [r.d for r in out] == [_h("1:1-2:é"), _h("1:11:-2:é"), _h("-0:-")]


# spelling variants


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and _one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@pytest.mark.parametrize("bucket_words", [1 << 15, 40])
def test_spelling_groups_against_all_pairs(spark, bucket_words):
    """Dense words over few letters, with one half that most share, long words, letters beyond ASCII; also by a grid of small buckets."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(300)}
    words |= {"abab" + "".join(rng.choice("abcdÿ") for _ in range(rng.randint(1, 4))) for _ in range(150)}
    words |= {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1500, "zzzzz", "b" * 17 + "ñ"}
    counts = {w: 3 * 2 ** rng.randint(0, 12) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    out = spelling.spelling_groups(table, bucket_words=bucket_words).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == _groups(counts) and len(out) == len(counts)


def test_index_finds_what_begins_with_the_exact_part():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(200)})
    index = spelling.Index(words)
    asked = [*words[:60], "abcz", "zabc", "aaaaaaaaaa"]
    who, found = index.near(asked, np.asarray([len(w) // 2 for w in asked]))
    got = {(asked[a], index.words[b]) for a, b in zip(who, found)}
    assert got == {(a, b) for a in asked for b in words if b.startswith(a[: len(a) // 2]) and _one_apart(a, b)}


def test_words_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Wörter WÖRTER wÖrter"), (3, "abcde-abcde ABCDE"), (3, "abcde×abcde"), (4, "ab cde 12345 abcdéābcde" * 200)] * 3
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    expected = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    out = {r.word: r.n for r in spelling.variant_counts(docs).collect()}
    assert out == {w: n for w, n in expected.items() if n >= 3 and len(w) >= 5}
    assert spelling.spelling_groups(spelling.variant_counts(docs.limit(0))).count() == 0


# decontamination


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _leaks(docs, bench, window=10):
    windows = defaultdict(set)
    for name, text in bench:
        w = _words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str("" if name is None else name))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, items = _words(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    items |= found
                    hit |= set(range(p, p + n))
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return Counter(out)


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé1") for _ in range(rng.randint(1, 3)))
    bench = [(i, " ".join(word() for _ in range(rng.randint(10, 90)))) for i in range(30)]
    bench += [(30, "Only three words"), (31, "one"), (32, None), (33, ""), (34, "?!"), (None, bench[3][1]), (3, "another row of item three with more than ten words in it"), (35, bench[4][1][10:] + " tail"), (36, "a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, "ONE!"), (4, "one " * 500), (5, "only, three; words only three"), (None, bench[0][1]), (None, bench[0][1]), (7, "a " * 5000), (8, "a " * 9)]
    for i in range(10, 120):
        own = [word() for _ in range(rng.randint(0, 60))]
        w = _words(rng.choice(bench[:30])[1])
        a = rng.randrange(len(w))
        own[rng.randint(0, len(own)) : 0] = w[a : a + rng.randint(1, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(own).upper()))
    docs += [(200, " ".join(word() for _ in range(60_000)) + " " + bench[7][1] + " end")]
    return docs, bench


@pytest.mark.parametrize("part_bytes", [1 << 24, 400])
def test_contamination_against_plain_windows(spark, leaky, part_bytes):
    """One part of the benchmark, and many that hand their finds on."""
    docs, bench = leaky
    rows = spark.createDataFrame([(i, t, "f", 1) for i, t in docs], "doc_id long, text string, found string, n_hit int").repartition(4)
    items = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, id string")
    out = decontaminate.contamination(rows, items, part_bytes=part_bytes).collect()
    assert Counter((r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == _leaks(docs, bench)
    assert all(sum(z - a for a, z in zip(r.runs[0::2], r.runs[1::2])) == r.n_hit for r in out)


def test_drop_contaminated_hands_columns_through(spark, leaky):
    docs, bench = leaky
    rows = spark.createDataFrame([(i, t, "f", 1) for i, t in docs], "doc_id long, text string, found string, n_hit int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    out = decontaminate.drop_contaminated(rows, items)
    assert out.columns == rows.columns
    clean = Counter((i, t) for i, t in docs for leaks in [_leaks([(i, t)], bench)] if not next(iter(leaks))[3])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == clean
    assert decontaminate.drop_contaminated(rows, items.limit(0)).count() == len(docs)
    assert decontaminate.contamination(rows.limit(0), items).count() == 0


def test_longest_matches_and_places(spark, leaky):
    docs, bench = leaky
    docs = [(i, t) for i, t in docs if i is not None]
    out = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench[:31], "item_id long, text string")).collect()
    words = {i: _words(t) for i, t in docs}
    at = defaultdict(list)
    for i, w in words.items():
        for p in range(len(w) - 9):
            at[tuple(w[p : p + 10])].append((i, p))
    expected = {}
    for name, text in bench[:31]:
        w = _words(text)
        for o in range(len(w) - 9):
            for i, p in at[tuple(w[o : o + 10])]:
                n = 10
                while o + n < len(w) and p + n < len(words[i]) and w[o + n] == words[i][p + n]:
                    n += 1
                expected[str(name), o] = max(expected.get((str(name), o), 0), n)
    assert {(r["item"], r.item_word): r.length for r in out} == expected
    for r in out:
        assert words[r.id][r.word : r.word + r.length] == _words(bench[int(r["item"])][1])[r.item_word : r.item_word + r.length]


def test_words_that_only_share_a_hash_are_no_hit(spark, monkeypatch):
    """With hashes of a few bits, bytes still decide."""
    plain = decontaminate.Words.__init__

    def clash(self, texts, salt=0):
        plain(self, texts, salt)
        self.hash = (self.hash % np.uint64(1009)) + np.uint64(salt << 40)
        if salt:
            self.hash = self.hash * np.uint64(0) + (np.frombuffer(b"".join(hashlib.md5(self.raw[a:z] + bytes([salt])).digest()[:2] for a, z in zip(self.start, self.stop)), np.uint16).astype(np.uint64))

    monkeypatch.setattr(decontaminate.Words, "__init__", clash)
    rng = random.Random(2)
    text = lambda n: " ".join(str(rng.randrange(10_000)) for _ in range(n))
    item = text(15)
    bench = decontaminate.Benchmark(["1"], [item.encode()])
    docs = [text(3000) for _ in range(5)] + [text(40) + " " + item + " " + text(40)]
    got = decontaminate._judged([d.encode() for d in docs], bench, None)
    assert [len(g["items"]) for g in got] == [0, 0, 0, 0, 0, 1] and got[5]["runs"] == [40, 55]
