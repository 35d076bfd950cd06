"""Words one edit apart, by FM-index search schemes over a vocabulary dealt by halves.

Two words one insertion, deletion or replacement apart agree in one whole half
of the asked word: its first half begins the other word, or its second half
ends it. The search schemes match either half exactly and extend across the
other, allowing one error. Words are delimited, so that a half always starts
at a delimiter and an extension ends at one.

Words are dealt to buckets by halves: an asked word goes to the bucket of its
first half and to that of its second, an indexed word to the buckets of all
halves that words of its length and one more or less can share with it. Each
bucket indexes its words read away from the exact half; so the two directions
of the index lie in buckets of their own, and neither ever turns. An index is
a suffix array with its last column; a search state is an interval of suffix
ranks, and an interval of whole delimited words is a word. A half that more
words share than a bucket holds has its words and its askers dealt over a grid
of buckets.

Defined results: null and empty texts have no words, very long texts and words
count whole; a null identifier counts as the empty text; repeated rows count
each; of near words of one count the smallest in code-point order is the form;
an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, materialize, partitions, scratch_scope, session_of

#: Fewest code points and occurrences of a word.
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Words that a bucket indexes (and as many askers), and askers searched at once.
BUCKET_WORDS = 1 << 15
ASKED_AT_ONCE = 1 << 13


def suffix_array(text: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling, from ranks of their first symbols."""
    n, step = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = ranks[step:] + 1 if step < n else 0
        key = ranks * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.append(0, key[1:] != key[:-1]))
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class Index:
    """FM-index of delimited words; a search extends words from their first letter on.

    The text is each word backwards behind a delimiter, so that extending a pattern to the left reads words
    forwards. ``at`` holds (symbol, place) of the last column in order: ranks are found in it by bisection, and a
    place in it is that of the extended interval.
    """

    def __init__(self, words: list[str]):
        backwards = sorted(w[::-1] for w in words)
        self.words = [w[::-1] for w in backwards]
        letters = np.frombuffer("".join(backwards).encode("utf-32-le"), np.uint32)
        self.letters, numbers = np.unique(letters, return_inverse=True)
        lengths = np.fromiter(map(len, backwards), np.int64, len(backwards))
        delimiters = np.append(np.cumsum(lengths + 1) - (lengths + 1), int(lengths.sum()) + len(words))
        text = np.zeros(int(lengths.sum()) + len(words) + 1, np.int64)
        inner = np.ones(len(text), bool)
        inner[delimiters] = False
        text[inner] = numbers.reshape(-1) + 1
        # delimiters sort as their words do, which stand in order; the last one, with no word behind it, comes first
        ranks = text + len(delimiters)
        ranks[delimiters] = np.append(np.arange(1, len(delimiters)), 0)
        order = suffix_array(text, ranks)
        self.last = text[order - 1]
        self.n = len(text)
        places = np.argsort(self.last, kind="stable")
        self.at = self.last[places] * self.n + places

    def symbols(self, words: list[str]) -> np.ndarray:
        """Words as rows of symbol numbers, with a delimiter behind; -1 for letters that the index has not."""
        longest = max(map(len, words))
        codes = np.frombuffer("".join(w.ljust(longest + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        found = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        known = self.letters[found] == codes if len(self.letters) else np.zeros(codes.shape, bool)
        return np.where(codes == 0, 0, np.where(known, found + 1, -1))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals extended by a symbol each; empty where nothing goes on so."""
        base = symbol * self.n
        low, high = np.searchsorted(self.at, base + low), np.searchsorted(self.at, base + high)
        return low, np.where(symbol < 0, low, high)

    def every(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, low, high) of each letter that extends each interval."""
        size = high - low
        state = np.repeat(np.arange(len(low)), size)
        rows = np.repeat(low, size) + np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size)
        width = len(self.letters) + 1
        key, count = np.unique(state * width + self.last[rows], return_counts=True)
        state, symbol = key // width, key % width
        keep = symbol > 0
        state, symbol, count = state[keep], symbol[keep], count[keep]
        start = np.searchsorted(self.at, symbol * self.n + low[state])
        return state, symbol, start, start + count

    def near(self, asked: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, word) of all words one error from an asked one that begin with its first ``exact`` letters."""
        pattern = self.symbols(asked)
        size = np.fromiter(map(len, asked), np.int64, len(asked))
        one = np.arange(len(asked))  # states without an error
        one_low, one_high = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.words) + 1)
        none = np.zeros(0, np.int64)
        err, err_low, err_high = none, none, none  # states with one error, at the same letter
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(pattern.shape[1]):
            later, later_low, later_high = none, none, none
            branch = (i >= exact[one]) & (i <= size[one])
            if branch.any():
                q, low, high = one[branch], one_low[branch], one_high[branch]
                # askers that share an interval share its letters
                _, pick, same = np.unique(low * (self.n + 1) + high, return_index=True, return_inverse=True)
                state, symbol, to_low, to_high = self.every(low[pick], high[pick])
                first = np.searchsorted(state, np.arange(len(pick) + 1))
                n = (first[1:] - first[:-1])[same.reshape(-1)]
                who = np.repeat(np.arange(len(q)), n)
                child = np.repeat(first[:-1][same.reshape(-1)], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                inside = i < size[q]
                replaced = inside[who] & (symbol[child] != pattern[q[who], i])
                # a letter more: the asked letter is still to come; a letter for another; a letter less
                err = np.concatenate([err, q[who]])
                err_low, err_high = np.concatenate([err_low, to_low[child]]), np.concatenate([err_high, to_high[child]])
                later = np.concatenate([q[who[replaced]], q[inside]])
                later_low = np.concatenate([to_low[child[replaced]], low[inside]])
                later_high = np.concatenate([to_high[child[replaced]], high[inside]])
            letter = pattern[:, i]
            err_low, err_high = self.extend(letter[err], err_low, err_high)
            alive = err_low < err_high
            done = alive & (i == size[err])
            # delimiters with a word behind them are rows 1 and up, in the order of the words; row 0 has none
            word = done & (err_low > 0)
            found.append((err[word], err_low[word] - 1))
            alive &= ~done
            err, err_low, err_high = np.concatenate([err[alive], later]), np.concatenate([err_low[alive], later_low]), np.concatenate([err_high[alive], later_high])
            one_low, one_high = self.extend(letter[one], one_low, one_high)
            alive = (one_low < one_high) & (i < size[one])
            one, one_low, one_high = one[alive], one_low[alive], one_high[alive]
        pairs = np.unique(np.concatenate([a * len(self.words) + w for a, w in found])) if found else none
        return pairs // max(len(self.words), 1), pairs % max(len(self.words), 1)


_ANSWER = "word string, n_near long, best_n long, best string"


def _answered(table: pa.Table) -> pa.Table:
    """Of each asked word of a bucket: its near words there, how many they are, and the one of the largest count."""
    word, n, asked, back = (table.column(c).to_pylist() for c in ("word", "n", "asked", "back"))
    side = bool(back[0])
    count = {w: k for w, k, a in zip(word, n, asked, strict=True) if not a}
    askers = [w for w, a in zip(word, asked, strict=True) if a]
    columns: list[list] = [[], [], [], []]
    if count and askers:
        index = Index([w[::-1] for w in count] if side else list(count))
        names = [w[::-1] for w in index.words] if side else index.words
        counts = np.asarray([count[w] for w in names], np.int64)
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        askers.sort(key=len)
        for at in range(0, len(askers), ASKED_AT_ONCE):
            some = askers[at : at + ASKED_AT_ONCE]
            first = np.asarray([len(w) // 2 for w in some], np.int64)
            who, near = index.near([w[::-1] for w in some] if side else some, np.asarray([len(w) - len(w) // 2 for w in some]) if side else first)
            if side:  # what begins with the first half is found from there
                keep = np.fromiter((not names[b].startswith(some[a][: len(some[a]) // 2]) for a, b in zip(who.tolist(), near.tolist(), strict=True)), bool, len(who))
                who, near = who[keep], near[keep]
            best = np.lexsort((order[near], -counts[near], who))
            who, near = who[best], near[best]
            start = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
            columns[0] += [some[a] for a in who[start].tolist()]
            columns[1] += np.diff(np.append(start, len(who))).tolist()
            columns[2] += counts[near[start]].tolist()
            columns[3] += [names[b] for b in near[start].tolist()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the distinct words (word, n) that have near ones."""
    spark = session_of(vocabulary)
    size = F.length("word")
    back = F.reverse("word")
    half, rest = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")

    def key(side: int, text: Column, length: Column) -> Column:
        return F.struct(F.lit(side).alias("back"), F.substring(text, F.lit(1), length).alias("half"))

    # halves of words one shorter, as long, and one longer
    halves = [F.floor((size + d) / 2).cast("int") for d in (-1, 1)] + [F.floor(size / 2).cast("int") + d for d in (0, 1)]
    indexed = F.array(key(0, F.col("word"), halves[0]), key(0, F.col("word"), halves[1]), key(1, back, halves[2]), key(1, back, halves[3]))
    asks = F.array(key(0, F.col("word"), half), key(1, back, rest))
    rows = vocabulary.select("word", "n", F.explode(indexed).alias("key"), F.lit(False).alias("asked")).unionByName(vocabulary.select("word", "n", F.explode(asks).alias("key"), F.lit(True).alias("asked")))
    # halves that more words share than a bucket holds; they are few
    held = vocabulary.select(F.explode(indexed).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("words"))
    hot = held.filter(F.col("words") > bucket_words).select("key", F.ceil(F.col("words") / bucket_words).cast("int").alias("parts"))
    buckets = max(partitions(spark), -(-4 * vocabulary.count() // bucket_words))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")
    mine = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(hot, "key", "left").select("word", "n", "asked", "key", "parts", mine.alias("mine"), other)
    cell = F.when(F.col("asked"), F.struct(F.col("other").cast("long").alias("i"), F.col("mine").alias("j"))).otherwise(F.struct(F.col("mine").alias("i"), F.col("other").cast("long").alias("j")))
    bucket = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.xxhash64("key", cell))
    dealt = dealt.select("word", "n", "asked", F.col("key.back").alias("back"), bucket.alias("bucket"))
    found = dealt.repartition(buckets, "bucket", "back").groupBy("bucket", "back").applyInArrow(_answered, _ANSWER)
    best = F.min(F.struct((-F.col("best_n")).alias("neg"), F.col("best").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.neg")).alias("best_n"), F.col("best.form").alias("best"))


def lowered(text: Column) -> Column:
    """A-Z lower-cased; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def variant_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of the texts, some of which lose a letter as the hash of document and word says."""
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered(docs[text_col]), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= least_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = runs.select(F.when(h % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def spelling_groups(vocabulary: DataFrame, ratio: int = 2, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word's form is its near word of the largest count, if ``ratio`` times its own.

    A form counts at least ``ratio`` times its word, so a chain of forms is short: paths are halved as often as its
    longest possible length asks for.
    """
    vocabulary = materialize(vocabulary, "vocabulary")
    near = near_words(vocabulary, bucket_words)
    fits = F.col("best_n") >= ratio * F.col("n")
    words = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    )
    words = materialize(words, "spelling-forms")
    steps, most = 0, words.agg(F.max("n")).first()[0] or 1
    while ratio**steps < most:
        steps += 1
    roots = words.filter("form is not null").select("word", F.col("form").alias("up"))
    for _ in range(steps.bit_length()):
        above = roots.select(F.col("word").alias("up"), F.col("up").alias("higher"))
        roots = materialize(roots.join(above, "up", "left").select("word", F.coalesce("higher", "up").alias("up")), "spelling-roots")
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with their near words, forms and roots; odd rows as the module says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_scope(spark):
        return materialize(spelling_groups(variant_counts(docs)), "spelling-groups", outer=True)


OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM counted),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM words GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
cuts AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS p FROM v),
keys AS (SELECT DISTINCT word, n, CASE WHEN p = length(word) THEN word ELSE substr(word, 1, p) || substr(word, p + 2) END AS key, p = length(word) AS whole, CASE WHEN p = length(word) THEN -1 ELSE p END AS p FROM cuts),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b USING (key) WHERE a.word <> b.word AND (a.whole <> b.whole OR (NOT a.whole AND NOT b.whole AND a.p = b.p))),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
climb AS (SELECT word, word AS cur FROM forms UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON f.word = c.cur WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.cur AS root FROM climb c JOIN forms f ON f.word = c.cur WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
