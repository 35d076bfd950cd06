"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: words (A-Z lower-cased, ASCII
punctuation divides them) and, for inflected forms, the first bytes of longer
words. The score is the logistic function of a bias, a weight for each
term and the inner products of the factors of each pair of terms, so that pairs
count that an additive model misses. It is fitted on a bounded sample of
labelled rows outside the held-out fold; every document is scored on its whole
text.

Defined results: null or empty text scores as a document without terms (the
bias alone); repeated rows score alike; without labelled rows of both classes
the model is the constant of the labels there are, or 0.5 without any; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TERMS, forget, held_out, labelled_sample, session_of, text_blocks, text_column, word_hashes
from .meeting import give_back

BITS = 20
#: Lengths in bytes of the word beginnings that are terms.
PREFIXES = (4, 6)
#: Bound on the labelled rows that are fitted.
SAMPLE_ROWS = 8_000
FACTORS = 4
#: Documents of a term at which its factors take half of their longest steps, and the deviations from
#: independence of the label at which its weight takes whole ones.
KNOWN_DOCUMENTS = 200
CLEAR = 5.0
THRESHOLD = 0.5


def term_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hashed term) pairs, ordered."""
    docs, buckets = [], []
    for lo, hi in text_blocks(texts):
        h, of = word_hashes(texts[lo:hi], TERMS, PREFIXES)
        pair = np.unique((of.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
        docs.append((pair >> BITS) + lo)
        buckets.append(pair & ((1 << BITS) - 1))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(docs), join(buckets)


@dataclass
class FactorizationMachine:
    bias: float
    terms: np.ndarray  # sorted hashed terms
    weights: np.ndarray
    factors: np.ndarray  # (terms, FACTORS)

    def logits(self, docs: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """docs, term: (document, place of the term in ``terms``) pairs."""
        z = self.bias + np.bincount(docs, self.weights[term], n)
        for v in self.factors.T:
            z += 0.5 * (np.bincount(docs, v[term], n) ** 2 - np.bincount(docs, v[term] ** 2, n))
        return z

    def places(self) -> np.ndarray:
        """Of each hashed term its place in ``terms``, or -1."""
        place = np.full(1 << BITS, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        return place

    def score(self, texts: list[bytes], place: np.ndarray | None = None) -> np.ndarray:
        docs, buckets = term_buckets(texts)
        term = (self.places() if place is None else place)[buckets]
        known = term >= 0
        return 1 / (1 + np.exp(-np.clip(self.logits(docs[known], term[known], len(texts)), -30, 30)))


def fit(docs: np.ndarray, buckets: np.ndarray, y: np.ndarray, epochs: int = 25, rate: float = 0.05, l2: float = 1e-4, l2_factors: float = 0.03, seed: int = 11) -> FactorizationMachine:
    """Adam on mini-batches of documents; a batch updates the terms that it holds.

    Every term seen has a weight and factors. What is known of a term sets the
    length of its steps, not whether it takes part: that of the weight grows with
    its correlation with the label or its documents, that of the factors with its
    documents alone, so that pairs of terms without a correlation are learned.
    """
    n, positive = len(y), float(y.sum())
    share = min(max((positive + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    none = FactorizationMachine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < positive < n or not len(buckets):
        return none
    terms, term, df = np.unique(buckets, return_inverse=True, return_counts=True)
    hits = np.bincount(term, y[docs])
    z = np.abs(hits - df * share) / np.sqrt(df * share * (1 - share) + 1)
    known = df / (df + KNOWN_DOCUMENTS)
    pace = np.empty((len(terms), 1 + FACTORS))
    pace[:, 0] = np.maximum(np.minimum(z / CLEAR, 1) ** 3, 0.02 * known)
    pace[:, 1:] = 0.5 * known[:, None]
    decay = np.array([l2] + [l2_factors] * FACTORS)
    start = np.searchsorted(docs, np.arange(n + 1))
    sums = lambda of, x, size: np.stack([np.bincount(of, c, size) for c in x.T], 1)

    rng = np.random.default_rng(seed)
    theta = np.zeros((len(terms), 1 + FACTORS))
    theta[:, 1:] = rng.normal(0, 0.01, (len(terms), FACTORS))
    m, v, mb, vb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    held, place = np.zeros(len(terms), bool), np.zeros(len(terms), np.int64)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            length = start[batch + 1] - start[batch]
            d = np.repeat(np.arange(len(batch)), length)
            t = term[np.repeat(start[batch] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())]
            held[t] = True
            some = np.flatnonzero(held)
            held[some] = False
            place[some] = np.arange(len(some))
            t, x = place[t], theta[some]
            fm = FactorizationMachine(bias, some, x[:, 0], x[:, 1:])
            err = 1 / (1 + np.exp(-np.clip(fm.logits(d, t, len(batch)), -30, 30))) - y[batch]
            e, of = x[t, 1:], err[d]
            total = sums(d, e, len(batch))
            g = np.concatenate([np.bincount(t, of, len(some))[:, None], sums(t, of[:, None] * (total[d] - e), len(some))], 1)
            g = g / len(batch) + decay * x
            gb, step = float(err.mean()), step + 1
            m[some], v[some] = 0.9 * m[some] + 0.1 * g, 0.999 * v[some] + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            a, b = 1 - 0.9**step, 1 - 0.999**step
            theta[some] = x - rate * pace[some] * (m[some] / a) / (np.sqrt(v[some] / b) + 1e-8)
            bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return FactorizationMachine(bias, terms, theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Terms are hashed on the executors; the driver gets those of at most ``rows`` documents."""

    def hashed(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            of, buckets = term_buckets(texts)
            cut = np.searchsorted(of, np.arange(1, len(texts)))
            packed = [x.astype(np.int32).tobytes() for x in np.split(buckets, cut)] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(packed, pa.binary()), batch.column("y")], ["i", "terms", "y"])

    sample = labelled_sample(docs, labels, label, rows, id_col, text_col).mapInArrow(hashed, "i long, terms binary, y int").toPandas()
    # copies of a text would count a label many times over
    sample = sample.sort_values(["i", "y"]).drop_duplicates(["terms", "y"])
    packed = [np.frombuffer(x, np.int32) for x in sample["terms"]]
    of = np.repeat(np.arange(len(packed)), [len(x) for x in packed]) if packed else np.zeros(0, np.int64)
    buckets = np.concatenate(packed).astype(np.int64) if packed else np.zeros(0, np.int64)
    return fit(of, buckets, (sample["y"].to_numpy() > 0).astype(float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = session_of(docs).sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            score = shared.value.score(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], ["id", "score"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(scored, "id long, score double")


#: Rows of an Arrow batch that become Python values at once, and bytes of their texts that are scored at once.
ROWS_AT_ONCE = 512
BLOCK = 1 << 20


def scored_parts(model: FactorizationMachine, batch: pa.RecordBatch, column: int):
    """(rows, their scores) for consecutive parts of a batch, so that memory does not follow the batch."""
    places = model.places()
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        rows = batch.slice(at, ROWS_AT_ONCE)
        texts = [x or b"" for x in rows.column(column).cast(pa.binary()).to_pylist()]
        for lo, hi in text_blocks(texts, BLOCK):
            yield rows.slice(lo, hi - lo), model.score(texts[lo:hi], places)


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    shared = session_of(docs).sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def kept(batches):
        forget()
        for batch in batches:
            for part, score in scored_parts(shared.value, batch, place):
                yield part.filter(pa.array(score < threshold))
        give_back()

    return docs.mapInArrow(kept, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs, fit_toxicity(docs, labels))
    return scores.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
