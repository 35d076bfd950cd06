"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes run every four bytes; the
rectified responses are max-pooled over overlapping chunks of a kilobyte that
cover the whole document; the mean and the maximum of the chunks are combined
into one probability. It is fitted by Adam on a bounded sample of labelled rows
outside the held-out fold and scores every document on its whole text.

Defined results: null or empty text scores as one chunk without bytes; repeated
rows score alike; without labelled rows of both classes the model is the
constant of the labels there are, or 0.5 without any; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, session_of, text_blocks, text_column

#: Bound on the labelled rows that are fitted; their texts are bounded by common.FIT_BYTES each.
SAMPLE_ROWS = 4_000
THRESHOLD = 0.3
STRIDE = 4
EMBED = 6
FILTERS = 24
#: Half a chunk in bytes; chunks overlap by that much.
HOP = 512
_POSITIONS = HOP // STRIDE


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded by zeros to whole hops (two at least), with their numbers of hops."""
    hops = np.fromiter((max(2, -(-len(t) // HOP)) for t in texts), np.int64, len(texts))
    flat = np.zeros(int(hops.sum()) * HOP + STRIDE, np.uint8)
    at = (np.cumsum(hops) - hops) * HOP
    for a, t in zip(at.tolist(), texts, strict=True):
        flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
    return flat, hops


@dataclass
class ByteNetwork:
    embed: np.ndarray  # (256, EMBED); byte 0 stays zero
    near: np.ndarray  # (STRIDE * EMBED, FILTERS): the first half of a filter
    far: np.ndarray  # and the second
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): mean, then maximum of the chunks
    bias: float

    def responses(self, flat: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses before rectifying, (hops, positions, filters), and the embedded input."""
        x = self.embed[flat].reshape(-1, STRIDE * EMBED)
        z = x[:-1] @ self.near
        z += x[1:] @ self.far
        last = np.cumsum(hops) * _POSITIONS - 1  # the next text is no part of a text's last position
        z[last] -= x[last + 1] @ self.far
        z += self.shift
        return z.reshape(-1, _POSITIONS, FILTERS), x

    @staticmethod
    def chunks(hop: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of neighbouring hops of a document, and the document of each chunk."""
        last = np.cumsum(hops) - 1
        inside = np.ones(len(hop), bool)
        inside[last] = False
        first = np.flatnonzero(inside)
        return first, np.repeat(np.arange(len(hops)), hops - 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in text_blocks(texts, 1 << 19):
            flat, hops = _layout(texts[lo:hi])
            z, _ = self.responses(flat, hops)
            hop = np.maximum(z.max(1), 0)
            first, _ = self.chunks(hop, hops)
            chunk = np.maximum(hop[first], hop[first + 1])
            start = np.cumsum(hops - 1) - (hops - 1)
            mean = np.add.reduceat(chunk, start) / (hops - 1)[:, None]
            most = np.maximum.reduceat(chunk, start)
            logit = mean @ self.weights[:FILTERS] + most @ self.weights[FILTERS:] + self.bias
            out.append(1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30))))
        return np.concatenate(out)


def _initial(rng, bias: float) -> ByteNetwork:
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    embed = normal(0.7, 256, EMBED)
    embed[0] = 0
    return ByteNetwork(embed, normal(0.2, STRIDE * EMBED, FILTERS), normal(0.2, STRIDE * EMBED, FILTERS), np.zeros(FILTERS, np.float32), normal(0.1, 2 * FILTERS), bias)


def _gradient(net: ByteNetwork, texts: list[bytes], y: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean log loss, for all parameters but the bias, and for the bias."""
    flat, hops = _layout(texts)
    z, x = net.responses(flat, hops)
    where = z.argmax(1)
    top = np.take_along_axis(z, where[:, None, :], 1)[:, 0]
    hop = np.maximum(top, 0)
    first, _ = net.chunks(hop, hops)
    later = hop[first + 1] > hop[first]
    chunk = np.where(later, hop[first + 1], hop[first])
    n = hops - 1
    start = np.cumsum(n) - n
    mean, most = np.add.reduceat(chunk, start) / n[:, None], np.maximum.reduceat(chunk, start)
    logit = mean @ net.weights[:FILTERS] + most @ net.weights[FILTERS:] + net.bias
    err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
    g_weights = np.concatenate([err @ mean, err @ most])
    g_chunk = np.repeat(err / n, n)[:, None] * net.weights[:FILTERS]
    is_most = chunk == np.repeat(most, n, 0)
    share = is_most / np.maximum(np.repeat(np.add.reduceat(is_most.astype(np.float32), start), n, 0), 1)
    g_chunk += np.repeat(err, n)[:, None] * net.weights[FILTERS:] * share
    g_hop = np.zeros_like(hop)
    rows = np.repeat(first[:, None], FILTERS, 1) + later
    cols = np.broadcast_to(np.arange(FILTERS), rows.shape)
    np.add.at(g_hop, (rows, cols), g_chunk)
    g_hop *= top > 0
    # only the position of each maximum has a gradient
    h, f = np.nonzero(g_hop)
    g = g_hop[h, f]
    at = h * _POSITIONS + where[h, f]
    inside = ~np.isin(at, np.cumsum(hops) * _POSITIONS - 1)
    a, b = x[at], x[at + 1] * inside[:, None]
    g_near, g_far, g_shift = np.zeros_like(net.near), np.zeros_like(net.far), np.zeros_like(net.shift)
    np.add.at(g_near.T, f, a * g[:, None])
    np.add.at(g_far.T, f, b * g[:, None])
    np.add.at(g_shift, f, g)
    g_in = np.concatenate([(net.near.T[f] * g[:, None]).reshape(-1, STRIDE, EMBED), (net.far.T[f] * (g * inside)[:, None]).reshape(-1, STRIDE, EMBED)], 1)
    bytes_at = flat[(at * STRIDE)[:, None] + np.arange(2 * STRIDE)]
    g_embed = np.stack([np.bincount(bytes_at.ravel(), g_in[:, :, e].ravel(), 256) for e in range(EMBED)], 1).astype(np.float32)
    g_embed[0] = 0
    return [g_embed, g_near, g_far, g_shift, g_weights.astype(np.float32)], float(err.sum())


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> ByteNetwork:
    n, positive = len(y), float(y.sum())
    share = min(max((positive + 0.5) / (n + 1), 1e-4), 1 - 1e-4)
    rng = np.random.default_rng(seed)
    net = _initial(rng, float(np.log(share / (1 - share))))
    if not 0 < positive < n:
        net.weights[:] = 0
        return net
    params = [net.embed, net.near, net.far, net.shift, net.weights]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    mb = vb = 0.0
    step, steps = 0, epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = order[lo : lo + batch]
            grads, gb = _gradient(net, [texts[i] for i in pick], y[pick])
            step += 1
            now = rate * (1 - step / steps) + rate * 0.02
            a, b = 1 - 0.9**step, 1 - 0.999**step
            for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                g = g + l2 * p
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= now * (mm / a) / (np.sqrt(vv / b) + 1e-7)
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.001 * (gb * gb - vb)
            net.bias -= now * (mb / a) / (np.sqrt(vb / b) + 1e-7)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS) -> ByteNetwork:
    """The driver gets the texts of at most ``rows`` documents; copies of a text count once."""
    sample = labelled_sample(docs, labels, label, rows, id_col, text_col).toPandas().sort_values(["i", "y"]).drop_duplicates(["text", "y"])
    texts = [(t or "").encode() for t in sample["text"]]
    return fit(texts, (sample["y"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = session_of(docs).sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            score = shared.value.score(text_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], ["id", "score"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(scored, "id long, score double")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_quality(docs, fit_quality(docs, labels))
    return scores.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
