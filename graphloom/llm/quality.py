"""Operator 10: random-indexing word vectors pooled per document, then a two-layer numpy network with temperature-calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textfeat
from graphloom.llm.common import release, table, texts, thrift
from graphloom.llm.textfeat import fit_temperature, held_out_column, labelled, score, sigmoid

#: Words share this many vectors by hash; an index vector has NONZERO entries of +1 or -1 among DIM.
BUCKETS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 16, 48, 4, 2, 32
#: Labelled rows that the driver fits on at most (textfeat.SAMPLE_WORDS bounds their words); rows with more than MAX_WORDS words add nothing to
#: the word vectors, so that a few very long ones do not settle them, but train the network and are scored whole.
MAX_ROWS, MAX_WORDS = 9_000, 20_000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
_SLICE = 25_000


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the NONZERO positions and signs of its sparse random index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hash."""
    return hashes.astype(np.int64) & (BUCKETS - 1)


def word_vectors(docs: list[np.ndarray]) -> np.ndarray:
    """Random indexing: a word's vector sums the index vectors of the words up to WINDOW places around it; unseen words keep their index vector. Unit length."""
    places, signs = index_vectors()
    gap = np.full(WINDOW, -1, np.int64)
    total = np.zeros(BUCKETS * DIM)
    slices, n = [[]], 0
    for d in docs:
        n += len(d)
        if n > _SLICE * 40:  # bounded memory: documents by the slice
            slices.append([])
            n = len(d)
        slices[-1].append(d)
    for some in slices:
        flat = np.concatenate([x for d in some for x in (_buckets(d), gap)] or [gap])
        for step in range(1, WINDOW + 1):
            for near, far in ((flat[:-step], flat[step:]), (flat[step:], flat[:-step])):
                both = (near >= 0) & (far >= 0)
                for k in range(NONZERO):
                    total += np.bincount(near[both] * DIM + places[far[both], k], weights=signs[far[both], k], minlength=len(total))
    vectors = total.reshape(BUCKETS, DIM)
    unseen = ~vectors.any(axis=1)
    own = np.zeros((BUCKETS, DIM))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    vectors[unseen] = own[unseen]
    vectors -= vectors[~unseen].mean(axis=0) if (~unseen).any() else 0
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.logits(pool(docs, self.vectors)) / self.temperature) if docs else np.zeros(0)


def pool(docs: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Of each whole document the mean word vector, its length, and the mean product of neighbouring words' vectors; zeros without words.

    Sums are taken in slices of bounded size.
    """
    sizes = np.array([len(d) for d in docs])
    sums, near = np.zeros((len(docs), vectors.shape[1])), np.zeros(len(docs))
    flat = _buckets(np.concatenate(docs)) if len(docs) else np.zeros(0, np.int64)
    last = np.zeros(len(flat) + 1, bool)
    last[np.cumsum(sizes) - 1] = True
    starts = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(sizes)
    for a in range(0, len(flat), _SLICE):
        part = vectors[flat[a : a + _SLICE + 1]]
        product = np.einsum("ij,ij->i", part[:-1], part[1:]) * ~last[a : a + len(part) - 1]
        product = np.append(product, 0.0)[: len(part[:_SLICE])]
        part = part[:_SLICE]
        inside = full[(starts[full] < a + len(part)) & (starts[full + 1] > a)]
        cuts = np.maximum(starts[inside] - a, 0)
        sums[inside] += np.add.reduceat(part, cuts, axis=0, dtype=np.float64)
        near[inside] += np.add.reduceat(product, cuts, dtype=np.float64)
    mean = sums / np.maximum(sizes, 1)[:, None]
    return np.column_stack([mean, np.linalg.norm(mean, axis=1), near / np.maximum(sizes - 1, 1)])


def fit(docs: list[np.ndarray], y: np.ndarray, lang: list[str] | None = None, epochs: int = 40, batch: int = 64, seed: int = 11) -> Network:
    """Word vectors and network from the labelled rows; a tenth of them only calibrates the temperature. With one class or no rows, the score is the share of label 1 (0.5 without rows)."""
    del lang
    vectors = word_vectors([d for d in docs if len(d) <= MAX_WORDS])
    x = np.concatenate([pool(docs[a : a + 256], vectors) for a in range(0, len(docs), 256)]) if docs else np.zeros((0, DIM + 2))
    rng = np.random.default_rng(seed)
    net = Network(vectors, x.mean(axis=0) if len(x) else np.zeros(DIM + 2), x.std(axis=0) + 1e-6 if len(x) else np.ones(DIM + 2), rng.normal(0, np.sqrt(2 / DIM), (DIM + 2, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    if len(y) < 8 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        net.w2[:], net.b2 = 0, float(np.log(share / (1 - share)))
        return net
    valid = np.arange(0, len(y), 10)
    train = np.setdiff1d(np.arange(len(y)), valid)
    z = (x - net.mean) / net.scale
    state = [[np.zeros_like(np.asarray(p, float)) for p in (net.w1, net.b1, net.w2, net.b2)] for _ in range(2)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), batch):
            i = order[a : a + batch]
            h = np.maximum(z[i] @ net.w1 + net.b1, 0)
            d = (sigmoid(h @ net.w2 + net.b2) - y[i]) / len(i)
            dh = np.outer(d, net.w2) * (h > 0)
            grads = [z[i].T @ dh + 1e-4 * net.w1, dh.sum(axis=0), h.T @ d + 1e-4 * net.w2, d.sum()]
            t += 1
            moved = []
            for p, g, m, v in zip((net.w1, net.b1, net.w2, net.b2), grads, *state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moved.append(p - 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = moved
    net.b2 = float(net.b2)
    net.temperature = fit_temperature(net.logits(x[valid]), y[valid])
    return net


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    thrift()
    model = fit(*labelled(docs, labels, "quality", HELD_OUT, max_rows, kind="<u2"))
    release()
    return model


def quality(docs: DataFrame, model: Network) -> DataFrame:
    """(doc_id, score) for each row of docs. A null or empty text has a zero vector; repeated rows give repeated rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score(texts(docs), lambda: held.value)


def filtered(docs: DataFrame, model: Network, keep) -> DataFrame:  # noqa: ANN001
    """The rows of docs whose score keep() accepts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return textfeat.filtered(docs, lambda: held.value, keep)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents, scored by a model that no held-out row has taught."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model).select("doc_id", held_out_column(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
