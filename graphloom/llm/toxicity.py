"""Operator 8: a convolutional text classifier over hashed word embeddings, trained in numpy, with thresholds calibrated by language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textfeat
from graphloom.llm.common import release, table, texts, thrift
from graphloom.llm.textfeat import fit_temperature, held_out_column, labelled, score, sigmoid

#: A word's embedding joins parts from three hashed tables: of the whole word, of its first four and of its first seven letters.
BUCKETS, TABLES, PART, WIDTHS, FILTERS = 1 << 16, 3, 6, (1, 2, 3), 16
DIM = TABLES * PART
#: Labelled rows that the driver fits on at most (textfeat.SAMPLE_WORDS bounds their words), and how long one of these may be in words (longer
#: ones train on nothing and are scored whole).
MAX_ROWS, MAX_WORDS = 9_000, 20_000
HELD_OUT = (3, 1)
THRESHOLD = 0.7
_SLICE = 30_000
_PAD = max(WIDTHS) - 1


def _rows(hashes: np.ndarray) -> np.ndarray:
    word = (hashes ^ (hashes >> np.uint64(16))) & np.uint64(BUCKETS - 1)
    return np.stack([word, (hashes >> np.uint64(32)) & np.uint64(BUCKETS - 1), hashes >> np.uint64(48)], axis=1).astype(np.int64)


def _flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all documents, each followed by padding rows (bucket BUCKETS, whose embedding is zero), and where each begins."""
    pad = np.full((_PAD + 1, TABLES), BUCKETS, np.int64)
    parts = [x for d in docs for x in (_rows(d), pad)]
    sizes = np.array([len(d) + _PAD + 1 for d in docs])
    return np.concatenate(parts) if parts else pad[:0], np.concatenate([[0], np.cumsum(sizes)])


def _reaching(starts: np.ndarray) -> np.ndarray:
    """Positions from which the widest filter would reach into the next document: they count for neither."""
    return (starts[1:, None] - np.arange(1, _PAD + 1)).ravel()


@dataclass
class Cnn:
    """Embeddings, one weight matrix for each filter width, and a linear layer over the largest activations."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def start(seed: int = 7) -> Cnn:
        rng = np.random.default_rng(seed)
        tables = [np.concatenate([rng.normal(0, 0.3, (BUCKETS, PART)), np.zeros((1, PART))]).astype(np.float32) for _ in range(TABLES)]
        filters = [rng.normal(0, 0.4 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return Cnn(tables, filters, np.full(n, -0.2, np.float32), rng.normal(0, 0.2, n).astype(np.float32), -1.0)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([t[rows[:, k]] for k, t in enumerate(self.tables)], axis=1)

    def activations(self, rows: np.ndarray) -> np.ndarray:
        """[positions, filters of all widths]: the convolution that begins at each position."""
        x = self.embed(rows)
        out = []
        for w, weights in zip(WIDTHS, self.filters, strict=True):
            y = x @ weights[0]
            for j in range(1, w):
                y[:-j] += (x @ weights[j])[j:]
            out.append(y)
        return np.concatenate(out, axis=1)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        """The largest activation of each filter over each whole document, in slices of bounded size that overlap by a filter's width."""
        rows, starts = _flat(docs)
        best = np.full((len(docs), len(self.bias)), -np.inf, np.float32)
        for a in range(0, len(rows), _SLICE):
            act = self.activations(rows[a : a + _SLICE + _PAD])[:_SLICE]
            own = _reaching(starts) - a
            act[own[(own >= 0) & (own < len(act))]] = -np.inf
            first = int(np.searchsorted(starts, a, "right")) - 1
            last = int(np.searchsorted(starts, a + len(act), "left"))
            cuts = np.maximum(starts[first:last] - a, 0)
            best[first:last] = np.maximum(best[first:last], np.maximum.reduceat(act, cuts, axis=0))
        return best

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(docs) + self.bias, 0).astype(np.float64) @ self.out + self.out_bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.logits(docs) / self.temperature) if docs else np.zeros(0)

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, sums: dict, rate: float) -> None:
        """One Adagrad step on a few documents; the gradient reaches only the positions that pooling chose."""
        rows, starts = _flat(docs)
        act = self.activations(rows)
        act[_reaching(starts)] = -np.inf
        top = np.stack([s + act[s:e].argmax(axis=0) for s, e in zip(starts[:-1], starts[1:], strict=True)])
        n = np.arange(act.shape[1])
        z = act[top, n] + self.bias
        h = np.maximum(z, 0)
        d = ((sigmoid(h @ self.out + self.out_bias) - y) * weight / len(y)).astype(np.float32)
        dh = np.outer(d, self.out).astype(np.float32) * (z > 0)

        def move(name, value, grad):  # noqa: ANN001, ANN202
            acc = sums.setdefault(name, np.full_like(grad, 1e-6))
            acc += grad * grad
            value -= rate * grad / np.sqrt(acc)

        move("out", self.out, h.T @ d + 1e-5 * self.out)
        self.out_bias -= 0.5 * rate * float(d.sum())
        move("bias", self.bias, dh.sum(axis=0))
        touched, grads = [], []
        for k, w in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            g = np.zeros_like(self.filters[k])
            for j in range(w):
                at = np.minimum(top[:, part] + j, len(rows) - 1)
                x = self.embed(rows[at.ravel()]).reshape(*at.shape, DIM)
                g[j] = np.einsum("df,dfe->ef", dh[:, part], x)
                touched.append(at.ravel())
                grads.append((dh[:, part, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
            move(f"filter{k}", self.filters[k], g)
        at, grad = rows[np.concatenate(touched)], np.concatenate(grads)
        for part, values in enumerate(self.tables):
            which, inverse = np.unique(at[:, part], return_inverse=True)
            total = np.zeros((len(which), PART), np.float32)
            np.add.at(total, inverse, grad[:, part * PART : (part + 1) * PART])
            acc = sums.setdefault(f"table{part}", np.full((BUCKETS + 1, 1), 1e-6, np.float32))
            acc[which] += (total * total).mean(axis=1, keepdims=True)
            values[which] -= rate * total / np.sqrt(acc[which])
            values[BUCKETS] = 0


def fit(docs: list[np.ndarray], y: np.ndarray, lang: list[str], epochs: int = 6, batch: int = 48, seed: int = 7, threshold: float = THRESHOLD) -> Cnn:
    """Train on nine tenths of the rows; the rest calibrate the temperature and, for each language with enough of both classes, the threshold of least error.

    Without both classes there is nothing to learn: every score is then the share of label 1 (0.5 without rows), as logit.
    """
    model = Cnn.start(seed)
    keep = np.array([i for i, d in enumerate(docs) if len(d) <= MAX_WORDS], int)
    if len(keep) < 8 or y[keep].min() == y[keep].max():
        model.out[:] = 0
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        model.out_bias = float(np.log(share / (1 - share)))
        return model
    valid, train = keep[::10], np.setdiff1d(keep, keep[::10])
    rng, sums = np.random.default_rng(seed), {}
    rare = (y[train] == 1).mean()
    weight = np.where(y == 1, min(3.0, np.sqrt((1 - rare) / max(rare, 1e-6))), 1.0)
    for epoch in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            model.step([docs[i] for i in some], y[some], weight[some], sums, 0.1 / (1 + 0.5 * epoch))
    logits = np.concatenate([model.logits([docs[i] for i in valid[a : a + 256]]) for a in range(0, len(valid), 256)])
    model.temperature = fit_temperature(logits, y[valid])
    p = sigmoid(logits / model.temperature)
    for code in sorted({lang[i] for i in valid if lang[i]}):
        own = np.array([lang[i] == code for i in valid])
        if (y[valid][own] == 1).sum() >= 8 and (y[valid][own] == 0).sum() >= 8:
            grid = np.round(np.arange(0.4, 0.91, 0.05), 2)
            wrong = [((p[own] >= t) != (y[valid][own] == 1)).sum() for t in grid]
            least = grid[np.array(wrong) == min(wrong)]
            model.thresholds[code] = float(least[np.argmin(np.abs(least - threshold))])
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Cnn:
    thrift()
    model = fit(*labelled(docs, labels, "toxic", HELD_OUT, max_rows))
    release()
    return model


def toxicity(docs: DataFrame, model: Cnn) -> DataFrame:
    """(doc_id, score) for each row of docs. A null or empty text is scored as a text without words; repeated rows give repeated rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return score(texts(docs), lambda: held.value)


def filtered(docs: DataFrame, model: Cnn, keep) -> DataFrame:  # noqa: ANN001
    """The rows of docs whose score keep() accepts."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return textfeat.filtered(docs, lambda: held.value, keep)


def rejects(model: Cnn, lang, value):  # noqa: ANN001, ANN201
    """The decision: a score from its language's threshold on; other languages take the general one."""
    limit = F.lit(THRESHOLD)
    for code, t in model.thresholds.items():
        limit = F.when(lang == code, F.lit(t)).otherwise(limit)
    return value >= limit


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents, scored by a model that no held-out row has taught."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out_column(*HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
