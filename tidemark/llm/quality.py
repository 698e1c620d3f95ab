"""A quality classifier from positive and unlabelled texts.

Trusted positives and a sample of unlabelled texts are turned into numbers that do not depend on the language: how often each
shape of word occurs (letters, digits and cases folded), and how much a text repeats itself. A small network is
fitted by minimising the non-negative unbiased risk: with prior p of positives among unlabelled texts, the risk of calling
unlabelled texts negative, less p times that of calling positives negative, estimates the risk on negatives; where a batch makes it
negative, its gradient is turned round. No text is ever used as a negative example.

The prior is estimated from positives and unlabelled texts alone: a logistic model that tells a part of the positives from a part of
the unlabelled texts gives, on the other part of the positives, how many times denser positives are among positives than
among unlabelled texts; where only positives occur that is one over the prior. Rows marked 0 are never read. A known
prior can be passed.

Training takes at most about `POSITIVES` and `UNLABELLED` texts, chosen by a hash of the id, whatever the tables' sizes. All texts are
scored as wholes, batch by batch, without a shuffle.

Defined cases: null text counts as empty; empty texts get a score like all others; without positives every score is the prior (0.5 if none is passed);
rows that repeat an id are scored separately, and several labels of one id count as its largest; a null label is no label; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import text_of

#: Texts that training may take.
POSITIVES, UNLABELLED = 3000, 4000
SHAPES = 256
#: Word shapes that a worker keeps.
KEPT_WORDS = 300_000
_FOLDS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "T" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "9"))


def _shape(word: str) -> int:
    from xxhash import xxh3_64_intdigest

    for pattern, by in _FOLDS:
        word = pattern.sub(by, word)
    return xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % SHAPES


class _Shapes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = _shape(word)
        if len(word) < 64:
            self[word] = value
        return value


_shapes = _Shapes()
N_FEATURES = SHAPES + 12


def features(text: str) -> np.ndarray:
    """Numbers between about 0 and 1 that describe a text."""
    words = text.split()
    out = np.zeros(N_FEATURES, np.float32)
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    shapes = np.bincount(np.fromiter(map(_shapes.__getitem__, words), np.int64, n), minlength=SHAPES)
    out[:SHAPES] = np.sqrt(shapes / n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = Counter(zip(words, words[1:], strict=False))
    top = counts.most_common(3)
    expected = min(1.0, 8 / np.sqrt(n))
    out[SHAPES:] = (
        len(counts) / n, len(counts) / n - expected, top[0][1] / n, sum(c for _, c in top) / n, 1 - len(pairs) / max(1, n - 1), max(pairs.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, sizes.mean() / 12), min(1.0, sizes.std() / 12), min(1.0, np.log1p(n) / 10), sum(c for w, c in counts.items() if len(w) == 1) / n, 0,
    )
    return out


@dataclass
class Model:
    """score = sigmoid(v . tanh(W x + b) + u . x + c), x standardised."""

    mean: np.ndarray
    scale: np.ndarray
    W: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    c: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.W + self.b) @ self.v + z @ self.u + self.c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 120, batch: int = 512, rate: float = 0.003, decay: float = 1e-3, seed: int = 11) -> Model:
    """Minimises the non-negative unbiased risk with the sigmoid loss, by Adam."""
    r, both = np.random.default_rng(seed), np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.02)
    k = both.shape[1]
    model = Model(mean, scale, r.normal(0, 1 / np.sqrt(k), (k, hidden)).astype(np.float32), np.zeros(hidden, np.float32), r.normal(0, 0.3, hidden).astype(np.float32), np.zeros(k, np.float32), np.zeros(1, np.float32))
    names = ("W", "b", "v", "u", "c")
    m, s = [{n: np.zeros_like(getattr(model, n)) for n in names} for _ in range(2)]
    step, rounds = 0, max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        orders = [r.permutation(len(positive)), r.permutation(len(unlabelled))]
        for part in zip(np.array_split(orders[0], rounds), np.array_split(orders[1], rounds), strict=True):
            step += 1
            x = np.concatenate([positive[part[0]], unlabelled[part[1]]])
            is_p = np.arange(len(x)) < len(part[0])
            n_p, n_u = max(1, len(part[0])), max(1, len(part[1]))
            z = np.clip((x - mean) / scale, -6, 6)
            h = np.tanh(z @ model.W + model.b)
            g = h @ model.v + z @ model.u + model.c[0]
            low = 1 / (1 + np.exp(np.clip(g, -30, 30)))  # the loss of calling a text positive at margin g; 1 - low is that of negative
            slope = low * (1 - low)
            negative = (1 - low)[~is_p].sum() / n_u - prior * (1 - low)[is_p].sum() / n_p
            up, un = np.where(is_p, -slope * prior / n_p, 0), np.where(is_p, -slope * prior / n_p, slope / n_u)
            dg = (up + un if negative >= 0 else -un).astype(np.float32)
            dh = dg[:, None] * model.v * (1 - h**2)
            grads = {"W": z.T @ dh + decay * model.W, "b": dh.sum(0), "v": h.T @ dg, "u": z.T @ dg + decay * model.u, "c": dg.sum(keepdims=True)}
            for n, grad in grads.items():
                m[n] += 0.1 * (grad - m[n])
                s[n] += 0.001 * (grad**2 - s[n])
                w = getattr(model, n)
                w -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 4, ridge: float = 30.0, steps: int = 12) -> float:
    """The share of positives among unlabelled texts, from features of both; each fold is judged by a model of the others.

    The density ratio of positives to unlabelled texts is at most one over the prior, and that at texts that only positives
    are like; its median over positives is taken, because a model's ratio strays at the ends.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.02)
    x = np.c_[np.clip((both - mean) / scale, -6, 6), np.ones(len(both))].astype(np.float64)
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    of = np.r_[np.arange(len(positive)) % folds, np.arange(len(unlabelled)) % folds]
    ratios = []
    for k in range(folds):
        at, w = of != k, np.zeros(x.shape[1])
        n_p, n_u = max(1, int((y[at] == 1).sum())), max(1, int((y[at] == 0).sum()))
        weight = np.where(y[at] == 1, 0.5 / n_p, 0.5 / n_u) * at.sum()
        for _ in range(steps):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x[at] @ w, -30, 30)))
            h = (x[at] * (weight * p * (1 - p))[:, None]).T @ x[at] + ridge * np.eye(x.shape[1])
            w -= np.linalg.solve(h, x[at].T @ (weight * (p - y[at])) + ridge * w)
        ratios.append(np.exp(np.clip(x[(of == k) & (y == 1)] @ w, -30, 30)))
    return float(np.clip(1 / np.median(np.concatenate(ratios)), 0.01, 0.99))


def _feature_rows(docs: DataFrame) -> np.ndarray:
    """Features of the texts of `docs` (id, text), a bounded number of rows, in the order of ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "x"])

    got = docs.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(rows, "id string, x binary").orderBy("id", "x").toArrow()
    return np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Model | None, float]:
    """The model and the prior. `training` picks the rows, of both tables, that may be learned from."""
    trusted = labels.where(training & (F.col(label_col) == 1)).select(F.col(id_col).alias("id")).distinct()
    ones = trusted.count()
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = docs.where(training).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    n = texts.select("id").count()
    given = 0.5 if prior is None else prior
    if not ones or not n:
        return None, given
    x_p = _feature_rows(texts.join(trusted.where(u < min(1.0, positives / ones)), "id", "left_semi"))  # about `positives` ids
    x_u = _feature_rows(texts.where(F.pmod(F.xxhash64("id", F.lit("u")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < min(1.0, unlabelled / n)))
    if not len(x_p) or not len(x_u):
        return None, given
    prior = estimate_prior(x_p, x_u) if prior is None else prior
    return fit(x_p, x_u, prior), prior


def score(docs: DataFrame, model: Model | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("score", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, N_FEATURES)
            scores = sent.value.score(x) if sent.value is not None else np.full(len(x), prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.astype(np.float64))], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(rows, f"doc_id {id_type.simpleString()}, score double")
