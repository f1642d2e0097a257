"""Document quality by a factorisation machine.

Features of a whole text: its words, hashed into ``buckets`` (weight: 1 + log
of the count, scaled to length 1), statistics of its structure (shares of
upper case, digits, signs and lines, word lengths, distinct and repeated
words) and its length as metadata.  The score is a logistic function of a bias,
a linear term and pairwise interactions of rank ``rank``; by the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2
a text is scored in time linear in its number of features.

Scale: fitted on a bounded sample of labelled rows (``rows_per_class`` per
label, texts of up to ``max_chars`` characters); the model has a fixed size
(buckets * (rank + 1) numbers) and travels with the tasks; scoring is a map
over the texts without a shuffle.

Defined results: null and empty texts have no words and all statistics zero.
Without labelled rows of both kinds every score is the share of label 1 (1
without labels: nothing is rejected unseen).  Repeated rows are scored alike;
extra columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.llm.common import labelled_sample, python_tasks
from tidemark.llm.streams import lean
from tidemark.llm.words import U64, chunks, code_point_table, words_of

STATISTICS = 16


@dataclass
class Model:
    buckets: int
    center: np.ndarray          # mean and spread of each statistic
    spread: np.ndarray
    bias: float
    linear: np.ndarray          # [buckets + STATISTICS]
    factors: np.ndarray         # [rank, buckets + STATISTICS]


def _kind(c: str) -> int:
    """0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 new line, 6 stop, 7 sign"""
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if c.isdigit():
        return 3
    if c.isalpha():
        return 2 if c.isupper() else 1
    return 6 if c in ".,;:?'\"()-" else 7 if 32 < ord(c) < 127 else 0


def features(texts: list[str], buckets: int):
    """(text, bucket, weight) of all words, and the statistics [texts, STATISTICS]."""
    w = words_of(texts)
    n = len(texts)
    doc = w.doc
    words = np.diff(w.first)
    code, count = np.unique((doc.astype(np.int64) * buckets)
                            + (w.hash % U64(buckets)).astype(np.int64), return_counts=True)
    row, col = code // buckets, code % buckets
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    value = value / norm[row]

    kind = code_point_table("kind", _kind, np.uint8)[w.chars].astype(np.int64)
    sizes = np.diff(w.offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, sizes) + kind, minlength=8 * n)
    kinds = kinds.reshape(n, 8).astype(np.float64)
    kinds[:, 5] -= 1                                       # the new line added to each text
    chars = np.maximum(sizes - 1, 1)[:, None]
    some = np.maximum(words, 1)
    length = (w.end - w.start).astype(np.float64)
    same = np.zeros(len(doc))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    per = lambda x: np.bincount(doc, weights=x, minlength=n) / some
    distinct = np.bincount(row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, row, count)
    mean = per(length)
    statistics = np.column_stack([
        np.sqrt(kinds / chars), mean, np.sqrt(np.maximum(per(length ** 2) - mean ** 2, 0)),
        distinct / some, most / some, per(same), per(length == 1),
        np.log1p(words), np.log1p(sizes - 1)])
    return row, col, value, statistics


def _design(model: Model, texts: list[str]):
    row, col, value, statistics = features(texts, model.buckets)
    z = np.clip((statistics - model.center) / model.spread, -5, 5) / 4
    n = len(texts)
    return (np.concatenate([row, np.repeat(np.arange(n), STATISTICS)]),
            np.concatenate([col, np.tile(model.buckets + np.arange(STATISTICS), n)]),
            np.concatenate([value, z.ravel()]), n)


def _sample_design(model: Model, texts: list[str]):
    """The design of a whole sample, made a run of texts at a time."""
    made = [(lo, _design(model, texts[lo:hi])) for lo, hi in chunks(texts)]
    return (np.concatenate([lo + d[0] for lo, d in made]),
            *(np.concatenate([d[k] for _, d in made]) for k in (1, 2)), len(texts))


def _forward(model: Model, row, col, x, n):
    """Score before the logistic function, and the sums of each factor."""
    out = model.bias + np.bincount(row, weights=model.linear[col] * x, minlength=n)
    sums = []
    for v in model.factors:
        vx = v[col] * x
        s = np.bincount(row, weights=vx, minlength=n)
        out += .5 * (s * s - np.bincount(row, weights=vx * vx, minlength=n))
        sums.append(s)
    return out, sums


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]], buckets: int = 1 << 15, rank: int = 6, steps: int = 80,
        rate: float = .05, l2: float = 2e-4) -> Model:
    """Full-batch gradient descent (Adam) on the log loss, both labels weighted alike."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    size = buckets + STATISTICS
    model = Model(buckets, np.zeros(STATISTICS), np.ones(STATISTICS), 0.0, np.zeros(size),
                  np.random.default_rng(7).normal(0, .05, (rank, size)))
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        model.bias, model.factors = np.log(share / (1 - share)), np.zeros((rank, size))
        return model
    texts = [t for t, _ in rows]
    statistics = np.concatenate([features(texts[a:b], buckets)[3] for a, b in chunks(texts)])
    model.center, model.spread = statistics.mean(axis=0), statistics.std(axis=0) + 1e-6
    row, col, x, n = _sample_design(model, texts)
    weight = np.where(y == 1, .5 / y.mean(), .5 / (1 - y.mean())) / n
    theta = [np.zeros(1), model.linear, *model.factors]
    m1, m2 = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        model.bias = float(theta[0][0])
        out, sums = _forward(model, row, col, x, n)
        g = weight * (_logistic(out) - y)
        gx = g[row] * x
        grads = [np.array([g.sum()]), np.bincount(col, weights=gx, minlength=size) + l2 * theta[1]]
        for v, s in zip(theta[2:], sums):
            grads.append(np.bincount(col, weights=gx * (s[row] - v[col] * x), minlength=size)
                         + l2 * v)
        for t, a, b, d in zip(theta, m1, m2, grads):       # in place: the model sees it
            a += .1 * (d - a)
            b += .01 * (d * d - b)
            t -= rate * (a / (1 - .9 ** step)) / (np.sqrt(b / (1 - .99 ** step)) + 1e-8)
        model.factors = np.stack(theta[2:])
    model.bias = float(theta[0][0])
    return model


def _scorer(model: Model):
    def score(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            scores = [_logistic(_forward(model, *_design(model, texts[lo:hi]))[0])
                      for lo, hi in chunks(texts)]
            yield b.assign(score=np.concatenate(scores) if scores else np.zeros(0))
    return score


def score_documents(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score``, the probability of label 1 (in place of a column
    of that name)."""
    python_tasks(spark)
    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(lean(_scorer(model)), fields + ", score double")


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = 1500,
          max_chars: int = 6_000) -> Model:
    """Fit on a bounded sample of the rows of ``labels`` where ``learn`` holds."""
    return fit(labelled_sample(docs, labels, "quality", learn, rows_per_class, max_chars))
