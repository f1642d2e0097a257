"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters and digits; a sequence is a stretch of tokens
without a full stop, question mark, exclamation mark or new line in between.
Two labels (clean, toxic).  Features of a token: a bias, its entries in a
lexicon found in the training sample (the word and its first 3 to 6 letters,
since insults are inflected), and whether its neighbours are in the lexicon;
transitions between labels are learned as well.  Only documents are
labelled, so training tokens are labelled by their document: toxic are the
lexicon's tokens in toxic documents, all others are clean.

Scoring: forward-backward marginals of every token of the whole text;
neighbouring tokens with a marginal of ``span_cut`` or more are a span.  The
document score is a logistic function of the number of toxic tokens the
marginals expect, their largest marginal and their share of the text; tokens
likelier clean than toxic (a marginal below 0.5) count as clean there.

Scale: training sees a bounded sample of labelled rows (``rows_per_class`` per
label, texts of up to ``max_chars`` characters, at most ``lexicon_size``
lexicon entries), the model is a few hundred KB and travels with the tasks;
scoring is a map over the texts without a shuffle.

Defined results: null and empty texts have no tokens and the score of a text
without any sign of toxicity.  Without labelled rows of both kinds every
score is the share of toxic labels (0 without labels).  Repeated rows are
scored alike; extra columns pass unchanged, but for columns named like the
new ones, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.llm.common import labelled_sample, python_tasks
from tidemark.llm.streams import lean
from tidemark.llm.words import U64, Words, chunks, code_point_table, words_of


BEGINNINGS = (3, 4, 5, 6)
FAINT = 0.5
TRAIN_CHARS = 1_500_000         # characters of the sample that training looks at at a time


@dataclass
class Model:
    words: np.ndarray           # sorted hashes of the lexicon: words and beginnings
    own: np.ndarray             # weight of each entry, for label toxic
    bias: float                 # weights for label toxic against clean
    before: float               # the previous token is in the lexicon
    after: float
    move: np.ndarray            # transition weights [from, to]
    doc: np.ndarray             # logistic weights of the document score


def _sequences(w: Words) -> np.ndarray:
    """First token of each sequence, one more at the end."""
    stop = code_point_table("stop", lambda c: c in ".!?\n", bool)[w.chars]
    seen = np.concatenate([[0], np.cumsum(stop)])
    new = np.ones(len(w.start), dtype=bool)
    new[1:] = seen[w.start[1:]] != seen[w.start[:-1]]       # texts end with a new line
    return np.append(np.flatnonzero(new), len(w.start))


def _entries(words: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All hits of the lexicon: index of the token, index of the entry."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.zeros(1 << 16, dtype=bool)                  # most tokens end here
    low[(words & U64(0xFFFF)).astype(np.int64)] = True
    tokens, entries = [], []
    for which, hashes in ((None, w.hash), *(w.beginnings(n) for n in BEGINNINGS)):
        maybe = np.flatnonzero(low[(hashes & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(words, hashes[maybe]), len(words) - 1)
        hit = words[at] == hashes[maybe]
        tokens.append(maybe[hit] if which is None else which[maybe[hit]])
        entries.append(at[hit])
    return np.concatenate(tokens), np.concatenate(entries)


def _neighbours(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the token before / after, in the same sequence, is in the lexicon."""
    inside = np.zeros(first[-1])
    inside[tokens] = 1.0
    before, after = np.zeros(first[-1]), np.zeros(first[-1])
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return before, after


def _marginals(potential: np.ndarray, first: np.ndarray, move: np.ndarray):
    """Forward-backward over all sequences at once, position by position.

    ``potential`` is the log potential of label toxic against clean.  Returns
    P(toxic) of each token and the expected label pairs [from, to].
    """
    n = len(potential)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    open_at = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1),
                              side="right")             # sequences longer than t
    e = np.exp(np.clip(potential, -30, 30))
    m = np.exp(move)
    # scaled messages: probability of label toxic up to / from here on
    fwd, back = np.empty(n), np.empty(n)
    toxic = e / (1 + e)
    for t, k in enumerate(open_at):
        at = start[:k] + t
        if t == 0:
            fwd[at] = toxic[at]
        else:
            p = fwd[at - 1]
            one = (p * m[1, 1] + (1 - p) * m[0, 1]) * e[at]
            zero = p * m[1, 0] + (1 - p) * m[0, 0]
            fwd[at] = one / (one + zero)
    for t in range(len(open_at) - 1, -1, -1):
        k = open_at[t]
        longer = open_at[t + 1] if t + 1 < len(open_at) else 0
        at = start[:k] + t
        back[at[longer:]] = 0.5
        if longer:
            nxt = at[:longer] + 1
            b1, b0 = back[nxt] * e[nxt], 1 - back[nxt]
            one, zero = m[1, 1] * b1 + m[1, 0] * b0, m[0, 1] * b1 + m[0, 0] * b0
            back[at[:longer]] = one / (one + zero)
    one, zero = fwd * back, (1 - fwd) * (1 - back)
    gamma = one / (one + zero)
    pairs = np.zeros((2, 2))
    last = np.zeros(n, dtype=bool)
    last[first[1:] - 1] = True
    a = np.flatnonzero(~last)
    f, b, x = fwd[a], back[a + 1], e[a + 1]
    joint = np.stack([(1 - f) * m[0, 0] * (1 - b), (1 - f) * m[0, 1] * x * b,
                      f * m[1, 0] * (1 - b), f * m[1, 1] * x * b])
    joint /= joint.sum(axis=0)
    pairs[:] = joint.sum(axis=1).reshape(2, 2)
    return gamma, pairs


def _potential(model: Model, hits: tuple, first: np.ndarray, around: tuple) -> np.ndarray:
    tokens, entries = hits
    own = np.bincount(tokens, weights=model.own[entries], minlength=first[-1])
    return model.bias + own + model.before * around[0] + model.after * around[1]


def _doc_features(gamma: np.ndarray, first_word: np.ndarray) -> np.ndarray:
    """Per text: 1, log of expected toxic tokens, largest marginal, share."""
    n = np.diff(first_word)
    # a word repeated through a long text must not add up to toxic by doubts alone
    gamma = np.where(gamma < FAINT, 0.0, gamma)
    total = np.add.reduceat(np.append(gamma, 0.0), first_word[:-1]) * (n > 0)
    most = np.maximum.reduceat(np.append(gamma, 0.0), first_word[:-1]) * (n > 0)
    return np.stack([np.ones(len(n)), np.log1p(total), most,
                     np.sqrt(total / np.maximum(n, 1))], axis=1)


def _seen_in(w: Words, y: np.ndarray):
    """Distinct words and beginnings of some texts, with the number of toxic
    and of other texts that hold each."""
    doc = w.doc
    code, texts = [], []
    for at, h in ((None, w.hash), *map(w.beginnings, BEGINNINGS)):
        code.append(h)
        texts.append(doc if at is None else doc[at])
    code, texts = np.concatenate(code), np.concatenate(texts)
    order = np.lexsort((texts, code))
    code, texts = code[order], texts[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (texts[1:] != texts[:-1])
    return _summed(code[new], y[texts[new]] == 1, y[texts[new]] != 1)


def _summed(code: np.ndarray, a: np.ndarray, b: np.ndarray):
    words, where = np.unique(code, return_inverse=True)
    return (words, np.bincount(where, weights=a, minlength=len(words)),
            np.bincount(where, weights=b, minlength=len(words)))


def _lexicon(texts: list[str], y: np.ndarray, size: int, least_docs: int,
             ratio: float) -> np.ndarray:
    """Hashes of the words that mark toxic texts: in at least ``least_docs`` of
    them and ``ratio`` times as often as in others; the clearest first."""
    words, a, b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for lo, hi in chunks(texts):
        more = _seen_in(words_of(texts[lo:hi], letters_only=True), y[lo:hi])
        words, a, b = _summed(*map(np.concatenate, zip((words, a, b), more)))
    na, nb = (y == 1).sum(), (y == 0).sum()
    lift = np.log((a + .5) / (na + 1)) - np.log((b + .5) / (nb + 1))
    signed = lift * np.sqrt(a)
    ok = np.flatnonzero((a >= least_docs) & (lift >= np.log(ratio)))
    best = ok[np.argsort(-signed[ok], kind="stable")][:size]
    return np.sort(words[best])


@dataclass
class Part:
    """What training keeps of a run of texts."""
    hits: tuple                 # lexicon hits: index of the token, of the entry
    first: np.ndarray           # first token of each sequence, one more at the end
    around: tuple               # lexicon word before, after
    label: np.ndarray           # of each token
    pairs: np.ndarray           # label pairs [from, to]
    first_word: np.ndarray      # first token of each text, one more at the end


def _part(texts: list[str], y: np.ndarray, lexicon: np.ndarray) -> Part:
    w = words_of(texts, letters_only=True)
    hits, first = _entries(lexicon, w), _sequences(w)
    label = np.zeros(len(w.hash), dtype=bool)
    label[hits[0]] = y[w.doc[hits[0]]] == 1
    last = np.zeros(len(label), dtype=bool)
    last[first[1:] - 1] = True
    a = np.flatnonzero(~last)
    pairs = np.bincount(2 * label[a] + label[a + 1], minlength=4).reshape(2, 2)
    around = tuple(x.astype(bool) for x in _neighbours(hits[0], first))
    return Part(hits, first, around, label, pairs, w.first)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - l2 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def fit(rows: list[tuple[str, int]], lexicon_size: int = 2000, least_docs: int = 5,
        ratio: float = 8.0, steps: int = 40, l2: float = 1e-3) -> Model:
    """Train on the sample: CRF by gradient ascent (Adam), then the document score."""
    y = np.array([label for _, label in rows])
    none = np.zeros(0)
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Model(none.astype(np.uint64), none, -20.0, 0.0, 0.0, np.zeros((2, 2)),
                     np.array([np.log(share / (1 - share)), 0, 0, 0]))
    texts = [t for t, _ in rows]
    lexicon = _lexicon(texts, y, lexicon_size, least_docs, ratio)
    parts = [_part(texts[lo:hi], y[lo:hi], lexicon) for lo, hi in chunks(texts, TRAIN_CHARS)]
    n = len(lexicon)
    model = Model(lexicon, np.zeros(n), 0.0, 0.0, 0.0, np.zeros((2, 2)), np.zeros(4))
    theta = np.zeros(n + 7)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = np.zeros(n + 7)
        for p in parts:
            gamma, pairs = _marginals(_potential(model, p.hits, p.first, p.around), p.first,
                                      model.move)
            diff = p.label - gamma
            grad += np.concatenate([
                np.bincount(p.hits[1], weights=diff[p.hits[0]], minlength=n),
                [diff.sum(), diff[p.around[0]].sum(), diff[p.around[1]].sum()],
                (p.pairs - pairs).ravel()])
        grad = grad / np.sqrt(1 + np.abs(grad)) - l2 * len(rows) * theta
        m1, m2 = .9 * m1 + .1 * grad, .99 * m2 + .01 * grad ** 2
        theta += .3 * (m1 / (1 - .9 ** step)) / (np.sqrt(m2 / (1 - .99 ** step)) + 1e-8)
        model.own, (model.bias, model.before, model.after) = theta[:n], theta[n:n + 3]
        model.move = theta[n + 3:].reshape(2, 2)
    x = np.concatenate([_doc_features(
        _marginals(_potential(model, p.hits, p.first, p.around), p.first, model.move)[0],
        p.first_word) for p in parts])
    weight = np.where(y == 1, .5 / (y == 1).mean(), .5 / (y == 0).mean())
    model.doc = _logistic(x, y, weight, l2=.1)
    return model


def _scorer(model: Model, span_cut: float):
    def score(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            scores, spans, expected = [], [], []
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi], letters_only=True)
                hits, first = _entries(model.words, w), _sequences(w)
                around = _neighbours(hits[0], first)
                gamma, _ = _marginals(_potential(model, hits, first, around), first, model.move)
                x = _doc_features(gamma, w.first)
                scores.append(1 / (1 + np.exp(-np.clip(x @ model.doc, -30, 30))))
                expected.append(np.expm1(x[:, 1]))
                spans += _spans(w, gamma >= span_cut, first, hi - lo)
            yield b.assign(score=np.concatenate(scores) if scores else np.zeros(0),
                           toxic_tokens=np.concatenate(expected) if expected else np.zeros(0),
                           spans=pd.Series(spans, dtype=object, index=b.index))
    return score


def _spans(w: Words, toxic: np.ndarray, first: np.ndarray, texts: int) -> list[list[dict]]:
    """Runs of toxic tokens of a sequence as code point offsets in their text."""
    out: list[list[dict]] = [[] for _ in range(texts)]
    at = np.flatnonzero(toxic)
    if not len(at):
        return out
    begins = np.zeros(len(toxic) + 1, dtype=bool)
    begins[first] = True
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) > 1) | begins[at[1:]]
    s = at[new]
    e = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    doc = np.searchsorted(w.first, s, side="right") - 1
    for d, x, y in zip(doc, w.start[s] - w.offsets[doc], w.end[e] - w.offsets[doc]):
        out[d].append({"start": int(x), "end": int(y)})
    return out


def score_documents(spark: SparkSession, docs: DataFrame, model: Model,
                    span_cut: float = 0.5) -> DataFrame:
    """``docs`` plus ``score, toxic_tokens, spans`` (array of start, end), which
    replace columns of these names."""
    python_tasks(spark)
    docs = docs.drop("score", "toxic_tokens", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(lean(_scorer(model, span_cut)), fields +
                            ", score double, toxic_tokens double, "
                            "spans array<struct<start:int,end:int>>")


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows_per_class: int = 1500,
          max_chars: int = 6_000) -> Model:
    """Fit on a bounded sample of the rows of ``labels`` where ``learn`` holds."""
    return fit(labelled_sample(docs, labels, "toxic", learn, rows_per_class, max_chars))
