"""The suffix tree keeps every context that passes the divergence test."""

import collections
import math
import random

import pytest

from tidemark.llm import suffix_tree

DOCS = "doc_id long, text string"


def brute_force(learn, copies, ask, min_gain=4.0, depth=5, symbols=64):
    """Scores, and the number of retained contexts, of texts of at most 62 letters."""
    nexts = collections.defaultdict(collections.Counter)
    for t in learn:
        s = "\0" * depth + t + "\0"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                nexts[s[i - d:i]][s[i]] += copies
    total = {c: sum(x.values()) for c, x in nexts.items()}
    kept = {""}
    for c, x in nexts.items():
        if c and sum(n * math.log(
                n * total[c[1:]] / (total[c] * nexts[c[1:]][a])) for a, n in x.items()) >= min_gain:
            kept |= {c[i:] for i in range(len(c) + 1)}

    def p(c, a):
        before = p(c[1:], a) if c else 1 / symbols
        seen, weight = nexts.get(c, {}), max(len(nexts.get(c, {})), 1)
        return (seen.get(a, 0) + weight * before) / (total.get(c, 0) + weight)

    def score(t):
        s, out = "\0" * depth + t + "\0", 0.0
        for i in range(depth, len(s)):
            best = max((d for d in range(depth + 1) if s[i - d:i] in kept))
            out += math.log10(p(s[i - best:i], s[i]))
        return out
    return [score(t) for t in ask], len(kept)


def test_all_passing_contexts_are_kept(spark):
    rng = random.Random(7)
    syllables = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3))
                 for _ in range(6000)]
    texts = ["".join(rng.choice(syllables) for _ in range(300)) for _ in range(150)]
    ask = texts[:20] + ["", "neverseen", "aaaaaaaaaaaa"]
    want, n_kept = brute_force(texts, 4, ask)
    assert n_kept > 80_000
    learn = spark.createDataFrame(list(enumerate(texts * 4)), DOCS)
    df = spark.createDataFrame(list(enumerate(ask)), DOCS)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(spark, df, learn).collect()}
    assert [got[i] for i in range(len(ask))] == pytest.approx(want, rel=1e-5)


def test_rare_contexts_are_tested_too(spark):
    texts = ["the cat sat on the mat " * 40, "xq" * 3, "zebra quartz", "jq"]
    want, _ = brute_force(texts, 1, texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(spark, df, df).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-5)


def test_preparing_holds_symbols_not_texts(monkeypatch):
    """A task holds about one byte a character of the chunk it gathers."""
    import random
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from tidemark.llm import suffix_tree
    monkeypatch.setattr(suffix_tree, "TaskContext", SimpleNamespace(
        get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    table = np.ones(0x110000, dtype=np.uint8)
    table[32:94] = np.arange(2, 64)

    def batches(n):
        draw = random.Random(1)
        for _ in range(n):
            yield pd.DataFrame({"doc_id": range(50), "text": [
                "".join(draw.choices("abcdefgh é", k=1000)) for _ in range(50)]})

    def peak(n):
        tracemalloc.start()
        for _ in suffix_tree._preparer(table, {b"a": 3}, 16)(batches(n)):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most
    assert peak(80) - peak(40) < 2 * 2_000_000          # bytes for 2 M more characters
