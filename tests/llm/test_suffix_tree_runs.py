"""Grams are made and sorted a run of symbols at a time, wherever a text is cut by it."""

import collections
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import suffix_tree

LETTERS = "abcdefgh é"


@pytest.fixture
def table(monkeypatch):
    monkeypatch.setattr(suffix_tree, "TaskContext", SimpleNamespace(
        get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    table = np.ones(0x110000, dtype=np.uint8)
    for i, c in enumerate(LETTERS[:-1]):                    # é is any other character
        table[ord(c)] = i + 2
    return table


def frames(texts, rows=3):
    for lo in range(0, len(texts), rows):
        part = texts[lo:lo + rows]
        yield pd.DataFrame({"doc_id": range(lo, lo + len(part)), "text": part})


def grams(text, table):
    s = [0] * suffix_tree.DEPTH + [int(table[ord(c)]) for c in text or ""] + [0]
    return [sum(s[i - j] << suffix_tree.BITS * j for j in range(suffix_tree.DEPTH + 1))
            for i in range(suffix_tree.DEPTH, len(s))]


def log_of(gram):
    return np.float32(-(int(gram) * 2654435761 % 1000003) / 1000003)


def scored(texts, table, buckets=16):
    """Scores out of prepared chunks whose requests are answered by ``log_of``."""
    asked = []
    for f in suffix_tree._preparer(table, {b"a": 3}, buckets)(frames(texts)):
        if f["symbols"].notna().any():
            asked.append(f.assign(bucket=-1, logs=b""))
        elif f["ask"].notna().any():
            asked.append(f.assign(logs=[np.array(
                [log_of(g) for g in suffix_tree._unspell(x)], np.float32).tobytes()
                for x in f["ask"]], row=0, buckets=0))
    return pd.concat(list(suffix_tree._adder()(asked)))["score"].to_numpy()


def odd_texts():
    draw = random.Random(3)
    return [None, "", "a", "é" * 9, "", *("".join(draw.choices(LETTERS, k=draw.randrange(60)))
                                         for _ in range(40)), "ab" * 50, ""]


@pytest.mark.parametrize("run", [1, 7, 64, 1 << 19])
def test_runs_may_end_inside_texts(table, monkeypatch, run):
    monkeypatch.setattr(suffix_tree, "RUN", run)
    monkeypatch.setattr(suffix_tree, "MANY", 9)             # counts pass on and merge often
    texts = odd_texts()
    want = collections.Counter(g for t in texts for g in grams(t, table))
    got = collections.Counter()
    for f in suffix_tree._gram_counter(table)(frames(texts)):
        for g, n in zip(f["gram"], f["n"]):
            got[g] += n
    assert got == want
    want = [sum(float(log_of(g)) for g in grams(t, table))
            - np.log10(0x110000) * (t or "").count("é") for t in texts]
    assert scored(texts, table) == pytest.approx(want, rel=1e-12)


def test_chunks_are_scored_apart(table, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK", 150)
    texts = odd_texts()
    want = [sum(float(log_of(g)) for g in grams(t, table))
            - np.log10(0x110000) * (t or "").count("é") for t in texts]
    assert scored(texts, table) == pytest.approx(want, rel=1e-12)


def test_word_figures_of_tokens(table):
    texts = ["a b A", None, "", "b\tb a\x0bzz b"]
    f = pd.concat(f for f in suffix_tree._preparer(table, {b"a": 9, b"": 99}, 16)(frames(texts))
                  if f["n_tokens"].notna().any())
    assert list(f["n_tokens"]) == [4, 1, 1, 6] and list(f["known"]) == [3, 1, 1, 2]
    assert list(f["base"]) == pytest.approx([4, 2, 2, 3])
    assert [dict(zip(w, n)) for w, n in zip(f["rare"], f["times"])] == [
        {b"b": 1}, {}, {}, {b"b": 3, b"zz": 1}]


def test_long_text_is_counted_by_runs(table):
    """A text of any length costs its symbols, not its grams, at once."""
    def peak(n):
        text = "abcdefgh" * (n // 8)
        tracemalloc.start()
        for _ in suffix_tree._gram_counter(table)(frames([text])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most
    assert peak(8_000_000) - peak(4_000_000) < 20 * 4_000_000       # bytes for 4 M more
