"""keep_one on rows whose ids are null or repeated, row by row."""

import collections
import itertools
import random

from tidemark.llm.jaccard_join import keep_one

DOCS = "doc_id long, text string, extra string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def near(a, b, n=5):
    x, y = ({tuple(t.split()[i:i + n]) for i in range(len(t.split()) - n + 1)} for t in (a, b))
    return len(x & y) >= .8 * len(x | y)


def test_keep_one_by_class_and_text(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = words(rng, 60)
        texts += [base, base, base + " more", base + " more words"][:rng.choice([1, 2, 4])]
    unique = words(rng, 40)
    copy = words(rng, 40)
    ids = [rng.choice([None, None, i, i % 5, (1 << 60) + i]) for i in range(len(texts))]
    rows = list(zip(ids, texts)) + [(5, unique), (5, copy), (3, copy), (None, words(rng, 30))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    got = keep_one(spark, df)
    assert got.columns == df.columns
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if near(rows[a][1], rows[b][1]):
            group = [group[a] if g == group[b] else g for g in group]
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        found = [m for m in set(members) for _ in range(kept[m])]
        assert len(found) == 1, members
        known = [i for i, _ in members if i is not None]
        assert found[0][0] == (min(known) if known else None)
    assert kept.total() == len(set(group))
