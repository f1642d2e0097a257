"""drop_contaminated on rows whose ids are null or repeated, row by row."""

import random

from tidemark.llm.decontaminate import drop_contaminated

DOCS = "doc_id long, text string, extra string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_decontamination_by_row(spark):
    rng = random.Random(12)
    items = [words(rng, 12), words(rng, 40)]
    half = items[1].split()
    rows = [(None, "x " + items[0]), (None, words(rng, 30)), (None, None), (None, ""),
            (7, items[1]), (7, words(rng, 20)), (7, words(rng, 25)),
            (8, " ".join(half[:24])), (8, " ".join(half[16:])), (9, words(rng, 9))]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = drop_contaminated(spark, df, bench)
    assert got.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r[0], r[1]) for r in got.collect()), key=key) == sorted(
        (r for r in rows if r not in (rows[0], rows[4])), key=key)
