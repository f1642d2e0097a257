"""Line dedup row by row against a plain loop: short lines, repeated and null ids."""

import collections
import random

from tidemark.llm.line_dedup import drop_boilerplate

DOCS = "doc_id long, text string, source string, n_chars long, extra string"


def brute(rows, min_sites=5):
    """Expected text of each row; a document is (id, site, text)."""
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if k := line.strip(" "):
                if s is not None:
                    sites[k].add(s)
                key = (i is None, i or 0, s is None, s or "")
                first[k] = min(first.get(k, key), key)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append(None)
            continue
        kept, seen = [], set()
        for line in t.split("\n"):
            k = line.strip(" ")
            mine = first.get(k) == (i is None, i or 0, s is None, s or "") and k not in seen
            seen.add(k)
            if not k or len(sites[k]) < min_sites or mine:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, s, len(t) if t else 0, str(n))
                                for n, (i, t, s) in enumerate(rows)], DOCS)
    got = {int(r.extra): r for r in drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    return [got[n].text for n in range(len(rows))], got


def test_short_lines_and_odd_rows_against_a_loop(spark):
    rng = random.Random(5)
    common = ["ok", "All rights reserved.", "a b c d", "the same line of many words here"]
    rows = []
    for n in range(60):
        lines = [f"own line {n}", *rng.sample(common, 2), "", "  ", rng.choice(common)]
        rng.shuffle(lines)
        rows.append((n, "\n".join(lines), rng.choice([None, *"abcdefg"])))
    rows += [(100, None, "a"), (101, "", "b"), (102, " ", "c"), (103, "ok\n" * 3000, "d")]
    texts, got = run(spark, rows)
    assert texts == brute(rows)
    assert all(got[n].n_chars == len(t) for n, t in enumerate(texts)
               if t is not None and t != rows[n][1])


def test_rows_that_share_an_id_or_have_none(spark):
    line = "boilerplate of the sites"
    for i in (7, None):
        rows = [(i, f"{line}\nrow {n}", f"s{n}") for n in range(8)]
        texts, _ = run(spark, rows)
        assert texts == brute(rows)
        assert sum(line in t for t in texts) == 1
    # rows equal in id, site and text are one document: both keep the line
    rows = [(1, f"{line}\nx", "s0")] * 2 + [(n, line, f"s{n}") for n in range(2, 8)]
    texts, _ = run(spark, rows)
    assert texts[:2] == [f"{line}\nx"] * 2 and set(texts[2:]) == {""}
