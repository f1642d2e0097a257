"""Filter audit, BPE codec and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance
from tidemark.llm.bpe_codec import (
    BpeVocabulary, Encoder, decode_ids, encode_texts, merge_words,
)
from tidemark.llm.filter_audit import MEASURES, audit_filters
from tidemark.llm.importance import GainPlanes, feature_buckets, ranked, resample
from tidemark.llm.queries_tokens import BPE_FILE, op12_bpe_codec

ODD = [None, "", " \n\t ", "one", "A B C", "é ▁  😀\r\n\x00 tail #", "long " * 30000,
       "x\u001cy\u0085z w"]


# ---- filter audit --------------------------------------------------------------

def audit(rows, labels):
    """rows: (id, text, lang)."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and i > smallest[t])) if bad}
        mine = [(q, x) for a, q, x in labels if a == i and i is not None]
        docs.append((lang or "", fails, 1 in [q for q, _ in mine], 1 in [x for _, x in mine]))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                early = sum(f in d[1] for d in mine) - len(gone)
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                out[part, order, k] = [len(left), len(gone), early,
                                       sum(d[1] == {f} for d in mine),
                                       sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(total[order[k - 1]])
    return out


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(ODD)]
    for i in range(100, 160):
        n = rng.choice([20, 120])
        t = " ".join(rng.choice(["Word", "word", "UP", "$x", *map(str, range(80))])
                     for _ in range(n))
        rows.append((i, t, rng.choice(["en", "de", None])))
    rows += [(rng.choice([None, 3, 105, 900, 901]), rng.choice(rows)[1], "en") for _ in range(40)]
    rows += rows[-6:]                                       # repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(100, 130)]
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    got = audit_filters(
        spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    have = {(r.part, r.filter_order, r.step): [r[m] for m in (*MEASURES, "shapley")]
            for r in got.collect()}
    assert have == audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(spark, docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    rows = audit_filters(spark, one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert {r.shapley for r in rows} == {0, 120}            # fails A only


# ---- BPE -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def bpe():
    return BpeVocabulary(BPE_FILE)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE_FILE)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "aab'sStTΣσς. \t\n\x1c\x85\xa0ẹ́́가ᄀ1٣-_é<|"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]
    return texts + ["<|startoftext|>a<|endoftext|><|endoftext|> b<|END", "a" * 5000, "ab" * 3000,
                    "don't can'T we'LL x'sy ''s", *[t or "" for t in ODD]]


def test_bpe_ids_of_the_library(bpe, library):
    texts = random_texts(4000)
    ids, first = Encoder(bpe, 1000).encode(texts)
    for t, a, b, x in zip(texts, first, first[1:],
                          library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == x.ids, t


def test_bpe_single_characters(bpe, library):
    texts = [chr(c) for c in range(1, 0x3000)]
    ids, first = Encoder(bpe, 10 ** 6).encode(texts)
    new = [t for t, a, b, x in zip(texts, first, first[1:],
                                   library.encode_batch(texts, add_special_tokens=False))
           if ids[a:b].tolist() != x.ids]
    # of letters younger than Python's tables
    assert all(__import__("unicodedata").category(t) == "Cn" for t in new)


def test_merges_of_one_index_are_those_of_each_word_alone(bpe):
    rng = random.Random(2)
    words = list({"".join(rng.choice("abetinr") for _ in range(rng.randrange(1, 14)))
                  for _ in range(500)} | {"a" * n for n in range(1, 40)})
    ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(bpe.left, bpe.right))}
    ids, starts = merge_words(words, bpe)
    for w, lo, hi in zip(words, starts, starts[1:]):
        raw = w.encode()
        s = [*bpe.inner[list(raw[:-1])], bpe.final[raw[-1]]] if len(raw) > 1 else \
            [bpe.final[raw[-1]]]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]:
            rank, i = min(pairs)
            s[i:i + 2] = [bpe.into[rank]]
        assert ids[lo:hi].tolist() == s


def test_bpe_tables(spark, bpe, library):
    texts = random_texts(200, 7) + [None]
    docs = spark.createDataFrame([(n, t, "kept") for n, t in enumerate(texts)],
                                 "doc_id long, text string, extra string")
    out = decode_ids(spark, encode_texts(spark, docs, bpe, slab_bytes=500), bpe)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    for n, t in enumerate(texts):
        x = library.encode(t or "", add_special_tokens=False)
        assert rows[n].ids == x.ids and rows[n].extra == "kept" and rows[n].text == t
        assert rows[n].decoded == library.decode(x.ids, skip_special_tokens=False)
    assert encode_texts(spark, docs.limit(0), bpe).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([-1, 10 ** 6, 320, None],)], "ids array<int>")
    assert [r.decoded for r in decode_ids(spark, odd, bpe).collect()] == [None, "", bpe.tokens[320]]


def test_bpe_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in op12_bpe_codec(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = library.encode(r.text or "", add_special_tokens=False)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(x.ids), sha(" ".join(map(str, x.ids))))
        assert g.decoded_sha256 == sha(library.decode(x.ids, skip_special_tokens=False))


# ---- importance resampling -------------------------------------------------------

def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                       re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_buckets_of_features():
    for t in (x or "" for x in ODD):
        words, grams = plain_features(t)
        n, found = feature_buckets(t.encode())
        assert n == len(words)
        assert sorted(found) == sorted(zlib.crc32(g.encode()) % 10000 for g in grams)


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(4)
    for gains in (rng.integers(-9000, 9000, 1000), np.zeros(1000, np.int64),
                  np.full(1000, -4096), np.full(1000, 4095)):
        counts = rng.integers(0, 5, (7, 1000)) * rng.integers(0, 3000, (7, 1000))
        assert (GainPlanes(gains).weights(counts) == counts @ gains).all()
    assert GainPlanes(gains).weights(np.zeros((0, 1000), np.int64)).shape == (0,)


def test_resample_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma1", "δέλτα", "eps", "ze-ta", "x"]
    texts = list(ODD) + [" ".join(rng.choices(vocabulary, k=rng.randrange(10, 60)))
                         for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[20]), (None, texts[21])] + [(30, texts[30])] * 5
    target = [" ".join(rng.choices(vocabulary[:3], k=40)) for _ in range(5)] + [None]

    def counts(ts):
        c = np.zeros(10000, np.int64)
        for t in ts:
            for g in plain_features(t)[1]:
                c[zlib.crc32(g.encode()) % 10000] += 1
        return c
    s, t = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (float(s.sum()) + 10000)
                                       / ((a + 1) * (float(t.sum()) + 10000))))
            for a, b in zip(s.tolist(), t.tolist())]
    expected = []
    for i, x in rows:
        words, grams = plain_features(x)
        w = sum(gain[zlib.crc32(g.encode()) % 10000] for g in grams)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))
        expected.append((i, len(words), len(grams), w, w + noise))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample(spark, docs, bench, percent=20).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    able = sorted((r for r in expected if r[1] >= 20),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 20 * len(able) // 100 + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(r[0], r[4]) for r in able[:len(drawn)]]


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resample(spark, docs, docs).count() == 0
    one = spark.createDataFrame([(1, None), (2, "a b")], docs.schema)
    assert {(r.doc_id, r.n_features, r.rank) for r in resample(spark, one, docs).collect()} == \
        {(1, 0, None), (2, 3, None)}


def test_ranks_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id"))
    out = ranked(spark, rows, [F.col("a").desc(), F.col("id").asc()], "r", partitions=9)
    got = sorted(out.collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [(r.a, r.id) for r in got] == sorted(((i % 7, i) for i in range(5000)),
                                                key=lambda x: (-x[0], x[1]))
    assert importance.noise(F.lit(1)) is not None
