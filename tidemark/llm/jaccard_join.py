"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams (five words, lower case, ASCII white space
between words).  Documents with equal sets form one *node*, so any number of
copies costs one node.  Nodes that share a MinHash band meet in a bucket;
inside a task the MinHash values of each pair are compared step by step and a
pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below ``tolerance``.  What is left is verified
exactly on the shingle sets.  Pairs are counted inside the task; only rows per
node leave it.

Scale: a bucket of more than ``block`` nodes is dealt out as pairs of blocks,
so no task holds more than two blocks of it.  Buckets with the same members
are kept once, a pair is judged only in its common bucket with the smallest
key.  Texts are fetched only for nodes that have a partner left after pruning.

Defined results: a null text counts as empty; all texts without a word are one
node (their sets are equal).  A text of one to four words has one shingle, all
its words.  Repeated rows are documents of the same node.  A null ``doc_id``
is kept; ``class_id`` is the smallest id of the class that is not null.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, packed, python_tasks, unpacked
from tidemark.llm.components import connected_components
from tidemark.llm.streams import lean, whole_groups
from tidemark.llm.words import U64, chunks, mix, shingles, words_of

BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS


def shingle_sets(texts: list[str], n: int):
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        hashes, first = shingles(words_of(texts[lo:hi]), n)
        for i in range(hi - lo):
            yield np.unique(hashes[first[i]:first[i + 1]])


def set_name(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def _minhash(sets: list[np.ndarray]) -> np.ndarray:
    """uint32 [sets, HASHES]; rows of empty sets are undefined."""
    rng = np.random.default_rng(20240517)
    mul = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
    out = np.zeros((len(sets), HASHES), dtype=np.uint32)
    full = np.flatnonzero([len(s) for s in sets])
    if len(full):
        joined = np.concatenate([sets[i] for i in full])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((joined * mul[k] + add[k]) >> U64(32), first)
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 [sets, BANDS]: one key per band, the band number mixed in."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key + v[:, :, r] + U64(0x9E3779B97F4A7C15))
    return mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketcher(n: int):
    def sketch(batches):
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            names, sizes, sigs, keys = [], [], [], []
            for lo, hi in chunks(texts):
                sets = list(shingle_sets(texts[lo:hi], n))
                sig = _minhash(sets)
                names += [set_name(s) for s in sets]
                sizes += [len(s) for s in sets]
                sigs += [row.tobytes() for row in sig]
                keys += [k if len(s) else k[:0] for k, s in zip(_band_keys(sig), sets)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "copy": b["copy"], "node": names, "n_shingles": sizes,
                                "sig": sigs, "keys": keys})
    return sketch


def fewest_matches(threshold: float, tolerance: float, step: int) -> dict[int, int]:
    """For n compared values the smallest number of equal ones at which
    P(similarity >= threshold) is still at least ``tolerance``: a Beta(m + 1,
    n - m + 1) posterior under a flat prior, as a sum of binomial terms."""
    out = {}
    for n in range(step, HASHES + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _pairs(block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        return np.triu_indices(len(block), 1)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _survivors(sig: np.ndarray, key: int, block: np.ndarray, same: bool,
               fewest: dict[int, int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that it owns and that pruning leaves."""
    keys = _band_keys(sig)
    a, b = _pairs(block, same)
    own_a, own_b = [a[:0]], [b[:0]]
    most = np.iinfo(np.int64).max
    for lo in range(0, len(a), 200_000):
        i, j = a[lo:lo + 200_000], b[lo:lo + 200_000]
        smallest = np.full(len(i), most)
        for k in range(BANDS):
            both = keys[i, k] == keys[j, k]
            smallest[both] = np.minimum(smallest[both], keys[i[both], k])
        i, j = i[smallest == key], j[smallest == key]
        equal = np.zeros(len(i), dtype=np.int32)
        for upto, least in fewest.items():
            cols = slice(upto - step, upto)
            equal += (sig[i, cols] == sig[j, cols]).sum(axis=1, dtype=np.int32)
            keep = equal >= least
            i, j, equal = i[keep], j[keep], equal[keep]
        own_a.append(i)
        own_b.append(j)
    return np.concatenate(own_a), np.concatenate(own_b)


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common shingles of each pair: products of 0/1 matrices over
    the shingles that occur in more than one set, some columns at a time."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                         for x, y in zip(i, j)], dtype=np.int64)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[col]
    row, col = row[use], number[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    wide = 4096
    for lo in range(0, int(shared.sum()), wide):
        s, e = np.searchsorted(col, [lo, lo + wide])
        m = np.zeros((len(sets), wide), dtype=np.float32)
        m[row[s:e], col[s:e] - lo] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _least_member(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Index of the smallest member linked, directly or not, to each of n."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            return least


BLOCK_KEYS = ["key", "lo", "hi"]
BLOCK_COLUMNS = "key long, lo int, hi int, blk int, node binary"


def _pruner(threshold: float, tolerance: float, step: int):
    fewest = fewest_matches(threshold, tolerance, step)

    def prune(batches):
        for f, starts in whole_groups(batches, BLOCK_KEYS):
            sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint32).reshape(len(f), HASHES)
            keep = np.zeros(len(f), dtype=bool)
            for s, e in zip(starts[:-1], starts[1:]):
                r = f.iloc[s]
                i, j = _survivors(sig[s:e], r["key"], f["blk"].to_numpy()[s:e],
                                  r["lo"] == r["hi"], fewest, step)
                keep[s + i] = keep[s + j] = True
            yield f.loc[keep, [*BLOCK_KEYS, "blk", "node"]]
    return prune


def _verifier(threshold: float, tolerance: float, step: int):
    fewest = fewest_matches(threshold, tolerance, step)

    def verify(batches):
        for f, starts in whole_groups(batches, BLOCK_KEYS, rows=1000):
            sig = np.frombuffer(b"".join(f["sig"]), dtype=np.uint32).reshape(len(f), HASHES)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in f["shingles"]]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            copies = f["copies"].to_numpy()
            docs, nodes = np.zeros(len(f), dtype=np.int64), np.zeros(len(f), dtype=np.int64)
            root = np.arange(len(f))
            for s, e in zip(starts[:-1], starts[1:]):
                r = f.iloc[s]
                i, j = _survivors(sig[s:e], r["key"], f["blk"].to_numpy()[s:e],
                                  r["lo"] == r["hi"], fewest, step)
                if not len(i):
                    continue
                both = _common(sets[s:e], i, j)
                good = both >= threshold * (size[s + i] + size[s + j] - both) - 1e-9
                i, j = i[good], j[good]
                for x, y in ((i, j), (j, i)):
                    np.add.at(docs, s + x, copies[s + y])
                    np.add.at(nodes, s + x, 1)
                root[s:e] = s + _least_member(e - s, i, j)
            linked = nodes > 0
            node = f["node"].to_numpy()
            yield pd.DataFrame({"node": node[linked], "root": node[root[linked]],
                                "links": docs[linked], "node_links": nodes[linked]})
    return verify


def _shingler(n: int):
    def cut(batches):
        for b in batches:
            names, sets = [], []
            for node, s in zip(b["node"], shingle_sets([t or "" for t in b["text"]], n)):
                if set_name(s) == bytes(node):        # a text of another hash: not it
                    names.append(bytes(node))
                    sets.append(s.tobytes())
            yield pd.DataFrame({"node": names, "shingles": sets})
    return cut


def text_hash() -> Column:
    """Names the text of a row; null counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _classes(spark: SparkSession, docs: DataFrame, n: int = 5, threshold: float = 0.8,
             tolerance: float = 1e-6, step: int = 16,
             block: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as (doc_id, copy, node), nodes with their component and links, and
    components with their smallest id, first row and number of documents."""
    python_tasks(spark)
    # ids as text: nulls among numbers would make them floating-point in the task
    sketch = materialize(spark, docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), text_hash().alias("copy"), "text")
        .mapInPandas(lean(_sketcher(n)), "doc_id string, copy binary, node binary, n_shingles int, "
                     "sig binary, keys array<long>")
        .withColumn("doc_id", F.col("doc_id").cast("long")), "sketch")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")
    nodes = materialize(spark, sketch.groupBy("node").agg(
        F.min(row).alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"),
        F.min("keys").alias("keys")), "nodes")

    # buckets of two or more nodes, one for all with the same members
    banded = nodes.select("node", F.explode("keys").alias("key"))
    buckets = (banded.groupBy("key").agg(F.count("*").alias("n"),
                                         F.bit_xor(F.xxhash64("node")).alias("members"))
               .where(F.col("n") >= 2)
               .groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    member = (banded.join(buckets, "key")
              .select("key", "node", blocks.alias("parts")).withColumn("blk", mine)
              .select("key", "node", "blk",
                      F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
              .select("key", F.least("blk", "other").alias("lo"),
                      F.greatest("blk", "other").alias("hi"), "blk", "node"))
    left = materialize(
        spark,
        member.join(nodes.select("node", "sig"), "node")
        .select(*BLOCK_KEYS, "blk", "node", "sig")
        .repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
        .mapInPandas(lean(_pruner(threshold, tolerance, step)), BLOCK_COLUMNS), "left")

    # texts of what is left, then the exact check
    wanted = left.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = (docs.select("doc_id", "text", text_hash().alias("copy"))
             .join(wanted, F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))
                   & (F.col("copy") == F.col("rep.copy")))
             .select("node", "text")
             .mapInPandas(lean(_shingler(n)), "node binary, shingles binary").dropDuplicates(["node"]))
    full = texts.join(nodes.select("node", "sig", "copies"), "node")
    links = materialize(
        spark,
        left.join(full, "node").select(*BLOCK_KEYS, "blk", "node", "sig", "copies", "shingles")
        .repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
        .mapInPandas(lean(_verifier(threshold, tolerance, step)),
                     "node binary, root binary, links long, node_links long"), "verified")

    parts = connected_components(spark, links.select(F.col("node").alias("a"),
                                                     F.col("root").alias("b")))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"),
                                       F.sum("node_links").alias("node_links"))
    each = (nodes.select("node", "rep", "copies").join(parts, "node", "left")
            .join(linked, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))
    classes = each.groupBy("component").agg(F.min("rep").alias("first"),
                                            F.sum("copies").alias("class_docs"))
    return sketch.select("doc_id", "copy", "node"), each, classes


def similar_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_text_links, class_docs``.

    ``n_links`` counts the other documents whose similarity is ``threshold``
    or more, ``n_text_links`` the other shingle sets; a class is a connected
    group of links, named by its smallest document id.
    """
    rows, each, classes = _classes(spark, docs, **options)
    info = each.join(classes, "component").select(
        "node", F.col("first.doc_id").alias("class_id"), "class_docs",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("node_links", F.lit(0)).alias("n_text_links"))
    return rows.select("doc_id", "node").join(info, "node").select(
        "doc_id", "class_id", "n_links", "n_text_links", "class_docs")


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows of a class but one: that of the smallest id,
    or any if its class has no id at all; of several texts under that id the one
    of the smallest hash.  Columns are those of ``docs``.
    """
    first = _classes(spark, docs.select("doc_id", "text"), **options)[2].select(
        F.col("first.doc_id").alias("kept"), F.col("first.copy").alias("of"))
    return (docs.select(F.col("doc_id").alias("id"), text_hash().alias("copy"),
                        packed(docs).alias("row"))
            .join(first, F.col("id").eqNullSafe(F.col("kept"))
                  & (F.col("copy") == F.col("of")), "left_semi")
            .dropDuplicates(["id", "copy"]).select(*unpacked("row", docs)))
