"""Language-model scores from a probabilistic suffix tree over characters.

The tree's states are contexts of 0 to ``DEPTH`` characters (A-Z lower-cased;
text boundaries are a symbol).  A context stays if its next-symbol
distribution diverges enough from that of the context one character shorter:
n * KL >= ``min_gain`` nats, n its number of occurrences; so do all shorter
contexts of one that stays.  There is no limit to their number.  A state's
distribution is smoothed with its parent's (Witten-Bell: as much weight as the
state has seen different symbols), down to the uniform one.  A
character is scored in the state of the longest retained suffix of the text
before it; a text's score is the sum of log10 probabilities of its characters
and its end, a probability over all texts.

Scale: counts cover all learning texts.  Tasks count their own texts, counts
are merged by aggregation.  The merged counts are dealt into buckets by the
``NEAR + 1`` symbols before the predicted one, so that a bucket has everything
the longer contexts need; only contexts of up to ``NEAR`` symbols (bounded by
the alphabet) come to the driver.  Texts are scored in chunks: the distinct
grams of a chunk are sent to their buckets, tested and scored there, and the
answers summed with the chunk's symbols.  Word counts for the base score stay
distributed: the ``heavy`` most frequent words (bounded) are looked up in the
task, the rest is joined by word.

Defined results: a null text counts as empty and has one token, its end.
Without learning texts all counts are zero and every symbol is equally likely.
Rows of equal id are scored one by one.  Characters beyond the ``SYMBOLS - 2``
most frequent share one symbol and are equally likely within it.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, python_tasks
from tidemark.llm.streams import give_back, group_starts, lean
from tidemark.llm.words import chunks

DEPTH, BITS = 5, 6
SYMBOLS = 1 << BITS                     # 0: text boundary, 1: any other character
NEAR = 2                                # depth up to which all contexts are known everywhere
SPREAD = 2654435761
MANY = 300_000                          # words a counting task holds before it passes them on
RUN = 1 << 19                           # grams made and sorted at once
SPARE = 63 - BITS * (DEPTH + 1)         # bits of a number free beside a gram
LOW = (1 << SPARE) - 1
CHUNK = 12_000_000                      # characters whose grams are asked for at once
PIECE = 16_384                          # grams of a request


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def _padded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, one byte each, behind DEPTH boundaries each and
    before one, and the length of each text."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = _ends(lengths)
    edge = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int8)
    edge[ends - 1 - lengths] += 1
    edge[ends - 1] -= 1
    out = np.zeros(len(edge), dtype=np.uint8)
    out[np.cumsum(edge, dtype=np.int8).view(bool)] = table[chars]
    return out, lengths


def _ends(lengths: np.ndarray) -> np.ndarray:
    """Index behind each padded text."""
    return np.cumsum(lengths + DEPTH + 1)


def _runs(symbols: np.ndarray, lengths: np.ndarray):
    """(index of the first symbol, which of the next are to be predicted, their
    grams), some at a time, of padded texts.  A gram is a symbol and the DEPTH
    before it, the nearest in the lowest bits."""
    last = _ends(lengths) - 1
    for lo in range(DEPTH, len(symbols), RUN):
        part = symbols[lo - DEPTH:lo + RUN]
        real = part[DEPTH:] != 0
        a, b = np.searchsorted(last, [lo, lo + RUN])
        real[last[a:b] - lo] = True
        gram = part[DEPTH:].astype(np.int64)
        for j in range(1, DEPTH + 1):
            gram |= part[DEPTH - j:-j].astype(np.int64) << (BITS * j)
        at = np.flatnonzero(real)
        yield lo, at, gram[at]


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])


def _unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting in place: faster here than ``np.unique``)."""
    values.sort()
    return values[_starts(values)]


def _distinct(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sorted distinct grams of padded texts."""
    return _unique(np.concatenate([_unique(grams) for _, _, grams in _runs(symbols, lengths)]))


def _by_place(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers that sort grams by bucket, then gram."""
    return _bucket(grams, buckets) << (63 - SPARE) | grams


# ---- counting -------------------------------------------------------------

def _count_words(batches):
    words: Counter = Counter()
    chars = np.zeros(0x110000, dtype=np.int64)

    def rows():
        return pd.DataFrame({"char": -1, "word": list(words), "n": list(words.values())})
    for b in batches:
        texts = [t if isinstance(t, str) else "" for t in b["text"]]
        for lo, hi in chunks(texts):
            points = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), dtype=np.uint32)
            seen = np.bincount(points)
            chars[:len(seen)] += seen
            for t in texts[lo:hi]:
                words.update(tokens(t))
            words[b""] += hi - lo                          # one end per text
            if len(words) > MANY:
                yield rows()
                words.clear()
    yield rows()
    chars[97:123] += chars[65:91]
    chars[65:91] = 0
    at = np.flatnonzero(chars)
    yield pd.DataFrame({"char": at.astype(np.int32), "word": [b""] * len(at), "n": chars[at]})


def _summed(counted: list[np.ndarray]) -> np.ndarray:
    """Grams with their counts in the ``SPARE`` low bits: one of each gram, sorted."""
    counted = np.concatenate(counted)
    counted.sort()
    grams = counted >> SPARE
    starts = _starts(grams)
    return grams[starts] << SPARE | np.add.reduceat(counted & LOW, starts)


def _gram_counter(table: np.ndarray):
    def count(batches):
        held, size, total = [], 0, 0                       # total: what no count exceeds

        def rows(counted):
            for lo in range(0, len(counted), MANY):
                part = counted[lo:lo + MANY]
                yield pd.DataFrame({"gram": part >> SPARE, "n": part & LOW})

        def padded():
            texts, n = [], 0
            for b in batches:
                for t in b["text"]:
                    texts.append(t if isinstance(t, str) else "")
                    n += len(texts[-1]) + DEPTH + 1
                    if n > RUN:
                        yield _padded(texts, table)
                        texts, n = [], 0
            if texts:
                yield _padded(texts, table)
        for symbols, lengths in padded():
            for _, _, grams in _runs(symbols, lengths):
                if total + len(grams) > LOW:
                    yield from rows(_summed(held))
                    held, size, total = [], 0, 0
                held.append(_summed([grams << SPARE | 1]))
                size += len(held[-1])
                total += len(grams)
                if size > 6 * MANY:
                    held = [_summed(held)]
                    size = len(held[0])
                    if size > 4 * MANY:
                        yield from rows(held[0])
                        held, size, total = [], 0, 0
        if held:
            yield from rows(_summed(held))
    return count


# ---- the tree, by bucket ----------------------------------------------------

def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Grams of the same ``NEAR + 1`` symbols before the predicted one share a bucket."""
    near = (gram >> BITS) & ((1 << BITS * (NEAR + 1)) - 1)
    return ((near * SPREAD) >> 16) % buckets


def _bucket_column(buckets: int):
    near = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << BITS * (NEAR + 1)) - 1))
    return F.pmod(F.shiftright(near * F.lit(SPREAD), 16), F.lit(buckets)).cast("int")


class Level:
    """Counts of the contexts of one depth: ``keys`` have the predicted symbol
    in the low bits, ``contexts`` lack it."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, inverse = np.unique(keys, return_inverse=True)
        self.n = np.bincount(inverse, weights=n, minlength=len(self.keys))
        self.contexts, self.owner = np.unique(self.keys >> BITS, return_inverse=True)
        self.total = np.bincount(self.owner, weights=self.n, minlength=len(self.contexts))
        self.seen = np.bincount(self.owner, minlength=len(self.contexts))

    def passing(self, above: Level, depth: int, min_gain: float) -> np.ndarray:
        """Contexts that pass the divergence test: log likelihood won over the
        context one symbol shorter, n * KL."""
        short = (1 << BITS * (depth - 1)) - 1
        up = np.searchsorted(above.keys, self.keys & ((short << BITS) | (SYMBOLS - 1)))
        ptotal = above.total[np.searchsorted(above.contexts, self.contexts & short)][self.owner]
        gain = np.bincount(self.owner, minlength=len(self.contexts), weights=self.n * np.log(
            self.n * ptotal / (self.total[self.owner] * above.n[up])))
        return gain >= min_gain

    def smoothed(self, grams: np.ndarray, depth: int, kept: np.ndarray,
                 before: np.ndarray) -> np.ndarray:
        """Probabilities of the grams' last symbols: those of the retained
        contexts, elsewhere those ``before``."""
        if not len(self.contexts):
            return before
        context = (grams >> BITS) & ((1 << BITS * depth) - 1)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        here = (self.contexts[at] == context) & kept[at]
        key = grams & ((1 << BITS * (depth + 1)) - 1)
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        n = np.where(self.keys[k] == key, self.n[k], 0.0)
        weight = np.maximum(self.seen[at], 1)
        return np.where(here, (n + weight * before) / (self.total[at] + weight), before)


def _levels(keys: np.ndarray, n: np.ndarray, lo: int, hi: int) -> dict[int, Level]:
    return {d: Level(keys & ((1 << BITS * (d + 1)) - 1), n) for d in range(lo, hi + 1)}


def _retained(levels: dict[int, Level], above: Level | None, lo: int, hi: int, below: np.ndarray,
              min_gain: float) -> dict[int, np.ndarray]:
    """Contexts of depths ``lo`` to ``hi`` that pass, or have a longer one that
    does; ``below`` are the contexts of depth ``hi`` that have one."""
    out = {}
    for d in range(hi, lo - 1, -1):
        parent = levels.get(d - 1, above)
        kept = np.isin(levels[d].contexts, below)
        kept |= levels[d].passing(parent, d, min_gain) if d else True
        out[d] = kept
        below = levels[d].contexts[kept] & ((1 << BITS * max(d - 1, 0)) - 1)
    return out


def _tester(near: Level, min_gain: float):
    """``context, depth, n``: contexts of NEAR symbols with longer ones that
    are retained, and the number of these by depth."""
    def test(batches):
        for _, grams, n, _ in _by_bucket(batches):
            levels = _levels(grams, n, NEAR + 1, DEPTH)
            kept = _retained(levels, near, NEAR + 1, DEPTH, np.zeros(0, np.int64),
                             min_gain)
            for d, level in levels.items():
                context, n_kept = np.unique(
                    level.contexts[kept[d]] & ((1 << BITS * NEAR) - 1), return_counts=True)
                yield pd.DataFrame({"context": context, "depth": d, "n": n_kept})
    return test


def _by_bucket(batches):
    """(bucket, grams, counts, requests) of rows sorted by bucket and ``chunk``;
    the learned grams of a bucket come first, with chunk -1, and are given
    before its requests, a frame at a time (None once, without any)."""
    bucket, grams, n, given = None, [], [], False

    def learned():
        return (bucket, np.concatenate([*grams, np.zeros(0, np.int64)]).astype(np.int64),
                np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64))
    for b in batches:
        starts = group_starts(b, ["bucket"])
        for s, e in zip(starts[:-1], starts[1:]):
            f = b.iloc[s:e]
            if f["bucket"].iloc[0] != bucket:
                if bucket is not None and not given:
                    yield (*learned(), None)
                bucket, grams, n, given = f["bucket"].iloc[0], [], [], False
            own = (f["chunk"] < 0).to_numpy()
            grams += list(f["grams"][own])
            n += list(f["n"][own])
            if not own.all():
                if not given:
                    now = learned()
                yield (*now, f[~own])
                given = True
    if bucket is not None and not given:
        yield (*learned(), None)


def _answerer(near: Level, lowest: np.ndarray, min_gain: float):
    """log10 probabilities of requested grams, in the order of the request."""
    def answer(batches):
        last = None
        for bucket, grams, n, asked in _by_bucket(batches):
            if asked is None:
                continue
            if bucket != last:
                levels = _levels(grams, n, NEAR + 1, DEPTH)
                kept = _retained(levels, near, NEAR + 1, DEPTH, np.zeros(0, np.int64),
                                 min_gain)
                last = bucket
            for lo in range(0, len(asked), 8):             # bounds the arrays below
                part = asked.iloc[lo:lo + 8]
                wanted = [_unspell(x) for x in part["ask"]]
                ask = np.concatenate(wanted)
                p = lowest[ask & ((1 << BITS * (NEAR + 1)) - 1)]
                for d, level in levels.items():
                    p = level.smoothed(ask, d, kept[d], p)
                logs = np.split(np.log10(p).astype(np.float32),
                                np.cumsum([len(w) for w in wanted])[:-1])
                yield pd.DataFrame({"chunk": part["chunk"], "bucket": part["bucket"],
                                    "piece": part["piece"], "logs": [x.tobytes() for x in logs]})
    return answer


def _spell(grams: np.ndarray) -> bytes:
    """Sorted grams as differences, byte by byte: high bytes are mostly zero."""
    return np.diff(grams, prepend=0).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unspell(spelled: bytes) -> np.ndarray:
    low = np.frombuffer(spelled, dtype=np.uint8).reshape(5, -1)
    out = np.zeros((low.shape[1], 8), dtype=np.uint8)
    out[:, :5] = low.T
    return np.cumsum(out.view(np.int64).ravel())


def _adder():
    """``row, score`` out of a chunk's symbols and the answers to its requests,
    sorted by chunk, bucket and piece, the symbols (bucket -1) first."""
    def total(symbols, lengths, row, buckets, answers):
        lengths = np.asarray(lengths, np.int64)
        ends = _ends(lengths)
        symbols = np.frombuffer(pa.decompress(symbols, int(ends[-1]), codec="zstd"), np.uint8)
        # every run's grams as numbers of its distinct ones, from 1; then, in place, as their logs
        code, held = np.zeros(len(symbols), dtype=np.int32), []
        for lo, at, grams in _runs(symbols, lengths):
            placed = np.sort(grams << SPARE | at)
            grams = placed >> SPARE
            starts = _starts(grams)
            code[lo:lo + RUN][placed & LOW] = np.repeat(
                np.arange(1, len(starts) + 1, dtype=np.int32), np.diff(starts, append=len(grams)))
            held.append((lo, grams[starts]))
        grams = _unique(np.concatenate([own for _, own in held]))
        logs = np.empty(len(grams), dtype=np.float32)
        logs[np.argsort(_by_place(grams, buckets))] = np.concatenate(
            [np.frombuffer(x, np.float32) for x in answers])
        value = code.view(np.float32)
        for lo, own in held:
            of = np.concatenate([np.zeros(1, np.float32), logs[np.searchsorted(grams, own)]])
            value[lo:lo + RUN] = of[code[lo:lo + RUN]]
        first = ends - lengths - DEPTH - 1
        score = (np.add.reduceat(value, first, dtype=np.float64)
                 - log10(0x110000) * np.add.reduceat(symbols == 1, first, dtype=np.int64))
        return pd.DataFrame({"row": np.arange(row, row + len(score)), "score": score})

    def add(batches):
        held, answers = None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.bucket < 0:
                    if held is not None:
                        yield total(*held, answers)
                        give_back()
                    held, answers = (r.symbols, r.lengths, r.row, r.buckets), []
                else:
                    answers.append(r.logs)
        if held is not None:
            yield total(*held, answers)
    return add


# ---- the operator ---------------------------------------------------------

WORK = ("row long, doc_id long, n_tokens long, known long, base double, rare array<binary>, "
        "times array<int>, chunk long, symbols binary, lengths array<int>, buckets int, "
        "bucket int, piece int, ask binary")


def _preparer(table: np.ndarray, heavy: dict[bytes, int], buckets: int):
    """Rows of three kinds: word figures of each text; a chunk of texts as
    symbols; the distinct grams of a chunk, by bucket."""
    logs = {w: log10(n + 1) for w, n in heavy.items()}
    names = [c.split()[0] for c in WORK.split(", ")]

    def frame(**columns):
        n = len(next(iter(columns.values())))
        return pd.DataFrame({c: pd.Series(list(columns.get(c, [None] * n)), dtype=object)
                             for c in names})

    def whole(row, packed):
        symbols, lengths = (np.concatenate(x) for x in zip(*packed))
        packed.clear()
        yield frame(row=[row], chunk=[row], lengths=[lengths], buckets=[buckets],
                    symbols=[pa.compress(symbols, codec="zstd", asbytes=True)])
        placed = np.sort(_by_place(_distinct(symbols, lengths), buckets))
        grams, where = placed & ((1 << 63 - SPARE) - 1), placed >> (63 - SPARE)
        out = []
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        for s, e in zip(starts, np.append(starts[1:], len(where))):
            out += [(int(where[s]), k, _spell(grams[i:min(i + PIECE, e)]))
                    for k, i in enumerate(range(s, e, PIECE))]
        yield frame(chunk=[row] * len(out), bucket=[x[0] for x in out], piece=[x[1] for x in out],
                    ask=[x[2] for x in out])

    def prepare(batches):
        row = TaskContext.get().partitionId() << 40
        held, size, first = [], 0, row                     # of the chunk, as symbols

        def hold(texts):
            held.extend(_padded(texts[lo:hi], table) for lo, hi in chunks(texts))
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            total, known, base, rare, times = [], [], [], [], []
            for t in texts:
                words = [*tokens(t), b""]
                found = list(map(logs.get, words))
                other = Counter([w for w, x in zip(words, found) if x is None]) \
                    if None in found else {}
                total.append(len(words))
                known.append(total[-1] - sum(other.values()))
                base.append(sum(filter(None, found), 0.0))
                rare.append(list(other))
                times.append(list(other.values()))
            ids = [None if pd.isna(i) else int(i) for i in b["doc_id"]]
            yield frame(row=np.arange(row, row + len(b)), doc_id=ids,
                        n_tokens=total, known=known, base=base, rare=rare, times=times)
            lo = 0
            for i, t in enumerate(texts):
                if size and size + len(t) > CHUNK:
                    hold(texts[lo:i])
                    yield from whole(first, held)
                    give_back()
                    first, size, lo = row + i, 0, i
                size += len(t) + DEPTH + 1
            hold(texts[lo:])
            row += len(b)
        if held:
            yield from whole(first, held)
    return prepare


def score_documents(spark: SparkSession, docs: DataFrame, learn: DataFrame,
                    min_gain: float = 4.0, heavy: int = 1 << 16,
                    bucket_grams: int = 100_000) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of ``docs``.

    ``learn`` has the learning texts; the base is the smoothed word unigram
    model of the same texts.
    """
    python_tasks(spark)
    learn, docs = learn.select("text"), docs.select("doc_id", "text")
    counts = materialize(
        spark, learn.mapInPandas(lean(_count_words), "char int, word binary, n long")
        .groupBy("char", "word").agg(F.sum("n").alias("n")), "words")
    words = counts.where(F.col("char") < 0).select("word", "n")
    n_all, v_all = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    frequent = counts.where(F.col("char") >= 0).orderBy(F.desc("n"), "char").limit(SYMBOLS - 2)
    table = np.ones(0x110000, dtype=np.uint8)
    for i, r in enumerate(frequent.select("char").collect()):
        table[r[0]] = i + 2
    table[65:91] = table[97:123]

    grams = materialize(
        spark, learn.mapInPandas(lean(_gram_counter(table)), "gram long, n long")
        .groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    buckets = max(16, -(-grams.count() // bucket_grams))
    learned = materialize(
        spark, grams.select(_bucket_column(buckets).alias("bucket"), "gram", "n",
                            F.pmod(F.xxhash64("gram"), F.lit(128)).alias("sub"))
        .groupBy("bucket", "sub").agg(F.collect_list("gram").alias("grams"),
                                      F.collect_list("n").alias("n"))
        .select("bucket", F.lit(-1).cast("long").alias("chunk"), "grams", "n"), "learned")

    # contexts of up to NEAR symbols: bounded by the alphabet, not by the texts
    near = grams.groupBy(F.col("gram").bitwiseAND(F.lit(SYMBOLS ** (NEAR + 1) - 1)).alias("key")) \
        .agg(F.sum("n").alias("n")).toArrow()
    levels = _levels(near.column("key").to_numpy().astype(np.int64),
                     near.column("n").to_numpy().astype(np.int64), 0, NEAR)
    below = (learned.repartition("bucket").sortWithinPartitions("bucket")
             .mapInPandas(lean(_tester(levels[NEAR], min_gain)),
                          "context long, depth int, n long")
             .groupBy("context").agg(F.sum("n").alias("n")).toArrow())
    kept = _retained(levels, None, 0, NEAR, below.column("context").to_numpy().astype(np.int64),
                     min_gain)
    lowest = np.full(SYMBOLS ** (NEAR + 1), 1 / SYMBOLS)
    for d, level in levels.items():
        lowest = level.smoothed(np.arange(len(lowest)), d, kept[d], lowest)

    top = (words.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(heavy)
           .collect())                                          # bounded by heavy
    work = materialize(
        spark, docs.mapInPandas(
            lean(_preparer(table, {bytes(r[0]): r[1] for r in top}, buckets)), WORK), "work")
    scored = work.where(F.col("chunk").isNull())
    asked = work.where(F.col("ask").isNotNull()).select("bucket", "chunk", "piece", "ask")
    whole = work.where(F.col("symbols").isNotNull())
    # a bucket's table goes to as many tasks as its requests need
    splits = max(1, -(-whole.count() // 256))
    part = F.pmod(F.xxhash64("chunk"), F.lit(splits)).cast("int")
    both = asked.withColumn("split", part).unionByName(
        learned.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))),
        allowMissingColumns=True)
    answers = (both.withColumn("bucket", F.col("bucket") + F.col("split") * F.lit(buckets))
               .repartition("bucket").sortWithinPartitions("bucket", "chunk")
               .select("bucket", "chunk", "piece", "ask", "grams", "n")
               .mapInPandas(lean(_answerer(levels[NEAR], lowest, min_gain)),
                            "chunk long, bucket int, piece int, logs binary")
               .withColumn("bucket", F.pmod("bucket", F.lit(buckets))))
    scores = materialize(
        spark, whole.select("chunk", F.lit(-1).alias("bucket"), "row", "symbols", "lengths",
                            "buckets")
        .unionByName(answers.withColumns({"row": F.lit(0), "buckets": F.lit(buckets)}),
                     allowMissingColumns=True)
        .repartition("chunk").sortWithinPartitions("chunk", "bucket", "piece")
        .select("bucket", "row", "symbols", "lengths", "buckets", "logs")
        .mapInPandas(lean(_adder()), "row long, score double"), "scores")

    rest = (scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
            .select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
            .join(words, "word")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest"),
                                F.sum("times").alias("found")))
    norm = log10(n_all + v_all + 1)
    return (scored.select("row", "doc_id", "n_tokens", "known", "base").join(scores, "row")
            .join(rest, "row", "left")
            .select("doc_id", "n_tokens",
                    (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
                    F.lit(int(n_all)).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rest", F.lit(0.0))
                     - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score"))
