"""Byte-pair encoding and decoding over a pair occurrence index.

The vocabulary is a tokenizer file (JSON) of the word-end kind: texts are
normalised (NFC, white space, lower case), cut into words, a word's UTF-8 bytes
are its first symbols, the last one marked as the end.  The file is read,
never trained; what it asks for is checked when it is read.

Encoding works on the distinct words that a task meets, a slab of texts at a
time.  All symbols of the slab's new words lie in one array.  An index maps
each pair that has a rank to all its positions; the active ranks (those with
positions) are applied in ascending order: every position of the pair that is
still valid is merged, and the new pairs to its left and right enter the lists
of their ranks.  A pair can only make pairs of higher rank (checked when the
file is read), so each word is merged as it would be by itself.

Rows are independent: Spark deals out the texts, nothing is shuffled, and a
task holds one slab and the pieces between white space it has met, with their
ids, until they are more than ``cache_pieces``.

Defined results: null and empty texts have no ids; the file's special tokens
are found in texts as such and are one id each.  Decoding joins tokens by a
space, as the file names no decoder; null lists decode to null, ids outside
the vocabulary to nothing.  Extra columns pass unchanged.  Letters and digits are
those of Python's Unicode tables (15.1); a character added to Unicode later may
be cut differently from a library with newer tables.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import python_tasks
from tidemark.llm.streams import lean

# Unicode white space, as the file's \s means it (without U+001C to U+001F)
SPACE = r"\t-\r \x85\xa0  -     　"
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = re.compile(f"[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves,
    the others by code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def characters(category: str) -> str:
    """Ranges of the code points of a Unicode category, for a character class."""
    inside = np.array([unicodedata.category(chr(c))[0] == category for c in range(0x110000)])
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return "".join(f"\\U{lo:08x}-\\U{hi - 1:08x}" for lo, hi in zip(edge[::2], edge[1::2]))


class BpeVocabulary:
    """Tokens, merges and the rules for cutting words of a tokenizer file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        cut, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]
                or spec["decoder"] is not None or spec["post_processor"] is not None
                or spec["normalizer"]["normalizers"][1]["pattern"]["Regex"] != r"\s+"
                or (cut["behavior"], cut["invert"]) != ("Removed", True)
                or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]
                or model["dropout"] or model["byte_fallback"] or model["ignore_merges"]
                or model["continuing_subword_prefix"] or not model["end_of_word_suffix"]):
            raise ValueError("a byte-level BPE file with word ends and no decoder is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        parts, made = np.zeros((len(model["merges"]), 3), dtype=np.int64), {}
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            parts[rank] = vocab[x], vocab[y], vocab[x + y]
            made[vocab[x + y]] = rank                       # the last merge that makes it
        self.left, self.right, self.into = parts.T.copy()
        key = self.left * self.size + self.right
        self.rank = np.argsort(key)
        self.key = key[self.rank]
        last = np.full(self.size, -1)
        last[list(made)] = list(made.values())
        late = np.maximum(last[self.left], last[self.right]) >= np.arange(len(parts))
        if late.any() or (np.diff(self.key) == 0).any():
            raise ValueError(f"merge {int(np.argmax(late))} has a part that it or a later merge "
                             "makes, or a pair has two merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
               for t in spec["added_tokens"]):
            raise ValueError("special tokens must be plain strings of the raw text")
        self.cut = (cut["pattern"]["Regex"].replace(r"\s", SPACE)
                    .replace(r"[\p{L}]", f"[{characters('L')}]").replace(r"\p{L}", characters("L"))
                    .replace(r"[\p{N}]", f"[{characters('N')}]").replace(r"\p{N}", characters("N")))
        self.tokens = [""] * (max([self.size - 1, *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 without one."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)


class PairIndex:
    """Positions of each pair that has a rank, and the ranks that have any."""

    def __init__(self):
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        some = np.flatnonzero(ranks >= 0)
        if not len(some):
            return
        ranks, positions = ranks[some], positions[some]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ranks)]):
            rank = int(ranks[lo])
            if rank not in self.positions:
                self.positions[rank] = []
                heapq.heappush(self.active, rank)
            self.positions[rank].append(positions[lo:hi])

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        # overlapping pairs are merged leftmost first
        return rank, np.sort(np.concatenate(self.positions.pop(rank)))


def _apart(positions: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of two equal symbols, those left when each symbol is used once."""
    kept, used = [], set()
    for i in positions.tolist():
        if i not in used:
            kept.append(i)
            used.add(int(right[i]))
    return np.array(kept, dtype=np.int64)


def merge_words(words: list[str], vocabulary: BpeVocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and where each word begins (one
    more at the end), by one pair occurrence index over all of them."""
    spelled = [w.encode("utf-8") for w in words]
    first = np.concatenate([[0], np.cumsum([len(w) for w in spelled])]).astype(np.int64)
    raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
    n = len(raw)
    sym = vocabulary.inner[raw]
    lasts = first[1:] - 1
    sym[lasts] = vocabulary.final[raw[lasts]]
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)     # neighbours, -1: none
    right[lasts] = -1
    left[first[:-1]] = -1
    index = PairIndex()
    pairs = np.flatnonzero(right >= 0)
    index.add(vocabulary.ranks(sym[pairs], sym[pairs + 1]), pairs)
    while index.active:
        rank, at = index.lowest()
        a, b, into = vocabulary.left[rank], vocabulary.right[rank], vocabulary.into[rank]
        nxt = right[at]
        # one of the two may have been merged meanwhile
        at = at[(sym[at] == a) & (nxt >= 0) & (sym[nxt] == b)]
        if a == b:
            at = _apart(at, right)
        gone = right[at]
        after, before = right[gone], left[at]
        sym[at], sym[gone] = into, -1
        right[at] = after
        here = after >= 0
        left[after[here]] = at[here]
        index.add(vocabulary.ranks(sym[at[here]], sym[after[here]]), at[here])
        before = before[before >= 0]
        index.add(vocabulary.ranks(sym[before], sym[right[before]]), before)
    kept = sym >= 0
    return sym[kept].astype(np.int32), np.concatenate([[0], np.cumsum(kept)])[first]


def pieces(text: str) -> list[str]:
    """A text between white space.  No rule of the file reaches across it."""
    if SEPARATORS.search(text):
        return [p for p in SPACES.split(text) if p]
    return text.split()


def normal(piece: str) -> str:
    # capital sigma is lower-cased alike at the end of a word and inside
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


class Encoder:
    """Ids of pieces between white space, remembered over the slabs of a task."""

    def __init__(self, vocabulary: BpeVocabulary, cache_pieces: int):
        self.vocabulary, self.cache = vocabulary, cache_pieces
        self.word = re.compile(vocabulary.cut)
        self.special = (re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")")
                        if vocabulary.special else None)
        self.hint = [s[:2] for s in vocabulary.special]
        self.clear()

    def clear(self):
        self.at: dict = defaultdict(count().__next__)     # piece -> number
        self.ids = np.zeros(0, np.int32)                  # of all pieces, one after the other
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _parts(self, text: str) -> list:
        """Pieces of a text; a special token is the number of its id."""
        if not any(h in text for h in self.hint):
            return pieces(text)
        out: list = []
        for part in self.special.split(text):
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            else:
                out += pieces(part)
        return out

    def _learn(self, new: list) -> None:
        """Ids of pieces that were not met before: words of all of them first,
        special tokens as words of their own."""
        number: dict = defaultdict(count().__next__)
        cuts, many = [], []
        for p in new:
            before = len(cuts)
            if isinstance(p, int):
                cuts.append(number[p])
            elif p.isascii() and p.isalpha():
                cuts.append(number[p.lower()])
            else:
                cuts += [number[w] for w in self.word.findall(normal(p))]
            many.append(len(cuts) - before)
        special = [(k, w) for k, w in enumerate(number) if isinstance(w, int)]
        ids, begin = merge_words([" " if isinstance(w, int) else w for w in number],
                                 self.vocabulary)
        for k, w in special:                              # a blank is one symbol: its place
            ids[begin[k]] = w
        cut, n_words = np.array(cuts, dtype=np.int64), np.array(many, dtype=np.int64)
        sizes = np.diff(begin)[cut]
        to = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(begin[cut] - to[:-1], sizes) + np.arange(to[-1])]
        ends = np.concatenate([[0], np.cumsum(n_words)])
        self.start = np.concatenate([self.start, len(self.ids) + to[ends[:-1]]])
        self.length = np.concatenate([self.length, to[ends[1:]] - to[ends[:-1]]])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin (one more at the end)."""
        if len(self.at) > self.cache:
            self.clear()
        known, at = len(self.at), self.at
        used = []
        for t in texts:
            used.append(np.array([at[p] for p in self._parts(t)] if t else [], dtype=np.int64))
        if len(at) > known:
            self._learn(list(islice(at, known, None)))
        which = np.concatenate([np.zeros(0, np.int64), *used])
        n = self.length[which]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.start[which] - to[:-1], n) + np.arange(to[-1])]
        return ids, to[np.concatenate([[0], np.cumsum([len(u) for u in used])]).astype(np.int64)]


def _ddl(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])


def _encoder(vocabulary: BpeVocabulary, slab_bytes: int, cache_pieces: int):
    def encode(batches):
        encoder = Encoder(vocabulary, cache_pieces)

        def slab(held):
            texts = [t for b in held for t in b.column(b.schema.names.index("text")).to_pylist()]
            ids, first = encoder.encode(texts)
            lo = 0
            for b in held:
                hi = lo + b.num_rows
                column = pa.ListArray.from_arrays(
                    pa.array(first[lo:hi + 1] - first[lo], pa.int32()),
                    pa.array(ids[first[lo]:first[hi]], pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, column],
                                                 names=[*b.schema.names, "ids"])
                lo = hi

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= slab_bytes:
                yield from slab(held)
                held, size = [], 0
        if held:
            yield from slab(held)
    return encode


def _decoder(vocabulary: BpeVocabulary, ids: str, into: str):
    spelling = [t.encode("utf-8") + b" " for t in vocabulary.tokens]

    def decode(batches):
        letters = np.frombuffer(b"".join(spelling), dtype=np.uint8)
        length = np.array([len(s) for s in spelling] + [0], dtype=np.int64)
        first = np.cumsum(length) - length
        nothing = len(spelling)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids))
            values = lists.flatten().fill_null(nothing).to_numpy(zero_copy_only=False)
            values = np.where((values < 0) | (values > nothing), nothing, values)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            n = length[values]
            to = np.concatenate([[0], np.cumsum(n)])
            out = letters[np.repeat(first[values] - to[:-1], n) + np.arange(to[-1])].tobytes()
            cut = to[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
            texts = [None if gone else out[s:max(s, e - 1)].decode("utf-8")
                     for s, e, gone in zip(cut, cut[1:], lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, into])
    return decode


SLAB_BYTES, CACHE_PIECES = 8_000_000, 300_000


def encode_texts(spark: SparkSession, docs: DataFrame, vocabulary: BpeVocabulary,
                 slab_bytes: int = SLAB_BYTES, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """``docs`` (with a ``text``, without an ``ids`` column) plus ``ids array<int>``."""
    python_tasks(spark)
    return docs.mapInArrow(lean(_encoder(vocabulary, slab_bytes, cache_pieces)),
                           _ddl(docs, "ids array<int>"))


def decode_ids(spark: SparkSession, encoded: DataFrame, vocabulary: BpeVocabulary,
               ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` plus the tokens of the column ``ids``, joined by spaces."""
    python_tasks(spark)
    return encoded.mapInArrow(lean(_decoder(vocabulary, ids, into)), _ddl(encoded, f"`{into}` string"))


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: BpeVocabulary) -> DataFrame:
    """``docs`` without its ``text``, plus ``ids`` and ``decoded``: both
    directions in the same task, so that ids cross to Python once and texts
    do not come back."""
    python_tasks(spark)
    encode = _encoder(vocabulary, SLAB_BYTES, CACHE_PIECES)
    decode = _decoder(vocabulary, "ids", "decoded")

    def code(batches):
        for b in decode(encode(batches)):
            yield b.drop_columns(["text"])
    return docs.mapInArrow(lean(code), _ddl(docs.drop("text"), "ids array<int>, decoded string"))
