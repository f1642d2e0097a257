"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

Encoding marks spaces, cuts a text into marked words (no piece crosses into
the next word, which is checked when the vocabulary is read), and finds for
every distinct word the segmentation with the highest sum of piece scores.
The distinct new words of a batch are sorted, which lays them out as a
depth-first walk of their trie: a word keeps the forward scores of the prefix
it shares with the word before and computes only the rest.  Found
segmentations are kept, up to ``cache_words`` words of a task.

The vocabulary (pieces, scores, kinds) is read from a SentencePiece model
file; it is never trained here.  The search maximises the file's scores, also
where the file's pieces were found by merging.  Characters without a piece
become byte pieces, so that decoding restores every text exactly; a literal
word mark (U+2581) is spelled in bytes for the same reason.

Rows are independent: Spark deals out the texts, nothing is shuffled, and the
vocabulary (bounded by the model file) travels with the tasks.

Defined results: null and empty texts have no pieces; null piece lists decode
to null; ids outside the vocabulary, control and unknown pieces decode to
nothing; bytes that are not UTF-8 decode to U+FFFD.  Equal scores: the longer
last piece wins.  Extra columns pass unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import python_tasks
from tidemark.llm.streams import lean

MARK = "▁"
LITERAL = "\udfff"            # stands for a literal mark; cannot occur in a text
UNKNOWN_PENALTY = 10.0
LETTERS = re.compile(r"[^\W\d_²³¹]+")
WORD = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
SHORT_WORD = re.compile(
    rf"{MARK}*[^\W\d_²³¹]+|{MARK}*(?:(?![{MARK}\n])[\W\d_²³¹])+|{MARK}+|\n")


class Vocabulary:
    """Pieces of a SentencePiece model with the tables both directions need."""

    def __init__(self, model_file: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.spelling: list[bytes] = []
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.spelling.append(bytes([value]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.spelling.append(b"")
            else:
                self.pieces[piece] = (i, m.get_score(i))
                self.spelling.append(piece.replace(MARK, " ").encode())
        crossing = [p for p in self.pieces if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing or len(set(self.bytes)) < 256:
            raise ValueError("a vocabulary with byte pieces is needed, whose pieces neither hold "
                             f"a word mark behind another character nor a new line: {crossing[:3]}")
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        # last character first, for the search backwards from each position:
        # character -> (next characters, id of the piece or None, its score)
        self.backward: dict = {}
        for piece in sorted(self.pieces, key=len):
            at = self.backward
            for c in piece[:0:-1]:
                at = at.setdefault(c, ({}, None, 0.0))[0]
            deeper = at.get(piece[0], ({},))[0]
            at[piece[0]] = (deeper, *self.pieces[piece])
        # words are also cut between letters and other characters, if no piece mixes them
        mixed = any(len({bool(LETTERS.match(c)) for c in p.lstrip(MARK)}) > 1
                    for p in self.pieces)
        self.words = WORD if mixed else SHORT_WORD


def segment_sorted(words: list[str], vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
    """Ids of the best segmentations of sorted words, one after the other, and
    the number of ids of each word."""
    flat, counts = [], []
    root, unknown, spell = vocabulary.backward, vocabulary.unknown, vocabulary.bytes
    size = max(map(len, words), default=0) + 1
    best, last, came = [0.0] * size, [None] * size, [0] * size    # by position
    before = ""
    for word in words:
        n = len(word)
        shared, upto = 0, min(len(before), n)
        while shared < upto and before[shared] == word[shared]:
            shared += 1
        for end in range(shared + 1, n + 1):
            at = end - 1
            top, piece, start = best[at] + unknown, None, at
            found = root.get(word[at])
            while found is not None:
                node, i, score = found
                if i is not None:
                    score += best[at]
                    if score >= top:
                        top, piece, start = score, i, at
                if not node or not at:
                    break
                at -= 1
                found = node.get(word[at])
            best[end], last[end], came[end] = top, piece, start
        before = word
        ids, end = [], n
        while end:
            piece = last[end]
            if piece is None:
                c = word[end - 1]
                ids += [spell[x] for x in reversed((MARK if c == LITERAL else c).encode())]
            else:
                ids.append(piece)
            end = came[end]
        flat += ids[::-1]
        counts.append(len(ids))
    return flat, counts


def marked_words(text: str, vocabulary: Vocabulary) -> list[str]:
    if not text:
        return []
    return vocabulary.words.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))


def _encoder(vocabulary: Vocabulary, cache_words: int):
    def encode(batches):
        index: dict[str, int] = defaultdict(count().__next__)
        starts, lengths, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if len(index) > cache_words:
                index = defaultdict(count().__next__)
                starts, lengths, flat = starts[:0], lengths[:0], flat[:0]
            known = len(index)
            used, sizes = [], []
            for t in texts:
                found = np.array([index[w] for w in marked_words(t, vocabulary)], dtype=np.int64)
                sizes.append(len(found))
                used.append(found)
            new = list(islice(index, known, None))
            order = sorted(range(len(new)), key=new.__getitem__)
            ids, n = segment_sorted([new[k] for k in order], vocabulary)
            n = np.array(n, dtype=np.int64)
            at, many = np.zeros((2, len(new)), dtype=np.int64)
            at[order], many[order] = len(flat) + np.cumsum(n) - n, n
            starts, lengths = np.concatenate([starts, at]), np.concatenate([lengths, many])
            flat = np.concatenate([flat, np.array(ids, dtype=np.int32)])
            words = np.concatenate(used) if used else np.zeros(0, np.int64)
            n = lengths[words]
            to = np.concatenate([[0], np.cumsum(n)])
            values = flat[np.repeat(starts[words] - to[:-1], n) + np.arange(to[-1])]
            offsets = to[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                              pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                             names=[*batch.schema.names, "ids"])
    return encode


def _decoder(vocabulary: Vocabulary, ids: str, into: str):
    spelled = np.frombuffer(b"".join(vocabulary.spelling), dtype=np.uint8)
    length = np.array([len(s) for s in vocabulary.spelling] + [0], dtype=np.int64)
    first = np.cumsum(length) - length
    nothing = len(vocabulary.spelling)

    def decode(batches):
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids))
            values = lists.flatten().fill_null(nothing).to_numpy(zero_copy_only=False)
            values = np.where((values < 0) | (values > nothing), nothing, values)
            sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()],
                             dtype=np.int64)
            n = length[values]
            to = np.concatenate([[0], np.cumsum(n)])
            out = spelled[np.repeat(first[values] - to[:-1], n) + np.arange(to[-1])].tobytes()
            cut = to[np.concatenate([[0], np.cumsum(sizes)])]
            texts = [None if gone else out[s:e].decode("utf-8", "replace")
                     for s, e, gone in zip(cut[:-1], cut[1:], lists.is_null().to_pylist())]
            # the mark in front of the first word is not part of the text
            texts = [t[1:] if t and t[0] == " " else t for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, into])
    return decode


def _ddl(df: DataFrame, extra: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, extra])


def encode_texts(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary,
                 cache_words: int = 100_000) -> DataFrame:
    """``docs`` (with a ``text``, without an ``ids`` column) plus ``ids array<int>``."""
    python_tasks(spark)
    return docs.mapInArrow(lean(_encoder(vocabulary, cache_words)), _ddl(docs, "ids array<int>"))


def decode_ids(spark: SparkSession, encoded: DataFrame, vocabulary: Vocabulary,
               ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` plus the text of the column ``ids``."""
    python_tasks(spark)
    return encoded.mapInArrow(lean(_decoder(vocabulary, ids, into)), _ddl(encoded, f"`{into}` string"))


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary,
               cache_words: int = 100_000) -> DataFrame:
    """``docs`` plus ``ids`` and ``decoded``: both directions in the same task."""
    python_tasks(spark)
    encode, decode = _encoder(vocabulary, cache_words), _decoder(vocabulary, "ids", "decoded")
    return docs.mapInArrow(lean(lambda batches: decode(encode(batches))),
                           _ddl(docs, "ids array<int>, decoded string"))
