"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton holds all pieces. It reads the text once; at each position its state and the output
links from there name all pieces that end there, the longest first, and each relaxes the best score
of that position. A character that is no piece of its own is an unknown step, written as the pieces of its UTF-8
bytes. The segmentation is the one of the highest sum of scores; of equal sums the one whose last
piece is longer.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE_MARK = "▁"
#: How much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Characters up to which a word is remembered; words remembered in each of two generations (about 100 MB in all).
REMEMBER_CHARS, REMEMBER_WORDS = 40, 200_000
#: Rows of one batch that a task gives back.
ROWS = 256


@dataclass
class Vocabulary:
    """Pieces with their scores and kinds, read from a model file on the driver and sent to the tasks (a few MB at most)."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  #: ids of the pieces <0x00> to <0xFF>; empty if the model has none
    unknown: int
    special: set[int] = field(default_factory=set)  #: ids that stand for no text

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        bytes_ = {pieces[i]: i for i in ids if sp.is_byte(i)}
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in ids], [bytes_[f"<0x{b:02X}>"] for b in range(256)] if bytes_ else [], sp.unk_id(), special)


class Codec:
    """Encodes texts; they are led by a space mark, and spaces become space marks."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        v = vocabulary
        self.vocabulary = v
        self.automaton = ahocorasick.Automaton()
        skip = v.special | set(v.byte_ids)
        for i, piece in enumerate(v.pieces):
            if i not in skip and piece:
                self.automaton.add_word(piece, (len(piece), v.scores[i], i))
        self.automaton.make_automaton()
        normal = [p for i, p in enumerate(v.pieces) if i not in skip and p]
        self.single = {p for p in normal if len(p) == 1}
        self.unknown_score = min((v.scores[i] for i in range(len(v.pieces)) if i not in skip), default=0.0) - UNKNOWN_PENALTY
        # No best path crosses a place that no piece crosses: before a space mark that follows another
        # character, and around a line feed. The text falls apart there, and words can be remembered.
        apart = all(SPACE_MARK not in p.lstrip(SPACE_MARK) and "\n" not in p for p in normal)
        self.words = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+" if apart else r"(?s).+").findall
        self.known = _Remembered(self)

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best segmentation of a marked text."""
        if not self.single.issuperset(text):
            return self._viterbi_with_unknown(text)
        n = len(text)
        best = [-1e30] * n + [0.0]  # of the text up to and with each character; index -1 is the place before the first
        back: list = [None] * n
        for end, match in self.automaton.iter(text):
            total = best[end - match[0]] + match[1]
            if total > best[end]:
                best[end], back[end] = total, match
        out, at = [], n - 1
        while at >= 0:
            size, _, i = back[at]
            out.append(i)
            at -= size
        out.reverse()
        return out

    def _viterbi_with_unknown(self, text: str) -> list[int]:
        """The same where a character may be no piece: an unknown step competes with the pieces that end there."""
        n, v = len(text), self.vocabulary
        best = [-1e30] * n + [0.0]
        back: list = [None] * n
        step = (1, self.unknown_score, v.unknown)
        ends = self.automaton.iter(text)
        end, match = next(ends, (n, None))
        for at, char in enumerate(text):
            while end == at:
                total = best[at - match[0]] + match[1]
                if total > best[at]:
                    best[at], back[at] = total, match
                end, match = next(ends, (n, None))
            if char not in self.single and best[at - 1] + self.unknown_score > best[at]:
                best[at], back[at] = best[at - 1] + self.unknown_score, step
        out, at = [], n - 1
        while at >= 0:
            size, _, i = back[at]
            if i == v.unknown and v.byte_ids:
                out += [v.byte_ids[b] for b in reversed(text[at].encode("utf-8", "surrogatepass"))]
            else:
                out.append(i)
            at -= size
        out.reverse()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids (int32) of a text; of an empty one, none."""
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(SPACE_MARK + text.replace(" ", SPACE_MARK)))), np.int32)


class Decoder:
    """Decodes ids: pieces put together, bytes read as UTF-8, space marks as spaces, without the leading one."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        byte_of = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        self.texts = [byte_of.get(i, b"" if i in v.special else p.replace(SPACE_MARK, " ").encode()) for i, p in enumerate(v.pieces)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.texts.__getitem__, ids.tolist())).removeprefix(b" ").decode("utf-8", "replace")


class _Remembered(dict):
    """Marked word to the bytes of its ids. Once full, it starts again and takes from the generation before it what is asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("i", self.codec.viterbi(word)).tobytes()
        if len(word) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


_made: dict = {}


def _made_once(kind: type, key: str, vocabulary):
    """One codec or decoder for each vocabulary in a Python worker, kept from task to task."""
    if (kind, key) not in _made:
        _made[kind, key] = kind(vocabulary.value)
    return _made[kind, key]


def _sent(spark: SparkSession, vocabulary: Vocabulary):
    return f"{len(vocabulary.pieces)}-{hash((tuple(vocabulary.pieces), tuple(vocabulary.scores)))}", spark.sparkContext.broadcast(vocabulary)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in lists]


def _mapped(df: DataFrame, new: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with new columns, in place of any of their names, that ``make`` gives for a few rows at a time."""
    kept = [c for c in df.columns if c not in new]

    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(rows[c] for c in kept), *work(rows)], [*kept, *new])

    fields = {f.name: f for f in df.schema.fields}
    return df.mapInArrow(run, T.StructType([*(fields[c] for c in kept), *(T.StructField(n, t) for n, t in new.items())]))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int): the pieces of each whole text.

    Null and empty texts have no ids. Everything else is encoded exactly: with byte pieces in the
    model, :func:`decode` gives each text back (but for the space mark itself, U+2581, which the format
    reads as a space). All other columns and repeated rows are passed through; a column of the name
    ``ids`` is replaced. An empty table gives an empty result.
    """
    key, sent = _sent(docs.sparkSession, vocabulary)

    def make():
        codec = _made_once(Codec, key, sent)
        return lambda rows: [_lists([codec.encode(t) for t in rows[text].to_pylist()])]

    return _mapped(docs, {ids: T.ArrayType(T.IntegerType())}, make)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the column ``text``: what the ids stand for; null and empty ids give an empty text."""
    key, sent = _sent(rows.sparkSession, vocabulary)

    def make():
        decoder = _made_once(Decoder, key, sent)
        return lambda batch: [pa.array([decoder.decode(x) for x in _arrays(batch[ids])], pa.string())]

    return _mapped(rows, {text: T.StringType()}, make)


def recode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass over the rows, so that texts go to Python once."""
    key, sent = _sent(docs.sparkSession, vocabulary)

    def make():
        codec, decoder = _made_once(Codec, key, sent), _made_once(Decoder, key, sent)

        def work(rows):
            found = [codec.encode(t) for t in rows[text].to_pylist()]
            return [_lists(found), pa.array([decoder.decode(x) for x in found], pa.string())]

        return work

    return _mapped(docs, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, make)
