"""SentencePiece encoding and decoding by a search shared between words.

A text's spaces become marks, and one mark is put in front.  No piece of the
vocabulary has a mark after another character, so the best segmentation of a text
is that of its marked words one by one (line ends that no piece contains cut as
well).  The distinct marked words of a slice of texts, sorted, are a trie walked
depth-first: a word takes over the back pointers and open piece prefixes (and
forward scores) of the characters it shares with the word before it, and only
computes the rest.  Characters outside the vocabulary become byte pieces, or unknown.

The segmentation is the one that the model defines.  A model of scores (unigram)
gives that of highest total score, ties to the longest last piece.  A model of
merges (BPE) joins the best-scored neighbours, leftmost first, until none is left.
Whether a merge crosses a boundary depends only on the two pieces beside it, so
pieces are what the merges give if and only if every two neighbours are what
the merges of those two give; the last piece of each prefix is the one such piece.

Nulls and odd rows: a null or empty text has no ids; texts that hold the mark
itself decode to spaces; repeated documents give one row each; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T

MARK = "▁"

#: What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0

#: Vocabulary files travel to the tasks with the function; larger ones are refused.
MOST_BYTES = 64 << 20

#: Pairs of neighbours whose merges a task remembers.
MOST_PAIRS = 1 << 20
#: Words whose ids a task keeps from slice to slice.
MOST_WORDS = 1 << 18


@dataclass
class Vocabulary:
    """Pieces with their scores; ``prefixes`` also has every prefix of a piece, with id -1."""

    strings: list[bytes]
    prefixes: dict[str, int] = field(default_factory=dict)
    scores: list[float] = field(default_factory=list)
    unknown: int = 0
    byte_ids: list[int] | None = None
    lines: bool = True
    merges: bool = False
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a model file; its own normalisation must be the identity."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"vocabulary file over {MOST_BYTES} bytes")
        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only vocabularies without text normalisation are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        return Vocabulary.of([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == 2)

    @staticmethod
    def of(pieces: list[tuple[str, float, int]], merges: bool = False) -> Vocabulary:
        """From (piece, score, type); types: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
        if merges and any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("merges with user-defined or unused pieces are not supported")
        vocabulary = Vocabulary(strings=[], scores=[p[1] for p in pieces], merges=merges)
        prefixes, bytes_found = vocabulary.prefixes, {}
        for number, (piece, _, kind) in enumerate(pieces):
            if kind == 6:
                bytes_found[int(piece[1:-1], 16)] = number
                vocabulary.strings.append(bytes([int(piece[1:-1], 16)]))
            elif kind == 2:
                vocabulary.unknown = number
                vocabulary.strings.append(" ⁇ ".encode())
            elif kind in (1, 4):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece holds a mark after another character")
                vocabulary.lines &= "\n" not in piece
                vocabulary.strings.append(piece.replace(MARK, " ").encode())
                for end in range(1, len(piece)):
                    prefixes.setdefault(piece[:end], -1)
                prefixes[piece] = number
            else:
                vocabulary.strings.append(b"")
        if len(bytes_found) == 256:
            vocabulary.byte_ids = [bytes_found[b] for b in range(256)]
        return vocabulary

    def key(self) -> str:
        """Tells vocabularies apart by all that decides ids."""
        return hashlib.sha256(repr((self.strings, self.prefixes, self.scores, self.unknown, self.byte_ids, self.lines, self.merges)).encode()).hexdigest()

    def merged(self, text: str) -> list[str]:
        """The pieces that the merges give for a short text."""
        parts, find, scores = list(text), self.prefixes.get, self.scores
        while True:
            top, place = None, -1
            for i in range(len(parts) - 1):
                number = find(parts[i] + parts[i + 1], -1)
                if number >= 0 and (top is None or scores[number] > top):
                    top, place = scores[number], i
            if place < 0:
                return parts
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the merges leave the boundary between two pieces, and both whole; ``left`` is empty at a word's start."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def units(self, text: str) -> list[str]:
        """The marked words of a text, in order."""
        if not text:
            return []
        out: list[str] = []
        lines = text.replace(MARK, " ").split("\n") if self.lines else [text.replace(MARK, " ")]
        for number, line in enumerate(lines):
            if number:
                out.append("\n")
            words = line.split(" ")
            if number == 0:
                words = ["", *words]
            marks = 0
            last = len(words) - 1
            if words[0]:
                out.append(words[0])
            for i in range(1, last + 1):
                marks += 1
                if words[i] or i == last:
                    out.append(MARK * marks + words[i])
                    marks = 0
        return out


def by_merges(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word of a sorted list without repeats, as the merges give them."""
    find, neighbours, pairs = vocabulary.prefixes.get, vocabulary.neighbours, vocabulary.pairs
    back, last, open_at = [0], [""], [()]
    out, previous = [], ""
    for word in words:
        shared = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            shared += 1
        del back[shared + 1 :], last[shared + 1 :], open_at[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            came, chosen, still = end - 1, None, []
            for start in (*open_at[-1], end - 1):
                piece = word[start:end]
                number = find(piece)
                if number is not None:
                    still.append(start)
                elif start < end - 1:
                    continue
                if chosen is None and (start == end - 1 or number >= 0):
                    fits = pairs.get((last[start], piece))
                    if fits or (fits is None and neighbours(last[start], piece)):
                        came, chosen = start, piece
            if chosen is None:
                raise AssertionError("a prefix without a last piece")
            back.append(came)
            last.append(chosen)
            open_at.append(tuple(still))
        ids: list[int] = []
        at = len(word)
        while at:
            number = find(last[at], -1)
            if number >= 0:
                ids.append(number)
            elif vocabulary.byte_ids:
                ids.extend(vocabulary.byte_ids[b] for b in reversed(last[at].encode()))
            elif not ids or ids[-1] != vocabulary.unknown:
                ids.append(vocabulary.unknown)
            at = back[at]
        ids.reverse()
        out.append(ids)
        previous = word
    return out


def segment(words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
    """The ids of each word of a sorted list without repeats."""
    if vocabulary.merges:
        return by_merges(words, vocabulary)
    prefixes, scores = vocabulary.prefixes, vocabulary.scores
    find = prefixes.get
    missing = min((s for p, n in prefixes.items() if n >= 0 for s in (scores[n],)), default=0.0) - UNKNOWN_PENALTY
    best, back, piece, open_at = [0.0], [0], [-1], [()]
    out, previous = [], ""
    for word in words:
        shared = 0
        for x, y in zip(previous, word):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], back[shared + 1 :], piece[shared + 1 :], open_at[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, came, chosen, still = None, end - 1, -1, []
            for start in (*open_at[-1], end - 1):
                number = find(word[start:end])
                if number is None:
                    if start == end - 1:
                        value = best[start] + missing
                        if top is None or value > top:
                            top, came, chosen = value, start, -1
                    continue
                still.append(start)
                if number < 0:
                    if start < end - 1:
                        continue
                    value = best[start] + missing
                else:
                    value = best[start] + scores[number]
                if top is None or value > top:
                    top, came, chosen = value, start, number
            best.append(top)
            back.append(came)
            piece.append(chosen)
            open_at.append(tuple(still))
        ids: list[int] = []
        at = len(word)
        while at:
            start = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            elif vocabulary.byte_ids:
                ids.extend(vocabulary.byte_ids[b] for b in reversed(word[start:at].encode()))
            elif not ids or ids[-1] != vocabulary.unknown:
                ids.append(vocabulary.unknown)
            at = start
        ids.reverse()
        out.append(ids)
        previous = word
    return out


class Words:
    """Ids of words from slice to slice: those of the last and of the one before, each of bounded number."""

    def __init__(self, most: int = MOST_WORDS) -> None:
        self.now: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.most = most

    def of(self, words: list[str], vocabulary: Vocabulary) -> list[list[int]]:
        """The ids of each word; words that are not kept are walked through in order, sharing their prefixes."""
        if len(self.now) > self.most:
            self.before, self.now = self.now, {}
        now, before, fresh = self.now, self.before, []
        for word in words:
            if word not in now:
                ids = before.get(word)
                if ids is None:
                    fresh.append(word)
                else:
                    now[word] = ids
        fresh.sort()
        now.update(zip(fresh, segment(fresh, vocabulary), strict=True))
        return [now[w] for w in words]


#: Of a Python worker: what its tasks have learned about a vocabulary's words and pairs.
_LEARNED: dict[str, tuple[Words, dict[tuple[str, str], bool]]] = {}


def encode_texts(texts: list[str | None], vocabulary: Vocabulary, kept: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after the other, and len + 1 offsets; ``kept`` has words from earlier calls."""
    units = [vocabulary.units(t or "") for t in texts]
    words = list(set(chain.from_iterable(units)))
    found = (kept or Words()).of(words, vocabulary)
    sizes = np.array([len(x) for x in found], np.int64)
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    number = dict(zip(words, range(len(words)), strict=True))
    counts = np.array([len(u) for u in units], np.int64)
    order = np.fromiter(map(number.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
    word, k = T.runs(sizes[order])
    ids = flat[begin[order][word] + k] if len(order) else flat
    ends = np.concatenate([[0], np.cumsum(sizes[order])])
    return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


class Decoder:
    """Bytes of pieces laid end to end."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.bytes = np.frombuffer(b"".join(vocabulary.strings), np.uint8)
        self.sizes = np.array([len(s) for s in vocabulary.strings], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        piece, k = T.runs(self.sizes[ids])
        raw = self.bytes[self.begin[ids][piece] + k].tobytes() if len(ids) else b""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[offs].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends, ends[1:])]


def encode(documents: DataFrame, vocabulary: Vocabulary, slice_bytes: int = T.SLICE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the decoded ids give back the text (null for a null text).

    ``slice_bytes`` of text are walked through at a time; ids do not depend on it.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that has had a task with this vocabulary goes on with its words
        kept, vocabulary.pairs = _LEARNED.setdefault(vocabulary.key(), (Words(), vocabulary.pairs))
        decoder = Decoder(vocabulary)
        for whole in batches:
            for batch in T.slices(whole, limit=slice_bytes):
                texts = batch.column("text").to_pylist()
                ids, offs = encode_texts(texts, vocabulary, kept)
                same = [None if t is None else t == d for t, d in zip(texts, decoder(ids, offs), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offs)), T.arrays(ids, offs, pa.int32()), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "ids", "round_trip"],
                )

    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table.mapInArrow(apply, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give an empty text."""
    most = len(vocabulary.strings)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            column = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            ids, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= most):
                raise ValueError("an id is outside the vocabulary")
            texts = decoder(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(apply, "doc_id long, text string")
