"""Benchmark decontamination by Wu-Manber search over words.

Test items become windows of consecutive words.  Windows of one length m form a
pattern set: a shift table over hashed blocks of two words tells how far a search
position may jump, suffix-hash buckets hold the windows that end in a block, and
a comparison of the words themselves confirms each occurrence.  All positions of
a slice of texts advance together, so that every step is a numpy operation.

Pattern sets are built from blocks of items of bounded size.  One block is the
rule; with more, the texts pass through one search per block, with the tables
between them written to the shared folder.

Nulls and odd rows: a null text has no words; a null item text has no windows; an
item without id marks words but is not listed; repeated items are one item;
repeated documents give one row each; other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T
from shelfline.session import stored

#: Bytes of 0-9, a-z and of every character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True

#: Bytes of item texts that one pattern block holds at most (unless one item is longer).
BLOCK_BYTES = 16 << 20

_PAIR = np.uint64(0xD6E8FEB86659FD93)
_BITS = 18


def _words(text: str | None) -> list[bytes]:
    data = T.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = T.spans(data, np.array([0, len(data)]), WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _blocks(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The hash of the block of ``width`` words that ends with word ``at``."""
    return hashes[at] if width == 1 else T.mixed(hashes[at - 1] * _PAIR + hashes[at])


class Patterns:
    """Windows of one length, with their shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]) -> None:
        self.length, self.width = length, min(2, length)
        self.windows = list(windows)
        self.items = list(windows.values())
        flat = [w for window in self.windows for w in window]
        ends = np.cumsum([len(w) for w in flat])
        starts = ends - [len(w) for w in flat]
        self.hashes = T.word_hashes(np.frombuffer(b"".join(flat), np.uint8), starts, ends).reshape(-1, length)
        far = length - self.width + 1
        self.shift = np.full(1 << _BITS, far, np.int64)
        for j in range(self.width - 1, length):
            np.minimum.at(self.shift, self._slot(_blocks(self.hashes.T, j, self.width)), length - 1 - j)
        suffix = _blocks(self.hashes.T, length - 1, self.width)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return block >> np.uint64(64 - _BITS)

    def search(self, raw: bytes, starts, ends, hashes: np.ndarray, first: np.ndarray):
        """Word position and pattern number of every occurrence."""
        m = self.length
        counts = np.maximum(np.diff(first) - m + 1, 0)  # possible places in each text
        pieces = -(-counts // 1024)  # long texts advance in several places at once
        lane, k = T.runs(pieces)
        pos = first[:-1][lane] + k * 1024 + m - 1
        last = np.minimum(first[:-1][lane] + (k + 1) * 1024, first[:-1][lane] + counts[lane]) + m - 1
        found = []
        while len(pos):
            step = self.shift[self._slot(_blocks(hashes, pos, self.width))]
            if (hit := pos[step == 0]).size:
                found.append(hit)
            pos = pos + np.maximum(step, 1)
            live = pos < last
            pos, last = pos[live], last[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        block = _blocks(hashes, at, self.width)
        low, high = np.searchsorted(self.suffix, block), np.searchsorted(self.suffix, block, side="right")
        place, k = T.runs(high - low)
        begin, pattern = at[place] - m + 1, self.order[low[place] + k]
        for j in range(m):
            same = hashes[begin + j] == self.hashes[pattern, j]
            begin, pattern = begin[same], pattern[same]
        same = [
            all(raw[starts[b + j] : ends[b + j]] == w for j, w in enumerate(self.windows[p]))
            for b, p in zip(begin.tolist(), pattern.tolist(), strict=True)
        ]
        return begin[same], pattern[same]


def compiled(items: list[tuple[str | None, str | None]], window: int = 10) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = _words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            listed = by_length[size][tuple(words[i : i + size])]
            if item is not None and item not in listed:
                listed.append(item)
    return [Patterns(n, dict(w)) for n, w in sorted(by_length.items())]


def _search(patterns: list[Patterns], batch: pa.RecordBatch, found: dict | None = None):
    """For each text: words, covered spans (flat, with offsets) and items, as numpy and lists."""
    data, offs = T.buffer(batch.column("text"))
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offs, WORD)
    hashes = T.word_hashes(data, starts, ends)
    raw = data.tobytes()
    cover = np.zeros(len(starts) + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    if found:
        for row, (spans, listed) in found.items():
            items[row].update(listed)
            for a, b in spans:
                cover[first[row] + a] += 1
                cover[first[row] + b] -= 1
    for p in patterns:
        begin, number = p.search(raw, starts, ends, hashes, first)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + p.length, -1)
        owner = np.searchsorted(first, begin, side="right") - 1
        for row, k in np.unique(np.stack([owner, number], 1), axis=0).tolist():
            items[row].update(p.items[k])
    inside = np.cumsum(cover[:-1]) > 0
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (group[1:] != group[:-1])
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | (group[1:] != group[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.diff(first), a, b, group[a] if len(a) else a, first, items


SCHEMA = "doc_id long, n_words long, span_starts array<long>, span_ends array<long>, items array<string>"


def _scanner(patterns: list[Patterns], last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole):
                found = None
                if "items" in batch.schema.names:
                    cols = [batch.column(c).to_pylist() for c in ("span_starts", "span_ends", "items")]
                    found = {i: (list(zip(a, b)), c) for i, (a, b, c) in enumerate(zip(*cols)) if a or c}
                n, a, b, row, first, items = _search(patterns, batch, found)
                offs = np.searchsorted(row, np.arange(batch.num_rows + 1))
                base = first[:-1][row] if len(a) else a
                out = {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(n, pa.int64()),
                    "span_starts": T.arrays(a - base, offs, pa.int64()),
                    "span_ends": T.arrays(b - base, offs, pa.int64()),
                    "items": pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
                }
                if not last:
                    out["text"] = batch.column("text")
                yield pa.RecordBatch.from_pydict(out)

    return scan


def pattern_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size; one partition at a time reaches the driver."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        size = len(row.text or "")
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item_id, row.text))
        held += size
    yield block


def find_items(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each document its word count, the spans of words inside occurrences and the items found."""
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = pattern_blocks(benchmark, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        schema = SCHEMA if following is None else SCHEMA + ", text string"
        table = table.mapInArrow(_scanner(compiled(block, window), following is None), schema)
        if following is not None:
            table = stored(table, "decontaminate")
        block = following
    return table


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_items``."""
    hit = F.aggregate(
        F.zip_with("span_ends", "span_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("span_starts") > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any occurrence, with all their columns; nothing is shuffled.

    More items than one block holds take one filtering pass for each block.
    """
    names, schema, table = documents.columns, documents.schema, documents
    for block in pattern_blocks(benchmark):
        patterns = compiled(block, window)

        def keep(batches, patterns=patterns):
            for whole in batches:
                for batch in T.slices(whole):
                    _, _, _, row, _, _ = _search(patterns, batch.select(["text"]))
                    mask = np.ones(batch.num_rows, bool)
                    mask[row] = False
                    yield batch.filter(pa.array(mask))

        table = table.select(names).mapInArrow(keep, schema)
    return table
