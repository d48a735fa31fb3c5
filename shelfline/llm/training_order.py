"""Training order on disk: a keyed permutation gives every sequence its slot, shards hold the slots in order.

A text's token ids are its UTF-8 bytes, an end mark and padding up to whole
sequences of fixed length (0xFF and 0xFE occur in no UTF-8 text).  Sequences are
numbered without gaps from counts per input partition; a Feistel network over the
next power of four, walked along its cycle until it lands inside the range,
permutes the numbers into slots.  A shard is a range of slots: its partition puts
every sequence at its place and writes one file of fixed stride, so that slot s is
found by arithmetic and a reader can start anywhere and go on in sequence.

Numbering needs the same rows in the same partitions twice, so both passes run on
one RDD, whose partitions are planned once; a fingerprint of each partition is held
against the first pass, the sum against a count of the table itself, and a
difference fails the job.  Shards are renamed into
place when whole, and the same shard always has the same bytes: lost executors and
speculative copies do no harm.  A task holds one shard.

Nulls and odd rows: a null or empty text is one sequence, only the end mark and
padding; a null doc_id is kept and read back as null; repeated documents give their
sequences each; an empty table gives no shard; other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.session import scratch_path

END, PAD = 0xFF, 0xFE
LENGTH = 256
SHARD_SLOTS = 1 << 16
ROUNDS = 6

#: Stands for a null doc_id in the files.
_NULL = -(1 << 63)


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Where a keyed Feistel network with cycle-walking sends each of 0 .. size - 1."""
    half = np.uint64(max(1, -(-(max(size, 2) - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << half) | right

    x = once(index.astype(np.uint64))
    while (outside := np.flatnonzero(x >= np.uint64(size))).size:
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def _sequences(text: str | None, length: int) -> int:
    return len((text or "").encode()) // length + 1


class _Fingerprint:
    """What a partition held: sequences, rows, and a checksum over ids and sizes in order."""

    def __init__(self) -> None:
        self.sequences, self.rows, self.sum = 0, 0, 0

    def add(self, doc_id, n: int) -> None:
        self.sequences, self.rows = self.sequences + n, self.rows + 1
        self.sum = zlib.crc32(f"{doc_id}/{n};".encode(), self.sum)

    def value(self) -> tuple[int, int, int]:
        return self.sequences, self.rows, self.sum


def materialise(documents: DataFrame, folder: str, key: int = 1, length: int = LENGTH, shard_slots: int = SHARD_SLOTS) -> list[tuple[str, int, int]]:
    """Writes the shards below ``folder`` and returns (path, first slot, slots) of each."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).rdd

    def count(number: int, rows) -> Iterator[tuple[int, tuple[int, int, int]]]:
        seen = _Fingerprint()
        for doc_id, text in rows:
            seen.add(doc_id, _sequences(text, length))
        yield number, seen.value()

    found = dict(texts.mapPartitionsWithIndex(count).collect())  # one small row for each partition
    begin, size = {}, 0
    for number in sorted(found):
        begin[number] = size
        size += found[number][0]
    bytes_of = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    expected = documents.agg(F.sum(F.floor(bytes_of / length) + 1)).first()[0] or 0
    if size != expected:
        raise RuntimeError(f"{size} sequences were numbered, the table holds {expected}")
    if not size:
        return []
    shards = -(-size // shard_slots)

    def pack(slots: np.ndarray, ids: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, tuple]]:
        order = np.argsort(slots, kind="stable")
        shard = slots[order] // shard_slots
        for part in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            raw = block[part].tobytes()
            yield int(slots[part[0]] // shard_slots), (slots[part].tobytes(), ids[part].tobytes(), pa.compress(raw, codec="zstd", asbytes=True))

    def send(number: int, rows) -> Iterator[tuple[int, tuple]]:
        seen, index, held, ids, count = _Fingerprint(), begin[number], [], [], 0
        for doc_id, text in rows:
            raw = (text or "").encode()
            n = len(raw) // length + 1
            seen.add(doc_id, n)
            held.append(raw + bytes([END]) + bytes([PAD]) * (n * length - len(raw) - 1))
            ids.append(np.stack([np.full(n, _NULL if doc_id is None else doc_id, np.int64), np.arange(n)], axis=1))
            count += n
            if count * length > 16 << 20:
                yield from pack(permuted(np.arange(index, index + count), size, key), np.concatenate(ids), np.frombuffer(b"".join(held), np.uint8).reshape(-1, length))
                index, held, ids, count = index + count, [], [], 0
        if count:
            yield from pack(permuted(np.arange(index, index + count), size, key), np.concatenate(ids), np.frombuffer(b"".join(held), np.uint8).reshape(-1, length))
        if seen.value() != found[number]:
            raise RuntimeError(f"partition {number} changed between the passes")

    def save(packs) -> Iterator[tuple[str, int, int]]:
        by_shard: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        for shard, (slots, ids, raw) in packs:
            slots, first = np.frombuffer(slots, np.int64), shard * shard_slots
            n = min(shard_slots, size - first)
            block, owners, filled = by_shard.setdefault(shard, (np.zeros((n, length), np.uint8), np.zeros((n, 2), np.int64), [0]))
            block[slots - first] = np.frombuffer(pa.decompress(raw, len(slots) * length, codec="zstd", asbytes=True), np.uint8).reshape(-1, length)
            owners[slots - first] = np.frombuffer(ids, np.int64).reshape(-1, 2)
            filled[0] += len(slots)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for shard, (block, owners, filled) in sorted(by_shard.items()):
            if filled[0] != len(block):
                raise RuntimeError(f"shard {shard} has {filled[0]} of {len(block)} sequences")
            name = f"{base}/shard-{shard:08d}"
            side = pa.compress(np.ascontiguousarray(owners.T).tobytes(), codec="zstd", asbytes=True)
            for path, data in ((f"{name}.tokens", block.tobytes()), (f"{name}.owners", side)):
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(data)
                store.move(part, path)
            yield name, shard * shard_slots, len(block)

    return sorted(texts.mapPartitionsWithIndex(send).partitionBy(shards, int).mapPartitions(save).collect(), key=lambda x: x[1])


def read(spark: SparkSession, shards: list[tuple[str, int, int]], length: int = LENGTH, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, doc_id, part, n_tokens and tokens of the slots from ``start`` to before ``stop``, in order within a shard.

    Only the shards and the bytes that hold those slots are read.
    """
    stop = shards[-1][1] + shards[-1][2] if stop is None and shards else stop or 0
    wanted = [(p, first, n) for p, first, n in shards if first < stop and first + n > start]
    schema = "slot long, doc_id long, part long, n_tokens long, tokens binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                low, high = max(start, first) - first, min(stop, first + n) - first
                with store.open_input_stream(f"{name}.owners", compression=None) as side:
                    owners = np.frombuffer(pa.decompress(side.read(), n * 16, codec="zstd", asbytes=True), np.int64).reshape(2, n)
                with store.open_input_file(f"{name}.tokens") as file:
                    file.seek(low * length)
                    for at in range(low, high, 8192):
                        rows = min(8192, high - at)
                        raw = file.read(rows * length)
                        block = np.frombuffer(raw, np.uint8).reshape(rows, length)
                        doc = owners[0, at : at + rows]
                        tokens = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * length).astype(np.int32)), pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(first + at, first + at + rows)), pa.array(doc, mask=doc == _NULL), pa.array(owners[1, at : at + rows]), pa.array((block != PAD).sum(axis=1)), tokens],
                            ["slot", "doc_id", "part", "n_tokens", "tokens"],
                        )

    if not wanted:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(wanted, "path string, first long, n long").repartition(len(wanted), "first")
    return listed.mapInArrow(scan, schema)


def training_order(spark: SparkSession, documents: DataFrame, key: int = 1, length: int = LENGTH) -> DataFrame:
    """Materialises the documents in the shared folder and reads every slot back, with a checksum of its tokens."""
    shards = materialise(documents, scratch_path(spark, "training-order"), key, length)
    return read(spark, shards, length).select("slot", "doc_id", "part", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))
