"""Exact top-k inner products, with candidates in buckets of like length.

Candidates are range-partitioned by length and packed into blocks whose
sub-buckets hold vectors of nearly equal length.  A query's k-th best score so
far, divided by its own and a sub-bucket's greatest length, is a local cosine
threshold there: above 1 the bucket is skipped; where it is low, candidates are
cut off by length; where it is high, the query's largest coordinates bound each
candidate's from both sides.  What is left is verified by whole-number products.
First thresholds come from a fixed number of the longest vectors, later ones from
the buckets already seen.

Queries are packed into blocks of bounded size and meet the candidate blocks, so
neither side is ever whole in one place; blocks that a threshold rules out never
meet.

Nulls and odd rows: vectors that are null, hold a null or non-finite component or
have no id take no part; an empty vector scores 0; missing components of a shorter
vector count as 0; repeated rows count once; rows that share the query's id are its
own; products beyond 64 bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stored

QUERIES = 512
BLOCK = 2048
BUCKET = 256
SEEDS = 256
FOCUS = 3

#: Cosine threshold from which coordinates prune better than lengths.
STEEP = 0.2

_EXACT = float(1 << 53)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, whole-number components and length of every vector that takes part."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 1024).cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    kept = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(~odd)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("length", length)


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(prefix: str, size: int, sort: bool):
    """Packs the rows of a partition into blocks of ``size``, each sorted by falling length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (-r[2], r[0]))
            m = _matrix([r[1] for r in rows])
            values = [np.array([r[0] for r in rows], np.int64).tobytes(), m.tobytes(), len(rows), rows[0][2], rows[-1][2]]
            names = [prefix + n for n in ("ids", "matrix", "rows", "most", "least")]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "length")), strict=True)
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    return pack


def _block_schema(prefix: str) -> str:
    return f"{prefix}ids binary, {prefix}matrix binary, {prefix}rows long, {prefix}most double, {prefix}least double"


def _unpack(ids: bytes, matrix: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(rows, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact whole-number products of one query with candidates."""
    d = min(len(q), c.shape[1])
    q, c = q[:d], c[:, :d]
    x, y = q.astype(np.float64), c.astype(np.float64)
    if np.sqrt(x @ x) * np.sqrt((y * y).sum(axis=1).max(initial=0.0)) < _EXACT:
        return (y @ x).astype(np.int64)
    limit = (1 << 63) - 1
    exact = [sum(int(a) * int(b) for a, b in zip(q, row, strict=True)) for row in c]
    return np.array([max(-limit - 1, min(limit, s)) for s in exact], np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores.astype(np.float64), -scores))[:k] if len(ids) < 2 * k else None
    if order is None:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        order = near[np.lexsort((ids[near], -scores[near]))][:k]
    return ids[order], scores[order]


def search_block(query_ids, queries, floors, ids, matrix, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of one candidate block; ``floors``: scores already reached by k candidates."""
    lengths = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
    unit = matrix / np.maximum(lengths, 1e-300)[:, None]
    out = []
    for number, own in enumerate(query_ids.tolist()):
        q = queries[number]
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        floor = floors[number]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        direction = q / max(length, 1e-300)
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        focus = focus[focus < matrix.shape[1]]
        for at in range(0, len(ids), BUCKET):
            piece = slice(at, at + BUCKET)
            bound = length * lengths[at]
            local = floor / bound - 1e-9 if bound else (-1.0 if floor <= 0 else 2.0)
            if local > 1:
                break  # lengths fall, so no later bucket can reach the threshold
            if local <= 0:
                pick = np.arange(at, min(at + BUCKET, len(ids)))
            elif local < STEEP:
                end = np.searchsorted(-lengths[piece], -(floor / length) * (1 - 1e-9), side="right")
                pick = np.arange(at, at + end)
            else:
                near = np.ones(len(lengths[piece]), bool)
                for f in focus:
                    reach = np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - local**2)))
                    x = unit[piece, f]
                    near &= (x >= direction[f] * local - reach - 1e-9) if direction[f] >= 0 else (x <= direction[f] * local + reach + 1e-9)
                pick = at + np.flatnonzero(near)
            if not len(pick):
                continue
            scores = _products(q, matrix[pick])
            good = (scores >= floor) & (ids[pick] != own)
            if good.any():
                best_ids, best = _best(np.concatenate([best_ids, ids[pick][good]]), np.concatenate([best, scores[good]]), k)
                if len(best) == k:
                    floor = max(floor, float(best[-1]))
        if len(best):
            out.append((own, best_ids, best))
    return out


def search(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best."""
    spark = embeddings.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = whole_vectors(embeddings).dropDuplicates(["vec_id", "v"])
    vectors = stored(vectors, "vectors")
    seeds = vectors.orderBy(F.desc("length"), "vec_id").limit(SEEDS).collect()
    seed_ids = np.array([r.vec_id for r in seeds], np.int64)
    seed_matrix = _matrix([r.v for r in seeds])

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds what k of the longest vectors reach for each query."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, m = _unpack(*(row.column(c)[0].as_py() for c in ("q_ids", "q_matrix", "q_rows")))
                found = np.full(len(ids), -np.inf)
                for j, own in enumerate(ids.tolist()):
                    scores = _products(m[j], seed_matrix[seed_ids != own])
                    if len(scores) >= k:
                        found[j] = np.partition(scores, len(scores) - k)[len(scores) - k]
                lengths = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
                least = np.where(found > 0, found / np.maximum(lengths, 1e-300), 0.0)
                least[(lengths == 0) & (found > 0)] = np.inf
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([found.tobytes()]), pa.array([float(least.min()) * (1 - 1e-9)])],
                    [*row.schema.names, "q_floors", "q_needs"],
                )

    packs = vectors.where(is_query).mapInArrow(_packed("q_", QUERIES, True), _block_schema("q_"))
    packs = packs.mapInArrow(floors, _block_schema("q_") + ", q_floors binary, q_needs double")
    packs = packs.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    blocks = (
        vectors.repartitionByRange(tasks, F.desc("length"), "vec_id")
        .sortWithinPartitions(F.desc("length"), "vec_id")
        .mapInArrow(_packed("c_", BLOCK, False), _block_schema("c_"))
        .withColumn("place", F.pmod(F.xxhash64("c_ids"), F.lit(tasks)).cast("int"))
    )
    pairs = blocks.join(packs, (blocks["place"] == packs["place"]) & (packs["q_needs"] <= blocks["c_most"]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                q_ids, q = _unpack(row["q_ids"], row["q_matrix"], row["q_rows"])
                ids, m = _unpack(row["c_ids"], row["c_matrix"], row["c_rows"])
                found = search_block(q_ids, q, np.frombuffer(row["q_floors"]), ids, m, k)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                            pa.array(np.concatenate([f[1] for f in found])),
                            pa.array(np.concatenate([f[2] for f in found])),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    wanted = ["q_ids", "q_matrix", "q_rows", "q_floors", "c_ids", "c_matrix", "c_rows"]
    found = pairs.select(wanted).mapInArrow(scan, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
