from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import training_order as order
from shelfline.session import scratch_path


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 1 << 40))
def test_permutation(size, key):
    assert sorted(order.permuted(np.arange(size), size, key).tolist()) == list(range(size))


def test_keys_differ():
    x = np.arange(10_000)
    assert (order.permuted(x, 10_000, 1) != order.permuted(x, 10_000, 2)).mean() > 0.99
    assert abs(np.corrcoef(x, order.permuted(x, 10_000, 1))[0, 1]) < 0.05


def test_round_trip_and_resumed_reads(spark):
    rows = [(i, f"text {i} é " * (i % 50), "x") for i in range(300)] + [(7, "again", "x"), (7, "again", "x"), (500, None, "x"), (501, "", "x"), (None, "nameless", "x"), (502, "a" * 64, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    docs = docs.sortWithinPartitions("doc_id", "text")
    shards = order.materialise(docs, scratch_path(spark, "order"), key=3, length=64, shard_slots=100)
    found = order.read(spark, shards, 64).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    parts = defaultdict(list)
    for r in found:
        parts[r.doc_id].append((r.part, bytes(r.tokens), r.n_tokens))
    for doc_id, text, _ in rows:
        if doc_id == 7:
            continue
        raw = b"".join(t for _, t, _ in sorted(parts[doc_id]))
        assert raw.rstrip(bytes([order.PAD])) == (text or "").encode() + bytes([order.END])
        assert sum(n for _, _, n in parts[doc_id]) == len((text or "").encode()) + 1
    assert sum(t.startswith(b"again") for _, t, _ in parts[7]) == 2
    resumed = order.read(spark, shards, 64, 150, 333).collect()
    whole = {r.slot: bytes(r.tokens) for r in found}
    assert {r.slot: bytes(r.tokens) for r in resumed} == {s: whole[s] for s in range(150, 333)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order.training_order(spark, docs).collect() == []


def test_lost_rows_fail(spark):
    draw = spark.range(200).selectExpr("id AS doc_id", "CAST(uuid() AS STRING) || repeat('x', CAST(rand() * 500 AS INT)) AS text")
    changing = draw.rdd.map(lambda r: (r.doc_id, r.text * (1 + np.random.default_rng().integers(9)))).toDF("doc_id long, text string")
    with pytest.raises(Exception, match="changed between the passes|were numbered"):
        order.materialise(changing, scratch_path(spark, "order"))
