import hashlib
import zlib

from pyspark.sql import functions as F

from shelfline.llm import queries, ring

SCHEMA = "doc_id long, text string, shard int, source string"


def walk_by_hand(point, shards, nodes=ring.VIRTUAL_NODES):
    """Shards in clockwise order from a point, by sorting all virtual nodes."""
    on_ring = sorted((ring._point(f"{s}/{v}"), hashlib.md5(f"{s}/{v}".encode()).hexdigest(), s) for s in range(shards) for v in range(nodes))
    ahead = [s for p, _, s in on_ring if p >= point] + [s for p, _, s in on_ring if p < point]
    return list(dict.fromkeys(ahead))


def by_hand(rows, shards, slack=ring.SLACK, load=lambda size: size):
    """Shard of every key: one key after the other, by rank, round by round."""
    keys = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        key = f"text {crc}" if doc_id is None else str(doc_id)
        point = int(hashlib.md5(key.encode()).hexdigest()[:4], 16)
        rank = int(hashlib.md5(f"{key} {size} {crc}".encode()).hexdigest()[:15], 16)
        keys.append((rank, load(size), walk_by_hand(point, shards), (doc_id, crc)))
    bound = -(-int(sum(k[1] for k in keys) * (1 + slack) + 1) // shards)
    loads, placed = [0] * shards, {}
    for r in range(shards):
        begun, last = list(loads), {}
        for rank, size, walk, key in sorted(k for k in keys if k[3] not in placed):
            s = walk[r]
            if begun[s] < bound or last.get(s) == rank:
                placed[key], last[s] = s, rank
                loads[s] += size
                begun[s] += size
    return placed


def placed(spark, rows, shards, **options):
    keys = ring.keyed(spark.createDataFrame([(*r, 99, "x") for r in rows], SCHEMA))
    return ring.assign(keys, ring.plan(keys, shards, **options)), keys


def test_walks_go_clockwise():
    found = ring.walks(5, 40)
    for point in (0, 1, 777, 32768, 65000, ring.POINTS - 1):
        assert found[point] == walk_by_hand(point, 5, 40)


def test_against_one_key_after_the_other(spark):
    rows = [(i, "word " * (i * 7919 % 97)) for i in range(400)] + [(None, None), (None, "a"), (1000, ""), (1001, None)]
    found, _ = placed(spark, rows, 8)
    assert {(r.doc_id, r.text_crc32): r.shard for r in found.collect()} == by_hand(rows, 8)


def test_one_text_may_outweigh_all_others(spark):
    rows = [(i, "short") for i in range(60)] + [(60, "long " * 300_000)]
    found, _ = placed(spark, rows, 4)
    assert {(r.doc_id, r.text_crc32): r.shard for r in found.collect()} == by_hand(rows, 4)


def test_bounds_hold_and_growth_moves_little(spark):
    rows = [(i, "t" * (50 + i % 50)) for i in range(6000)]
    before, keys = placed(spark, rows, 8)
    after = ring.assign(keys, ring.plan(keys, 9))
    loads = [r.s for r in before.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    mean = sum(loads) / 8
    assert len(loads) == 8 and max(loads) <= mean * (1 + ring.SLACK) + 102 and min(loads) >= 0.95 * mean
    moved = before.join(after.select("doc_id", F.col("shard").alias("grown")), "doc_id").where("shard <> grown")
    assert moved.count() < len(rows) * 0.2 and moved.where("grown <> 8").count() < len(rows) * 0.06


def test_counts_as_loads_differ_by_one_at_most(spark):
    found, _ = placed(spark, [(i, "x" * i) for i in range(203)], 8, load=F.lit(1), slack=0)
    counts = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sum(counts) == 203 and max(counts) == 26


def test_slots_repeats_and_an_empty_table(spark):
    docs = spark.createDataFrame([(i % 90, f"t{i % 90}", 1, "s") for i in range(180)], SCHEMA)
    rows = ring.shard_documents(docs, 8).collect()
    assert len(rows) == 180
    of = {}
    for r in rows:
        of.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in of.values())
    assert len({(r.doc_id, r.shard) for r in rows}) == 90
    assert ring.shard_documents(docs.limit(0), 8).collect() == []


def test_query(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op12_ring_shards(spark, sf_dir).collect()}
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    expected = by_hand([tuple(d) for d in docs], 8)
    for d in docs:
        raw = d.text.encode()
        r = found[d.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert r.shard == expected[d.doc_id, r.text_crc32]
