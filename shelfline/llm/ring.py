"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POINTS`` points.  Every shard owns ``virtual_nodes`` of them, drawn by
hash from the shard's number alone, so that a new shard only takes points over.  A
key starts at the point of its hash and walks clockwise; it meets the shards in the
order of their next virtual nodes.  No shard may be loaded beyond its bound, ``slack``
over an even share: keys are admitted by ascending rank, another hash of theirs, as
long as the shard is below its bound, and those that overflow continue clockwise to
the next shard that has room.  Round r admits the keys at the r-th shard of their
walk, so a table needs at most as many rounds as there are shards.

Only a shard's *cut*, the largest rank that it admits in a round, is needed to tell
where every key goes.  Cuts come from sums over rank ranges (all keys, summed map-side)
and then over the single ranks of the one range in which the bound is reached.  The
plan is some numbers for each shard and round; the assignment is one expression over
them, without a join, a sort or state, and gives the same shard on every retry.

Bound: a shard's load stays below the bound plus the size of the last rank admitted.
As the bounds sum to more than the total, every key finds a shard.  Movement: keys
that never overflowed move only to the new shard; a bound touches the overflow alone.

Results for odd rows: a null text has size 1 and checksum 0 as the empty text has; a
null doc_id is placed by its text; rows alike in doc_id and text share a rank and lie
in one shard; texts of any length are measured whole; an empty table gives no rows;
other columns are not read, whatever their names.  Equal texts with different doc_ids
are different keys: a group of copies is spread, which keeps a hot group from
filling a shard.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.llm.numbering import numbered
from shelfline.session import stored

POINTS = 1 << 16
VIRTUAL_NODES = 512
#: Load over an even share at which a shard is full.
SLACK = 0.002
#: Ranks have 60 bits; sums are first taken over ranges of their upper 16.
_LOW = 44


def _point(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:4], 16)


def walks(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For every point of the ring, the shards in the order in which a key that starts there meets them."""
    owners: dict[int, list[tuple[str, int]]] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            name = f"{shard}/{node}"
            owners.setdefault(_point(name), []).append((hashlib.md5(name.encode()).hexdigest(), shard))
    found: list[list[int]] = [[]] * POINTS
    walk: list[int] = []
    for turn in range(2):  # the second turn has walks that go past the last point
        for point in range(POINTS - 1, -1, -1):
            here = list(dict.fromkeys(shard for _, shard in sorted(owners.get(point, []))))
            walk = here + [s for s in walk if s not in here] if here else walk
            found[point] = walk
    return found


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a key's point and rank on the ring; the texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    measured = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    place = F.md5(key.cast("binary"))
    rank = F.md5(F.concat_ws(" ", key, F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary"))
    return measured.select(
        "*", F.conv(F.substring(place, 1, 4), 16, 10).cast("int").alias("point"),
        F.conv(F.substring(rank, 1, 15), 16, 10).cast("long").alias("rank"),
    )


@dataclass(frozen=True)
class Plan:
    """``cuts[r][s]``: keys whose r-th shard is s are admitted there up to this rank."""

    shards: int
    virtual_nodes: int
    cuts: list[dict[int, int]]

    def shard(self) -> Column:
        """The shard of a row with ``walk`` and ``rank``: the first one that admits it."""
        found = F.lit(None).cast("int")
        for r in reversed(range(len(self.cuts))):
            met = F.element_at("walk", r + 1)
            found = F.when(F.col("rank") <= _of(met, self.cuts[r]), met).otherwise(found)
        return found


def _of(shard: Column, values: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), shard)


def _walking(keys: DataFrame, shards: int, virtual_nodes: int) -> DataFrame:
    """Keys with their walk; the ring is a table of fixed size."""
    ring = keys.sparkSession.createDataFrame(list(enumerate(walks(shards, virtual_nodes))), "point int, walk array<int>")
    return keys.join(F.broadcast(ring), "point")


def _cuts(waiting: DataFrame, room: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """The largest rank that each shard admits of ``waiting`` (shard, rank, load), and the load admitted."""
    everything = (1 << 60) - 1
    ranges = waiting.groupBy("shard", F.shiftright("rank", _LOW).alias("range")).agg(F.sum("load").alias("load"))
    before = F.coalesce(F.sum("load").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # 65,536 ranges of a shard at most; the last one that begins below the bound holds the cut
    begun = ranges.select("*", before.alias("before")).where(F.col("before") < _of(F.col("shard"), room))
    last = {r["shard"]: (r["range"], r["before"]) for r in begun.groupBy("shard").agg(F.max_by(F.struct("range", "before"), "range").alias("x")).select("shard", "x.*").collect()}
    cuts = {s: -1 if room[s] <= 0 else everything for s in room}
    if not last:
        return cuts, dict.fromkeys(room, 0)
    none = dict.fromkeys(room, -1)
    inside = waiting.where(F.shiftright("rank", _LOW) == _of(F.col("shard"), none | {s: x[0] for s, x in last.items()}))
    single = inside.groupBy("shard", "rank").agg(F.sum("load").alias("load"))
    begins = _of(F.col("shard"), none | {s: x[1] for s, x in last.items()})
    upto = F.sum("load").over(Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) + begins
    admitted = single.select("shard", "rank", upto.alias("upto"), (upto - F.col("load")).alias("before")).where(
        F.col("before") < _of(F.col("shard"), room)
    )
    loads = dict.fromkeys(room, 0)
    for r in admitted.groupBy("shard").agg(F.max("rank").alias("cut"), F.max("upto").alias("load")).collect():
        cuts[r["shard"]], loads[r["shard"]] = r["cut"], r["load"]
    return cuts, loads


def plan(keys: DataFrame, shards: int, load: Column | str = "size", slack: float = SLACK, virtual_nodes: int = VIRTUAL_NODES) -> Plan:
    """Cuts of every round for a table of ``keyed`` rows (which is read once or twice a round)."""
    load = F.col(load) if isinstance(load, str) else load
    total = keys.agg(F.sum(load)).first()[0] or 0
    bound = -(-int(total * (1 + slack) + 1) // shards)
    room = dict.fromkeys(range(shards), bound)
    walking = _walking(keys, shards, virtual_nodes)
    made = Plan(shards, virtual_nodes, [])
    left = total
    while left > 0:
        waiting = walking.where(made.shard().isNull()).select(
            F.element_at("walk", len(made.cuts) + 1).alias("shard"), "rank", load.alias("load")
        )
        cuts, loads = _cuts(waiting, room)
        made.cuts.append(cuts)
        room = {s: room[s] - loads[s] for s in room}
        left -= sum(loads.values())
    return made


def assign(keys: DataFrame, made: Plan) -> DataFrame:
    """The rows with their shard, by the plan alone."""
    rows = _walking(keys, made.shards, made.virtual_nodes)
    return rows.select(*keys.columns, made.shard().alias("shard"))


def shard_documents(documents: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: a gapless number in the shard by doc_id."""
    keys = stored(keyed(documents), "keys")
    placed = assign(keys, plan(keys, shards, slack=slack))
    order = ["shard", "doc_id", "text_crc32", "size"]
    rows = numbered(placed.select(*order), order, "number")
    begins = {r["shard"]: r["begin"] for r in rows.groupBy("shard").agg(F.min("number").alias("begin")).collect()}
    if not begins:
        return rows.select("doc_id", "size", "text_crc32", "shard", F.col("number").alias("slot"))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("number") - _of(F.col("shard"), begins)).alias("slot"))
