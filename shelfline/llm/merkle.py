"""Merkle manifest of a document table: leaves, levels of parent-linked nodes, and proofs by a recursive query.

A leaf is the hash of a row's fields.  Each source has a tree of its own over its
leaves by ascending doc_id, sixteen to a node; the subroots, by source, are the
leaves of the top tree.  Levels are built one after the other by grouping and kept
as node rows: a node holds the digests of its children in one binary and the
place of its parent.

``climb`` is a Spark recursive query.  It ascends from every leaf to the root: each
step meets the parent's row, appends the siblings' digests and folds the leaf's
(possibly tampered) hash with them.  The leaves of one run of sixteen share all
ancestors, so a row of the query carries a run, with a folded hash for each leaf and
the common siblings once; a row for every leaf would write the same siblings sixteen
times (about six times the documents' bytes at 250,000 documents).

Hot nodes: every leaf ends at the root.  Leaves are cut into blocks of ``BLOCK``
consecutive ones, a node above several blocks has a row for each, and the block is
part of the join key: no key of the join has more than a block's runs, and a level
has at most one row more for each block.

Results for odd rows: a null field is hashed as ``-``; null sources come first and
form a tree; null doc_ids come first and are never tampered with; rows alike in all
five fields are leaves of their own, next to each other, with the same leaf hash and
different proofs; equal doc_ids with different rows are ordered by leaf hash; empty
texts are hashed as ``0:``; texts of any length are hashed whole, one at a time; a
single leaf is its own root with an empty proof; an empty table gives no rows; columns
other than the five fields are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.numbering import numbered
from shelfline.session import stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RUN = 16
#: Leaves below a block's first and last one; a power of RUN, so that low nodes lie in one block.
BLOCK = RUN**4
TOP = -1  # number of the tree over the subroots

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's five fields, some of them replaced."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def tampered_leaf() -> Column:
    """The leaf of a row whose text was lower-cased (A-Z) where 5 divides its doc_id's CRC-32."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, leaf_hash(text=F.translate("text", _UPPER, _LOWER))).otherwise(F.col("leaf"))


def _hashed(digests: str) -> str:
    """SQL: digest of a binary of digests, which are hashed as lower-case hex text."""
    return f"unhex(sha2(lower(hex({digests})), 256))"


@dataclass(frozen=True)
class Manifest:
    """``runs``: up to sixteen leaves and their parent; ``nodes``: all nodes with children, for each block."""

    runs: DataFrame
    nodes: DataFrame


def _leaves(documents: DataFrame, presented: Column) -> DataFrame:
    """doc_id, leaf, presented leaf, number of the source (tree), place in it (at), its size (n) and overall place."""
    hashes = stored(
        documents.select(*FIELDS, leaf_hash().alias("leaf")).select("doc_id", "source", "leaf", presented.alias("presented")), "leaves"
    )
    placed = numbered(hashes, ["source", "doc_id", "leaf"], "place")
    # a source's share of one range: bounded, however hot the source is
    shares = stored(placed.groupBy("source", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "shares")
    sources = numbered(shares.groupBy("source").agg(F.min("first").alias("begin"), F.sum("n").alias("size")), ["begin"], "tree", "_")
    known = shares.select("source", "part").join(
        sources.select(F.col("source").alias("_s"), "begin", "size", "tree"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "begin", "size", "tree")
    return placed.join(known, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "leaf", "presented", "place", "tree", (F.col("place") - F.col("begin")).alias("at"), F.col("size").alias("n")
    )


def _parents(level: DataFrame, height: int) -> DataFrame:
    """The nodes above those of trees that still have several."""
    grouped = (
        level.where("n > 1")
        .groupBy("tree", F.expr(f"at div {RUN}").alias("_up"))
        .agg(
            F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_c"),
        )
    )
    joined = "aggregate(_c, X'', (a, x) -> concat(a, x.digest))"
    return grouped.select(
        "tree", F.lit(height).alias("height"), F.col("_up").alias("at"), F.expr(f"n div {RUN} + int(n % {RUN} > 0)").alias("n"),
        "lo", "hi", F.expr(joined).alias("children"),
    ).withColumn("digest", F.expr(_hashed("children")))


def _linked(level: DataFrame, trees: int) -> DataFrame:
    """Nodes with their parent's place, and their own in it; the root has none."""
    last = F.col("n") == 1
    subroot = last & (F.col("tree") != TOP)
    none = (last & (F.col("tree") == TOP)) | (subroot & F.lit(trees == 1))
    at = F.when(subroot, F.col("tree")).otherwise(F.col("at"))

    def unless_root(value: Column, kind: str) -> Column:
        return F.when(~none, value).cast(kind)

    return level.select(
        "*", subroot.alias("is_subroot"),
        unless_root(F.when(subroot, TOP).otherwise(F.col("tree")), "long").alias("up_tree"),
        unless_root(F.when(subroot, 1).otherwise(F.col("height") + 1), "int").alias("up_height"),
        unless_root(F.floor(at / RUN), "long").alias("up_at"),
        unless_root(at % RUN, "int").alias("position"),
    )


def _steps(size: int) -> int:
    """Levels above ``size`` nodes."""
    steps = 0
    while size > 1:
        size, steps = -(-size // RUN), steps + 1
    return steps


def build(documents: DataFrame, presented: Column | None = None) -> Manifest:
    """The trees of a table; ``presented`` is the leaf hash that a later check is shown (default: the leaf itself)."""
    leaves = _leaves(documents, F.col("leaf") if presented is None else presented)
    members = F.array_sort(F.collect_list(F.struct("at", "doc_id", "leaf", "presented")))
    first = leaves.groupBy("tree", F.expr(f"at div {RUN}").alias("at")).agg(
        F.max("n").alias("leaves_of_tree"), F.min("place").alias("lo"), (F.max("place") + 1).alias("hi"), members.alias("leaves")
    )
    digests = "aggregate(leaves, X'', (a, x) -> concat(a, x.leaf))"
    runs = stored(
        first.select(
            "tree", F.lit(1).alias("height"), "at", F.expr(f"leaves_of_tree div {RUN} + int(leaves_of_tree % {RUN} > 0)").alias("n"),
            "lo", "hi", "leaves", "leaves_of_tree", F.expr(digests).alias("children"),
        ).withColumn("digest", F.expr(f"if(leaves_of_tree > 1, {_hashed('children')}, children)")),
        "runs",
    )
    columns = ["tree", "height", "at", "n", "lo", "hi", "children", "digest"]
    levels = [runs.where("leaves_of_tree > 1").select(*columns)]
    now = runs.select(*columns)
    facts = runs.agg(F.max("leaves_of_tree"), F.count_distinct("tree")).first()
    largest, trees = facts[0] or 0, facts[1]
    subroots = [now.where("n = 1")]
    for height in range(2, _steps(largest) + 1):
        now = stored(_parents(now, height), "level")
        levels.append(now)
        subroots.append(now.where("n = 1"))
    now = subroots[0]
    for more in subroots[1:]:
        now = now.union(more)
    now = now.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), "lo", "hi", "digest")
    for height in range(1, _steps(trees) + 1):
        now = stored(_parents(now, height), "level")
        levels.append(now)
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.union(more)
    copies = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK)))
    rows = _linked(nodes, trees).select(
        "tree", "height", "at", copies.alias("block"), "children", "digest", "is_subroot", "up_tree", "up_height", "up_at", "position"
    )
    return Manifest(_linked(runs, trees), stored(rows, "nodes"))


def _folded(before: str, value: str, after: str) -> str:
    return _hashed(f"concat({before}, {value}, {after})")


_BEFORE, _AFTER = "substring(n.children, 1, 32 * c.position)", "substring(n.children, 32 * c.position + 33)"

_CLIMB = f"""
WITH RECURSIVE climb (leaves, several, block, up_tree, up_height, up_at, position, proof, subroot, root) AS (
  SELECT
    transform(leaves, (x, i) -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'folded', if(leaves_of_tree > 1,
      {_folded("substring(children, 1, 32 * i)", "x.presented", "substring(children, 32 * i + 33)")}, x.presented))),
    leaves_of_tree > 1, lo div {BLOCK}, up_tree, up_height, up_at, position, X'', if(is_subroot, digest, NULL), if(up_tree IS NULL, digest, NULL)
  FROM {{runs}}
  UNION ALL
  SELECT
    transform(c.leaves, x -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'folded', {_folded(_BEFORE, "x.folded", _AFTER)})),
    c.several, c.block, n.up_tree, n.up_height, n.up_at, n.position, concat(c.proof, {_BEFORE}, {_AFTER}),
    coalesce(c.subroot, if(n.is_subroot, n.digest, NULL)), if(n.up_tree IS NULL, n.digest, NULL)
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.height = c.up_height AND n.at = c.up_at AND n.block = c.block
)
SELECT leaves, several, proof, subroot, root FROM climb WHERE up_tree IS NULL
"""

#: Guards of recursive queries that are meant for runaway recursion; a climb ends at the root.
_UNGUARDED = {"spark.sql.cteRecursionRowLimit": "-1"}


def climb(manifest: Manifest) -> DataFrame:
    """Runs at the root: their leaves with folded hashes, common siblings, subroot and root.  Runs at once."""
    spark = manifest.nodes.sparkSession
    before = {key: spark.conf.get(key) for key in _UNGUARDED}
    try:
        for key, value in _UNGUARDED.items():
            spark.conf.set(key, value)
        return stored(spark.sql(_CLIMB, runs=manifest.runs, nodes=manifest.nodes), "climb")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def proofs(manifest: Manifest) -> DataFrame:
    """One row for each leaf: doc_id, leaf, subroot, root, proof (siblings' digests, binary), folded_root, verified."""
    ends = climb(manifest).withColumn("_row", F.expr("aggregate(leaves, X'', (a, x) -> concat(a, x.leaf))"))
    each = ends.select("*", F.posexplode("leaves").alias("_i", "_x"))
    own = "if(several, concat(substring(_row, 1, 32 * _i), substring(_row, 32 * _i + 33)), X'')"
    return each.select(
        "_x.doc_id", "_x.leaf", "subroot", "root", F.expr(f"concat({own}, proof)").alias("proof"),
        F.col("_x.folded").alias("folded_root"), F.col("_x.folded").eqNullSafe(F.col("root")).alias("verified"),
    )


def report(found: DataFrame) -> DataFrame:
    """``proofs`` with digests as lower-case hex and each proof as the digest of its siblings."""
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "proof", "folded_root")}
    return found.select(
        "doc_id", text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
        F.sha2(text["proof"], 256).alias("proof_sha256"), text["folded_root"].alias("folded_root"), "verified",
    )
