"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Sizes fall into bands.  In the tile of a band, with K fixed blocks of the hash
range, two sets that reach the threshold differ in fewer elements than there are
blocks, so that one block at least is the same in both: blocks are the join key,
and no pair is lost.  K leaves room for blocks that are empty; a set with more
empty blocks than that room also shares its empty blocks as keys.

1. Every set has a hash of each block.  Equal keys within a piece of a task form local
   stars, whose pairs are tested there, where the sets are at hand, and contracted; a
   key then has one row for each piece at most, however many copies there are.  These
   rows meet as a star again: (key, smallest document, other).
2. Of the stars between pieces, bit counts of hashed bitmaps (made where the sets are at
   hand) leave few pairs; those are verified exactly, over texts of their documents alone.
   All links make components.
3. Keys whose stars join different components are looked at in full (the stars of
   a key hold all its sets): within such a key, sets of different components meet in
   tiles of bounded size, where the same bitmaps bound the overlap from above before
   the exact intersection of sorted arrays.

Only components and exact links between distinct texts are asked for, so copies
are never expanded into all their pairs.  Shingles are 64-bit hashes of words
(two different shingles of one pair agree by chance once in 10**13 pairs or so).

Nulls and odd rows: a null or wordless text has an empty set, linked with nothing;
fewer words than a shingle make one shingle; rows without doc_id have no links and
no component; repeated doc_ids are one node, one row each in the result; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import text as T
from shelfline.llm.components import components
from shelfline.session import stored

#: All bytes but the space and tab to carriage return.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SALT = np.uint64(0x165667B19E3779F9)

#: Ratio of a band's bounds, bytes of texts hashed at a time, keys and shingles held at a time, sets of a
#: tile's side, and keys that a set brings into its tiles.
BAND = 1.5
SLICE = 1 << 20
PIECE = 2_000_000
TILE = 1024
FIRST = 8


def enough(inter, size_a, size_b, percent: int):
    """Jaccard similarity of at least ``percent`` hundredths, in whole numbers."""
    return 100 * inter >= percent * (size_a + size_b - inter)


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, offs, WORD)
    h = T.word_hashes(data, starts, ends)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled = rolled * _STEP
        rolled[: n - j] += h[j:]
    rolled = T.mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = T.mixed(np.array([short]) * _STEP + x)[0]
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands, with the number of blocks and the room for empty ones in each band's tile."""

    def __init__(self, percent: int) -> None:
        self.percent, self.bands = percent, []

    def _grow(self) -> None:
        low = self.bands[-1][1] + 1 if self.bands else 1
        high = max(low, int(low * BAND))
        differ = (2 * high * (100 - self.percent)) // (100 + self.percent)
        least = -(-low * self.percent // 100)
        blocks, room = differ + 1, 0
        if differ:
            empty = blocks * math.exp(-least / blocks)
            room = math.ceil(empty + 2 * math.sqrt(empty))
        self.bands.append((low, high, least, blocks + room, room))

    def tiles(self, n: int) -> list[tuple[int, int, int]]:
        """(band, blocks, room) of every tile that a set of n elements belongs to."""
        while not self.bands or self.bands[-1][2] <= n:
            self._grow()
        return [(i, k, room) for i, (_, high, least, k, room) in enumerate(self.bands) if least <= n <= high]


def keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The join keys of a set: one for each tile and non-empty block, and for empty ones beyond the room."""
    spread = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mixed(s * _STEP + _SALT))])
    out = []
    for band, blocks, room in bands.tiles(len(s)):
        edges = (np.arange(1, blocks, dtype=np.float64) * (2.0**64 / blocks)).astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        number = np.arange(blocks, dtype=np.uint64) + np.uint64(band << 32)
        key = T.mixed(spread[at[1:]] - spread[at[:-1]] + T.mixed(number * _SALT + _STEP))
        full = at[1:] > at[:-1]
        out.append(key if blocks - full.sum() > room else key[full])
    return np.concatenate(out)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def set_sizes(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, n_shingles, a digest and a bitmap of the set, one row for each document."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in T.slices(whole, limit=SLICE):
                sets = shingle_sets(*T.buffer(batch.column("text")), words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(map(_digest, sets), pa.binary()),
                        pa.array([_bitmap(s).tobytes() for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bits"],
                )

    return documents.mapInArrow(sizes, "doc_id long, n_shingles long, digest binary, bits binary")


#: What a row says: a key and its document; a star between pieces, not tested yet; a star
#: of one piece with its ends in different or in the same component there; a link.
KEY, UNTESTED, APART, TOGETHER, LINK = range(5)

_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("k", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])


def _packed(parts: np.ndarray, kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[dict]:
    """Rows of the columns' bytes, one for each run of equal parts and 20,000 entries at most."""
    for place in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
        for at in range(0, len(place), 20_000):
            cut = slice(place[at], place[min(at + 20_000, len(place)) - 1] + 1)
            yield dict(part=int(parts[place[at]]), kind=kind, k=key[cut].tobytes(), a=a[cut].tobytes(), b=b[cut].tobytes())


def _stars(key: np.ndarray, doc: np.ndarray):
    """Sorted distinct keys, each one's smallest document, and star rows (key, center, other) for the rest."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    begins = np.ones(len(key), bool)
    begins[1:] = key[1:] != key[:-1]
    center = doc[begins][np.cumsum(begins) - 1]
    rest = ~begins & (center != doc)
    return key[begins], doc[begins], key[rest], center[rest], doc[rest]


def contracted(sets: list[np.ndarray], docs: np.ndarray, pairs: np.ndarray, percent: int):
    """Each set's component under the links among the pairs, and the links (document, document) that made them.

    ``docs`` ascend; sets of one document are one node.  A pair within a component is not tested again.
    """
    root = np.searchsorted(docs, docs).tolist()
    size = np.array([len(s) for s in sets], np.int64)
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    few, many = np.sort(size[pairs], axis=1).T
    for a, b in pairs[enough(few, few, many, percent)].tolist():
        x, y = find(a), find(b)
        if x != y and linked(sets[a], sets[b], percent):
            root[max(x, y)] = min(x, y)
            links.append((docs[a], docs[b]))
    return np.array([find(i) for i in range(len(sets))], np.int64), np.array(links, np.int64).reshape(-1, 2)


def star_rows(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(kind, k, a, b): links, and stars of documents a and b that share key k.

    Each key's sets are those of its stars, by way of one star within each piece.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks

    def rows(held: list) -> Iterator[dict]:
        held.sort(key=lambda row: row[0])
        docs, sets = np.array([d for d, _, _ in held], np.int64), [s for _, s, _ in held]
        at = np.repeat(np.arange(len(held)), [len(ks) for _, _, ks in held])
        key, first, star_k, star_c, star_d = _stars(np.concatenate([ks for _, _, ks in held]), at)
        pairs = np.unique(np.stack([star_c, star_d], axis=1), axis=0)
        component, links = contracted(sets, docs, pairs, percent)
        part = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        yield from _packed(part, KEY, key, docs[first], docs[:0])
        spread = lambda n: (np.arange(n) // 20_000 * 7919 + docs[0]) % parts
        same = component[star_c] == component[star_d]
        for kind, some in ((APART, ~same), (TOGETHER, same & (docs[star_c] != docs[star_d]))):
            yield from _packed(spread(some.sum()), kind, star_k[some], docs[star_c[some]], docs[star_d[some]])
        yield from _packed(spread(len(links)), LINK, np.zeros(len(links), np.uint64), links[:, 0], links[:, 1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, seen, count = Bands(percent), [], set(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(rows(held)) if held else []
            held.clear(), seen.clear()
            for at in range(0, len(found), 16):
                yield pa.RecordBatch.from_pylist(found[at : at + 16], _PACKED)

        for whole in batches:
            for batch in T.slices(whole, limit=SLICE):
                sets = shingle_sets(*T.buffer(batch.column("text")), words)
                for doc, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                    if doc is None or not len(s) or (digest := _digest(s)) in seen:
                        continue
                    seen.add(digest)
                    held.append((doc, s, keys(s, bands)))
                    count += len(s) + len(held[-1][2])
                if count > PIECE:
                    yield from flush()
                    count = 0
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, out = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                k, a, b = (np.frombuffer(row[c], t) for c, t in (("k", np.uint64), ("a", np.int64), ("b", np.int64)))
                if row["kind"] == KEY:
                    key.append(k)
                    doc.append(a)
                else:
                    out.append((row["kind"], k, a, b))
        if key:
            out.append((UNTESTED, *_stars(np.concatenate(key), np.concatenate(doc))[2:]))
        for kind, k, a, b in out:
            for at in range(0, len(k), 100_000):
                piece = slice(at, at + 100_000)
                kinds = pa.array(np.full(len(k[piece]), kind, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kinds, pa.array(k[piece].view(np.int64)), pa.array(a[piece]), pa.array(b[piece])], ["kind", "k", "a", "b"]
                )

    packed = documents.mapInArrow(send, "part int, kind int, k binary, a binary, b binary")
    return packed.repartition(tasks, "part").mapInArrow(meet, "kind int, k long, a long, b long")


def _bitmap(s: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, three times the set's size at least (64 to 131,072)."""
    bits = 1 << min(17, max(6, int(3 * len(s) - 1).bit_length()))
    raw = np.zeros(bits, bool)
    raw[(T.mixed(s ^ _SALT) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(raw).view(np.uint64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap with fewer bits."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def bounded(a: np.ndarray, size_a, b: np.ndarray, size_b):
    """An upper bound of the overlap of two sets, from bitmaps of equal length (b may be many)."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Bit counts first, then the exact intersection of the sorted arrays."""
    x, y = _bitmap(a), _bitmap(b)
    few = min(len(x), len(y))
    if not enough(bounded(_folded(x, few), len(a), _folded(y, few), len(b)), len(a), len(b), percent):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return bool(enough(int((large[at] == small).sum()), len(a), len(b), percent))


def likely(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sizes and bitmaps allow the threshold; ``sizes`` are those of set_sizes."""
    side = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    close = sized.where(f"100 * least(n_a, n_b) >= {int(percent)} * greatest(n_a, n_b)")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [batch.column(c).to_pylist() for c in ("bits_a", "bits_b")]
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            lengths = np.array([[len(x) // 8 for x in m] for m in maps], np.int64).reshape(2, -1)
            good = np.zeros(batch.num_rows, bool)
            for la, lb in np.unique(lengths, axis=1).T.tolist():
                at = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
                few = min(la, lb)
                a, b = (
                    np.bitwise_or.reduce(np.frombuffer(b"".join([m[i] for i in at]), np.uint64).reshape(len(at), -1, few), axis=1)
                    for m in maps
                )
                good[at] = enough(bounded(a, n_a[at], b, n_b[at]), n_a[at], n_b[at], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    found = close.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long")
    return found.distinct()


def texts_of(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of the documents of some stored pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    return stored(table.join(wanted, "doc_id", "left_semi"), "texts")


def verified(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets reach the threshold; ``texts`` are those of their documents."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(
        texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for whole in batches:
            for batch in T.slices(whole, "tb", SLICE):
                right = shingle_sets(*T.buffer(batch.column("tb")), words)
                good = np.zeros(batch.num_rows, bool)
                texts_a, ids_a = batch.column("ta"), batch.column("a").to_pylist()
                for i, s in enumerate(right):
                    if ids_a[i] != last:
                        last, left = ids_a[i], shingle_sets(*T.buffer(texts_a.slice(i, 1)), words)[0]
                    good[i] = len(s) and len(left) and linked(left, s, percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _tile_pairs(sizes: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """Of sets that share a key (k, doc, comp, rows): pairs of different components that sizes and bitmaps allow.

    A tile leaves a pair to the tile of a smaller key if both sets have that key among their FIRST smallest
    ones.  The tile of the smallest common key never does, so no pair is lost, and few come twice.
    """
    own = rest.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("k")), 1, FIRST).alias("keys"))

    bitmaps = sizes.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "bits").join(own, "doc")
    sides = F.ceil(F.col("rows") / TILE).cast("int")
    rows = rest.withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("doc"), F.col("sides")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")
    tiles = rows.select("k", "doc", "comp", "side", other).select(
        "k", "doc", "comp", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side"
    )

    def compare(tile: pa.Table) -> pa.Table:
        k, x, y = (tile.column(c)[0].as_py() for c in ("k", "x", "y"))
        doc, comp, n, side = (tile.column(c).to_numpy() for c in ("doc", "comp", "n", "side"))
        maps = [np.frombuffer(b, np.uint64) for b in tile.column("bits").to_pylist()]
        few = min(map(len, maps))
        stack = np.stack([_folded(m, few) for m in maps])
        own = np.array([ks + [k] * (FIRST - len(ks)) for ks in tile.column("keys").to_pylist()], np.int64)
        out = []
        for i in np.flatnonzero(side == x).tolist():
            able = (comp != comp[i]) & (side == y) & ((doc > doc[i]) | (x != y))
            able &= enough(np.minimum(n, n[i]), n, n[i], percent)
            j = np.flatnonzero(able)
            if len(j):
                j = j[enough(bounded(stack[i], n[i], stack[j], n[j]), n[j], n[i], percent)]
                j = j[~np.isin(own[j], own[i][own[i] < k]).any(axis=1)]
                out.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])]))
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": found[0], "b": found[1]})

    return tiles.join(bitmaps, "doc").groupBy("k", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _worth_comparing(rest: DataFrame) -> DataFrame:
    """(k, doc, comp, rows) without keys of one component or of two sets (their star was that pair), and one
    key of those with the same sets."""
    groups = rest.groupBy("k").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("members"),
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
    )
    some = groups.where("rows > 2 AND low < high").groupBy("rows", "members").agg(F.min("k").alias("k"))
    return rest.join(some.select("k", "rows"), "k")


def near_duplicates(documents: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = stored(set_sizes(table, words), "sizes")
    some = sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    first = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = stored(some.join(first, "digest").select("doc_id", "rep"), "representatives")
    copies = reps.where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    stars = stored(star_rows(table, words, percent), "stars")
    rep_of = lambda name: reps.select(F.col("doc_id").alias(name), F.col("rep").alias(f"rep_{name}"))
    met = stars.where(F.col("kind") == UNTESTED).select("a", "b").distinct().join(rep_of("a"), "a").join(rep_of("b"), "b")
    pairs = met.where("rep_a != rep_b").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    pairs = stored(pairs, "set-pairs")
    close = stored(likely(pairs, sizes, percent), "pairs")
    near = stars.where(F.col("kind") == LINK).select("a", "b").union(copies)
    links = stored(verified(texts_of(table, close), close, words, percent).union(near), "links")

    comps = components(links)
    in_comp = lambda name: comps.select(F.col("node").alias(name), F.col("component").alias(f"comp_{name}"))
    unlike = stars.where(F.col("kind").isin(UNTESTED, APART)).select("a", "b").distinct()
    where = unlike.join(in_comp("a"), "a", "left").join(in_comp("b"), "b", "left")
    apart = where.where("coalesce(comp_a, a) != coalesce(comp_b, b)").select("a", "b")
    open_keys = stored(stars.join(apart, ["a", "b"], "left_semi").select("k").distinct(), "open-keys")
    if not open_keys.isEmpty():
        within = stars.where(F.col("kind") != LINK).join(open_keys, "k", "left_semi")
        rest = (
            within.select("k", F.col("a").alias("doc"))
            .union(within.select("k", "b"))
            .join(rep_of("doc"), "doc")
            .join(comps.select(F.col("node").alias("rep_doc"), "component"), "rep_doc", "left")
            .select("k", F.col("rep_doc").alias("doc"), F.coalesce("component", "rep_doc").alias("comp"))
            .distinct()
        )
        rest = stored(_worth_comparing(rest), "open-rows")
        found = stored(_tile_pairs(sizes, rest, percent).join(close, ["a", "b"], "left_anti"), "pairs")
        more = verified(texts_of(table, found), found, words, percent)
        comps = components(links.union(stored(more, "links")))
    found = sizes.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns; rows without id stay."""
    classes = near_duplicates(documents, words, percent)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    kept = documents.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(documents.where("doc_id IS NULL")).select(documents.columns)
