import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shelfline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(digests):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def by_hand(rows):
    """Every row's manifest line from plain loops over the whole table."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    leaf = lambda r: digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    by_source = {}
    for row in rows:
        r, shown = row[:5], row[:5]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            shown = (*r[:4], r[4].translate(lower))
        by_source.setdefault(r[1], []).append((r[0], leaf(r), leaf(shown)))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [levels([x[1] for x in by_source[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, own, shown) in enumerate(by_source[s]):
            siblings, folded = [], shown
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    begin = at // 16 * 16
                    left, right = level[begin:at], level[at + 1 : begin + 16]
                    siblings += left + right
                    folded, at = digest(*left, folded, *right), at // 16
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], digest(*siblings), folded, folded == top[-1][0]))
    return out


def check(spark, rows):
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA), merkle.tampered_leaf())
    found = merkle.report(merkle.proofs(manifest)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, by_hand(rows)))
    return found


def test_against_plain_loops(spark, monkeypatch):
    """Sources of 1 to 600 leaves, with last runs of one node, and blocks smaller than the trees."""
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "_CLIMB", merkle._CLIMB.replace(str(16**4), "16"))
    rows = [(i, s, "en", i, f"Text {s} {i}", 0) for s, n in (("a", 600), ("b", 1), ("c", 16), ("d", 17), ("é", 257), ("Z", 2)) for i in range(n)]
    found = check(spark, rows)
    assert 0 < sum(not r.verified for r in found) < len(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None, 0), (None, None, None, None, None, 1), (5, None, "", 0, "", 2),
        (7, "a", "en", 3, "ABC", 3), (7, "a", "en", 3, "ABC", 4), (7, "a", "en", 3, "abd", 5),
        (8, "", "en", 1, "É:", 6), (9, "a", None, 2_000_000, "Long tExt " * 200_000, 7),
    ]
    check(spark, rows)


def test_one_leaf_and_no_leaf(spark):
    (row,) = check(spark, [(0, "a", "en", 1, "A", 0)])
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")
    assert check(spark, []) == []


@pytest.mark.parametrize("changed, expected", [("text", False), ("doc_id", True)])
def test_any_change_of_a_field_is_seen(spark, changed, expected):
    """Of 40 rows the presented one of doc 3 has another text; or nothing is changed."""
    docs = spark.createDataFrame([(i, "a", "en", 1, f"t{i}", 0) for i in range(40)], SCHEMA)
    other = merkle.leaf_hash(text=F.lit("x")) if changed == "text" else F.col("leaf")
    found = merkle.proofs(merkle.build(docs, F.when(F.col("doc_id") == 3, other).otherwise(F.col("leaf"))))
    assert {r.doc_id: r.verified for r in found.collect()} == {i: expected or i != 3 for i in range(40)}
