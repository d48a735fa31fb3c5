import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import jaccard_join as jj

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def make(seed):
    draw = random.Random(seed)
    rows = [(None, "a b c d e"), (None, "a b c d e"), (1, None), (2, ""), (3, " \t "), (4, "one two"), (5, "ONE two"), (6, "one  two three"), (7, "x"), (8, "x")]
    n = 10
    passage = [f"p{i}" for i in range(30)]
    for size in (4, 5, 8, 13, 20, 40, 90, 200, 700):
        for _ in range(4):
            base = [f"w{draw.randrange(3000)}" for _ in range(size)]
            if size > 20:
                base[3:3] = passage
            for copy in range(7):
                rows.append((n, edited(draw, base, copy * max(1, size // 90))))
                n += 1
    chain = [f"c{i}" for i in range(300)]
    for step in range(40):  # each next text is near the one before it only
        chain[step * 5] = f"z{step}"
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, rows[-1][1]), (n, rows[-1][1]), (40, rows[60][1])]  # repeated rows, one id with two texts
    draw.shuffle(rows)
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    return sorted((tuple(r) for r in jj.near_duplicates(docs.repartition(3)).collect()), key=repr)


def test_matches_brute_force(spark):
    rows = make(1)
    assert run(spark, rows) == brute(rows)


def test_small_pieces_and_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 3)
    rows = make(2)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_one_of_each_group_stays(spark):
    rows = make(3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    kept = jj.deduplicated(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute(rows) if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 2**32))
def test_sets_at_the_threshold_share_a_key(size, edits, seed):
    draw = np.random.default_rng(seed)
    a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
    drop = draw.permutation(len(a))[: draw.integers(0, edits + 1)]
    b = np.unique(np.concatenate([np.delete(a, drop), draw.integers(0, 2**63, draw.integers(0, edits + 1), dtype=np.uint64)]))
    inter = len(np.intersect1d(a, b))
    if len(b) and jj.enough(inter, len(a), len(b), 85):
        bands = jj.Bands(85)
        assert np.intersect1d(jj.keys(a, bands), jj.keys(b, bands)).size
        assert jj.linked(a, b, 85)
    elif len(b):
        assert not jj.linked(a, b, 85)
    x, y = jj._bitmap(a), jj._bitmap(b)
    few = min(len(x), len(y))
    assert jj.bounded(jj._folded(x, few), len(a), jj._folded(y, few), len(b)) >= inter


def test_texts_are_joined_for_likely_pairs_only(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"w{rng.random()}" for _ in range(40)])) for i in range(60)]
    rows += [(60, rows[5][1] + " more"), (61, rows[6][1] + " else")]
    joined, real = [], jj.stored
    monkeypatch.setattr(jj, "stored", lambda df, label: joined.append(df.count()) or real(df, label) if label == "texts" else real(df, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in jj.near_duplicates(docs).collect()}
    assert found == {i: i for i in range(60)} | {60: 5, 61: 6}
    assert sum(joined) <= 8
