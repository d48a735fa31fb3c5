import hashlib
import random
import re

from shelfline.llm import decontaminate as dc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= {n for n in names if n is not None}
        names = sorted(map(str, found))
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def make(seed, n_docs=80, n_items=25):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "the", "x1", "été", "Ünd", "东京", "no"]
    text = lambda n: draw.choice([" ", "-", ", "]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(n_items)] + [(3, text(12)), (None, text(14)), (77, None)]
    docs = []
    for i in range(n_docs):
        part = text(draw.randrange(0, 60))
        if i % 3 == 0:
            part += " " + (draw.choice(items)[1] or "") + " " + text(4)
        docs.append((i, part))
    docs += [(5, None), (5, ""), (None, "the a"), (900, text(3000) + " " + items[6][1] + " " + text(2500))]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in dc.report(dc.find_items(d, b, **options)).collect()), key=repr)


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs, items = make(seed)
        if seed == 2:  # no very short items, so that shifts are long
            items = [(i, t) for i, t in items if t and len(words(t)) >= 9]
        assert run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = make(3)
    assert run(spark, docs, items, block_bytes=120) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = make(4, 5)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_clean_keeps_columns_and_other_documents(spark):
    docs, items = make(5)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = dc.clean(d, b)
    assert kept.columns == d.columns
    good = [(r[0]) for r in brute(docs, items) if not r[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(good, key=repr)
