import math
from collections import Counter

from shelfline.llm import license_scan as ls


def run(spark, rows):
    table = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, licence string")
    return sorted(((r.path, r.licence, r.how, r.folder) for r in ls.scan(table).collect()), key=repr)


def test_headers_files_and_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("r/LICENSE", gpl),
        ("r/a.txt", "plain words only"),
        ("r/src/b.txt", "plain words only"),
        ("r/src/own.txt", "some text here " * 30 + f"\n{apache}\nmore text"),
        ("r/lib/COPYING", "\n".join([mit, "prose that goes on about other things entirely"])),
        ("r/lib/deep/er/c.txt", "plain"),
        ("r/lib/deep/er/c.txt", "plain"),
        ("other/d.txt", None),
        ("other/e.txt", ""),
        ("other/talk.txt", "we spoke about a license and the version of the public work we use " * 30),
        (None, mit),
        ("top.txt", "plain"),
    ]
    assert run(spark, rows) == sorted(
        [
            ("r/LICENSE", "GPL-3.0", "header", "r"),
            ("r/a.txt", "GPL-3.0", "inherited", "r"),
            ("r/src/b.txt", "GPL-3.0", "inherited", "r"),
            ("r/src/own.txt", "Apache-2.0", "header", "r/src"),
            ("r/lib/COPYING", "MIT", "header", "r/lib"),
            ("r/lib/deep/er/c.txt", "MIT", "inherited", "r/lib"),
            ("r/lib/deep/er/c.txt", "MIT", "inherited", "r/lib"),
            ("other/d.txt", None, None, None),
            ("other/e.txt", None, None, None),
            ("other/talk.txt", None, None, None),
            (None, None, None, None),
            ("top.txt", None, None, None),
        ],
        key=repr,
    )


def test_every_template_is_its_own_best_match(spark):
    rows = [(f"d/{i}.txt", text) for i, (_, text) in enumerate(ls.TEMPLATES)]
    found = {p: licence for p, licence, _, _ in run(spark, rows)}
    assert [found[f"d/{i}.txt"] for i in range(len(rows))] == [licence for licence, _ in ls.TEMPLATES]


def test_signature_leaves_too_little(spark):
    rows, _, _ = ls.weights()
    chosen = set(ls.signature(rows, 0.3))
    for number in {r[0] for r in rows}:
        assert sum(w * w for n, _, t, w in rows if n == number and t not in chosen) < 0.09


def test_empty_table(spark):
    assert run(spark, []) == []


def test_terms_are_counted_without_a_shuffle(spark):
    rows, idf, other = ls.weights()
    lists = {"a": ["released", "mit", "license", "mit", "b", "b", "c"], "b": ["public", "work"] * 3 + ["zz"], "c": ["none", "known"]}
    table = spark.createDataFrame([(k, v) for k, v in lists.items()], "path string, terms array<string>")
    out = ls.matches(table, ["path"], 0.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

    def best(terms):
        w = {t: n * idf.get(t, other) for t, n in Counter(terms).items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        dots = {}
        for number, licence, term, share in rows:
            if term in w:
                dots[number, licence] = dots.get((number, licence), 0.0) + w[term] * share
        return min((-round(dot / length, 9), licence) for (_, licence), dot in dots.items()) if dots else None

    want = {k: best(v) for k, v in lists.items()}
    assert {r.path: (-r.score, r.licence) for r in out.collect()} == {k: v for k, v in want.items() if v}
