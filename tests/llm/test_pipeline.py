"""Each stage against a brute-force version on its own input, odd rows included."""

import corpus_pipeline as cp
import pytest
from test_decontaminate import brute as hits
from test_jaccard_join import brute as groups
from test_jaccard_join import shingles

from shelfline.llm import sentencepiece, toxicity
from shelfline.llm.queries import QUERIES, TOKENIZER, remainder, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, as ``run`` hands them on."""
    docs = table(spark, sf_dir, "documents")
    odd = [(None, "words without an id", "en", None, 1), (10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", None, None, None)]
    item = table(spark, sf_dir, "benchmark").first().text
    odd += [(10_004, f"something before {item} and after", "en", "s", 9), (10_005, "plain text of its own kind", None, None, None), (10_005, "plain text of its own kind", None, None, None)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    found = []
    for number, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs, out))
        docs = out
    return found


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(spark, sf_dir, stages):
    columns = table(spark, sf_dir, "documents").columns
    assert all(out.columns == columns for _, out in stages[:-1])


def test_language_stage(stages):
    before, after = map(rows, stages[0])
    kept = sorted(after, key=repr)
    assert kept == sorted([r for r in before if r[1] and any(c.isalpha() for c in r[1])], key=repr)


def test_toxicity_stage(spark, sf_dir, stages):
    docs, out = stages[1]
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert sorted(rows(out), key=repr) == sorted([r for r in rows(docs) if scored[r[0]] < 0.5], key=repr)


def test_duplicate_stage(stages):
    before, after = map(rows, stages[2])
    assert all(len(shingles(t, 5)) for _, t in before)
    import test_jaccard_join as t

    plain, t.shingles = t.shingles, lambda text, k=5: shingles(text, k)
    try:
        want = {c for _, _, c in groups(before, 80)}
    finally:
        t.shingles = plain
    assert {d for d, _ in after} == want and len(after) == len(want)


def test_decontamination_stage(spark, sf_dir, stages):
    before, after = map(rows, stages[3])
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    good = [r[0] for r in hits(before, items) if not r[5]]
    assert sorted((d for d, _ in after), key=repr) == sorted(good, key=repr) and 10_004 not in good


def test_token_stage(spark, stages):
    docs, out = stages[4]
    assert out.where("NOT round_trip").count() == 0 and out.count() == docs.count()
    back = {r.doc_id: r.text for r in sentencepiece.decode(out, sentencepiece.Vocabulary.load(TOKENIZER)).collect()}
    assert back == dict(rows(docs))


def test_run_gives_the_same_shape(spark, sf_dir):
    assert cp.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_every_query_is_registered(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
