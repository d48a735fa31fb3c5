"""What a Python worker holds at once in the pipeline's stages, whatever the size of a batch."""

import random
import tracemalloc
from types import SimpleNamespace

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest

from shelfline.llm import jaccard_join as jj
from shelfline.llm import sentencepiece
from shelfline.llm import text as T


class Rows:
    """Stands for a table: keeps the function that a stage would send to the workers."""

    sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda name: "8"))

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        self.function = function
        return self


@pytest.fixture(scope="module")
def batch():
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(3000)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])


def peak(run):
    T._powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_word_hashes_do_not_depend_on_the_block(batch):
    data, offs = T.buffer(batch.column("text").slice(0, 50))
    starts, ends, _ = T.spans(data, offs, jj.WORD)
    assert (T.word_hashes(data, starts, ends, 100) == T.word_hashes(data, starts, ends, 4 << 20)).all()


def test_sets_of_a_large_batch_need_little_memory(batch):
    rows = Rows()
    jj.set_sizes(rows, 5)
    assert peak(lambda: [None for _ in rows.function(iter([batch]))]) < 100


def test_token_ids_of_a_large_batch_need_little_memory(spark, batch):
    rows, whole = Rows(), Rows()
    cp.token_ids(spark, rows, "")
    sentencepiece.encode(whole, sentencepiece.Vocabulary.load(cp.TOKENIZER))
    some = batch.slice(0, 1200)
    ids = lambda held: pa.concat_arrays([b.column("ids") for b in held.function(iter([some]))])
    assert ids(rows) == ids(whole)  # the words are known from here on
    most = peak(lambda: [None for _ in rows.function(iter([some]))])
    assert most < 0.6 * peak(lambda: [None for _ in whole.function(iter([some]))])
