import random

import pytest

from shelfline.llm import sentencepiece as sp

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def library():
    """The same pieces in the library's own best-path search, and here.

    The library adds scores in single precision: runs of marks, at -1e9 in the
    file, get a score that leaves sums exact.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000)
    ours = sp.Vocabulary.of([(p.piece, p.score, p.type) for p in model.pieces])
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), ours


TEXTS = ["", " ", "  ", "a", "Hello world", "a  b   c ", "line one\nline two\n\n three", "\ttab", "naïve café 東京 😀", "x" * 300, "the the then theme", "▁mark", " lead", "執 벨 \x00"]


def random_texts(n):
    draw = random.Random(5)
    letters = "abcdeinorst  éü\n.,東"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 200))) for _ in range(n)]


def test_matches_the_library(library):
    library, vocabulary = library
    texts = TEXTS + random_texts(300)
    ids, offs = sp.encode_texts(texts, vocabulary)
    for i, text in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == library.encode(text), repr(text)


def test_ids_are_those_of_the_unmodified_model(vocabulary):
    import pyarrow.parquet as pq
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    documents = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    texts = TEXTS + random_texts(300) + [" " * n for n in range(1, 70)] + [t for t in documents if t]
    ids, offs = sp.encode_texts(texts, vocabulary)
    for i, text in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == processor.encode(text), repr(text[:80])


def test_merges_are_not_the_best_path():
    pieces = [("<unk>", 0, 2), ("▁", -9, 1), ("a", -8, 1), ("b", -7, 1), ("c", -6, 1), ("ab", -1, 1), ("bc", -2, 1)]
    assert sp.segment(["abc", "abcbcé"], sp.Vocabulary.of(pieces, merges=True)) == [[5, 4], [5, 4, 6, 0]]


def test_round_trip_and_nulls(spark, vocabulary):
    texts = [t for t in TEXTS + random_texts(50) if "▁" not in t]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, None), (99, None, None), (None, "a b", "x")], "doc_id long, text string, ids string")
    encoded = sp.encode(docs, vocabulary)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 3
    assert all(r.round_trip for r in rows if r.doc_id != 99)
    assert [(r.n_tokens, r.ids, r.round_trip) for r in rows if r.doc_id == 99] == [(0, [], None)] * 2
    decoded = {r.doc_id: r.text for r in sp.decode(encoded, vocabulary).collect()}
    assert all(decoded[i] == t for i, t in enumerate(texts))


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(docs, vocabulary).collect() == []


def test_unknown_without_byte_pieces():
    small = sp.Vocabulary.of([("<unk>", 0, 2), ("▁", -2, 1), ("a", -1, 1), ("ab", -1.5, 1), ("b", -3, 1)])
    ids, offs = sp.encode_texts(["ab qq", None], small)
    assert ids.tolist() == [1, 3, 1, 0] and offs.tolist() == [0, 4, 4]


def test_ids_outside_the_vocabulary_fail(spark, vocabulary):
    bad = spark.createDataFrame([(1, [5_000_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        sp.decode(bad, vocabulary).collect()


def test_words_kept_from_slice_to_slice_have_the_same_ids(vocabulary):
    """Small generations are dropped and refilled in between."""
    texts = [f"The government of word{i % 37} and policy{i % 11} goes on, {i}" for i in range(120)]
    expected = sp.encode_texts(texts, vocabulary)
    kept, ids = sp.Words(most=20), []
    for begin in range(0, 120, 10):
        found, _ = sp.encode_texts(texts[begin : begin + 10], vocabulary, kept)
        ids += found.tolist()
    assert ids == expected[0].tolist() and len(kept.now) < 80
