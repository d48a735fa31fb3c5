"""From raw documents to token ids: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next one's documents.
All stages but the last keep the columns of the documents they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import decontaminate, jaccard_join, langid, sentencepiece, toxicity
from shelfline.llm.queries import TOKENIZER, remainder, table
from shelfline.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or a clear language go."""
    return langid.keep_confident(docs, langid.train(docs, remainder(5) != 0))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles."""
    return jaccard_join.deduplicated(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, ids, and whether they decode to the text."""
    # workers still hold what the stages before needed: small slices, half a worker's memory
    return sentencepiece.encode(docs, sentencepiece.Vocabulary.load(TOKENIZER), slice_bytes=1 << 20)


STAGES = [
    ("language ID", language_id),
    ("toxicity", clean_language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Trained networks are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
