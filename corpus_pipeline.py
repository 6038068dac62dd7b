"""From raw documents to token ids: five stages of training-data operators.

1. quality: documents that the classifier rejects go.
2. near-duplicates: one document of each group stays. SimHash covering masks and
   bands find candidates, links are exact: five-word shingles, similarity 0.8.
3. personal data: base spans are generalised, disclosing terms removed.
4. mixing: sources are taken to their target weights, whole epochs repeated.
5. tokens: whole texts are encoded, and decoded again.

Every stage works on all rows that its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import mixing, pii, piece_bpe, quality, similar
from tensorloom.llm.common import checkpointed, table
from tensorloom.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", sanitise),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL has no form of the classifier, the fingerprints and the tokenizer; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is computed once and cut off from its lineage."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
