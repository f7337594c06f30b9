"""The corpus pipeline: toxicity filter, exact and near deduplication, packing. Each stage is one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import exact_dedup, packing, simhash, toxicity
from glyphmill.llm.common import free_name, materialize, tokenizer_path
from glyphmill.llm.queries import table

#: Score from which a document is rejected.
REJECT = 0.5
#: Further fingerprints of a document by which near copies are linked.
FINGERPRINTS = 15


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return toxicity.score(docs, model, docs.columns, name=name).where(F.col(name) < REJECT).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id.

    One fingerprint links under half of the copies that differ in a word; FINGERPRINTS of other hashes find more.
    """
    return simhash.keep_rows(docs, further=FINGERPRINTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: A classifier and fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
