"""From raw documents to token ids: good texts, one of each group, mixed by source, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
Those that read texts in Python bound the bytes of a batch for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.llm import bpe_automaton, mixing, quality, shingle_dedup
from textrill.llm.common import small_batches, table
from textrill.session import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (operator 3): documents that it rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (operator 5): one document of each group stays."""
    small_batches(spark)
    return shingle_dedup.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (operator 6): each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoding (operator 2): ids of each document, with the digests of ids and decoded text."""
    small_batches(spark)
    coded = bpe_automaton.encode_decode(docs)
    return coded.select(
        "doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("mix", mix_sources),
    ("encode", encode),
]

# A trained classifier and MinHash have no SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
