"""Word vectors and document vectors.

``word_vec(word, vec ARRAY<FLOAT>, origin)`` has one row per word; ``origin`` is ``base`` for
the vocabulary trained first and ``added`` for words met later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrill.config import JoinPolicy
from textrill.operators import word_blocks
from textrill.operators.joins import fits_broadcast, lookup_join, measure
from textrill.operators.labelled import with_ordinal
from textrill.operators.tfidf import exploded
from textrill.session import materialise, path_exists

# Tokens that one training task takes, and what the driver may hold of a vocabulary in training.
TASK_TOKENS = 500_000
DRIVER_BYTES = 512 << 20


def train_word_vectors(
    corpus: DataFrame,
    size: int = 50,
    min_count: int = 1,
    window: int = 5,
    step: float = 0.025,
    iterations: int = 1,
    partitions: int | None = None,
    seed: int = 1,
    origin: str = "base",
    driver_bytes: int = DRIVER_BYTES,
) -> DataFrame:
    """F6. Vectors of the words of ``corpus(tokens)``. Fails loudly if nothing can be trained.

    Without ``partitions``, one task trains on about ``TASK_TOKENS`` tokens; the library averages what the tasks
    learned of a word. It holds vocabulary and vectors on the driver, so words are counted on Spark first, and a
    vocabulary beyond ``driver_bytes`` is an error before any of it is collected.
    """
    texts = materialise(corpus.select("tokens"), "corpus")
    counted = corpus_vocabulary(texts).where(F.col("cn") >= min_count)
    words, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("cn"), F.lit(0))).first()
    held = words * word_bytes(size)
    if held > driver_bytes:
        raise ValueError(
            f"{words} words need about {held >> 20} MB on the driver, more than {driver_bytes >> 20} MB: "
            "raise min_count, or driver_bytes with the driver's memory"
        )
    model = Word2Vec(
        vectorSize=size,
        minCount=min_count,
        windowSize=window,
        stepSize=step,
        maxIter=iterations,
        numPartitions=partitions or max(1, -(-tokens // TASK_TOKENS)),
        seed=seed,
        inputCol="tokens",
        outputCol="vector",
    ).fit(texts)
    return from_model(model, origin)


def word_bytes(size: int) -> int:
    """About what a word takes on the driver: its tree path, and two vectors kept twice."""
    return 600 + 16 * size


def from_model(model: Word2VecModel, origin: str = "base") -> DataFrame:
    """The vectors of a trained model as a table."""
    return model.getVectors().select(
        "word",
        vector_to_array("vector", "float32").alias("vec"),
        F.lit(origin).alias("origin"),
    )


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S8. A saved word-vector table, or a saved model."""
    if path_exists(spark, f"{path}/metadata"):  # what the library writes beside its data
        return from_model(Word2VecModel.load(path))
    return spark.read.parquet(path).select("word", "vec", "origin")


def vector_sizes(word_vec: DataFrame, size: int) -> tuple[int, int]:
    """The words of a table, and the bytes that one and its vector take in a task."""
    return measure(word_vec, "word", 96 + 8 * size)


class VectorTable:
    """Word vectors within the broadcast bound, sent to the tasks once."""

    def __init__(self, words: pa.Array, vectors: np.ndarray, spark: SparkSession):
        self.shared = spark.sparkContext.broadcast((words, vectors))

    @classmethod
    def of(cls, word_vec: DataFrame) -> "VectorTable":
        found = word_vec.where("word IS NOT NULL AND vec IS NOT NULL").select("word", F.col("vec").cast("array<double>")).toArrow()
        lists = found["vec"].combine_chunks()
        vectors = pc.fill_null(lists.flatten(), 0.0).to_numpy().reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))
        return cls(found["word"].combine_chunks(), vectors, word_vec.sparkSession)


def row_vectors(docs: DataFrame, table: VectorTable, size: int, carry: Sequence[str] = ()) -> DataFrame:
    """F7 for each row by itself: ``(id, *carry, features)``, rows that share an id stay apart."""
    kept = docs.select("id", *carry, "tokens")
    keys = kept.columns[:-1]
    types = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys)
    shared = table.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        for batch in batches:
            tokens = batch.column(len(keys))
            counts = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            at = pc.index_in(tokens.flatten(), value_set=words)
            row = np.repeat(np.arange(len(counts)), counts)[at.is_valid().to_numpy(zero_copy_only=False)]
            known = at.drop_null().to_numpy()
            out = np.zeros((len(counts), size))
            for k in range(min(size, vectors.shape[1])):
                out[:, k] = np.bincount(row, weights=vectors[known, k], minlength=len(counts))
            out /= np.maximum(counts, 1)[:, None]
            ends = np.arange(len(counts) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(ends, out.ravel())], [*keys, "features"]
            )

    return kept.mapInArrow(run, f"{types}, features array<double>")


def document_vectors(
    docs: DataFrame,
    word_vec: DataFrame,
    size: int,
    carry: Sequence[str] = (),
    policy: JoinPolicy = JoinPolicy(),
    measured: tuple[int, int] | None = None,
) -> DataFrame:
    """F7. ``(id, *carry, features)``: the sum of known words' vectors over the count of all tokens.

    Unknown words add nothing but count in the divisor; a text without tokens gets zeros.
    If the vector table may be broadcast, it goes to the rows, which stay where they are, and nothing is shuffled.
    Otherwise a block of texts looks each of its distinct words up once; rows that share id and ``carry`` are one text.
    """
    words, width = measured or vector_sizes(word_vec, size)
    if fits_broadcast(words, width, policy):
        return row_vectors(docs, VectorTable.of(word_vec), size, carry)
    keys = ["id", *carry, "_n"]
    types = docs.withColumn("_n", F.size("tokens")).schema
    blocks = materialise(word_blocks.cut(docs.withColumn("_n", F.size("tokens")), keys), "blocks")
    known = word_vec.where(F.col("vec").isNotNull()).select("word", F.col("vec").cast("array<double>").alias("vec"))
    # a row per block and word: no word has more of them than there are blocks
    met = word_blocks.words(blocks).select("r", "code", "word").join(known.hint("merge"), "word").drop("word")

    def sums(kept: list, row: np.ndarray, code: np.ndarray, count: np.ndarray, found: pa.Table) -> pa.Table:
        place, texts = np.zeros((word_blocks.codes(code), size)), len(kept[0])
        at = found["code"].to_numpy()
        np.add.at(place, at, word_blocks.vectors_of(found["vec"], size))
        has = np.zeros(len(place), bool)
        has[at] = True
        row, code, count = (x[has[code]] for x in (row, code, count))
        columns = [np.bincount(row, weights=count * place[code, p], minlength=texts) for p in range(size)]
        return pa.table([*kept, *(pa.array(c, pa.float64()) for c in columns)], names=[*keys, *(f"s{p}" for p in range(size))])

    columns = [*(f"`{k}` {types[k].dataType.simpleString()}" for k in keys), *(f"s{p} DOUBLE" for p in range(size))]
    found = word_blocks.meet(blocks, met, sums, ", ".join(columns))
    summed = found.groupBy(*keys).agg(*(F.sum(f"s{p}").alias(f"s{p}") for p in range(size)))
    means = ", ".join(f"coalesce(try_divide(s{p}, CAST(_n AS DOUBLE)), 0.0D)" for p in range(size))
    return summed.selectExpr("id", *carry, f"array({means}) AS features")


def unfamiliar_texts(docs: DataFrame, base: DataFrame, policy: JoinPolicy = JoinPolicy()) -> DataFrame:
    """F8. Texts of ``docs(id, ..., tokens)`` that share no word with the base vocabulary.

    A text is kept or dropped as one group of its own tokens, marked by one lookup.
    """
    known = base.select("word", F.lit(1).alias("_known"))
    tokens = exploded(docs, F.array_distinct("tokens"), "word", ["id"])
    words, width = measure(base, "word", 64)
    marked = lookup_join(
        tokens,
        known,
        "word",
        right_rows=words,
        row_bytes=width,
        spread=F.col("id"),
        policy=policy,
        how="inner",
    )
    return docs.join(marked.select("id").distinct(), "id", "left_anti")


def corpus_vocabulary(docs: DataFrame) -> DataFrame:
    """F9. Words with their counts, no minimum."""
    return (
        exploded(docs, F.col("tokens"), "word")
        .groupBy("word")
        .agg(F.count("*").alias("cn"))
    )


def indexed_vocabulary(docs: DataFrame) -> DataFrame:
    """F9. The vocabulary with the position of each word, commonest first."""
    return with_ordinal(corpus_vocabulary(docs), [F.desc("cn"), F.col("word")], "position")


def train_new_words(
    docs: DataFrame,
    base: DataFrame,
    size: int = 50,
    seed: int = 1,
    policy: JoinPolicy = JoinPolicy(),
    driver_bytes: int = DRIVER_BYTES,
) -> DataFrame | None:
    """F10. Skip-gram vectors of the unfamiliar texts' words; None if there is no such text."""
    texts = unfamiliar_texts(docs, base, policy).select("tokens")
    if texts.isEmpty():
        return None
    return train_word_vectors(
        texts, size, min_count=0, window=3, step=0.025, iterations=1, seed=seed, origin="added",
        driver_bytes=driver_bytes,
    )


def merge_vectors(current: DataFrame, new: DataFrame) -> DataFrame:
    """F11. Add words that are not there yet. A word's first vector stays."""
    return current.unionByName(new.join(current.select("word"), "word", "left_anti"))
