"""Term features.

The feature table is long: one row per (text, term) with ``idx`` and ``v``. A text without
terms has one row with a null ``idx``, so that no text is lost. ``by`` names key columns
that split the work into independent parts, such as the batch (F4).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrill.config import JoinPolicy
from textrill.functions import text as tx
from textrill.operators import word_blocks
from textrill.operators.joins import lookup_join, measure, partitions
from textrill.session import materialise, shared_dir

TERM_BYTES = 64


def exploded(
    docs: DataFrame, values: Column, name: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per array value.

    Written as an outer explode with a filter after it: for a plain explode the optimiser
    infers a filter on the array below it and works out the tokens of every text again there.
    """
    return docs.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def _index(term: Column, buckets: int | None) -> Column:
    if buckets is None:
        return term
    return F.when(term.isNotNull(), tx.hash_bucket(term, buckets))


def term_counts(
    docs: DataFrame, buckets: int | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """F1. Raw term counts ``(id, *carry, idx, tf)`` of ``docs(id, *carry, tokens)``.

    ``idx`` is the term itself, or its hash bucket if ``buckets`` is given.
    """
    terms = docs.select("id", *carry, F.explode_outer("tokens").alias("_term"))
    counted = terms.groupBy("id", *carry, _index(F.col("_term"), buckets).alias("idx"))
    return counted.agg(F.count("_term").cast("double").alias("tf"))


def document_frequency(
    docs: DataFrame, buckets: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Number of texts per index, ``(*by, idx, df)``.

    Repeats within a text are dropped inside its row, so the only exchange is that of the
    per-task partial counts.
    """
    indexes = (
        F.col("tokens")
        if buckets is None
        else F.transform("tokens", lambda term: tx.hash_bucket(term, buckets))
    )
    seen = exploded(docs, F.array_distinct(indexes), "idx", by)
    return seen.groupBy(*by, "idx").agg(F.count("*").alias("df"))


def idf_value(docs: Column, df: Column) -> Column:
    """F2. ln((m + 1) / (df + 1))."""
    return F.log((docs + 1).cast("double") / (df + 1).cast("double"))


def inverse_document_frequency(
    docs: DataFrame,
    buckets: int | None = None,
    by: Sequence[str] = (),
    texts: int | None = None,
) -> DataFrame:
    """F2. ``(*by, idx, df, idf)``, fitted over each part of ``docs``, of ``texts`` texts.

    ``by`` names batches, of which there are few beside the terms: their sizes are broadcast.
    """
    df = document_frequency(docs, buckets, by)
    if not by:
        texts = docs.count() if texts is None else texts
        return df.withColumn("idf", idf_value(F.lit(texts), F.col("df")))
    sizes = docs.groupBy(*by).agg(F.count("*").alias("_m"))
    # one row per batch, while the terms of a batch would meet in one task
    return (
        df.join(F.broadcast(sizes), list(by)).withColumn("idf", idf_value(F.col("_m"), F.col("df"))).drop("_m")
    )


def tfidf(
    docs: DataFrame,
    buckets: int | None = None,
    carry: Sequence[str] = (),
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """F3. ``(id, *carry, idx, v)`` with v = tf * idf, the IDF fitted on this very batch.

    Two passes over the texts: one for the IDF, one for the counts. For the second the texts
    are spread by ``id`` first: counting within a text then needs no further exchange, and
    with a broadcast IDF the result is still partitioned by ``id``, as the learners want it.
    """
    shared_dir(docs.sparkSession)
    texts = docs.count()
    idf = inverse_document_frequency(docs, buckets, texts=texts).select("idx", "idf").checkpoint()
    terms, width = measure(idf, "idx", TERM_BYTES)
    joined = lookup_join(
        term_counts(docs.repartition(partitions(docs, texts), "id"), buckets, carry),
        idf,
        "idx",
        right_rows=terms,
        row_bytes=width,
        spread=F.col("id"),
        policy=policy,
    )
    value = F.coalesce(F.col("tf") * F.col("idf"), F.lit(0.0))
    return joined.select("id", *carry, "idx", value.alias("v"))


def weighted(
    docs: DataFrame,
    idf: DataFrame,
    texts: int,
    buckets: int | None = None,
    carry: Sequence[str] = (),
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """F3 with a given ``idf(idx, idf)``, fitted on ``texts`` texts: ``(id, *carry, idx, v)``."""
    terms, width = measure(idf, "idx", TERM_BYTES)
    joined = lookup_join(
        term_counts(docs, buckets, carry), idf, "idx",
        right_rows=terms, row_bytes=width, spread=F.col("id"), policy=policy,
    )
    unknown = idf_value(F.lit(texts), F.lit(0))
    value = F.when(F.col("idx").isNotNull(), F.col("tf") * F.coalesce("idf", unknown)).otherwise(0.0)
    return joined.select("id", *carry, "idx", value.alias("v"))


def tfidf_by_batch(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """F4. TF-IDF of all batches of ``docs(batch, id, tokens)`` at once.

    The batch is part of every key, so each batch has its own IDF. Texts are read once; a block of them asks
    for the IDF of its distinct words.
    """
    tokens, kind = F.col("tokens"), "string"
    if buckets is not None:
        tokens, kind = F.transform("tokens", lambda term: tx.hash_bucket(term, buckets)), "int"
    # rows that share batch and id are one text; they may be in several blocks
    again = not docs.groupBy("batch", "id").agg(F.count("*").alias("_rows")).where("_rows > 1").isEmpty()
    keys = ["batch", "id"]
    types = docs.schema
    batch_type = types["batch"].dataType.simpleString()
    blocks = materialise(word_blocks.cut(docs.select(*keys, tokens.alias("tokens")), keys, "batch"), "blocks")
    sizes = docs.groupBy("batch").agg(F.count("*").alias("_m"))
    # a window holds a row per block at most
    met = word_blocks.words(blocks, kind, batch_type).withColumn(
        "df", F.sum("texts").over(Window.partitionBy("of", "word"))
    )
    met = met.join(F.broadcast(sizes), F.col("of") == F.col("batch"), "left")
    idf = F.coalesce(idf_value(F.col("_m"), F.col("df")), F.lit(0.0))
    met = met.select("r", "code", "word", idf.alias("idf"))

    def values(kept: list, row: np.ndarray, code: np.ndarray, count: np.ndarray, found: pa.Table) -> pa.Table:
        place = np.empty(word_blocks.codes(code), np.int64)
        place[found["code"].to_numpy()] = np.arange(len(found))
        empty = np.flatnonzero(np.bincount(row, minlength=len(kept[0])) == 0)
        rows = pa.array(np.append(row, empty))
        idx = found["word"].combine_chunks().take(pa.array(place[code]))
        v = np.append(count * found["idf"].to_numpy()[place[code]], np.zeros(len(empty)))
        columns = [kept[0].take(rows), kept[1].take(rows), pa.chunked_array([idx, pa.nulls(len(empty), idx.type)]), pa.array(v)]
        return pa.table(columns, names=[*keys, "idx", "v"])

    schema = f"batch {batch_type}, id {types['id'].dataType.simpleString()}, idx {kind}, v double"
    found = word_blocks.meet(blocks, met, values, schema)
    return found.groupBy("batch", "id", "idx").agg(F.sum("v").alias("v")) if again else found


def vocabulary(docs: DataFrame) -> DataFrame:
    """F12. Distinct terms of a corpus; repeats within a text go before the exchange."""
    return exploded(docs, F.array_distinct("tokens"), "term").distinct()


def word_set(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """F13. Binary bag of words: one row with v = 1.0 per (text, distinct term)."""
    terms = exploded(docs, F.array_distinct("tokens"), "term", ["id", *carry])
    return terms.withColumn("v", F.lit(1.0))
