"""Text cleaning as DataFrame steps (T1-T4). All work on batch and on streaming frames."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.config import JoinPolicy, TextConfig
from textrill.functions import text as tx
from textrill.operators.joins import lookup_join, measure
from textrill.session import materialise

Step = Callable[[DataFrame], DataFrame]


def clear_text(df: DataFrame, separator: str = " ", column: str = "text") -> DataFrame:
    """T1."""
    return df.withColumn(column, tx.clear(F.col(column), separator))


def filter_characters(df: DataFrame, separator: str = " ", column: str = "text") -> DataFrame:
    """T2."""
    return df.withColumn(column, tx.keep_plain_characters(F.col(column), separator))


def remove_words(
    df: DataFrame, words: Iterable[str], separator: str = " ", column: str = "text"
) -> DataFrame:
    """T3 for a list the caller holds in memory."""
    return df.withColumn(column, tx.drop_words(F.col(column), words, separator))


# what a word takes in a set beside its own bytes
WORD_BYTES = 112
# texts whose tokens are held at once, beside those of a batch from Spark
ROWS_AT_ONCE = 500


def _without(df: DataFrame, words: Sequence[DataFrame], column: str) -> DataFrame:
    """Drop the words of some small lists from the token arrays in ``column``, in one step.

    Each list goes to the tasks as a set of its own; tokens stay in their Arrow arrays.
    """
    context = df.sparkSession.sparkContext
    shared = [context.broadcast(part.toArrow()["word"].combine_chunks()) for part in words]
    at, names = df.columns.index(column), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                lists = batch.column(at)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                tokens = lists.flatten()
                stays = np.ones(len(tokens), bool)
                for part in shared:
                    stays &= ~pc.is_in(tokens, value_set=part.value).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                ends = np.cumsum(np.bincount(row[stays], minlength=len(sizes)))
                columns = batch.columns
                columns[at] = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends), pa.int32()), tokens.filter(pa.array(stays)), mask=lists.is_null()
                )
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)


def remove_stop_words(
    df: DataFrame,
    words: DataFrame,
    separator: str = " ",
    column: str = "text",
    id_column: str = "id",
    policy: JoinPolicy = JoinPolicy(),
) -> DataFrame:
    """T3 for a table ``words(word)`` of any size.

    A list within the broadcast bound, measured in bytes, goes to the texts as a set; they aren't shuffled. On a stream a
    larger list goes as several such sets, all to one step. On a table it is joined with the exploded
    tokens, and each text is put together again in token order; a text comes from one row, so its group is bounded by it.
    There the rows are written once with a number of their own, so that repeated and null
    values of ``id_column`` keep their rows apart. All ways give the same and leave a null text null.
    """
    words = words.select("word").where(F.col("word").isNotNull()).distinct()
    count, width = measure(words, "word", WORD_BYTES)
    parts = max(1, math.ceil(count * width / max(1, policy.broadcast_bytes)))
    if parts == 1 or df.isStreaming:
        if not count:
            return df
        kept = df.withColumn(column, tx.java_split(F.col(column), separator))
        lists = [words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) for k in range(parts)]
        return _without(kept, lists, column).withColumn(column, F.array_join(column, " "))

    row = "_row"
    while row in df.columns:
        row += "_"
    # written, as the numbers must not change when a task is run again
    df = materialise(df.withColumn(row, F.monotonically_increasing_id()), "texts")
    tokens = df.select(
        row,
        F.posexplode_outer(tx.java_split(F.col(column), separator)).alias("_pos", "word"),
    )
    marked = lookup_join(
        tokens,
        words.withColumn("_stop", F.lit(True)),
        "word",
        right_rows=count,
        row_bytes=width,
        spread=F.col(row),
        policy=policy,
    )
    kept = F.when(
        F.col("_stop").isNull() & F.col("word").isNotNull(), F.struct("_pos", "word")
    )
    rebuilt = (
        marked.groupBy(row)
        .agg(F.sort_array(F.collect_list(kept)).alias("_kept"))
        .select(row, F.array_join(F.col("_kept.word"), " ").alias("_rebuilt"))
    )
    text = F.when(F.col(column).isNotNull(), F.col("_rebuilt")).alias(column)
    return df.join(rebuilt, row).select(*(text if c == column else F.col(c) for c in df.columns if c != row))


def cleaner(cfg: TextConfig) -> Step:
    """T4. The cleaners named in the settings, chained in order.

    The separator of the settings is for the first; what it hands on is joined by spaces.
    """
    steps: dict[str, Callable[[DataFrame, str], DataFrame]] = {
        "clear": clear_text,
        "characters": filter_characters,
        "stop_words": lambda df, separator: remove_words(df, cfg.stop_words, separator),
    }
    unknown = [name for name in cfg.cleaners if name not in steps]
    if unknown:
        raise ValueError(f"unknown cleaners {unknown}; known are {sorted(steps)}")

    def run(df: DataFrame) -> DataFrame:
        separator = cfg.separator
        for name in cfg.cleaners:
            df = df.transform(steps[name], separator)
            if name != "stop_words" or cfg.stop_words:
                separator = " "
        return df

    return run


def tokenise(df: DataFrame, separator: str = " ", column: str = "text") -> DataFrame:
    """T0. Replace the text by its ``tokens``."""
    return df.withColumn("tokens", tx.java_split(F.col(column), separator)).drop(column)
