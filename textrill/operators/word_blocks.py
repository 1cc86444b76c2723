"""Words of texts met with tables of words, a block of texts at a time.

Texts are cut into blocks as they are read. A block asks once for each of its distinct words, so what is shuffled are the blocks' words and
what is known of them, not one row per text and word, and a word that is in every text is one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.operators.blocks import distinct_entries, pack, pieces, unpack

TEXTS, WORDS = range(2)
FRAME = "r BIGINT, kind INT, payload BINARY"


def cut(docs: DataFrame, keys: Sequence[str], by: str | None = None, texts: bool = True) -> DataFrame:
    """Blocks of ``docs(*keys, tokens)``: of each its texts, with their words as codes, and the words.

    With ``by``, one of ``keys``, a word is another one for each value of it. Without ``texts`` only the words are given.
    """
    at = None if by is None else list(keys).index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch):
                terms, row, code, count = distinct_entries(piece)[:4]
                of_word = None
                if at is not None:
                    values = piece.column(at).dictionary_encode(null_encoding="encode")
                    key = values.indices.to_numpy()[row].astype(np.int64) * max(1, len(terms)) + code
                    met, code = np.unique(key, return_inverse=True)
                    value, word = np.divmod(met, max(1, len(terms)))
                    of_word, terms = values.dictionary.take(pa.array(value)), terms.take(pa.array(word))
                in_texts = np.bincount(code, minlength=len(terms))
                tokens = np.bincount(code, weights=count, minlength=len(terms)).astype(np.int64)
                rows = [(WORDS, pack(of_word, terms, in_texts, tokens))]
                if texts:
                    rows.append((TEXTS, pack(piece.columns[:-1], row.astype(np.int32), code.astype(np.int32), count)))
                r = (task << 32) + k
                k += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * len(rows), pa.int64()), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())],
                    ["r", "kind", "payload"],
                )

    return docs.select(*keys, "tokens").mapInArrow(run, FRAME)


def words(blocks: DataFrame, kind: str = "string", by: str | None = None) -> DataFrame:
    """``(r, code, word, texts, tokens)``: the words of each block, in how many of its texts they are and how often; ``of``, with the type
    ``by``, is what they were told apart by."""
    named = by is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of, terms, texts, tokens = unpack(payload)
                size = len(terms)
                columns = [pa.array(np.full(size, r)), pa.array(np.arange(size, dtype=np.int32)), terms, pa.array(texts), pa.array(tokens)]
                names = ["r", "code", "word", "texts", "tokens"]
                yield pa.RecordBatch.from_arrays(columns + [of] * named, names + ["of"] * named)

    schema = f"r BIGINT, code INT, word {kind}, texts BIGINT, tokens BIGINT" + (f", of {by}" if named else "")
    return blocks.where(F.col("kind") == WORDS).select("r", "payload").mapInArrow(run, schema)


def meet(blocks: DataFrame, found: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(keys, row, code, count, found)`` on each block with what was ``found(r, code, ...)`` for its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (payload,) = left["payload"].to_pylist()
        return work(*unpack(payload), right)

    texts = blocks.where(F.col("kind") == TEXTS).groupBy("r")
    return texts.cogroup(found.groupBy("r")).applyInArrow(run, schema)


def vectors_of(lists: pa.ChunkedArray, size: int) -> np.ndarray:
    """Arrays of numbers as rows of ``size`` values; null, absent and missing values are 0."""
    out = np.zeros((len(lists), size))
    lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = pc.fill_null(lists.flatten(), 0.0).to_numpy()
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes)[at < size], at[at < size]] = flat[at < size]
    return out


def codes(code: np.ndarray) -> int:
    """How many words the codes of a block stand for."""
    return int(code.max()) + 1 if len(code) else 0
