"""Token ids in Parquet list columns (operator 10).

One row per document in ascending doc_id order: its metadata and its ids as a list column.
The ids are dictionary-encoded (a vocabulary has few distinct values), the numbers that grow
are delta-encoded (version 2 pages). Row groups and pages are of set sizes, and the writer puts
page indexes at the end of each file: a reader of metadata doesn't touch the ids, and a reader of a
range of documents reads only the row groups and pages that overlap it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrill.llm.common import give_back, table
from textrill.llm.units import TextEncoder, UnitTable, byte_batches
from textrill.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
TEXT_RUN = 1 << 19
TABLE_BYTES = 64 << 20

FORMAT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}

# how the byte-level pre-tokenizer cuts a text into words: fixed values
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII_WORD = re.compile(rb" ?[A-Za-z]+| ?[!-&(-/:-@\[-`{-~]+")
_LATIN_UNIT = re.compile(" ?[!-~\xa1-\u024f]+")


class Encoder:
    """A tokenizer of the library, asked once for each distinct unit of the texts.

    New units that are one word go to the library together, a line each: a line end between words is a
    word of its own, so the ids of one line end part them. All others go one by one. The special strings are
    those that the library takes literally; files with other ones aren't read.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(file_text)
        self.library.no_truncation()
        self.library.no_padding()
        special = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized and self.library.normalizer for t in special.values()):
            raise ValueError("only special strings that stand for themselves are read")
        (self.line_end,) = self._whole("\n").tolist()
        self.units = UnitTable(self._learn, TABLE_BYTES)
        self.texts = TextEncoder({t.content: i for i, t in special.items()}, self.units)

    def _whole(self, text: str) -> np.ndarray:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.uint32)

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lines, at, alone = [], [], []
        for i, unit in enumerate(new):
            text = unit.decode()
            if _ASCII_WORD.fullmatch(unit) or _LATIN_UNIT.fullmatch(text) and len(_WORDS.findall(text)) == 1:
                lines.append(text)
                at.append(i)
            else:
                alone.append((i, self._whole(text)))
        counts = np.zeros(len(new), np.int64)
        ids = self._whole("\n".join(lines))
        ends = np.flatnonzero(ids == self.line_end)
        counts[at] = np.diff(ends, prepend=-1, append=len(ids))[: len(at)] - 1
        ids = np.delete(ids, ends)
        if not alone:
            return ids, counts
        places = np.array([i for i, _ in alone])
        more = np.array([len(x) for _, x in alone])
        before = np.cumsum(counts) - counts
        counts[places] = more
        return np.insert(ids, np.repeat(before[places], more), np.concatenate([x for _, x in alone])), counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        return self.texts.encode(texts)

_encoders: dict[int, Encoder] = {}


def encoder_of(file_text: str) -> Encoder:
    key = hash(file_text)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders.clear()
        _encoders[key] = Encoder(file_text)
    return _encoders[key]


def encoded_batches(encoder: Encoder, batches: Iterator[pa.RecordBatch], end_id: int | None) -> Iterator[pa.RecordBatch]:
    """``(doc_id, n_tokens, ids)`` of batches ``(doc_id, text)``. The encoder's table, of bounded bytes, stays for the next task."""
    for batch in batches:
        for begin, texts in byte_batches(batch, 1, TEXT_RUN):
            ids, at = encoder.encode(texts)
            texts.clear()
            n = len(at) - 1
            if end_id is not None:
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(begin, n), pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(at.astype(np.int32), np.ascontiguousarray(ids).view(np.int32)),
                ],
                ["doc_id", "n_tokens", "ids"],
            )
    give_back()


def encoded(docs: DataFrame, file_text: str, end_id: int | None = END_ID) -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>)`` of every row, in the order and tasks of the input."""
    shared = docs.sparkSession.sparkContext.broadcast(file_text)  # the size of the vocabulary file
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(encoder_of(shared.value), batches, end_id)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID) -> None:
    """Write the token files of ``docs``, in ascending doc_id order over all files.

    Rows are dealt out by ranges of doc_id before they are encoded, as texts are smaller than ids.
    Folder names ascend with the ranges. Null text counts as empty and has the end id alone; rows
    without an id come first; repeated rows stay, side by side; an empty table leaves no files but
    the schema.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    encoded(ordered, text, end_id).withColumn("place", F.monotonically_increasing_id()).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, place)``; ``place`` ascends with doc_id over all files."""
    return spark.read.parquet(path)


def starts(meta: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows with ``place`` and ``n_tokens``.

    The upper bits of a place name the task that wrote it. A file's rows are summed up by
    themselves, then the files' totals: no task sees more than one file or one row per file.
    """
    part = meta.withColumn("_part", F.shiftright("place", 33))
    totals = part.groupBy("_part").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = part.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(totals, "_part").withColumn("start", F.col("_before") + F.col("_within")).drop(
        "_part", "_within", "_before"
    )


def id_checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, place, n_tokens, ids_crc32)`` from the lists read."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
            pairs = list(zip(offsets[:-1], offsets[1:], strict=True))
            sums = [zlib.crc32(values[a:b]) for a, b in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([int(b - a) for a, b in pairs], pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "place", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "place", "ids").mapInArrow(
        run, f"doc_id {id_type}, place long, n_tokens long, ids_crc32 long"
    )


def op10_parquet_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files, read them back, and say what they hold."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return starts(id_checksums(read_tokens(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
