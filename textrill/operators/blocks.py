"""Cutting Arrow batches of texts into blocks, and packing what a block holds."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# tokens of a block of several texts
BLOCK_TOKENS = 1 << 21


def pack(*values: object) -> bytes:
    raw = pickle.dumps(values, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def unpack(data: bytes) -> tuple:
    size = int.from_bytes(data[:8], "little")
    return pickle.loads(pa.decompress(data[8:], decompressed_size=size, codec="lz4", asbytes=True))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts of a batch, whose last column has their tokens, in blocks."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + BLOCK_TOKENS, "right")))
        yield batch.slice(start, end - start)
        start = end


def distinct_entries(piece: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a block; row, code and count of each term of a text; and the code of every token."""
    tokens = piece.column(piece.num_columns - 1)
    row = np.repeat(np.arange(piece.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    flat = tokens.flatten()
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    found = flat.dictionary_encode()
    terms, codes = found.dictionary, found.indices.to_numpy()
    key, count = np.unique(row * max(1, len(terms)) + codes, return_counts=True)
    row, code = np.divmod(key, max(1, len(terms)))
    count = count.astype(np.min_scalar_type(int(count.max()) if len(count) else 0))
    return terms, row, code, count, codes
