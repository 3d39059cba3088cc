"""Helpers that the training-text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import _written, clear, cut, shared_folder, table  # noqa: F401

#: What separates words in the contracts that speak of "[^\x20\x09-\x0D]+".
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, stem: str) -> str:
    """A beginning of names that no column of df has, for columns on the way."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sampled(df: DataFrame, rows: int, seed: str) -> DataFrame:
    """About `rows` rows, the same on every run; all of them if there are fewer. Only for fitting and for filling caches."""
    n = df.count()
    if n <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    return df.where(share < int(rows / n * (1 << 30)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column end to end, and where each begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    begins = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[begins[0] : begins[-1]], begins - begins[0]


def pieces(batches: Iterator[pa.RecordBatch], nbytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about nbytes of text each (one long text makes a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + nbytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def sha256_hex(data) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
