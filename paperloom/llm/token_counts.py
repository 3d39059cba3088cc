r"""Token counts (operator 10).

A text's tokens are those of its pieces between ASCII white space: the tokenizer's normalizers turn white space into
single spaces and its pre-tokenizer drops them, so no token, special string or composed character spans two pieces.
Counting is one map over the documents, without a shuffle of pieces before or after it: each task looks the distinct pieces of a batch up in a
broadcast table of frequent pieces (at most `table_size` entries in flat arrays), then in a cache of its worker (at most `cache_size`
entries), and has the library encode only the rest. Which pieces are in the table or the cache never changes a count.

Nulls and empty texts have 0 bytes and 0 tokens. Any text that Spark can hold is counted whole. Rows that repeat are
counted each; extra columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import pieces, sampled

#: Documents from which the frequent pieces are taken, pieces that a task sends, and pieces kept: they bound what reaches
#: the driver (each sampled document's task at most) and the broadcast (about 1 MB).
SAMPLE_DOCS = 4000
TASK_SIZE = 1 << 11
TABLE_SIZE = 1 << 16
CACHE_SIZE = 1 << 19
BATCH_BYTES = 16 << 20
#: Texts whose counts show whether a tokenizer drops white space.
PROBES = ("ab  cd", "ab\n\ncd", " ab \t cd ", "don't  stop")
OUT = "doc_id long, n_bytes long, n_tokens long"

_loaded: dict = {}


def _library(path: str):
    """The worker's own tokenizer and cache, made once a process."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {})
    return _loaded[path]


def _encode(library, words: list[str]) -> list[int]:
    out: list[int] = []
    for k in range(0, len(words), 4096):
        out += [len(e.ids) for e in library.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
    return out


def _split(column) -> tuple[pa.Array, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def frequent(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE, task_size: int = TASK_SIZE) -> list[str]:
    """The commonest pieces of a bounded sample. Each task counts its own and sends its `task_size` commonest; the driver
    adds up these short lists, so no piece is shuffled."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in pieces(batches, BATCH_BYTES):
            counts = pc.value_counts(_split(batch.column(0))[0])
            total.update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())))
            if len(total) > 32 * task_size:
                total = Counter(dict(total.most_common(16 * task_size)))
        top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:task_size]
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    lists = sampled(docs.select("doc_id", "text"), sample_docs, "pieces").select("text").mapInArrow(local, "piece string, n long").toArrow()
    added = lists.group_by("piece").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("piece", "ascending")])
    return added.slice(0, table_size).column("piece").to_pylist()


class Table:
    """Frequent pieces with their numbers of tokens, as two flat arrays; Arrow looks a whole batch up by hash."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words = pa.array(words, pa.string())
        self.counts = np.array([*counts, -1], np.int64)

    def get(self, names: pa.Array) -> np.ndarray:
        """The numbers for an array of pieces; -1 where one isn't held."""
        return self.counts[pc.fill_null(pc.index_in(names, value_set=self.words), -1).to_numpy(zero_copy_only=False)]


def count_tokens(docs: DataFrame, tokenizer: str, table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs(doc_id, text). tokenizer: path of the library's JSON file; one that
    keeps white space is refused."""
    for probe in PROBES:
        if sum(_encode(_library(tokenizer)[0], [probe])) != sum(_encode(_library(tokenizer)[0], probe.split())):
            raise ValueError("this tokenizer doesn't drop white space, so its counts don't add up over pieces")
    words = frequent(docs, table_size=table_size)
    table = docs.sparkSession.sparkContext.broadcast(Table(words, _encode(_library(tokenizer)[0], words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, cache = _library(tokenizer)
        known = table.value
        for batch in pieces(batches, BATCH_BYTES):
            text = batch.column(1)
            flat, per_doc = _split(text)
            if isinstance(flat, pa.ChunkedArray):
                flat = flat.combine_chunks()
            coded = flat.dictionary_encode()
            lengths = known.get(coded.dictionary)
            unseen = np.flatnonzero(lengths < 0)
            names = dict(zip(unseen.tolist(), coded.dictionary.take(pa.array(unseen)).to_pylist()))
            misses = []
            for k, name in names.items():
                n = cache.get(name)
                if n is None:
                    misses.append(k)
                else:
                    lengths[k] = n
            if misses:
                if len(cache) + len(misses) > cache_size:
                    cache.clear()
                fresh = [names[k] for k in misses]
                for k, w, n in zip(misses, fresh, _encode(library, fresh)):
                    lengths[k] = n
                    if len(cache) < cache_size:
                        cache[w] = n
            each = lengths[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
            sums = np.concatenate(([0], np.cumsum(each)))
            ends = np.cumsum(per_doc)
            tokens = sums[ends] - sums[ends - per_doc]
            nbytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nbytes, pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, OUT)
