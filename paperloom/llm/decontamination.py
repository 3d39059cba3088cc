r"""Benchmark decontamination (operator 5).

A training shard is a bounded run of documents inside a task. Its words become numbers of the benchmark's vocabulary;
runs of vocabulary words that are long enough to hold a test phrase are indexed: suffixes sorted by prefix doubling, the
Burrows-Wheeler transform held in a wavelet matrix, and suffix positions sampled at every SAMPLE-th word of a run. All
test phrases are searched backward at once through the wavelet ranks; occurrences are located by stepping to a sampled
position; the words they cover are merged into removal spans.

Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, so digits, letters and everything outside ASCII. A test
phrase is 10 consecutive words of an item, or all words of a shorter one. Documents are only mapped over, never shuffled.
The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words; a larger one is searched block after block.

Nulls: a null text has no words; a null item text is no item; an item without id is named by the empty string. Items that
share an id are one item. Long texts make a shard of their own. Rows that repeat are each searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import fresh, pieces, utf8
from paperloom.llm.hashing import Substrings

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
SAMPLE = 8

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its hash; no word spans two texts."""
    low = _LOWER[data]
    inside = _IS_WORD[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = begins[(begins > 0) & (begins < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, Substrings(low).of(start, end)


class Phrases:
    """The test phrases of a block of items: distinct windows as rows of vocabulary numbers, with their items."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        found: dict[bytes, set[int]] = {}
        for name, hashes in items:
            number = np.searchsorted(self.vocabulary, hashes).astype(np.int32) + 1
            for k in range(max(1, len(number) - window + 1)):
                found.setdefault(number[k : k + window].tobytes(), set()).add(place[name])
        self.length = np.array([len(w) // 4 for w in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)  # from the right end, as backward search reads them
        for k, w in enumerate(found):
            self.words[k, : len(w) // 4] = np.frombuffer(w, np.int32)[::-1]
        self.item_at = np.cumsum([0, *(len(s) for s in found.values())])
        self.items = np.array([i for s in found.values() for i in sorted(s)], np.int64)
        self.shortest = int(self.length.min()) if len(found) else 0


class Index:
    """An FM-index over runs of numbers from 1 up; runs are parted by zeros."""

    def __init__(self, text: np.ndarray, offset: np.ndarray, top: int):
        """offset: each number's place in its run. text must end with a zero."""
        n = len(text)
        order = _suffixes(text)
        bwt = text[order - 1]  # the last zero stands before the first number
        self.count = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1)[: top + 1], out=self.count[1:])
        self.n, self.bwt = n, bwt
        self.levels = []
        level = bwt
        for bit in range(int(top).bit_length() - 1, -1, -1):
            ones = (level >> bit) & 1
            before = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, n - int(before[-1])))
            level = np.concatenate((level[ones == 0], level[ones == 1]))
        sampled = (offset[order] % SAMPLE == 0) | (text[order] == 0)
        self.sampled_before = np.zeros(n + 1, np.int64)
        np.cumsum(sampled, out=self.sampled_before[1:])
        self.sampled, self.positions = sampled, order[sampled]

    def rank(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each number stands in the transform before each row."""
        at, start = row.astype(np.int64), np.zeros(len(row), np.int64)
        for bit, before, zeros in self.levels:
            one = ((number >> bit) & 1).astype(bool)
            at = np.where(one, zeros + before[at], at - before[at])
            start = np.where(one, zeros + before[start], start - before[start])
        return at - start

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their intervals of rows."""
        alive = np.arange(len(phrases.length))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for step in range(phrases.words.shape[1]):
            number = phrases.words[alive, step]
            going = phrases.length[alive] > step
            new_low = np.where(going, self.count[number] + self.rank(number, low), low)
            new_high = np.where(going, self.count[number] + self.rank(number, high), high)
            full = new_low < new_high
            alive, low, high = alive[full], new_low[full], new_high[full]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of the suffix in each row, by steps to the left until a sampled one."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        at, which = rows.copy(), np.arange(len(rows))
        while len(at):
            here = self.sampled[at]
            out[which[here]] = self.positions[self.sampled_before[at[here]]] + steps
            at, which = at[~here], which[~here]
            number = self.bwt[at]
            at, steps = self.count[number] + self.rank(number, at), steps + 1
        return out


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; a zero ends a comparison, zeros stand in order of place."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text + int(zeros.sum())).astype(np.int64)
    width = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-width] = rank[width:] if width < n else 0
        key = rank * (n + len(rank) + int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def occurrences(number: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word place and phrase of every occurrence. number: vocabulary number of each word, 0 for others; doc: its text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not phrases.shortest or not len(number):
        return none
    known = number > 0
    broken = np.ones(len(number), bool)
    broken[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(broken)
    length = np.diff(np.append(begin, len(number)))
    use = known[begin] & (length >= phrases.shortest)
    begin, length = begin[use], length[use]
    if not len(begin):
        return none
    # Each run followed by a zero: `source` is the word's place, `offset` its place in the run.
    size = length + 1
    run = np.repeat(np.arange(len(begin)), size)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    source = begin[run] + offset
    end = offset == length[run]
    text = np.where(end, 0, number[np.minimum(source, len(number) - 1)]).astype(np.int64)
    index = Index(text, offset, len(phrases.vocabulary))
    which, low, high = index.search(phrases)
    if not len(which):
        return none
    many = high - low
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return source[index.locate(rows)], np.repeat(which, many)


class Hits:
    """What a block's phrases hit in one shard."""

    def __init__(self, column: pa.Array, phrases: Phrases):
        self.data, self.begins = utf8(column)
        self.start, self.end, hashes = words(self.data, self.begins)
        self.doc = np.searchsorted(self.begins, self.start, side="right") - 1
        at = np.searchsorted(phrases.vocabulary, hashes)
        at[at == len(phrases.vocabulary)] = 0
        known = phrases.vocabulary[at] == hashes if len(phrases.vocabulary) else np.zeros(len(hashes), bool)
        place, which = occurrences(np.where(known, at + 1, 0), self.doc, phrases)
        cover = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + phrases.length[which], -1)
        self.hit = np.cumsum(cover)[:-1] > 0
        many = np.diff(phrases.item_at)[which]
        flat = np.repeat(phrases.item_at[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        pair = np.unique(np.repeat(self.doc[place], many) * max(1, len(phrases.names)) + phrases.items[flat]) if len(place) else np.zeros(0, np.int64)
        self.item_doc, self.item = pair // max(1, len(phrases.names)), pair % max(1, len(phrases.names))
        n = len(self.begins) - 1
        self.n_words = np.bincount(self.doc, minlength=n)[:n]
        # Maximal runs of hit words of a text, as byte ranges of the shard.
        h = self.hit
        first, last = h.copy(), h.copy()
        same = self.doc[1:] == self.doc[:-1]
        first[1:] &= ~(h[:-1] & same)
        last[:-1] &= ~(h[1:] & same)
        self.span_start, self.span_end, self.span_doc = self.start[first], self.end[last], self.doc[first]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of bounded size; one block at a time is held by the driver."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull()).orderBy("item", "text").toLocalIterator():
        data = np.frombuffer(r.text.encode(), np.uint8)
        _, _, hashes = words(data, np.array([0, len(data)]))
        if not len(hashes):
            continue
        if rows and held + len(hashes) > block_words:
            yield Phrases(rows)
            rows, held = [], 0
        rows.append((r.item or "", hashes))
        held += len(hashes)
    if rows:
        yield Phrases(rows)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("word_start", "word_end", "start", "end")]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def _listed(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Values grouped by their owner, in order, as one list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _found(column: pa.Array, phrases: Phrases) -> list[pa.Array]:
    """The columns of FOUND for a shard."""
    h, n = Hits(column, phrases), len(column)
    own, word = h.begins[h.span_doc], np.searchsorted(h.doc, h.span_doc)
    ends = np.searchsorted(h.end, h.span_end) + 1
    parts = (np.searchsorted(h.start, h.span_start) - word, ends - word, h.span_start - own, h.span_end - own)
    spans = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], names=["word_start", "word_end", "start", "end"])
    names = pa.array([phrases.names[k] for k in h.item], pa.string())
    return [pa.array(h.n_words.astype(np.int64)), _listed(spans, h.span_doc, n), _listed(names, h.item_doc, n)]


def find(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans and items, one row for each of docs. spans: removal spans as word numbers and as bytes of
    the UTF-8 text; those of one block are merged, those of several blocks stand side by side."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(benchmark, block_words)
    phrases, out, first = next(blocks, Phrases([])), slim, True
    while phrases is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)
        keep = ["doc_id", *(["text"] if following else []), *([] if first else ["spans0", "items0"])]

        def search(batches: Iterator[pa.RecordBatch], shared=shared, keep=keep) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, SHARD_BYTES):
                column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                arrays = [*(column[k] for k in keep), *_found(column["text"], shared.value)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *FOUND.names])

        out = out.mapInArrow(search, T.StructType([*(out.schema[k] for k in keep), *FOUND]))
        if not first:
            out = out.withColumn("spans", F.concat("spans0", "spans")).withColumn("items", F.array_distinct(F.concat("items0", "items")))
            out = out.drop("spans0", "items0")
        if following:
            out = out.drop("n_words").withColumnsRenamed({"spans": "spans0", "items": "items0"})
        phrases, first = following, False
    return out


def report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs(doc_id, text)."""
    fold = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda a, x: F.struct(
            (a["hit"] + F.greatest(F.lit(0), x["word_end"] - F.greatest(x["word_start"], a["reach"]))).alias("hit"),
            F.greatest(a["reach"], x["word_end"]).alias("reach"),
        ),
    )
    return find(docs, benchmark, block_words).select(
        "doc_id", "n_words", fold["hit"].alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(text: str, spans: list[dict]) -> str:
    """The text without the spans; those that overlap or follow word on word are cut as one."""
    raw, done, kept, reach = text.encode(), 0, [], -1
    for x in sorted(spans, key=lambda x: (x["word_start"], x["word_end"])):
        if x["word_start"] > reach:
            kept.append(raw[done : x["start"]])
        done, reach = max(done, x["end"]), max(reach, x["word_end"])
    return b"".join([*kept, raw[done:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The same rows and columns without the hit words (n_chars follows the text where there is one). Every block is
    searched in the text as it came; what all of them hit is cut once, after the last."""
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    at, n = docs.columns.index("text"), len(docs.columns)
    held = fresh(docs, "_spans")
    found = T.StructType([*docs.schema, T.StructField(held, FOUND["spans"].dataType)])
    blocks = _blocks(benchmark, block_words)
    phrases, out, first = next(blocks, None), docs, True
    while phrases is not None:
        following = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(phrases)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=following is None) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, SHARD_BYTES):
                columns, names = batch.columns[:n], batch.schema.names[:n]
                spans = _found(columns[at], shared.value)[1]
                if not first:
                    spans = pa.array([a + b for a, b in zip(batch.column(n).to_pylist(), spans.to_pylist())], spans.type)
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, held])
                    continue
                many = np.diff(spans.offsets.to_numpy())
                if many.any():
                    text = columns[at].to_pylist()
                    for d in np.flatnonzero(many).tolist():
                        text[d] = _cut(text[d], spans[d].as_py())
                    columns[at] = pa.array(text, columns[at].type)
                    if chars is not None:
                        columns[chars] = pa.array([None if t is None else len(t) for t in text], columns[chars].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.mapInArrow(search, found if following else docs.schema)
        phrases, first = following, False
    return out
