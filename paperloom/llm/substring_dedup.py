"""Suffix-array deduplication of repeated strings (operator 3): every byte covered by a 100-byte string that also starts
earlier, in a smaller document or earlier in the same one, is removed.

The construction is blockwise, one bucket of suffixes at a time, with ties resolved by a cover sample:

1. Sampled positions (a cover chosen by content, see anchors.py) are sent to the bucket of the K bytes that begin there.
   Each stands for the run of suffixes whose first 100 bytes hold it as their sample.
2. A bucket is sorted on its own. Samples equal in K bytes are told apart by the rank of all bytes around them: within a
   rank, everything after the first occurrence is removed without looking at a single suffix. Only the first occurrence
   of a rank, where another rank shares its K bytes and a neighbouring half, stays contested.
3. The suffixes of contested samples are taken from the texts and sorted by their first 100 bytes, again in buckets.
4. The removed starts meet their texts and the bytes go.

An arithmetic cover of period 73 has 9 residues, and up to 9 ranks go with every suffix that is sent; the sample by content has the same
property (equal 100-byte strings have a sample at the same place), with one rank for a run of about 30 suffixes. The README
has figures. Orders are by hash, not by byte value: only equality and the first place matter here.

Repeats within a task's batch are resolved there, so a string found everywhere is sent once a batch. Texts move to the
buckets of their documents compressed. Nothing grows with a group but the list of its contested first occurrences, which
is spread over buckets by suffix.

Nulls: a null text is empty. Rows without doc_id, or that share one, are first given distinct ids in the order of doc_id
(null first), then of the text's hash; rows that repeat entirely count as one document and get the same answer. Extra
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.anchors import HALF, SPAN, cover
from paperloom.llm.common import cut, pieces, utf8
from paperloom.llm.hashing import Substrings, mixed

BATCH_BYTES = 2 << 20
#: Text for which one bucket of samples, of suffixes and of documents is made.
BUCKET_BYTES = 12 << 20
LEAST_BUCKETS, MOST_BUCKETS, MOST_PARTITIONS = 16, 1 << 18, 20_000
_U = np.uint64

#: What is sent of a sample, of a removed run of starts, of a contested run, and of a suffix.
SAMPLE = np.dtype([("gram", "<u8"), ("all", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "u1"), ("off", "u1"), ("left", "u1"), ("right", "u1")])
GONE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("count", "<u4")])
SUFFIX = np.dtype([("all", "<u8"), ("doc", "<i8"), ("start", "<u4")])
ROW = "bucket long, kind string, data binary"


def _pack(table: np.ndarray) -> bytes:
    """Fields one after the other, each byte plane on its own, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(table[f]).view(np.uint8).reshape(len(table), -1).T).tobytes() for f in table.dtype.names]
    return len(table).to_bytes(8, "little") + bytes(pa.compress(b"".join(planes), codec="lz4_raw", asbytes=True))


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * kind.itemsize, codec="lz4_raw", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = np.zeros(n, kind), 0
    for f in kind.names:
        width = kind[f].itemsize
        out[f] = np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind[f]).ravel()
        at += n * width
    return out


def _all(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.concatenate([_unpack(b, kind) for b in blobs]) if blobs else np.zeros(0, kind)


def _dealt(table: np.ndarray, bucket: np.ndarray, name: str) -> list[tuple[int, str, bytes]]:
    """One packed row for each bucket that gets something."""
    order = np.argsort(bucket, kind="stable")
    table, bucket = table[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    ends = [*cuts[1:], len(bucket)]
    return [(int(bucket[a]), name, _pack(table[a:b])) for a, b in zip(cuts, ends)]


def _rows(rows: list[tuple[int, str, bytes]]) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())]


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (mixed(doc.astype(_U)) % _U(buckets)).astype(np.int64)


def _gone(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), GONE)
    out["doc"], out["start"], out["count"] = doc, start, count
    return out


def _first(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys, then by place, and whether each begins a run of equal keys."""
    order = np.lexsort((start, doc, *keys[::-1]))
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            k = k[order]
            same &= k[1:] == k[:-1]
        fresh[1:] = ~same
    return order, fresh


def _samples(buckets: int):
    """Step 1; repeats within a batch are removed at once. Rows for documents have negative buckets and pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH_BYTES):
            data, begins = utf8(batch.column(1))
            c = cover(data, begins)
            s = np.zeros(len(c["doc"]), SAMPLE)
            s["doc"] = batch.column(0).to_numpy(zero_copy_only=False)[c["doc"]]
            for f in ("gram", "all", "start", "count", "off", "left", "right"):
                s[f] = c[f]
            order, fresh = _first([s["gram"], s["all"]], s["doc"], s["start"])
            s = s[order]
            again, s = s[~fresh], s[fresh]
            gone = _gone(again["doc"], again["start"], again["count"])
            rows = _dealt(s, (mixed(s["gram"]) % _U(buckets)).astype(np.int64), "sample") + _dealt(gone, -1 - _home(gone["doc"], buckets), "gone")
            yield pa.RecordBatch.from_arrays(_rows(rows), names=["bucket", "kind", "data"])

    return run


def _ranked(buckets: int):
    """Step 2 for one bucket."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            gone = _all(table.column("data").to_pylist(), GONE)
            rows = _dealt(gone, _home(gone["doc"], buckets), "gone")
            return pa.Table.from_arrays(_rows(rows), names=["bucket", "kind", "data"])
        s = _all(table.column("data").to_pylist(), SAMPLE)
        order, fresh = _first([s["gram"], s["all"]], s["doc"], s["start"])
        s = s[order]
        again, s = s[~fresh], s[fresh]
        gone = _gone(again["doc"], again["start"], again["count"])
        # Only first occurrences are left; of those, what shares the K bytes and a half with another.
        sides = {}
        for side in ("left", "right"):
            o = np.lexsort((s[side], s["gram"]))
            same = (s["gram"][o][1:] == s["gram"][o][:-1]) & (s[side][o][1:] == s[side][o][:-1])
            flag = np.zeros(len(s), bool)
            flag[o[1:][same]] = flag[o[:-1][same]] = True
            sides[side] = flag
        s = s[sides["left"] | sides["right"]] if len(s) else s
        left, right = (sides[k][sides["left"] | sides["right"]] for k in ("left", "right"))
        start, count, off = s["start"].astype(np.int64), s["count"].astype(np.int64), s["off"].astype(np.int64)
        # Starts that hold HALF bytes to the right of the sample begin at most HALF before it, and the other way about.
        low = np.where(left, start, np.maximum(start, start + off - HALF))
        high = np.where(right, start + count, np.minimum(start + count, start + off - HALF + 1))
        some = high > low
        contested = _gone(s["doc"][some], low[some], (high - low)[some])
        rows = _dealt(gone, _home(gone["doc"], buckets), "gone") + _dealt(contested, _home(contested["doc"], buckets), "contested")
        return pa.Table.from_arrays(_rows(rows), names=["bucket", "kind", "data"])

    return run


TEXTS = "bucket long, docs binary, lengths binary, data binary"


def _texts(buckets: int):
    """Texts, packed by the bucket of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 * BATCH_BYTES):
            data, begins = utf8(batch.column(1))
            doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            home = _home(doc, buckets)
            out = []
            for b in np.unique(home):
                mine = np.flatnonzero(home == b)
                raw = b"".join(data[begins[k] : begins[k + 1]].tobytes() for k in mine)
                out.append((int(b), doc[mine].tobytes(), np.diff(begins)[mine].tobytes(), bytes(pa.compress(raw, codec="zstd", asbytes=True))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "docs", "lengths", "data"])

    return run


def _each_text(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    for docs, lengths, data in zip(*(table.column(c).to_pylist() for c in ("docs", "lengths", "data"))):
        n = np.frombuffer(lengths, np.int64)
        raw = np.frombuffer(pa.decompress(data, decompressed_size=int(n.sum()), codec="zstd", asbytes=True), np.uint8) if n.sum() else np.zeros(0, np.uint8)
        ends = np.cumsum(n)
        for doc, a, b in zip(np.frombuffer(docs, np.int64).tolist(), (ends - n).tolist(), ends.tolist()):
            yield doc, raw[a:b]


def _suffixes(buckets: int):
    """Step 3, first part: the contested suffixes of a bucket of documents, by bucket of their first 100 bytes."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        contested = _all(found.column("data").to_pylist(), GONE)
        contested = contested[np.lexsort((contested["start"], contested["doc"]))]
        docs, begin = np.unique(contested["doc"], return_index=True)
        part = dict(zip(docs.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(contested)])))
        parts = []
        if part:
            for doc, data in _each_text(texts):
                if doc not in part:
                    continue
                c = contested[slice(*part[doc])]
                count = c["count"].astype(np.int64)
                at = np.repeat(c["start"] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                s = np.zeros(len(at), SUFFIX)
                s["all"], s["doc"], s["start"] = Substrings(data).of(at, at + SPAN), doc, at
                parts.append(s)
        s = np.concatenate(parts) if parts else np.zeros(0, SUFFIX)
        order, fresh = _first([s["all"]], s["doc"], s["start"])
        s = s[order]
        again, s = s[~fresh], s[fresh]
        s = s[np.lexsort((s["start"], s["doc"]))]
        gone = _gone(again["doc"], again["start"], np.ones(len(again)))
        rows = _dealt(s, (mixed(s["all"]) % _U(buckets)).astype(np.int64), "suffix") + _dealt(gone, -1 - _home(gone["doc"], buckets), "gone")
        return pa.Table.from_arrays(_rows(rows), names=["bucket", "kind", "data"])

    return run


def _sorted(buckets: int):
    """Step 3, second part: one bucket of suffixes in order; what isn't first is removed."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            gone = _all(table.column("data").to_pylist(), GONE)
        else:
            s = _all(table.column("data").to_pylist(), SUFFIX)
            order, fresh = _first([s["all"]], s["doc"], s["start"])
            again = s[order][~fresh]
            gone = _gone(again["doc"], again["start"], np.ones(len(again)))
        gone = gone[np.lexsort((gone["start"], gone["doc"]))]
        return pa.Table.from_arrays(_rows(_dealt(gone, _home(gone["doc"], buckets), "gone")), names=["bucket", "kind", "data"])

    return run


def _kept(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Step 4 for a bucket of documents."""
    import hashlib

    gone = _all(found.column("data").to_pylist(), GONE)
    gone = gone[np.lexsort((gone["start"], gone["doc"]))]
    docs, begin = np.unique(gone["doc"], return_index=True)
    part = dict(zip(docs.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(gone)])))
    ids, size, removed, spans, digests = [], [], [], [], []
    for doc, data in _each_text(texts):
        kept, lost, runs = data, 0, 0
        if doc in part:
            g = gone[slice(*part[doc])]
            a = g["start"].astype(np.int64)
            b = np.maximum.accumulate(a + g["count"] + SPAN - 1)
            head = np.concatenate(([True], a[1:] > b[:-1]))
            first = a[head]
            last = b[np.append(np.flatnonzero(head)[1:] - 1, len(b) - 1)]
            lost, runs = int((last - first).sum()), len(first)
            stay = np.ones(len(data), bool)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[first] += 1
            edge[last] -= 1
            stay = np.cumsum(edge[:-1], dtype=np.int8) == 0
            kept = data[stay]
        ids.append(doc), size.append(len(data)), removed.append(lost), spans.append(runs), digests.append(hashlib.sha256(np.ascontiguousarray(kept)).hexdigest())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _distinct_ids(docs: DataFrame) -> DataFrame | None:
    """Where doc_id is missing or shared: distinct rows with new ids in order, else None."""
    ids = docs.select("doc_id")
    shared = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if shared.isEmpty():
        return None
    distinct = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).dropDuplicates(["doc_id", "hash"])
    order = distinct.select("doc_id", "hash").sort(F.col("doc_id").asc_nulls_first(), "hash")
    numbered = order.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF("doc_id long, hash long, place long")
    return cut(numbered)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = _distinct_ids(docs)
    if numbered is not None:
        keyed = docs.withColumn("hash", F.xxhash64("text")).alias("d").join(
            numbered.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.hash") == F.col("n.hash"))
        ).select(F.col("d.doc_id").alias("own"), "place", "text")
        answer = _dedup(keyed.dropDuplicates(["place"]).select(F.col("place").alias("doc_id"), "text"))
        return keyed.select("own", "place").join(answer.withColumnRenamed("doc_id", "place"), "place").select(F.col("own").alias("doc_id"), *[c.split()[0] for c in KEPT.split(", ")[1:]])
    return _dedup(docs)


def _dedup(docs: DataFrame) -> DataFrame:
    nbytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, nbytes // BUCKET_BYTES))
    # As many partitions as buckets: what a task reads doesn't grow with the input.
    dealt = lambda rows: rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").groupBy("bucket")
    ranked = cut(dealt(docs.mapInArrow(_samples(buckets), ROW)).applyInArrow(_ranked(buckets), ROW))
    texts = docs.mapInArrow(_texts(buckets), TEXTS)
    suffixes = dealt(texts).cogroup(dealt(ranked.where("kind = 'contested'"))).applyInArrow(_suffixes(buckets), ROW)
    gone = ranked.where("kind = 'gone'").union(dealt(suffixes).applyInArrow(_sorted(buckets), ROW))
    return dealt(texts).cogroup(dealt(gone)).applyInArrow(_kept, KEPT)
