"""N-gram Jaccard join (operator 1): exact links between documents whose sets of 5-word shingles are at least 0.8 alike.

1. Shingles: each task turns a batch of texts into sets of hashed shingles, and sends every distinct shingle of the batch
   once to the bucket of its hash, packed. A bucket answers how many batches or documents hold it; the answers return to
   the batch. A document of n shingles of which fewer than 0.8 n occur elsewhere can't have a link and goes no further.
2. Documents with equal sets become one class; everything below works on classes.
3. Candidates: with shingles ordered from rare to common, two sets that are 0.8 alike share one of their first
   n - ceil(0.8 n) + 1 (prefix filter). Classes that share such a shingle are joined into candidate components.
4. Blocked product: candidate components are cut into blocks; for each pair of blocks of a component whose sizes allow a link
   the sparse incidence matrices are multiplied, overlap counts accumulate, and pairs below 0.8 * (|A| + |B|) / 1.8 are
   discarded. What leaves a block is the number of links of each class and a spanning forest, never the pairs.

A frequent shingle is sent once a batch, copies are counted before they are sent on, and large components are spread over
block pairs, so no key gathers a share of the rows. Exact but for hash collisions: hashes have 40 bits and the bucket number
(4 bits at least, 18 at most) and are compared within pairs of blocks of a candidate component, so two documents of 10,000
shingles each share one by chance with a probability of 10^8 / 2^44, or 6 in a million.

Nulls: a null or wordless text has an empty set and no link; its component is itself. Rows that repeat are copies of each
other. Long texts make batches of their own; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut, pieces, utf8
from paperloom.llm.components import components
from paperloom.llm.hashing import Substrings, mixed

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 80
BATCH_BYTES = 2 << 20
#: Text for which one bucket of hashes is made.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS, MOST_BUCKETS, MOST_PARTITIONS = 16, 1 << 18, 20_000
#: Weight of a block of the product: a class weighs 1, and 1 more for every UNIT shingles of its set.
BLOCK, UNIT = 1024, 1024
#: Levels of set size: more than 100 / PERCENT, so sets that are 0.8 alike lie on one level or on neighbours.
STEP = 1.26
#: Shingles of all classes for which one shard of prefix entries is made (a fifth of them at most are in prefixes).
SHARD_SHINGLES = 1 << 21
#: Shingles held by more classes of a block than this are multiplied densely.
DENSE = 48

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = _SPACE[0x09:0x0E] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U)
LOW = 40


def shingles(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of each text, and the text's number; a text repeats a hash if it repeats the shingle."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = begins[(begins > 0) & (begins < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    word = Substrings(low).of(start, end)
    doc = np.searchsorted(begins, start, side="right") - 1
    n = len(begins) - 1
    many = np.bincount(doc, minlength=n)[:n]
    full = np.zeros(len(word), bool)
    if len(word) >= SHINGLE:
        full[: len(word) - SHINGLE + 1] = doc[: len(word) - SHINGLE + 1] == doc[SHINGLE - 1 :]
    at = np.flatnonzero(full)
    h = np.zeros(len(at), _U)
    for k in range(SHINGLE):
        h += word[at + k] * _PLACE[k]
    h, owner = mixed(h), doc[at]
    short = np.flatnonzero((many > 0) & (many < SHINGLE))
    if len(short):
        begin = np.searchsorted(doc, short)
        s = np.zeros(len(short), _U)
        for k in range(SHINGLE - 1):
            has = many[short] > k
            s[has] += word[begin[has] + k] * _PLACE[k]
        h, owner = np.concatenate((h, mixed(s + many[short].astype(_U)))), np.concatenate((owner, short))
    return h, owner


def sets(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, ordered by hash."""
    h, owner = shingles(data, begins)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    again = np.zeros(len(h), bool)
    if len(h) > 1:
        # Within a run of equal hashes owners are not in order yet only if the stable sort saw short texts last.
        same = np.flatnonzero(np.concatenate(([False], h[1:] == h[:-1])))
        if len(same):
            run = np.cumsum(np.concatenate(([True], h[1:] != h[:-1])))
            near = np.flatnonzero(np.isin(run, run[same]))
            inner = near[np.lexsort((owner[near], run[near]))]
            owner[near] = owner[inner]
            again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return h[~again], owner[~again]


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers as planes of their lowest bytes, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(values).to_bytes(8, "little") + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def _unplaned(data: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _bytes5(keys: np.ndarray) -> bytes:
    """Keys in order, as their steps."""
    return _planes(np.diff(keys, prepend=_U(0)), 5)


def _from5(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, 5), dtype=_U)


PACKED = "bucket long, batch long, keys binary, meta binary, owners binary"


def _packed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, ordinal = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, BATCH_BYTES):
            for part in range(0, batch.num_rows, 1 << 16):
                rows = batch.slice(part, 1 << 16)
                number = (task << 32) | ordinal
                ordinal += 1
                data, begins = utf8(rows.column(1))
                h, owner = sets(data, begins)
                # The bucket is the leading part of the hash; within it, LOW bits are kept.
                bucket = ((h >> _U(40)) * _U(buckets)) >> _U(24)
                key = (bucket << _U(LOW)) | ((h >> _U(8)) & _U((1 << LOW) - 1))
                n = np.bincount(owner, minlength=rows.num_rows)[: rows.num_rows].astype(np.int64)
                sums = [_digest(mixed(h ^ _U(salt)), owner, rows.num_rows) for salt in (0, 0x5851F42D4C957F2D)]
                order = np.lexsort((owner, key)) if len(key) and (np.diff(key.view(np.int64)) < 0).any() else np.arange(len(key))
                key, owner = key[order], owner[order]
                fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                unique = key[fresh]
                repeated = np.diff(np.append(np.flatnonzero(fresh), len(key))) > 1
                own = unique >> _U(LOW)
                cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(own))
                doc_ids = rows.column(0)
                ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
                meta = np.concatenate([ids, known, n, *(s.view(np.int64) for s in sums)]).tobytes()
                keys = [_bytes5(unique[a:b] & _U((1 << LOW) - 1)) for a, b in zip(cuts, ends)]
                flags = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cuts, ends)]
                packed_owners = _planes(owner, 2) + np.packbits(fresh).tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(own[a]) for a in cuts] + [-1 - number], pa.int64()), pa.array([number] * (len(cuts) + 1), pa.int64()),
                    pa.array(keys + [b""], pa.binary()), pa.array(flags + [meta], pa.binary()), pa.array([None] * len(cuts) + [packed_owners], pa.binary()),
                ], names=["bucket", "batch", "keys", "meta", "owners"])

    return run


def _digest(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(owner, kind="stable")
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(values[order])))
    at = np.searchsorted(owner[order], np.arange(n + 1))
    return sums[at[1:]] - sums[at[:-1]]


def _counted(table: pa.Table) -> pa.Table:
    """A bucket's answer to each batch: which of its keys occur elsewhere, and the order of magnitude of how often."""
    if table.num_rows == 1 and table.column("bucket")[0].as_py() < 0:
        return table
    lists = [_from5(k) for k in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in lists])
    key = np.concatenate(lists)
    twice = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=s) for f, s in zip(table.column("meta").to_pylist(), sizes)])
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.cumsum(fresh) - 1
    held = np.bincount(group, weights=1 + twice[order])[group]
    rank = np.zeros(len(key), np.uint8)
    rank[order] = np.where(held > 1, 1 + np.floor(np.log2(np.maximum(held, 1))), 0)
    answers_key, answers_meta, at = [], [], 0
    for s in sizes:
        own = rank[at : at + s]
        answers_key.append(_bytes5(key[at : at + s][own > 0]))
        answers_meta.append(_planes(own, 1))
        at += s
    return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "keys": pa.array(answers_key, pa.binary()), "meta": pa.array(answers_meta, pa.binary()), "owners": table.column("owners")})


SETS = "doc_id long, n long, d1 long, d2 long, keys binary, ranks binary"


def _assembled(table: pa.Table) -> pa.Table:
    """A batch's documents with their sizes and digests; those that may have a link also with their shared shingles,
    ordered from rare to common."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), table.column("meta").to_pylist(), table.column("owners").to_pylist()))
    meta = np.frombuffer(rows[0][2], np.int64).reshape(5, -1)
    ids, known, n, d1, d2 = meta
    docs = len(ids)
    total = int(n.sum())
    flags = -(-total // 8)
    owner = _unplaned(rows[0][3][: len(rows[0][3]) - flags], 2).astype(np.int64)
    fresh = np.unpackbits(np.frombuffer(rows[0][3], np.uint8, offset=len(rows[0][3]) - flags), count=total).astype(np.int64)
    rank = np.concatenate([_unplaned(r[2], 1) for r in rows[1:]]).astype(np.uint8) if len(rows) > 1 else np.zeros(0, np.uint8)
    keys = np.zeros(len(rank), _U)
    if len(rank):
        keys[rank > 0] = np.concatenate([_from5(r[1]) | (_U(r[0]) << _U(LOW)) for r in rows[1:]])
    which = np.cumsum(fresh) - 1
    shared = rank[which] > 0 if total else np.zeros(0, bool)
    many = np.bincount(owner[shared], minlength=docs)[:docs]
    alive = (n > 0) & (100 * many >= PERCENT * n)
    use = np.flatnonzero(shared & alive[owner]) if total else np.zeros(0, np.int64)
    k, r, o = keys[which[use]], rank[which[use]], owner[use]
    order = np.lexsort((k, r, o))
    k, r, o = k[order], r[order], o[order]
    at = np.searchsorted(o, np.arange(docs + 1))
    blobs = [k[a:b].tobytes() if live else None for a, b, live in zip(at[:-1], at[1:], alive)]
    ranks = [r[a:b].tobytes() if live else None for a, b, live in zip(at[:-1], at[1:], alive)]
    return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n": n, "d1": d1, "d2": d2, "keys": pa.array(blobs, pa.binary()), "ranks": pa.array(ranks, pa.binary())})


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, d1, d2 (digests of the set), keys and ranks of shared shingles (null if no link is possible)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nbytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, nbytes // BUCKET_BYTES))
    packed = slim.mapInArrow(_packed(buckets), PACKED)
    # As many partitions as buckets: what a task reads doesn't grow with the input.
    parts = min(buckets, MOST_PARTITIONS)
    answered = packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_counted, PACKED)
    return answered.repartition(parts, "batch").groupBy("batch").applyInArrow(_assembled, SETS)


def _prefixes(shards: int):
    """Packed (key, class) entries of the prefixes, with a batch's own repeats joined: edges to the batch's least class,
    and one entry for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = [], []
            for cls, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                k = np.frombuffer(blob, _U)
                prefix = n - -(-PERCENT * n // 100) + 1 - (n - len(k))
                keys.append(k[:prefix])
                owners.append(np.full(len(k[:prefix]), cls, np.int64))
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            hub = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(key) else owner
            pair = np.unique(np.stack((hub[~fresh], owner[~fresh])), axis=1) if (~fresh).any() else np.zeros((2, 0), np.int64)
            key, owner = key[fresh], owner[fresh]
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([pair[0].tobytes()], pa.binary()), pa.array([pair[1].tobytes()], pa.binary())], names=["shard", "left", "right"])
            shard = (mixed(key) % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            key, owner, shard = key[order], owner[order], shard[order]
            cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(key) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(key))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[cuts]), pa.array([key[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            ], names=["shard", "left", "right"])

    return run


def _stars(table: pa.Table) -> pa.Table:
    """Edges from each class to the least class with which it shares a prefix shingle."""
    key = np.concatenate([np.frombuffer(x, _U) for x in table.column("left").to_pylist()])
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("right").to_pylist()])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    hub = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    apart = hub != owner
    pair = np.unique(np.stack((hub[apart], owner[apart])), axis=1) if apart.any() else np.zeros((2, 0), np.int64)
    return pa.table({"a": pair[0], "b": pair[1]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64))], names=["a", "b"])


def overlaps(keys: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of a block: the product of the incidence matrix with its transpose, dense for keys that
    many rows hold and sparse for the others."""
    n = len(keys)
    out = np.zeros((n, n), np.int32)
    if not n:
        return out
    row = np.repeat(np.arange(n), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    held = np.bincount(group)[group] if len(key) else np.zeros(0, np.int64)
    heavy = held > DENSE
    if heavy.any():
        column = np.unique(group[heavy], return_inverse=True)[1]
        rows = row[heavy]
        for k in range(0, int(column.max()) + 1, 4096):
            part = (column >= k) & (column < k + 4096)
            m = np.zeros((n, min(4096, int(column.max()) + 1 - k)), np.float32)
            m[rows[part], column[part] - k] = 1
            out += (m @ m.T).astype(np.int32)
    light = (held > 1) & ~heavy
    row, group = row[light], group[light]
    flat = np.zeros(n * n, np.int64)
    for d in range(1, DENSE):
        same = np.flatnonzero(group[d:] == group[:-d]) if d < len(group) else np.zeros(0, np.int64)
        if not len(same):
            break
        flat += np.bincount(row[same] * n + row[same + d], minlength=n * n)
    flat = flat.reshape(n, n).astype(np.int32)
    return out + flat + flat.T


def _product(table: pa.Table) -> pa.Table:
    """Links within one block, or between two blocks of a component: link counts and a spanning forest of the links."""
    cls = np.concatenate([np.asarray(x, np.int64) for x in table.column("cls").to_pylist()])
    n = np.concatenate([np.asarray(x, np.int64) for x in table.column("n").to_pylist()])
    copies = np.concatenate([np.asarray(x, np.int64) for x in table.column("copies").to_pylist()])
    side = np.repeat(table.column("side").to_numpy(), [len(x) for x in table.column("cls").to_pylist()])
    keys = [np.frombuffer(k, _U) for x in table.column("keys").to_pylist() for k in x]
    both = overlaps(keys)
    linked = 100 * both.astype(np.int64) >= PERCENT * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    if table.column("low")[0] != table.column("high")[0]:
        linked &= side[:, None] != side[None, :]  # pairs within a block are counted where it meets itself
    links = (linked * copies[None, :]).sum(axis=1)
    label = np.arange(len(cls))
    while True:
        near = np.where(linked, label[None, :], len(cls)).min(axis=1, initial=len(cls))
        after = np.minimum(label, near)
        after = after[after]
        if (after == label).all():
            break
        label = after
    return pa.table({"cls": cls, "links": links, "near": cls[label]})


def blocked(nodes: DataFrame, bins: int) -> DataFrame:
    """nodes(node, component, n, weight) -> cls, part, block, others: the block of each class, and the blocks of the same part that it
    must meet (itself included). Components of at most BLOCK are one block, several to a part. A larger one is cut by levels of
    set size: sets of which one is over STEP times the other can't be 0.8 alike, so blocks meet those of their own level and
    of the next ones only, and the rest of the product is never formed."""
    nodes = nodes.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(STEP))).cast("long"))
    levels = cut(nodes.groupBy("component", "level").agg(F.sum("weight").alias("held")))
    sizes = levels.groupBy("component").agg(F.sum("held").alias("size"))
    large = levels.join(sizes.where(F.col("size") > BLOCK), "component").select("component", "level", F.ceil(F.col("held") / BLOCK).alias("blocks"))
    # The numbers of blocks of a level and of both its neighbours; levels of a component are few.
    around = Window.partitionBy("component").orderBy("level")
    near = lambda f, d: F.when(f("level").over(around) == F.col("level") + d, f("blocks").over(around)).otherwise(0).cast("long")
    large = large.select("component", "level", "blocks", near(F.lag, -1).alias("before"), near(F.lead, 1).alias("behind"))
    d = nodes.join(sizes, "component").join(large, ["component", "level"], "left")
    whole = F.col("blocks").isNull()
    within = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).cast("long")
    name = lambda level, k: level * (1 << 32) + k
    ids = lambda d, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: name(F.col("level") + d, k))).otherwise(F.array().cast("array<long>"))
    others = F.concat(ids(-1, F.col("before")), ids(0, F.col("blocks")), ids(1, F.col("behind")))
    zero = F.lit(0).cast("long")
    return d.select(
        F.col("node").alias("cls"), F.when(whole, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("part"),
        F.when(whole, zero).otherwise(name(F.col("level"), within)).alias("block"), F.when(whole, F.array(zero)).otherwise(others).alias("others"),
    )


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs(doc_id, text)."""
    found = cut(document_sets(docs))
    alive = found.where(F.col("keys").isNotNull())
    classes = alive.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    weight = F.lit(1) + F.floor(F.col("n") / UNIT)
    total, shingled = classes.agg(F.sum(weight), F.sum("n")).first()
    shards = max(LEAST_BUCKETS, (shingled or 0) // SHARD_SHINGLES)
    packed = cut(classes.select("cls", "n", "keys").mapInArrow(_prefixes(shards), "shard long, left binary, right binary"))
    stars = packed.where("shard >= 0").repartition(min(shards, MOST_PARTITIONS), "shard").groupBy("shard").applyInArrow(_stars, "a long, b long")
    own = packed.where("shard < 0").select("left", "right").mapInArrow(_unpacked, "a long, b long")
    candidate = components(stars.union(own))
    nodes = blocked(candidate.join(classes.select(F.col("cls").alias("node"), "n", weight.alias("weight")), "node"), max(1, (total or 0) // BLOCK))
    rows = classes.select("cls", "n", "copies", "keys").join(nodes, "cls")
    blocks = rows.groupBy("part", "block", "others").agg(F.collect_list(F.struct("cls", "n", "copies", "keys")).alias("rows"))
    blocks = blocks.select("part", "block", "others", *[F.col(f"rows.{c}").alias(c) for c in ("cls", "n", "copies", "keys")])
    paired = blocks.withColumn("other", F.explode("others"))
    paired = paired.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("block").alias("side"), "cls", "n", "copies", "keys")
    out = cut(paired.groupBy("part", "low", "high").applyInArrow(_product, "cls long, links long, near long"))
    links = out.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(out.where("near != cls").select(F.col("cls").alias("a"), F.col("near").alias("b"))).withColumnsRenamed({"node": "cls"})
    reps = classes.select("cls", "n", "d1", "d2", "rep", "copies").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = reps.join(least, "component").join(links, "cls", "left")
    told = told.select("n", "d1", "d2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found.select("doc_id", "n", "d1", "d2").join(told, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that aren't the first (smallest doc_id) of their component. Rows that share a kept
    doc_id and the text stay once; a row without doc_id stays unless it is linked to one with."""
    told = join(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    shared = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    kept = docs.alias("d").join(told.distinct().alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")), "left_semi").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"]) if shared else kept
