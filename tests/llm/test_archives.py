"""Manifest, clusters and archives against plain versions, on rows with edges."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import clustering, manifest, warc

from . import brute

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, s, lang, n, t):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, lang, n, t)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def tree(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row (doc_id, source, lang, n_chars, text), sorted."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, r in enumerate(by[s]):
            steps = []
            for lv, place in ((trees[s], k), (top, j)):
                for nodes in lv[:-1]:
                    first = place // 3 * 3
                    steps.append((nodes[first:place], nodes[place + 1 : first + 3]))
                    place //= 3
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(*r[:4], r[4].replace("\n", "") if r[4] and touched else r[4])
            for before, after in steps:
                now = h(*before, now, *after)
            proof = h(*[x for before, after in steps for x in before + after])
            out.append((r[0], trees[s][0][k], trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS).repartition(3)
    return sorted((tuple(r) for r in manifest.report(df).collect()), key=repr)


@pytest.fixture
def small_steps(monkeypatch):
    """Many rounds and digits, few rows."""
    monkeypatch.setattr(manifest, "STRETCH", 2)
    monkeypatch.setattr(manifest, "COPIES", 2)
    monkeypatch.setattr(manifest.placed, "__defaults__", (2,))
    monkeypatch.setattr(manifest.manifest, "__defaults__", (3, 2, None))


def test_manifest_of_one_source(spark, small_steps):
    for n in (1, 2, 3, 4, 10, 28):
        rows = [(i * i - 50, "s", "en", i, f"text {i}\nmore") for i in range(n)]
        assert found(spark, rows) == tree(rows)


def test_manifest_of_odd_rows(spark, small_steps):
    rows = [(i, f"s{i % 5}" if i % 7 else None, "en", i, t) for i, t in brute.TEXTS] + [(-5, "", None, None, "a\nb"), (None, "ß", "x", 1, None), (None, None, None, None, None)]
    rows += [(9, "s1", "en", 1, "again\n")] * 5 + [(9, "s1", "de", 1, "again\n")] + [(10**18, "s1", "en", 1, "far"), (-(10**18), "s1", "en", 1, "far")] + [(2, "𝄞", "en", 1, "x"), (2, "～", "en", 1, "x")]
    assert found(spark, rows) == tree(rows)


def test_manifest_with_production_parameters(spark):
    rows = [(i * 37 % 2003, "hot" if i % 3 else f"s{i % 40}", "en", i, f"t{i}\n" if i % 2 else f"t{i}") for i in range(2003)]
    got = found(spark, rows)
    assert got == tree(rows)
    assert {r[6] for r in got} == {True, False}
    assert found(spark, []) == []


def test_manifest_tells_a_changed_row(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(30)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], DOCS)
    columns = {c: F.col(c) for c in manifest.COLUMNS}
    other = F.when(F.col("doc_id") == 7, manifest.leaf_of(**columns | {"lang": F.lit("de")})).otherwise(manifest.leaf_of(**columns))
    m = manifest.manifest(df, carry={"other": other})
    assert [r.doc_id for r in m.where(manifest.fold(F.col("other"), F.col("path")) != F.col("root")).collect()] == [7]


def clusters(rows, k=8, rounds=10, d=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    named = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for vs, c in zip(own, centroids)]
    ends = [(i, *near(v)) for i, v in kept]
    total = {j: sum(e[1] for e in ends if e[2] == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, dist, total[j], sum(total.values()), digest[j]) for i, dist, j in ends), key=repr)


def clustered(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in clustering.cluster(df, **options).drop("centroid").collect()), key=repr)


def test_clusters(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=64).astype(np.float32).tolist()) for i in range(120)]
    rows += [(500 + i, rows[5][1]) for i in range(40)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]  # one very common vector, ids that repeat or lack
    odd = [(900, None), (901, [0.0] * 63), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, []), (906, [1e5] * 64)]
    assert clustered(spark, rows + odd) == clusters(rows + odd)
    assert clustered(spark, odd[:6]) == []
    assert clustered(spark, rows[:3]) == clusters(rows[:3])
    same = [(i, [0.5] * 64) for i in range(20)]
    assert {x[1] for x in clustered(spark, same)} == {0} and clustered(spark, same) == clusters(same)
    with pytest.raises(Exception, match="after scaling"):
        clustered(spark, [(1, [3e38] + [0.0] * 63)])


def test_screening_intervals_hold_the_exact_nearest():
    r = np.random.default_rng(5)
    for size in (10, 10**4, 10**8):
        centroids = r.integers(-size, size, (8, 64))
        centroids[5] = centroids[2]  # equal ones
        centroids[6] = centroids[2] + 1
        x = np.concatenate([r.integers(-size, size, (200, 64)), centroids, (centroids[2] + centroids[6])[None, :] // 2])
        best, distance, opened = clustering.nearest(x, centroids)
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x], dtype=object)
        assert (distance == exact.min(1)).all() and (best == [row.tolist().index(min(row)) for row in exact]).all()
        assert opened < len(x)


PAGES = "page_id long, url string, html string, type string"


def pages_of(n):
    rows = [(i, f"http://example.com/{i}?q=a b\r\nx", f"<html>{i} " + "ü text " * (i % 50) + "</html>", "clash") for i in range(n)]
    rows += [(n + i, f"http://copy/{i}", rows[3][2] + "x" * 100, "") for i in range(30)] + [(n + 100 + i, None, "short", "") for i in range(3)]
    return rows + [(n + 200, None, None, ""), (None, "u", "y" * 200, ""), (n + 300, "u", "y" * 200, ""), (n + 300, "u", "y" * 200, ""), (n + 301, None, "z" * 100, ""), (n + 302, None, "z" * 100, ""), (n + 400, "big", "w\x00" * 300_000, "")]


def archived(rows):
    groups, out, seen = {}, [], set()
    for i, u, t, _ in rows:
        groups.setdefault((t or "").encode(), []).append((i is None, i or 0, u or ""))
    for i, u, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (t or "").encode()
        first = len(data) < 100 or data not in seen
        seen.add(data)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first else min(groups[data])[1]))
    return sorted(out, key=repr)


def test_archives(spark):
    rows = pages_of(200)
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    for split in (997, 1 << 20):
        assert sorted((tuple(r) for r in warc.report(df, split=split).collect()), key=repr) == archived(rows)
    empty = spark.createDataFrame([], PAGES)
    assert warc.report(empty).collect() == []


def test_every_range_length_gives_each_record_once(spark):
    """Small archives, ranges that begin within members, at them, and one byte beside."""
    rows = pages_of(12)
    files = warc.write(spark.createDataFrame(rows, PAGES).repartition(2), archive=4000).cache()
    assert files.count() > 2
    whole = sorted((r.path, r.start, r.length, r.type, r.record_id, r.target_uri, r.digest, r.payload) for r in warc.read(files).where("type <> 'warcinfo'").collect())
    assert len(whole) == len(rows) and len({r[4] for r in whole}) == len(rows)
    ends = {}
    for r in sorted((r.path, r.start, r.length) for r in warc.read(files).collect()):
        assert r[1] == ends.get(r[0], 0)  # records lie end to end, so none is missed
        ends[r[0]] = r[1] + r[2]
    assert ends == {r.path: r.length for r in files.collect()}
    for split in (whole[0][2], whole[0][2] + 1, 333, 5001):
        assert sorted((r.path, r.start, r.length, r.type, r.record_id, r.target_uri, r.digest, r.payload) for r in warc.read(files, split).where("type <> 'warcinfo'").collect()) == whole


def test_reader_passes_over_what_is_no_record(tmp_path):
    import gzip

    import pyarrow as pa

    one = warc.record("resource", [("WARC-Record-ID", "<a>")], b"block " * 5000, 0)  # stored, so the block stands as it is
    inner = gzip.compress(b"not a record at all, but gzip")
    lying = gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n")
    data = b"noise\x1f\x8b\x08more" + inner + one + lying + b"\x1f\x8b" + one + b"\x1f\x8b\x08"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with pa.OSFile(str(path), "rb") as f:
        whole = list(warc.Archive(f, len(data)).records(0, len(data)))
        assert [(data[a:b], block) for a, b, _, block in whole] == [(one, b"block " * 5000)] * 2
        for cut in range(0, len(data), 4001):
            a, b = warc.Archive(f, len(data)).records(0, cut), warc.Archive(f, len(data)).records(cut, len(data))
            assert [*a, *b] == whole


def test_archives_can_be_read_as_streams(spark, tmp_path):
    """One member after another is also one gzip stream, as other readers take it."""
    import gzip

    files = warc.write(spark.createDataFrame(pages_of(5), PAGES).coalesce(1), f"file://{tmp_path}/out").collect()
    text = gzip.open(files[0].path.removeprefix("file://")).read()
    assert text.count(b"WARC/1.1\r\n") == files[0].records == 1 + len(pages_of(5))
