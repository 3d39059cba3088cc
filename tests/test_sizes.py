"""What a task holds doesn't grow with the tables."""

import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.operators import views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(session, "ROWS", 500, raising=False)


def test_items_are_dealt_out_by_their_number(spark, few_rows):
    n = views.order_items(spark, SF).count()
    most = views.order_items(spark, SF).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert n > 4 * 500 and most < 2 * 500


def test_amounts_are_told_as_before(spark):
    """One look at a text says what the compact form said."""
    from paperloom.functions import text as t

    def told(text, pattern):
        c = t.compact_money(text)
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        wrapped = c.startswith("(") & c.endswith(")") & (F.length(c) > 2)
        return c.rlike(r"\d") & F.when(wrapped, ~inner.rlike(r"[()]") & inner.rlike(pattern)).otherwise(~c.rlike(r"[()]") & c.rlike(pattern))

    odd = ["", " ", "12", "1,2.5%", "-$5.00", "$-5", "(1.00)", "( 1 .0 0)", "(1", "1)", "()", "(-)", "-", ",", "5-", "5%-", "12\n", "12\u0085", "(12\u0085)", "1 2", "−5.00", "5—", "1 2.50", "a1", "1a", "x", "٣", "1.2.3", "﻿7", "1 3"]
    d = spark.createDataFrame([(x,) for x in [*odd, None]], "x string").select("x", *[f(F.col("x")).alias(n) for n, f in (("a", t.looks_like_amount), ("m", t.looks_like_money))], told(F.col("x"), t.AMOUNT).alias("wa"), told(F.col("x"), t.MONEY).alias("wm"))
    assert all((r.a, r.m) == (r.wa, r.wm) for r in d.collect())


def test_runs_are_looked_at_once(spark):
    """Whether a run is an amount isn't asked again for its neighbour."""
    from paperloom.operators import layout

    r = spark.createDataFrame([(1, 1, 1, 0, 5.0, 9.0, 9.0, "a")], "doc_id long, page int, line int, ord int, x double, width double, font_size double, text string")
    plan = layout.columns_of_lines(r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 16


def test_pages_without_hits_stay_items(spark):
    """Pages are walked through in batches, not one group each, and a hit's boxes are those of its glyphs."""
    from paperloom.operators import glyphs

    rows = [(p, 1, k, text, 50.0 * k, 700.0, 45.0, 9.0, k == 2) for p in range(40) for k, text in enumerate(("Big wid", "get  é", None if p % 2 else "İx"))]
    items = spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, x double, y double, width double, height double, has_eol boolean")
    hits = glyphs.find_hits(items, "widget")
    assert "FlatMapGroups" not in hits._jdf.queryExecution().optimizedPlan().toString()
    found = hits.collect()
    assert len(found) == 40 and {(r.first, r.last, r.matched) for r in found} == {(4, 9, "widget")}
    g = [r for r in glyphs.glyphs(items.where("doc_id = 0")).orderBy("ord", "k").collect()][4:10]
    box = found[0].rects[0]
    assert (box.x, box.y, box.width) == (min(r.x for r in g), min(r.y for r in g), max(r.x + r.width for r in g) - min(r.x for r in g))
    kept = {(r.doc_id, r.ord): r.kept for r in glyphs.kept_text(items, glyphs.erase_marks(hits.where("doc_id = 0"))).collect()}
    assert len(kept) == 120 and [kept[1, k] for k in range(3)] == ["Big wid", "get  é", ""] and "wid" not in kept[0, 0] and kept[0, 2] == "İx"


def test_drafts_are_looked_up_where_they_lie(spark):
    """Only shows become glyphs, once for each of their characters; drafts stay whole."""
    from paperloom.sources import rewriting

    shows = spark.createDataFrame([(1, 1, 0, "F", "aba", bytearray(b"xyz")), (1, 1, 1, "F", "ba", bytearray(b"pq")), (1, 1, 2, "G", "a", bytearray(b"\x00a"))], "doc_id long, page int, ord int, font string, text string, bytes binary")
    drafts = spark.createDataFrame([(1, 1, 0, "a b"), (1, 1, 1, "ac"), (1, 1, 2, "a a"), (1, 1, 3, "a")], "doc_id long, page int, ord int, draft string")
    codes = rewriting.reused_codes(shows, drafts)
    assert codes._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert {r.ord: r.codes for r in codes.collect()} == {0: "712070", 1: None, 2: "006100200061", 3: None}


def test_edges_at_half_the_greatest_are_hot():
    """Gradients of (63, 101) are just half as long as those of (6, 238)."""
    import numpy as np

    from paperloom.operators import sheets

    image = np.zeros((8, 8), int)
    image[0, 2], image[1, 2], image[0, 1] = 1, 31, 50
    image[5, 6], image[6, 7] = 119, 3
    e = sheets.sobel(image)
    assert e[1, 1] ** 2 == pytest.approx(63**2 + 101**2) and e.max() == e[6, 6] and e[1, 1] >= e.max() / 2


def test_events_count_in_the_hours_of_the_sql(spark, tmp_path):
    """The last half millisecond of an hour belongs to the next one, half a millisecond before it only since 1970; no event is left out."""
    import duckdb

    from paperloom.plans import catalog

    times = ["2024-01-01 00:59:59.999499", "2024-01-01 00:59:59.999500", "2024-01-01 01:00:00", "1969-12-31 22:59:59.999500", "1969-12-31 22:59:59.999501", "1969-12-31 23:59:59.999600", None]
    rows = ", ".join(f"({k}, TIMESTAMP '{t}', 'a', {2**k}.25)" if t else f"({k}, NULL, 'a', {2**k}.25)" for k, t in enumerate(times))
    db = duckdb.connect()
    db.sql(f"create table events as select * from (values {rows}) t(event_id, ts, event_type, value)")
    db.sql(f"copy (select event_id, ts, event_type, value::double as value from events) to '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["event_windows"](spark, str(tmp_path)).collect()]
    want = [(r[0], r[1], r[2], float(r[3])) for r in db.sql(catalog.SQL["event_windows"]).fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_documents_share_states(spark, tmp_path, monkeypatch):
    """Totals of many documents over three triggers, their states in two buckets; lines without a text or a document are no stumbling block."""
    from paperloom.streaming import lines as stream

    monkeypatch.setattr(stream, "BUCKETS", 2)
    schema, docs = "doc_id long, seq int, text string", [*range(2**60, 2**60 + 40), None]
    for k in range(3):
        new = [(d, 10 * k + j, text) for d in docs for j, text in enumerate([f"row {k} 1.50", None, f"row 2 {k}.25"][: 3 if d is None or d % 2 else 1])]
        new += [(d, 10 * k + 9, "Total 100.00") for d in docs if k == 2 or d == 2**60 + 1]
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream.to_table(stream.running_totals(stream.read_files(spark, f"{tmp_path}/in/*", schema)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.doc_id, r.seq): (r.n, r.actual) for r in spark.read.schema(stream.TOTALS).parquet(f"{tmp_path}/out").collect()}
    want = {(d, 29): (3, 4.5) if d is not None and d % 2 == 0 else (6, 8.25) for d in docs}
    want |= {(2**60 + 1, 10 * k + 9): (2, 1.75 + k) for k in range(3)}
    assert got == want


def test_bands_are_made_once(spark):
    """Rows of a page are a fold that no filter works out before it is taken apart, and a selection reads them from a table."""
    from paperloom.operators import layout, members

    r = spark.createDataFrame([(1, 1, k // 2, k % 2, 60.0 * k, 700.0 - 18 * (k // 2), 20.0, 9.0, 9.0, f"a{k}") for k in range(6)], "doc_id long, page int, line int, ord int, x double, y double, width double, height double, font_size double, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(layout.visual_bands(r)).count("aggregate(rows") == 1
    chosen = members.selection_runs(r, r.select("doc_id", "page", "line").distinct().withColumn("selection", F.col("line")))
    assert "aggregate(rows" not in plan(chosen) and chosen.count() == 6


def test_groups_of_shows_are_made_once(spark):
    """No filter works groups and scores out before they are made."""
    from paperloom.operators import edits

    shows = spark.createDataFrame([(1, 1, 1, k, text, 50.0 * k, 700.0, 9.0) for k, text in enumerate(("A-1", "1,234.00", "x", "y"))], "doc_id long, page int, stream int, ord int, text string, x double, y double, font_size double")
    needles = ["A-1 1234.00", "A - 1", "1,234.00 x", "1,234.00-", "none", "--"]
    patches = spark.createDataFrame([(1, 1, k, 0.0, 700.0, needle, None) for k, needle in enumerate(needles)], "doc_id long, page int, patch_id int, x double, y double, original string, raw_text string")
    found = edits.by_text(shows, patches)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {r.patch_id: ([m.ord for m in r.members], round(r.score, 2)) for r in found.collect()} == {0: ([0, 1], 860.0), 1: ([0], 840.0), 2: ([1, 2], 950.0), 3: ([1], 690.0)}


def test_drafts_are_dealt_where_lines_lie(spark):
    """A line's runs are gathered once; nothing is numbered, taken apart and joined again by run."""
    from paperloom.operators import members

    rows = [(1, 0, 56.0, "blue"), (1, 1, 86.0, "sea"), (1, 2, 360.0, "7"), (1, 3, 420.0, "1,000.00"), (2, 5, 10.0, "one run"), (3, 0, 400.0, "9.00"), (3, 1, 10.0, None), (3, 2, 30.0, "a b"), (4, 0, 10.0, "x"), (4, 1, 30.0, "y")]
    runs = spark.createDataFrame([(1, 1, line, ord, x, 25.0, 9.0, text) for line, ord, x, text in rows], "doc_id long, page int, line int, ord int, x double, width double, font_size double, text string")
    drafts = spark.createDataFrame([(1, 1, 1, "new big  blue sea 7 1,000.00"), (1, 1, 2, " a  b "), (1, 1, 3, "p q r 8.00"), (1, 1, 4, None)], "doc_id long, page int, line int, draft string")
    dealt = members.dealt(runs, drafts)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    got = {(r.line, r.ord): (r.column, r.draft) for r in dealt.collect()}
    assert got == {
        (1, 0): (0, "new"), (1, 1): (0, "big blue sea"), (1, 2): (1, "7"), (1, 3): (2, "1,000.00"), (2, 5): (0, "a b"), (3, 1): (0, "p"), (3, 2): (0, "q r"), (3, 0): (1, "8.00"), (4, 0): (0, ""), (4, 1): (0, ""),
    }


def test_drafts_of_columns_meet_items_once(spark):
    """Flags and texts come with the same items; a token that is an amount's text by its key alone goes to it; what a column takes isn't
    worked out for a filter, nor its type told anew for each row."""
    from paperloom.operators import drafts
    from paperloom.plans import catalog

    plan = catalog.QUERIES["draft_columns"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("aggregate(reverse") == 1
    texts = [("a­-5.00 5.0­0", "5.00"), ("b 5.00­", "5.00"), ("c x", "5.00"), ("d (5)", " (5)\t"), ("e 5–", "5-")]
    d = spark.createDataFrame(texts, "draft string, amount string").select("draft", drafts.across_columns(F.array(F.lit("name"), "amount"), F.col("draft")).alias("d"))
    assert {r.draft[0]: r.d for r in d.collect()} == {"a": ["a­-5.00", "5.0­0"], "b": ["b", "5.00­"], "c": ["c x", ""], "d": ["d", "(5)"], "e": ["e", "5–"]}


def test_streams_are_patched_where_they_lie(spark):
    """A stream is cut once on the way to operators, and put together again as token by token; pages of which nothing is left go."""
    from paperloom.sources import content, rewriting

    texts = ["BT /F 9 Tf 1 0 0 1 5 6 Tm (a) Tj % note\n(b) Tj 3 4 Td <41> Tj ET", "(only) Tj", "BT 7 8 Td (c) Tj ET", ""]
    streams = spark.createDataFrame([(d, 1, t) for d, t in enumerate(texts)], "doc_id long, page int, stream string")
    cut_once = content.operators_of(streams)._jdf.queryExecution().optimizedPlan().toString()
    assert cut_once.count("regexp_extract_all(stream") == 1
    toks = content.tokens(streams)
    assert toks._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(stream") == 1
    ops, shows = content.operators_of(streams), content.painted(streams).where("kind = 'show'")
    s = shows.select("doc_id", "page", "ord", F.when(F.col("text") == "b", "remove").when(F.col("text") == "only", "remove").when(F.col("text") == "c", "keep").otherwise("text").alias("action"), F.lit("n (1)").alias("text"), F.lit(None).cast("string").alias("codes"))
    changes = s.withColumns({"to_x": F.when(F.col("doc_id") == 2, 70.0).when(F.col("text") == "", 1.0), "to_y": F.lit(None).cast("double")})
    want = {r.doc_id: r.stream for r in rewriting.joined(rewriting.patched(toks, ops, shows, changes)).collect()}
    again = rewriting.patched_streams(streams, ops, shows, changes)
    got = {r.doc_id: r.stream for r in again.collect()}
    assert got == want and set(got) == {0, 2} and "(n \\(1\\)) Tj 3 4 Td (n \\(1\\)) Tj ET" in got[0] and "%" not in got[0]


def test_phrases_are_anchored_by_neighbours(spark):
    """The rarest inner word of a phrase is its only anchor, and only where its neighbours stand beside it; texts are parted and looked through once."""
    from paperloom.operators import search

    pages = spark.createDataFrame([(1, 1, "a b  c d\ne a b c x d e"), (2, 1, "B C D"), (3, 1, "xa b c d ex b c"), (4, 1, "  "), (5, 1, None)], "doc_id long, page int, text string")
    queries = spark.createDataFrame([(1, "a b c d e"), (2, "b c d"), (3, "b d"), (4, "c"), (5, "b c x d"), (6, "a c b d")], "query_id int, query string")
    index = search.Index(pages, ("doc_id", "page"))
    probes = [r for r in search._probes(queries, index.vocabulary).collect() if len(r.needle.split()) > 2]
    inner = lambda r, k: r.needle.split()[k] if 0 < k < len(r.needle.split()) - 1 else None
    assert {r.query_id for r in probes} == {1, 2, 5, 6} and len(probes) == 4
    assert all((r.anchors, r.word, r.before, r.after) == (1, inner(r, r.k), inner(r, r.k - 1), inner(r, r.k + 1)) for r in probes)
    hits = search.find_pages(pages, queries)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan and plan.count("\\Q") <= 2
    assert {(r.query_id, r.doc_id, r.start) for r in hits.collect()} == {(1, 1, 0), (1, 3, 1), (2, 1, 2), (2, 2, 0), (2, 3, 3), (4, 1, 4), (4, 1, 14), (4, 2, 2), (4, 3, 5), (4, 3, 14), (5, 1, 12)}
