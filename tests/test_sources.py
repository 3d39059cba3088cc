"""Content streams, fonts, marks, pixels and streams of files."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fonts
from paperloom.operators import marks, pixels
from paperloom.sources import content
from paperloom.streaming import lines as stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tokens(spark):
    text = "BT % note\n/F1 12 Tf [(Hel\\)lo) -250 <576F>] TJ (a(b)c) Tj << /K 1 >> ET"
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, stream string")
    got = [(r.kind, r.str, r.num) for r in content.tokens(df).orderBy("ord").collect()]
    assert got == [
        ("op", None, None), ("name", "F1", None), ("num", None, 12.0), ("op", None, None), ("[", None, None), ("string", "Hel)lo", None), ("num", None, -250.0), ("hex", "Wo", None),
        ("]", None, None), ("op", None, None), ("string", "a(b)c", None), ("op", None, None), ("<<", None, None), ("name", "K", None), ("num", None, 1.0), (">>", None, None), ("op", None, None),
    ]


def test_shows(spark):
    text = "BT /F1 12 Tf 1 0 0 1 50 700 Tm (one) Tj 0 -14 Td (two) Tj 16 TL T* [(th) -300 (ree)] TJ ET BT /F2 9 Tf 5 6 Td 3 Tr (four) Tj ET"
    got = content.shows(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, stream string")).orderBy("ord").collect()
    assert [(r.text, r.font, r.size, r.x, r.y, r["mode"]) for r in got] == [
        ("one", "F1", 12.0, 50.0, 700.0, 0), ("two", "F1", 12.0, 50.0, 686.0, 0), ("th ree", "F1", 12.0, 50.0, 670.0, 0), ("four", "F2", 9.0, 5.0, 6.0, 3),
    ]


def test_literal_round_trip(spark):
    for text in ("a(b)c", "back\\slash", ")(", ""):
        assert one(spark, content.unescaped(content.literal(F.lit(text)))) == text


@pytest.mark.parametrize("name,family,stem", [("ABCDEF+Helvetica-Bold", "helvetica", "helvetica"), ("TimesNewRomanPSMT", "times", "timesnewroman"), ("CourierNew", "courier", "couriernew"), ("ZapfDingbats", "symbol", "zapfdingbats"), ("Foo Sans", "helvetica", "foosans"), ("Foo", "unknown", "foo")])
def test_fonts(spark, name, family, stem):
    assert one(spark, fonts.family(F.lit(name))) == family and one(spark, fonts.face_stem(F.lit(name))) == stem


def test_encodings(spark):
    assert one(spark, fonts.missing_characters(F.lit("a€中б中”"))) == ["中", "б"]
    assert one(spark, fonts.looks_utf16(F.unhex(F.lit("00410042")))) and not one(spark, fonts.looks_utf16(F.unhex(F.lit("4142"))))
    assert not one(spark, fonts.looks_utf16(F.unhex(F.lit("004100"))))


def test_names(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, marks.export_name(F.lit("a"), t, t, f, f, t)) == "a-redacted.pdf" and one(spark, marks.export_name(F.lit("a"), f, f, t, t, f)) == "a-filled.pdf"
    assert one(spark, marks.new_name(F.lit("a.pdf"), F.lit("A.PDF"))) == "a-edited.pdf" and one(spark, marks.new_name(F.lit("a.pdf"), F.lit("b"))) == "b.pdf"
    assert [one(spark, marks.size_label(F.lit(n).cast("long"))) for n in (5, 2048, 5 << 20, 3 << 30)] == ["5 B", "2 KB", "5.0 MB", "3.00 GB"]
    assert [one(spark, marks.checkbox_on(F.lit(v))) for v in ("Yes", "on", "1", "off", "", None)] == [True, True, True, False, False, False]
    assert [one(spark, marks.lane(F.lit(k))) for k in ("erase", "redact", "note", "rect")] == ["erase", "burn", "editor", "native"]


def test_pixels(spark):
    image = spark.createDataFrame([(1, 3, [0.0, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0])], "image_id long, width int, pixels array<double>")
    got = pixels.box_blur(image, 1).first().pixels
    assert got[4] == pytest.approx(1.0) and got[0] == pytest.approx(9 / 4) and got[1] == pytest.approx(9 / 6)
    h = pixels.homographies(spark.createDataFrame([(1, [20.0, 10.0, 180.0, 30.0, 160.0, 220.0, 10.0, 200.0], [0.0, 0.0, 100.0, 0.0, 100.0, 140.0, 0.0, 140.0]), (2, [0.0] * 8, [0.0] * 8)], "quad_id long, src array<double>, dst array<double>"))
    rows = {r.quad_id: r.h for r in h.collect()}
    assert rows[2] is None
    for (x, y), want in zip([(20, 10), (180, 30), (160, 220), (10, 200)], [(0, 0), (100, 0), (100, 140), (0, 140)]):
        a = rows[1]
        w = a[6] * x + a[7] * y + a[8]
        assert ((a[0] * x + a[1] * y + a[2]) / w, (a[3] * x + a[4] * y + a[5]) / w) == pytest.approx(want, abs=1e-6)


def test_running_totals_over_files(spark, tmp_path):
    schema = "doc_id long, seq int, text string"
    rows = [(1, 0, "a 1 10.00"), (1, 1, "b 2 20.00"), (1, 2, "Total 30.00"), (1, 3, "c 1 5.00"), (2, 0, "x 1 1.00"), (2, 1, "y 1 2.00")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    src = f"{tmp_path}/in/*"
    stream.to_table(stream.running_totals(stream.read_files(spark, src, schema)), out, state)
    assert spark.read.schema("doc_id long, seq int, n long, actual double, claimed double").parquet(out).count() == 0
    # State outlives the run: the rest of both documents comes later.
    spark.createDataFrame([(1, 4, "d 1 6.00"), (1, 5, "Total 99.00"), (2, 2, "Total 3.50")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream.to_table(stream.running_totals(stream.read_files(spark, src, schema)), out, state)
    got = {(r.doc_id, r.seq): (r.n, r.actual, r.claimed) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 5): (2, 11.0, 99.0), (2, 2): (2, 3.0, 3.5)}


def test_event_windows_stream_and_table_agree(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "ab"[m % 2], float(m)) for h in range(9) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    flow = stream.event_windows(stream.read_files(spark, f"{tmp_path}/in/*", df.schema))
    stream.to_table(flow, f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.start, r.event_type): (r.n, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = {(r.start, r.event_type): (r.n, r.value) for r in stream.event_windows(df).collect()}
    # Windows that the watermark hasn't passed stay in the state.
    assert got and all(whole[k] == v for k, v in got.items()) and len(got) >= len(whole) - 6


def test_streams_are_cut_where_they_lie(spark):
    """The same operators as from sorted tokens, and no stream's tokens or operators are dealt out or sorted on the way to paint."""
    rows = [(1, 1, "BT % note\n/F1 12 Tf [(Hel\\)lo) -250 <576F>] TJ (a(b)c) Tj << /K 1 >> ET BI /W 1 ID x EI 5 -.5 Td 7"), (1, 2, ""), (2, 1, "q 3 Tr % end"), (3, 1, None)]
    streams = spark.createDataFrame(rows, "doc_id long, page int, stream string")
    told = lambda df: sorted(str(tuple(r)) for r in df.select("doc_id", "page", "ord", "op", "args", "first").collect())
    assert told(content.operators_of(streams)) == told(content.operators(content.tokens(streams)))
    plan = content.painted(streams)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_streams_are_walked_without_rows_of_tokens(spark):
    """What is painted is told from the stream itself, the same as from its operators as rows; kinds and columns that aren't asked for aren't made."""
    odd = ["(a\\051\\\r\nb\\q) Tj <4 1\n4> Tj <zz> Tj", "[(a) -200 % x\n(b) -1 <4>] TJ -200 TJ 5 Tj", "1 0 0 1 5 6 cm /F#31 9 Tf BT 1.2.3 Tr 3 Tr +1 .5 Td (x) ' BI /W 1 ID x EI (y) Tj",
           "BIT (a(b(c)) Tj ) Tj [1 << /K 2 >> 1 1 1 rg\xa00 0 5 5 re", "1 1 1 rg 0 0 5 5 re\x0b/A Do q Q Q 1 0 0 0 k", "%only", "", None, "1 1 1 rg 1 2 3 4 re BI"]
    streams = spark.createDataFrame([(d, 1, t) for d, t in enumerate(odd)], "doc_id long, page int, stream string").coalesce(1)
    told = lambda df: [str(tuple(r)) for r in df.collect()]
    p = content.painted(streams)
    assert told(p) == told(content._walked(content.operators_of(streams))) and len(told(p)) == 12
    assert "regexp_extract_all" not in p._jdf.queryExecution().optimizedPlan().toString()
    for kinds, names in ((("box",), ("doc_id", "white", "x", "y", "wide")), (("box",), ("mode", "red")), (("show",), ("text",)), (("show",), ("x", "in_text", "scale")), (("image", "mode"), ("kind", "x", "size")), (("show", "box"), ("y", "ctm"))):
        assert told(content.painted(streams, kinds, names)) == told(p.where(F.col("kind").isin(*kinds)).select(*names))


def test_streams_tell_which_operators_place_shows(spark):
    """The same owners from the stream itself as from its operators as rows, and the same patched stream."""
    from paperloom.sources import rewriting

    odd = ["BT 1 0 0 1 5 6 Tm (a) Tj % note\n(b) Tj 3 4 Td (c) Tj ET 9 9 Td (d) Tj", "1 2 /N % x\n 3 TD (e) ' BT", "7 Td (f) Tj T* (g) Tj ET (h) Tj 1 2 Td q (i) Tj Q", "BT 1 2 Td T* (j) Tj 1 0 0 1 2 3 Tm (k) TJ", "", None]
    streams = spark.createDataFrame([(d, 1, t) for d, t in enumerate(odd)], "doc_id long, page int, stream string")
    told = lambda df: sorted((r.doc_id, r.ord, r.position, r.p_ord, [(a.ord, a.kind == "num") for a in r.p_args]) for r in df.where("position is not null").collect())
    assert told(rewriting.owned(streams)) == told(rewriting._owned(content.operators_of(streams))) and len(told(rewriting.owned(streams))) == 6
    shows = content.painted(streams, ("show",))
    changes = shows.select("doc_id", "page", "ord", F.lit("keep").alias("action"), "text", F.lit(None).cast("string").alias("codes"), (F.col("x") + 5).alias("to_x"), F.lit(None).cast("double").alias("to_y"))
    new = lambda ops: sorted(tuple(r) for r in rewriting.patched_streams(streams, ops, shows, changes).collect())
    assert new(None) == new(content.operators_of(streams))


def test_lines_are_split_without_the_driver(spark):
    """No side of a join is sent to every executor by way of the driver, and what joins read is written once."""
    from paperloom.operators import members

    lines = spark.createDataFrame([(1, 1, 1, "a 1.00", 56.0, 90.0, 500.0, 10.0, 9.0), (1, 1, 2, "b", 56.0, 30.0, 500.0, 10.0, 9.0)], "doc_id long, page int, line int, text string, x double, y double, width double, height double, font_size double")
    shows = spark.createDataFrame([(1, 1, 1, "a", 56.0, 89.0, 9.0), (1, 1, 2, "1.00", 490.0, 89.0, 9.0)], "doc_id long, page int, ord int, text string, x double, y double, font_size double")
    split = members.split_by_shows(lines, shows)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "LocalTableScan" not in plan and "Scan ExistingRDD" not in plan
    assert sorted((r.line, r.column, r.text, r.n_columns) for r in split.collect()) == [(1, 0, "a", 2), (1, 1, "1.00", 2), (2, 0, "a", 2), (2, 1, "1.00", 2)]


def test_trees_are_climbed_where_they_lie(spark):
    """The same as by jumping, for trees that a worker holds, larger ones, circles, lost parents and nodes of one number; nodes are dealt out once."""
    from paperloom.operators import trees

    rows = [(d, o, None if o % 9 == 0 else 99 if o == 13 else (o * 7 + d) % o if o % 5 else o + 1, f"a{o}" if o % 4 == d % 4 else None, [f"v{o}"] if o % 3 else None, [] if o == 4 else [f"p{o}"], "n" if o % 2 else None) for d in range(8) for o in range(1 + 4 * d)]
    rows += [(8, 1, None, "x", None, ["r"], None), (8, 1, None, "y", None, ["s"], "n"), (8, 2, 1, None, None, ["t"], None), (None, 1, None, "x", None, ["r"], None), (None, 2, 1, None, None, ["t"], None), (9, None, None, None, None, [], None)]
    nodes = spark.createDataFrame(rows, "doc_id long, obj int, parent int, a string, v array<string>, path array<string>, name string")
    of = lambda g: sorted(repr((r.doc_id, r.obj, r.a, r.v, r.path) if r.rooted else (r.doc_id, r.obj)) for r in g.collect())
    want, most = of(trees.jumped(nodes, ("a", "v"), "path")), trees.MOST
    try:
        counts = set()
        for trees.MOST in (most, 10):
            g = trees.inherited(nodes, ("a", "v"), "path", counted="name")
            assert of(g) == want
            counts.add(repr(sorted((r.doc_id, r.obj, r.n_named, r.n_below) for r in g.where("rooted and doc_id < 8").collect())))
        assert len(counts) == 1
    finally:
        trees.MOST = most


def test_keys_of_stacked_shows_are_made_once(spark):
    """Both sides of the pairs read written keys, so no plan of pairs makes any."""
    streams = spark.createDataFrame([(1, 1, "BT /F 9 Tf 1 0 0 1 5 6 Tm (Abcdefgh) Tj ET BT 1 0 0 1 5 7 Tm (Abcdefgh i) Tj ET BT 1 0 0 1 5 7 Tm (\x7f1234-----------) Tj ET"), (2, 1, "(Abcdefgh) Tj")], "doc_id long, page int, stream string")
    pairs = content.stacked_pairs(content.painted(streams))
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, 1)]
    assert "regexp_replace" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_items_lie_by_order(spark):
    """Lines are numbered over all items, then those without a part go; operators by document shuffle nothing more."""
    import tempfile

    from paperloom.operators import layout, views

    at = tempfile.mkdtemp()
    item = spark.createDataFrame([(1, 1, 9, 1), (1, 2, 5, 1), (1, 2, 6, 1), (2, 1, 5, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    item.withColumns({"l_quantity": F.lit(1.0), "l_extendedprice": F.lit(2.0)}).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(5, "five", 1.0), (6, "six", 1.0), (6, "again", 1.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{at}/part.parquet")
    got = sorted((r.l_orderkey, r.line, r.p_name) for r in views.order_items(spark, at).collect())
    assert got == [(1, 2, "five"), (1, 3, "again"), (1, 3, "six"), (2, 1, "five")]
    plan = layout.visual_bands(layout.columns_of_lines(views.runs(spark, at)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "hashpartitioning(doc_id" not in plan
