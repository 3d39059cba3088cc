"""Literal cases of objects, streams and edits: inherited attributes, fields, resources, rewritten tokens, shows found and dropped."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import gates, text as t
from paperloom.operators import edits, forms, lines, members, resources, search, trees
from paperloom.sources import content, rewriting
from paperloom.streaming import lines as stream


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# Streams: tokens.
def toks(spark, text):
    return [(r.kind, r.raw, r.str, r.num) for r in content.tokens(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, stream string")).orderBy("ord").collect()]


def test_codes_are_read_in_one_pass(spark):
    assert toks(spark, r"(\134101\101) /F#2341#41 (\x\050) (a\
b\8\7)") == [("string", r"(\134101\101)", r"\101A", None), ("name", "/F#2341#41", "F#41A", None), ("string", r"(\x\050)", "x(", None), ("string", "(a\\\nb\\8\\7)", "ab8\x07", None)]
    assert [x[2] for x in toks(spark, "<4 1\n5>")] == ["AP"]


def test_numbers_and_pictures(spark):
    assert [(k, n) for k, _, _, n in toks(spark, "1e3 -.5E-1 +4. 7a .")] == [("num", 1000.0), ("num", -0.05), ("num", 4.0), ("op", None), ("op", None)]
    assert [(k, r) for k, r, _, _ in toks(spark, "q BI /W 1 ID aEIb EI Q BIG")] == [("op", "q"), ("inline-image", "BI /W 1 ID aEIb EI"), ("op", "Q"), ("op", "BIG")]


def test_long_strings_and_words(spark):
    long = "x" * 100_000 + r"\)" * 100_000
    got = toks(spark, f"({long}) Tj ({'(a)' * 50_000}) Tj")
    assert [g[0] for g in got] == ["string", "op", "string", "op"] and len(got[0][2]) == 200_000 and got[2][2] == "(a)" * 50_000
    words = spark.createDataFrame([("ha " * 100_000 + "end.",), ("It was was The the end",)], "text string")
    assert [r.v for r in words.select(t.clean_copy(F.col("text")).alias("v")).collect()] == ["ha end.", "It was The end"]


# Streams: rewriting.
STREAM = "BT /F1 9 Tf 1 0 0 1 10 20 Tm (one) Tj ET q 2 0 0 2 5 5 cm BT /F1 9 Tf 30 40 Td (two) Tj (tail) Tj ET Q BT 7 8 Td <6162> Tj ET"


def changed(spark, *changes):
    streams = spark.createDataFrame([(1, 1, STREAM)], "doc_id long, page int, stream string")
    tokens = content.tokens(streams)
    shows = content.painted(streams).where("kind = 'show'")
    at = {r.text: r.ord for r in shows.collect()}
    rows = [(1, 1, at[c[0]], *c[1:]) for c in changes]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, action string, text string, codes string, to_x double, to_y double")
    new = rewriting.joined(rewriting.patched(tokens, content.operators(tokens), shows, df))
    return new.first().stream, [(r.text, round(r.x, 3), round(r.y, 3)) for r in content.painted(new).where("kind = 'show'").orderBy("ord").collect()]


def test_rewritten_streams(spark):
    whole, shown = changed(spark, ("one", "text", "a(b)\\é", None, None, None), ("two", "remove", None, None, None, None), ("ab", "codes", None, "4344", None, None))
    assert shown == [("a(b)\\é", 10.0, 20.0), ("tail", 65.0, 85.0), ("CD", 7.0, 8.0)] and r"(a\(b\)\\\351) Tj" in whole and "<4344> Tj" in whole


def test_moved_shows(spark):
    # Its own Tm is changed, a Td that a later show relies on stays and a Tm is put in, a Td of its own becomes a Tm.
    whole, shown = changed(spark, ("one", "keep", None, None, 11.5, 21.25), ("two", "keep", None, None, 100.0, None), ("ab", "text", "c", None, None, 9.0))
    assert shown == [("one", 11.5, 21.25), ("two", 100.0, 85.0), ("tail", 100.0, 85.0), ("c", 7.0, 9.0)]
    assert "1 0 0 1 11.5 21.25 Tm (one)" in whole and "30 40 Td 1 0 0 1 47.5 40 Tm (two)" in whole and "7 8 Td" not in whole
    assert changed(spark, ("one", "keep", None, None, 10.0, 20.0))[0] == " ".join(r[1] for r in toks(spark, STREAM))


def test_reused_codes(spark):
    shows = [(1, 1, 1, "F", "abc", b"\x01\x02\x03"), (1, 1, 2, "F", "ad", b"\x09\x04"), (1, 1, 3, "F", "xy", b"\x00\x01\x00\x02"), (1, 1, 4, "G", "abc", b"\x07\x08"), (2, 1, 1, "F", "z", b"\x05")]
    df = spark.createDataFrame(shows, "doc_id long, page int, ord int, font string, text string, bytes binary")
    drafts = spark.createDataFrame([(1, 1, 1, "da c"), (1, 1, 2, "az"), (1, 1, 3, "y x"), (1, 1, 4, "a"), (2, 1, 1, "")], "doc_id long, page int, ord int, draft string")
    got = lambda **by: {(r.doc_id, r.ord): r.codes for r in rewriting.reused_codes(df, drafts, **by).collect()}
    assert got() == {(1, 1): "04092003", (1, 2): None, (1, 3): "000200200001", (1, 4): None, (2, 1): ""}
    assert got(by=("doc_id", "page", "ord")) == {(1, 1): None, (1, 2): None, (1, 3): "000200200001", (1, 4): None, (2, 1): ""}


# Trees, forms, resources.
def test_inherited(spark):
    rows = [(1, 0, None, "r", 5), (1, 1, 0, "a", None), (1, 2, 1, "b", 7), (1, 3, 2, "c", None), (1, 8, 9, "x", None), (1, 9, 8, "y", 1), (1, 4, 77, "lost", None), (2, 3, None, "other", None)]
    rows += [(3, k, k - 1 if k else None, f"n{k}", 3 if k == 0 else None) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, obj int, parent int, name string, v int").withColumn("path", F.array("name"))
    got = {(r.doc_id, r.obj): (r.v, ".".join(r.path), r.rooted) for r in trees.inherited(df, ("v",), "path").collect()}
    assert got[1, 3] == (7, "r.a.b.c", True) and got[1, 1] == (5, "r.a", True) and got[1, 4] == (None, "lost", True) and got[2, 3] == (None, "other", True)
    assert not got[1, 8][2] and not got[1, 9][2] and got[3, 69] == (3, ".".join(f"n{k}" for k in range(70)), True)
    assert trees.inherited(df.limit(0), ("v",), "path").count() == 0


NODE = "doc_id long, obj int, parent int, name string, type string, flags int, value array<string>, options array<string>, export string, page_obj int, actions boolean, x double, y double, width double, height double"


def test_form_fields(spark):
    box = (1.0, 2.0, 3.0, 4.0)
    rows = [
        (1, 1, None, "who", "Tx", 1, ["Ann"], None, None, 11, False, *box), (1, 2, None, "ok", "Btn", 0, ["Yes"], None, None, None, False, *box), (1, 3, 2, None, None, None, None, None, "Yes", None, True, *box),
        (1, 4, None, "pick", "Btn", forms.RADIO, ["0"], ["left", "right"], None, None, False, *box), (1, 5, 4, None, None, None, None, None, "0", 12, False, *box), (1, 6, 4, None, None, None, None, None, "1", 99, False, *box),
        (1, 7, None, "push", "Btn", forms.PUSH, None, None, None, None, False, *box), (1, 8, None, "odd", None, None, None, None, None, None, False, *box), (1, 9, None, "group", None, forms.REQUIRED, None, None, None, None, False, *box), (1, 10, 9, "in", "Ch", None, None, ["a"], None, None, False, *box),
    ]
    pages, listed = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "doc_id long, page int, obj int"), spark.createDataFrame([(1, 2, 3)], "doc_id long, page int, obj int")
    found = forms.fields(spark.createDataFrame(rows, NODE), listed, pages)
    got = {r.name: r for r in found.collect()}
    assert set(got) == {"who", "ok", "pick", "push", "group.in"}
    assert (got["who"].kind, got["who"].value, got["who"].fillable, got["who"].widgets[0].page) == ("text", "Ann", False, 1)
    assert (got["ok"].checked, got["ok"].value, got["ok"].has_actions, got["ok"].widgets[0].page) == (True, "Yes", True, 2)
    assert (got["pick"].value, got["pick"].options, [w.page for w in got["pick"].widgets]) == ("left", ["left", "right"], [2, 1])
    assert (got["push"].kind, got["push"].fillable) == ("button", False) and (got["group.in"].kind, got["group.in"].required, got["group.in"].value) == ("optionList", True, "")
    documents = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True)], "doc_id long, has_form boolean, dynamic boolean")
    told = {r.doc_id: (r.field_count, r.fillable_count, r.has_actions, r.warnings) for r in forms.report(documents, found).collect()}
    assert told == {1: (5, 3, True, ["dynamic form", "field scripts"]), 2: (0, 0, False, ["dynamic form", "nothing to fill"]), 3: (0, 0, False, [])}
    assert {r.name: r["values"] for r in forms.seeds(found).collect()} == {"who": ["Ann"], "ok": ["true"], "pick": ["left"], "push": [""], "group.in": []}


def test_page_resources(spark):
    tree = spark.createDataFrame([(1, 1, None, None, 10), (1, 2, 1, 1, None), (1, 3, 1, 2, 20), (1, 4, 5, 3, None), (1, 5, 4, None, None)], "doc_id long, obj int, parent int, page int, resources int")
    entries = spark.createDataFrame([(1, 10, "Font", "A", 0, 100), (1, 10, "XObject", "X", 1, 200), (1, 20, "Font", "A", 0, 101), (1, 30, "Font", "A", 0, 102), (1, 30, "XObject", "Y", 1, 201), (1, 31, "Font", "B", 0, 100), (1, 31, "XObject", "X", 1, 200)], "doc_id long, resources int, category string, key string, pos int, target int")
    xobjects = spark.createDataFrame([(1, 200, "Form", 30, "x"), (1, 201, "Form", 31, "y")], "doc_id long, obj int, subtype string, resources int, stream string")
    fonts = spark.createDataFrame([(1, 100, "Helvetica", "Type1", "WinAnsiEncoding"), (1, 101, "ABCDEF+X", "TrueType", ""), (1, 102, "CID", "Type0", "Identity-H")], "doc_id long, obj int, base_font string, subtype string, encoding string")
    shallow, deep = resources.reached(tree, entries, xobjects), resources.reached(tree, entries, xobjects, None)
    faces = lambda r: {(x.page, x.key): (x.base_font, x.subset, x.standard, x.cid) for x in resources.page_fonts(r, entries, fonts).collect()}
    assert faces(shallow) == {(1, "A"): ("CID", False, False, True), (2, "A"): ("ABCDEF+X", True, False, False)}
    assert faces(deep) == {**faces(shallow), (1, "B"): ("Helvetica", False, True, False)}
    contents = spark.createDataFrame([(1, 1, 1, 51, "b"), (1, 1, 0, 50, "a"), (1, 2, 0, 52, None)], "doc_id long, page int, pos int, obj int, stream string")
    assert [(r.nth, r.kind, r.stream) for r in resources.page_streams(deep, contents).orderBy("page", "nth").collect()] == [(0, "page", "a"), (1, "page", "b"), (2, "form", "x"), (3, "form", "y")]


# Edits: shows found.
SHOW = "doc_id long, page int, stream int, ord int, text string, x double, y double, font_size double"
PATCH = "doc_id long, page int, patch_id int, x double, y double, width double, height double, font_size double, original string, raw_text string, text string"


def shows_of(spark, *rows):
    return spark.createDataFrame([(1, 1, s, k, text, float(x), float(y), 10.0) for k, (s, text, x, y) in enumerate(rows)], SHOW)


def patch(spark, original, x, y, width=20.0, text="new", raw=None, boxes=None):
    df = spark.createDataFrame([(1, 1, 1, float(x), float(y), float(width), 10.0, 10.0, original, raw, text)], PATCH)
    kind = "array<struct<x:double,y:double,width:double,height:double>>"
    return df.withColumn("boxes", F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "width", "height"), b)]) for b in boxes]).cast(kind)) if boxes else df


def found(shows, p):
    r = edits.find_shows(shows, p).first()
    return r and (r.found, [m.ord for m in r.members], round(r.score, 2))


def test_shows_by_text(spark):
    s = shows_of(spark, (1, "Widget", 50, 700), (1, "Total due", 50, 680), (1, "2,500.00", 200, 680), (1, "see Widget here", 50, 660), (1, "Debit - Debit", 50, 640), (1, "12", 50, 620), (1, "34", 60, 620))
    assert found(s, patch(spark, "Widget", 50, 700)) == ("text", [0], 1000.0)
    assert found(s, patch(spark, "2 500.00", 200, 680)) == ("text", [2], 860.0)
    assert found(s, patch(spark, "Debit-Debit", 50, 640)) == ("text", [4], 840.0)
    assert found(s, patch(spark, "dget her", 50, 660)) == ("text", [3], 739.65)  # one show holds it
    assert found(s, patch(spark, "1234", 50, 620)) == ("text", [5, 6], 1000.0)  # end to end
    assert found(s, patch(spark, "Total due 2,500.00", 50, 680, 300)) == ("text", [1, 2], 1000.0)
    assert found(s, patch(spark, "nowhere", 300, 100)) is None


def test_shows_by_box_and_place(spark):
    s = shows_of(spark, (1, "alpha", 50, 700), (1, "beta", 90, 700), (2, "gamma", 50, 500), (1, "1,234.00", 300, 400))
    assert found(s, patch(spark, "lost words", 50, 700, 60)) == ("box", [0, 1], 522.0)  # both are covered, and beta begins no column of its own
    kind, ords, _ = found(s, patch(spark, "lost", 50, 500, 30))
    assert (kind, ords) == ("box", [2])
    assert found(s, patch(spark, "9,999.99", 260, 412, 10, raw="1 234.00")) == ("text", [3], round(860 - (40**2 + 12**2) ** 0.5, 2))
    near = shows_of(spark, (1, "1,234.00", 300, 400))
    assert found(near, patch(spark, "", 260, 409, 10, raw="")) is None


def test_expansion_and_clipping(spark):
    s = shows_of(spark, (1, "Fee", 50, 700), (1, "250.00", 300, 700), (1, "note", 420, 700), (2, "9.99", 300, 700), (2, "250.00", 302, 700), (2, "apart", 50, 300))
    p = patch(spark, "Fee 250.00 more", 50, 700, 400, raw="Fee")
    kind, ords, _ = found(s, p)
    assert (kind, ords) == ("text", [0, 1])  # the amount is part of the original, the note isn't
    f = edits.find_shows(s, p)
    assert [(r.stream, r.ord) for r in edits.covered_elsewhere(s, f, p).collect()] == [(2, 4)]
    several = patch(spark, "Fee", 50, 700, 20, boxes=[(50, 700, 20, 10), (300, 700, 40, 10)])
    assert found(s, several)[1] == [0]  # a box covers the amount, but it begins a column that the original doesn't have
    assert {r.ord for r in edits.covered_elsewhere(s, edits.find_shows(s, several), several).collect()} == set()
    close = shows_of(spark, (1, "Fee", 50, 700), (2, "Fi", 66, 700))
    both = patch(spark, "Fee", 50, 700, 20, boxes=[(50, 700, 20, 10), (66, 700, 20, 10)])
    assert [r.ord for r in edits.covered_elsewhere(close, edits.find_shows(close, both), both).collect()] == [1]


def test_a_blocked_patch_holds_back_its_document(spark):
    s = shows_of(spark, (1, "one", 50, 700), (1, "two", 50, 650))
    p = patch(spark, "one", 50, 700).union(patch(spark, "missing", 400, 100).withColumn("patch_id", F.lit(2)))
    planned = edits.plan(edits.inspect(s, p, s.limit(0)))
    assert {r.patch_id: (r.method, r.reason, r.applied) for r in planned.collect()} == {1: ("redraw-standard", "", False), 2: ("blocked", "not found", False)}
    assert sorted(r.text for r in edits.apply_plan(s, planned).collect()) == ["one", "two"]
    alone = edits.plan(edits.inspect(s, patch(spark, "one", 50, 700, text="noon"), s.limit(0)))
    assert [(r.method, r.text) for r in alone.collect()] == [("in-place", "noon")] and sorted(r.text for r in edits.apply_plan(s, alone).collect()) == ["noon", "two"]


# Search.
def test_hits_over_line_ends(spark):
    pages = spark.createDataFrame([(1, 1, "A Social\n  Security\tNumber stands here"), (1, 2, "social security numbers"), (2, 1, "Social"), (2, 2, "aa aa aa")], "doc_id long, page int, text string")
    queries = spark.createDataFrame([(1, "social security number"), (2, "curity num"), (3, "cia"), (4, "aa aa"), (5, "a"), (6, "x"), (7, " "), (8, "Social")], "query_id int, query string")
    got = {(r.query_id, r.doc_id, r.page, r.start) for r in search.find_pages(pages, queries).collect()}
    plain = {(r.doc_id, r.page): " ".join(r.text.lower().split()) for r in pages.collect()}
    want = set()
    for q, needle in ((1, "social security number"), (2, "curity num"), (3, "cia"), (4, "aa aa"), (5, "a"), (6, "x"), (8, "social")):
        for (d, p), text in plain.items():
            at = text.find(needle)
            while at >= 0:
                want.add((q, d, p, at))
                at = text.find(needle, at + len(needle))
    assert got == want
    plan = search.find_pages(pages, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# Members.
def test_split_by_shows(spark):
    line = "doc_id long, page int, line int, text string, x double, y double, width double, height double, font_size double"
    lines_ = spark.createDataFrame([(1, 1, 1, "Paid To 500.00 4,972.29", 50.0, 700.0, 500.0, 12.0, 10.0), (1, 1, 2, "alone", 50.0, 600.0, 40.0, 12.0, 10.0), (1, 1, 3, "bare", 900.0, 10.0, 20.0, 12.0, 10.0)], line)
    s = shows_of(spark, (1, "Paid", 50, 701), (1, "To", 75, 701), (1, "500.00", 300, 701), (1, "4,972.29", 450, 701), (1, "alone", 50, 603))
    got = [(r.line, r.column, r.text, r.origin_y) for r in members.split_by_shows(lines_, s).orderBy("line", "column").collect()]
    assert got == [(1, 0, "Paid To", 701.0), (1, 1, "500.00", 701.0), (1, 2, "4,972.29", 701.0), (2, 0, "alone", 603.0), (3, 0, "bare", 10.0)]


def test_raw_text_of_members(spark):
    case = lambda own, patch, needle: one(spark, members.raw_text_of(F.lit(own), F.lit(patch), F.lit(needle)))
    assert case("x", "y", "z") == "x" and case(None, "Fee 250.00", "Fee") is None and case(None, " Fee ", "Fee") == "Fee" and case(None, "a-b", "a - b") == "a-b" and case(None, None, "a") is None and case(None, "a", "") is None


# What the catalogue compares with SQL alone: lines, pictures and gates.
def test_lines_and_gates(spark):
    r = spark.createDataFrame([(1, 1, 1, 0, "Total", 10.0, 700.0, 25.0, 10.0, 10.0), (1, 1, 1, 1, "due:", 37.0, 700.0, 20.0, 10.0, 10.0), (1, 1, 1, 2, ", then", 57.5, 700.0, 30.0, 10.0, 10.0), (1, 1, 2, 0, "next", 10.0, 680.0, 20.0, 10.0, 10.0), (1, 1, 2, 1, " ", 31.0, 680.0, 2.0, 10.0, 10.0)], "doc_id long, page int, line int, ord int, text string, x double, y double, width double, height double, font_size double")
    got = {x.line: (x.text, x.n_runs, x.x) for x in lines.join_runs(r, ("doc_id", "page", "line")).collect()}
    assert got == {1: ("Total due:, then", 3, 10.0), 2: ("next", 1, 10.0)}
    assert one(spark, gates.paints(F.lit(3), F.lit(True))) is False and one(spark, gates.paints(F.lit(3), F.lit(False))) is True and one(spark, gates.paints(F.lit(0), F.lit(True))) is True
    assert one(spark, gates.is_object_name(F.lit("Im1"))) and not one(spark, gates.is_object_name(F.lit("img_p0_1"))) and not one(spark, gates.is_object_name(F.lit("inline-3")))
    assert one(spark, gates.image_type(F.unhex(F.lit("FFD8FF")))) == "image/jpeg" and one(spark, gates.image_type(F.unhex(F.lit("8950")))) == "image/png"
    assert one(spark, gates.warnings(F.lit(True), F.lit(False), F.lit(True), F.lit(0))) == ["dynamic form", "signature fields", "nothing to fill"]


def test_totals_of_a_step():
    import pandas as pd

    rows = pd.DataFrame({"seq": [3, 4, 5, 6, 7], "total": [False, True, False, False, True], "n": [2, 1, 2, 1, 1], "last": [5.0, 9.0, 4.0, None, 4.0]})
    out, n, total = stream._totals(rows, 1, 2.0)
    assert out.to_dict("records") == [{"seq": 4, "n": 2, "actual": 7.0, "claimed": 9.0}] and (n, total) == (0, 0.0)
    assert stream._totals(rows.iloc[:1], 1, 2.0)[1:] == (2, 7.0)


@pytest.mark.parametrize("mode,within,shown", [(0, True, 1), (3, True, 0), (3, False, 1)])
def test_painted_modes(spark, mode, within, shown):
    text = f"q BT {mode} Tr (a) Tj ET Q" if within else f"q {mode} Tr BT (a) Tj ET Q"
    p = content.painted(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, stream string")).where("kind = 'show'")
    assert p.where(content.visible(p)).count() == shown



def test_tables_of_objects_are_not_broadcast(spark):
    """Files of repeated values are small and their rows are not, so the join must not go by their size."""
    nodes = spark.createDataFrame([(1, 1, None, "who", "Tx", 1, ["Ann"], None, None, 11, False, 1.0, 2.0, 3.0, 4.0)], NODE)
    listed, pages = spark.createDataFrame([(1, 1, 1)], "doc_id long, page int, obj int"), spark.createDataFrame([(1, 1, 11)], "doc_id long, page int, obj int")
    tree = spark.createDataFrame([(1, 1, None, None, 1), (1, 2, 1, 1, None)], "doc_id long, obj int, parent int, page int, resources int")
    entries = spark.createDataFrame([(1, 1, "Font", "F1", 0, 5)], "doc_id long, resources int, category string, key string, pos int, target int")
    xobjects = spark.createDataFrame([], "doc_id long, obj int, subtype string, resources int, stream string")
    faces = spark.createDataFrame([(1, 5, "Courier", "Type1", "")], "doc_id long, obj int, base_font string, subtype string, encoding string")
    found = resources.page_fonts(resources.reached(tree, entries, xobjects), entries, faces)
    fields = forms.fields(nodes, listed, pages)
    assert [(r.page, r.key, r.base_font) for r in found.collect()] == [(1, "F1", "Courier")] and [r.name for r in fields.collect()] == ["who"]
    for df in (found, fields, forms.report(pages.selectExpr("doc_id", "true as has_form", "false as dynamic"), fields)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_circles_end_the_climb(spark, monkeypatch):
    """Nodes in a circle don't keep the others' rounds going: a few rounds, whatever the number of nodes."""
    rows = [(1, k, 0 if k else None, k) for k in range(500)] + [(1, 1001, 1002, None), (1, 1002, 1001, None)]
    written = []
    monkeypatch.setattr(trees, "cut", lambda df: written.append(df) or df.localCheckpoint())
    got = {r.obj: r.rooted for r in trees.inherited(spark.createDataFrame(rows, "doc_id long, obj int, parent int, v int"), ("v",)).collect()}
    assert not got[1001] and not got[1002] and sum(got.values()) == 500 and len(written) <= 4
