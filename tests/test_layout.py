"""Literal cases of the layout operators."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry as g
from paperloom.functions import text as t
from paperloom.operators import joins, layout, numbers, pages, recognition, search, signing

ITEM = "doc_id long, page int, ord int, text string, x double, y double, width double, height double, font string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def grouped(spark, *items):
    rows = [(1, 1, k, s, float(x), float(y), float(w), float(h), f) for k, (s, x, y, w, h, f) in enumerate(items)]
    return [r.text for r in layout.group_text_items(spark.createDataFrame(rows, ITEM)).orderBy("run").collect()]


def test_group_text_items(spark):
    assert grouped(spark, ("Total due", 420, 400, 50, 11, "F2"), ("1,987.00", 490, 400, 44, 11, "F2")) == ["Total due", "1,987.00"]
    assert grouped(spark, ("06-06 Paid To Chk 4220268", 50, 700, 350, 8, "F"), ("500.00", 400, 700, 40, 8, "F"), ("4,972.29", 500, 700, 44, 8, "F")) == ["06-06 Paid To Chk 4220268", "500.00", "4,972.29"]
    assert grouped(spark, ("Valid for", 56, 700, 48, 10, "F"), ("30 days.", 108, 700, 44, 10, "F")) == ["Valid for 30 days."]
    assert grouped(spark, ("2", 490, 400, 8, 11, "F"), (",", 498, 400, 4, 11, "F"), ("500.00", 502, 400, 36, 11, "F")) == ["2,500.00"]
    assert grouped(spark, ("1", 490, 400, 7, 11, "F"), ("987.00", 499, 400, 36, 11, "F")) == ["1,987.00"]


@pytest.mark.parametrize("text,amount,money", [("250.00-", 1, 1), ("250.00 -", 1, 1), ("(250.00)", 1, 1), ("($250.00)", 1, 1), ("$250.00-", 1, 1), ("1,834.34", 1, 1), ("500.00", 1, 1), ("05-22", 0, 0), ("Paid To", 0, 0), ("4220268", 1, 0)])
def test_amounts(spark, text, amount, money):
    assert one(spark, t.looks_like_amount(F.lit(text))) == bool(amount)
    assert one(spark, t.looks_like_money(F.lit(text))) == bool(money)


def test_cluster_columns(spark):
    schema = "doc_id long, page int, line int, ord int, x double, width double, font_size double, text string"
    rows = [(1, 1, 1, 0, 50.0, 80.0, 8.0, "06-06"), (1, 1, 1, 1, 180.0, 90.0, 8.0, "Paid To"), (1, 1, 1, 2, 400.0, 40.0, 8.0, "500.00"), (1, 1, 1, 3, 500.0, 44.0, 8.0, "4,972.29")]
    rows += [(1, 1, 2, 0, 14.0, 380.0, 8.0, "description"), (1, 1, 2, 1, 409.0, 40.0, 8.0, "250.00-"), (1, 1, 2, 2, 517.0, 40.0, 8.0, "1,834.34")]
    df = spark.createDataFrame(rows, schema)
    got = layout.columns_of_lines(df).orderBy("line", "ord").collect()
    assert [r.column for r in got] == [0, 0, 1, 2, 0, 1, 2]
    assert [r.label for r in layout.column_fields(df).where("line = 2").orderBy("column").collect()] == ["Description", "Amount", "Balance"]


@pytest.mark.parametrize("text,want", [("2,500.00", "2,500.00"), ("Total due 1,987.00", "Total due 1,987.00"), ("oak,birch,pine", "oak, birch, pine"), ("EUR €40.00 on 2026-09-14", "EUR €40.00 on 2026-09-14"), ("due before before the timber", "due before the timber"), ("12:30", "12: 30"), ("a  b ,c", "a b, c"), ("x y", "x y"), ("the the THE end", "the end")])
def test_clean_copy(spark, text, want):
    assert one(spark, t.clean_copy(F.lit(text))) == want


def lines(spark, *texts):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "doc_id long, seq int, text string")


def test_check_numbers(spark):
    got = numbers.check_numbers(lines(spark, "3 x 12 = 35 for the worktop run", "2 + 2 = 4", "9 / 0 = 3")).collect()
    assert [(r.kind, r.actual, r.claimed) for r in got] == [("arithmetic", 36.0, 35.0)]
    rows = ["a 1 35", "b 2 888.00", "c 3 258.00", "d 4 992.00", "e 5 84.00", "Total due 1,987.00"]
    got = numbers.totals(lines(spark, *rows)).collect()
    assert [(r.n, r.actual, r.claimed, r.severity) for r in got] == [(5, 2257.0, 1987.0, "error")]
    # Prose stops the reading after two amounts; a total closes its island.
    assert numbers.totals(lines(spark, "x 1 500.00", "prose", "a 1 10.00", "b 1 20.00", "Subtotal 30.00", "Total 99.00")).count() == 0
    assert numbers.totals(lines(spark, "x 1 500.00", "prose", "a 1 10.00", "b 1 20.00", "Total 31.00")).first().actual == 30.0


@pytest.mark.parametrize("spec,want", [("1-3, 7", [1, 2, 3, 7]), ("2,2,1", [2, 1]), ("1 - 3", None), ("", None), ("0", None), ("9-11", None), ("3-1", None)])
def test_page_ranges(spark, spec, want):
    assert one(spark, t.page_ranges(F.lit(spec), F.lit(10))) == want


def test_align(spark):
    schema = "doc_id long, page int, line int, ord int, x double, width double"
    df = spark.createDataFrame([(1, 1, 1, k, float(x), float(w)) for k, (x, w) in enumerate([(50, 60), (400, 40), (500, 50)])], schema)
    assert [r.new_x for r in layout.align(df, "right").orderBy("ord").collect()] == [490.0, 510.0, 500.0]
    df = spark.createDataFrame([(1, 1, 1, k, float(x), 20.0) for k, x in enumerate([50, 120, 200])], schema)
    assert [r.new_x for r in layout.align(df, "left").collect()] == [50.0] * 3
    assert {r.new_x for r in layout.align(df, "center").collect()} == {125.0}
    assert [r.new_x for r in layout.align(df, "justify").orderBy("ord").collect()] == [50.0, 125.0, 200.0]


def test_quad(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(80, 90), (10, 12), (12, 88), (84, 8)]])
    assert [p.x for p in one(spark, g.ordered_quad(pts))] == [10.0, 84.0, 80.0, 12.0]
    sq = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (100, 0), (100, 200), (0, 200)]])
    assert one(spark, g.quad_area(sq)) == 20000.0 and one(spark, g.rectangularity(sq)) > 0.95


@pytest.mark.parametrize("args,want", [((8, 1, 8, 1.0, 0.0), "ok"), ((120, 2, 40, 0.1, 0.05), "ok"), ((40, 1, 12, 0.0, 0.8), "ok"), ((0, 1, 0, 1.0, 0.0), "image-only"), ((0, 0, 0, 1.0, 0.0), "no-operators"), ((3, 1, 2, 0.0, 0.0), "ocr-ghost")])
def test_classify(spark, args, want):
    assert one(spark, recognition.classify_page(*map(F.lit, args))) == want


def test_ocr_words(spark):
    schema = "doc_id long, page int, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
    word = lambda p, k, s, a, b, c=95.0: (1, p, k, s, c, float(a), 10.0, float(b), 20.0)
    df = spark.createDataFrame([word(1, 0, "Total due", 20, 90), word(1, 1, "1,987.00", 200, 260), word(2, 0, "Paid", 10, 40), word(2, 1, "To", 44, 60), word(2, 2, "PayPal", 64, 110, 40.0)], schema)
    got = recognition.group_words(df).orderBy("page", "x0").collect()
    assert [r.text for r in got] == ["Total due", "1,987.00", "Paid To PayPal"]
    gate = {r.page: r.blocked for r in recognition.verify_gate(df, df.where("page = 1").select("doc_id", "page", "ord")).collect()}
    assert gate == {1: False, 2: True}


def test_boxes(spark):
    cols = "doc_id long, page int, ord int, x double, y double, width double, height double"
    a = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 100.0), (1, 1, 1, 50.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.0, 0.0, 5.0, 5.0)], cols)
    b = spark.createDataFrame([(1, 1, 7, 5.0, 90.0, 10.0, 60.0), (1, 1, 8, 10.0, 0.0, 5.0, 5.0)], cols)
    assert [(r.ord, r.b_ord) for r in joins.overlapping(a, joins.renamed(b)).collect()] == [(0, 7)]
    assert {(r.ord, r.b_ord) for r in joins.overlapping(a, joins.renamed(b), 0.5).collect()} == {(0, 7), (0, 8)}
    assert {(r.page, r.ord) for r in joins.kept_after_erase(a, b, key=("doc_id", "page", "ord")).collect()} == {(1, 1), (2, 0)}


def test_pages(spark):
    p = spark.createDataFrame([(1, k, 10 + k, 0) for k in (1, 2, 3)] + [(2, 1, 20, 90)], "doc_id long, pos int, page_id long, rotation int")
    assert [r.pos for r in p.where("doc_id = 1").select(pages.move(F.col("pos"), F.lit(3), F.lit(1)).alias("pos")).collect()] == [2, 3, 1]
    none = pages.delete(p, p.where("doc_id = 2 or pos = 2"))
    assert sorted((r.doc_id, r.pos, r.page_id) for r in none.collect()) == [(1, 1, 11), (1, 2, 13), (2, 1, 20)]
    bad = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 1)], "doc_id long, pos int, new_pos int")
    assert [r.doc_id for r in pages.reorder(p, bad).collect()] == [2]


def test_signing(spark):
    rows = [(1, 1, 0, 1, True, True), (1, 1, 0, 2, False, False), (1, 2, 1, 3, True, False), (1, 3, 2, 4, True, True), (1, 4, 1, 5, False, False)]
    f = spark.createDataFrame(rows, "packet int, signer int, stage int, field int, required boolean, filled boolean").withColumn("ts", F.current_timestamp())
    got = {r.signer: (r.complete, r.unlocked) for r in signing.signer_status(f).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (True, True)}
    assert signing.next_signer(f).first().signer == 2


def test_search(spark):
    assert one(spark, search.occurrences(F.lit("aXbXXc"), F.lit("X"))) == [1, 3, 4]
    assert one(spark, search.occurrences(F.lit("aaaa a.a"), F.lit("aa"))) == [0, 2]
    assert one(spark, search.occurrences(F.lit("a.b"), F.lit("."))) == [1]
    hits = search.find_lines(lines(spark, "see FIRST  LAST here", "firstlast", "first"), spark.createDataFrame([(1, " first last "), (2, "  ")], "query_id int, query string"))
    assert [(r.seq, r.start, r.end) for r in hits.collect()] == [(0, 4, 14)]


def test_phrases_are_found_beside_marks_and_letters(spark):
    texts = lines(spark, "(first last)", "the secret, told", "\U0001f600SECRET", "\"longestword of all\"", "xlongestword of allx", "first, last", "longestword often all")
    queries = spark.createDataFrame([(1, "first last"), (2, "secret"), (3, "longestword of all"), (4, "of")], "query_id int, query string")
    plain = [r.text.lower() for r in texts.orderBy("seq").collect()]
    want = {(q, k, t.index(n)) for q, n in ((1, "first last"), (2, "secret"), (3, "longestword of all"), (4, "of")) for k, t in enumerate(plain) if n in t}
    got = search.find_lines(texts, queries).select("query_id", "seq", "start").collect()
    low = min(r.seq for r in texts.collect())
    assert len(got) == len(want) == 8 and {(r.query_id, r.seq - low, r.start) for r in got} == want


def test_otsu(spark):
    h = spark.createDataFrame([("a", 10, 50), ("a", 12, 50), ("a", 200, 40), ("a", 210, 40)], "image_id string, level int, n long")
    assert recognition.otsu(h).first().threshold == 12


def page_items(spark, *items):
    rows = [(1, 1, k, s, float(x), 700.0 - 20 * row, float(w), 10.0, eol) for k, (s, x, row, w, eol) in enumerate(items)]
    return spark.createDataFrame(rows, "doc_id long, page int, ord int, text string, x double, y double, width double, height double, has_eol boolean")


@pytest.mark.parametrize("items,query,want", [
    ([("SE", 40, 0, 24, False), ("CRET", 64, 0, 48, False)], "SECRET", [("SECRET", 1)]),
    ([("SECRET", 40, 0, 60, False)], "   ", []),
    ([("😀SECRET", 40, 0, 70, False)], "secret", [("SECRET", 1)]),
    ([("Aİ SECRET", 40, 0, 70, False)], "secret", [("SECRET", 1)]),
    ([("Social Security", 40, 0, 90, True), ("Number 123", 40, 1, 60, False)], "Security Number", [("Security\nNumber", 2)]),
    ([("FIRST  LAST", 40, 0, 70, False)], "first last", [("FIRST  LAST", 1)]),
    ([("foo bar", 40, 0, 50, False)], "foobar", []),
])
def test_glyph_search(spark, items, query, want):
    from paperloom.operators import glyphs

    hits = glyphs.find_hits(page_items(spark, *items), query).collect()
    assert [(h.matched, len(h.rects)) for h in hits] == want


def test_erased_glyphs_are_gone_and_others_stay(spark):
    from paperloom.operators import glyphs

    items = page_items(spark, ("KEEP this", 40, 0, 60, True), ("the SECRET part", 40, 3, 100, True), ("VISIBLE", 40, 6, 50, False))
    marks = glyphs.erase_marks(glyphs.find_hits(items, "secret"))
    kept = [r.kept for r in glyphs.kept_text(items, marks).orderBy("ord").collect()]
    assert kept[0] == "KEEP this" and kept[2] == "VISIBLE" and "SECRET" not in kept[1] and kept[1].startswith("th") and kept[1].endswith("art")


def test_drafts(spark):
    from paperloom.operators import drafts

    runs = spark.createDataFrame([(1, 1, 0, "Paid To"), (1, 1, 1, "PayPal"), (1, 1, 2, "now")], "doc_id long, line int, ord int, text string")
    draft = lambda t_: spark.createDataFrame([(1, 1, t_)], "doc_id long, line int, draft string")
    got = lambda t_: [r.draft for r in drafts.split_across_runs(runs, draft(t_)).orderBy("ord").collect()]
    assert got("Sent By Visa right away") == ["Sent By", "Visa", "right away"] and got("One") == ["One", "", ""] and got(" ") == ["", "", ""]
    assert one(spark, drafts.wrapped(F.lit("aaa bbb ccc"), 10.0, 35.0)) == ["aaa bbb", "ccc"] and one(spark, drafts.wrapped(F.lit("  "), 10.0, 35.0)) == []
    text = lambda w: drafts.shortened(spark.createDataFrame([("please note that the very long title is just here",)], "t string"), "t", 10.0, w).first().t
    assert text(1000.0) == "please note that the very long title is just here" and text(160.0) == "the very long title is just here" and text(60.0).endswith("…")
    shown = spark.createDataFrame([(1, 1, "POS"), (1, 1, "DEBIT"), (1, 1, "Total  due")], "doc_id long, page int, text string")
    seen = spark.createDataFrame([(1, 1, "POS DEBIT 6205"), (1, 1, "Total due")], "doc_id long, page int, text string")
    assert drafts.match_lines(seen, shown).first().ratio == 0.5
