"""Members of lines: a fat line split by what its stream shows, drafts dealt onto columns and on to runs, patches of members, and the
runs that a selection means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import let, looks_like_amount, looks_like_money, normalize, soft_match_key
from paperloom.operators.drafts import across_columns, across_runs
from paperloom.operators.edits import show_width
from paperloom.operators.layout import _new_column, columns_of_lines, visual_bands
from paperloom.session import cut
from paperloom.session import dealt as dealt_out

LINE = ("doc_id", "page", "line")
#: Height of the bands in which lines look for shows, in points.
BAND = 24


def _nearest(lines: DataFrame, shows: DataFrame) -> DataFrame:
    """doc_id, page, line, stream_y: the baseline of the show nearest to each line among those that share a fifth of its width. Lines
    meet shows in bands of height; only those without one within a band's height look through the whole page, so a page isn't
    compared line by show."""
    s = shows.select("doc_id", "page", F.col("ord").alias("s_ord"), F.col("x").alias("s_x"), F.col("y").alias("s_y"), show_width(F.col("text"), F.col("font_size")).alias("s_w"))
    b = lines.select(*LINE, "x", "y", "width")
    shared = F.least(F.col("s_x") + F.col("s_w"), F.col("x") + F.col("width")) - F.greatest("s_x", "x")
    meets = shared > F.least("s_w", "width") * 0.2
    best = F.min_by("s_y", F.struct(F.abs(F.col("s_y") - F.col("y")), "s_ord"))
    band = F.floor(F.col("y") / BAND)
    around = b.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    near = around.join(dealt_out(s.withColumn("band", F.floor(F.col("s_y") / BAND))), ["doc_id", "page", "band"]).where(meets & (F.abs(F.col("s_y") - F.col("y")) <= BAND))
    near = cut(near.groupBy(*LINE).agg(best.alias("stream_y")))
    far = b.join(dealt_out(near.select(*LINE)), [*LINE], "left_anti").join(dealt_out(s), ["doc_id", "page"]).where(meets).groupBy(*LINE).agg(best.alias("stream_y"))
    return near.unionByName(far)


def split_by_shows(lines: DataFrame, shows: DataFrame) -> DataFrame:
    """lines(doc_id, page, line, text, x, y, width, height, font_size) of one run each, and shows(doc_id, page, ord, text, x, y,
    font_size) -> doc_id, page, line, column, text, x, y, width, height, font_size, n_columns, origin_y: a line whose stream shows
    several columns at its place becomes their texts, any other stays itself. The place is the nearest shown baseline; a
    column begins where a show doesn't go on from the one before it. What several joins read is written first, and no side of a
    join is sent whole, so neither plans nor tables grow in the driver."""
    lines, shows = cut(lines), cut(shows)
    d = lines.join(dealt_out(_nearest(lines, shows)), [*LINE], "left")
    reach = F.greatest(F.lit(3.0), F.col("font_size") * 0.5)
    first, last = F.floor((F.col("stream_y") - reach) / BAND), F.floor((F.col("stream_y") + reach) / BAND)
    at = d.where("stream_y is not null").select(*LINE, "x", "width", "font_size", "stream_y", F.explode(F.sequence(first, last)).alias("band"))
    s = shows.select("doc_id", "page", F.col("ord"), F.col("text"), F.col("x").alias("s_x"), F.col("y").alias("s_y"), F.col("font_size").alias("s_size"), show_width(F.col("text"), F.col("font_size")).alias("s_w"), F.floor(F.col("y") / BAND).alias("band"))
    shared = F.least(F.col("s_x") + F.col("s_w"), F.col("x") + F.col("width")) - F.greatest("s_x", "x")
    hits = at.join(dealt_out(s), ["doc_id", "page", "band"]).where((shared > F.least("s_w", "width") * 0.2) & (F.abs(F.col("s_y") - F.col("stream_y")) <= F.greatest(F.lit(3.0), F.col("font_size") * 0.5)))
    runs = hits.select(*LINE, "ord", "text", F.col("s_x").alias("x"), F.col("s_y").alias("y"), F.col("s_w").alias("width"), F.col("s_size").alias("font_size"), F.col("font_size").alias("own"))
    cols = columns_of_lines(runs).groupBy(*LINE, "column").agg(
        F.sort_array(F.collect_list(F.struct("x", "ord", "text"))).alias("t"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("y").alias("y"),
        F.greatest(F.max("font_size"), F.max("own")).alias("font_size"), F.count(F.lit(1)).alias("n"),
    )
    line = Window.partitionBy(*LINE)
    cols = cut(cols.withColumns({"n_columns": F.count(F.lit(1)).over(line), "n_hits": F.sum("n").over(line)}))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("t", lambda r: r["text"]), " "), r"[ \t]+", " "))
    size = F.col("font_size")
    split = cols.where("n_columns > 1").select(
        *LINE, "column", text.alias("text"), "x", "y", F.greatest(F.col("right") - F.col("x"), size * 0.6).alias("width"), (size * 1.18).alias("height"), "font_size", "n_columns", F.col("y").alias("origin_y"),
    )
    told = cols.groupBy(*LINE).agg(F.first("n_columns").alias("n_columns"), F.first("n_hits").alias("n_hits"))
    rest = d.join(dealt_out(told), [*LINE], "left").where("coalesce(n_columns, 1) = 1")
    # A line with one show stands where that stands, one whose shows are a single column where it is.
    own = F.when(F.coalesce("n_hits", F.lit(0)) < 2, F.coalesce("stream_y", "y")).otherwise(F.col("y"))
    rest = rest.select(*LINE, F.lit(0).alias("column"), "text", "x", "y", "width", "height", "font_size", F.lit(1).cast("long").alias("n_columns"), own.alias("origin_y"))
    return split.unionByName(rest)


def dealt(runs: DataFrame, drafts: DataFrame) -> DataFrame:
    """runs(doc_id, page, line, ord, text, x, width, font_size) and drafts(doc_id, page, line, draft) -> doc_id, page, line, ord, column, draft:
    a line's draft dealt onto its columns, amounts from the right, and each column's part on to its runs by their words."""
    lines = runs.groupBy(*LINE).agg(F.collect_list(F.struct("x", "ord", "text", "width", "font_size")).alias("runs"))
    return dealt_lines(lines.join(drafts.select(*LINE, "draft"), [*LINE]))


def dealt_lines(lines: DataFrame) -> DataFrame:
    """The same from lines(doc_id, page, line, runs, draft) that hold their runs (structs of x, ord, text, width, font_size). A line is
    dealt where it lies: its runs are neither taken apart before nor joined and sorted again."""

    def begins(runs: Column) -> Column:
        """Places of runs (from 0) at which columns begin."""
        told = lambda r: (looks_like_money(F.coalesce(r["text"], F.lit(""))), looks_like_amount(F.coalesce(r["text"], F.lit(""))))

        def fresh(r: Column, k: Column) -> Column:
            begun = lambda p: _new_column(p["x"], p["width"], told(p), r["x"], told(r), F.greatest(r["font_size"], p["font_size"], F.lit(8.0)))
            return F.when(k == 0, k).when(let(F.get(runs, k - 1), begun), k)

        return F.filter(F.transform(runs, fresh), lambda k: k.isNotNull())

    def dealt_out(s: Column) -> Column:
        """s: runs of a line, from the left, and where columns begin."""
        def of(begin: Column, c: Column) -> Column:
            end = F.coalesce(F.get(s["begins"], c + 1), F.size(s["runs"]))
            return F.transform(F.slice(s["runs"], begin + 1, end - begin), lambda r: r["text"])

        texts = F.transform(s["begins"], of)

        def parts(texts: Column) -> Column:
            onto = across_columns(F.transform(texts, lambda t: F.array_join(t, " ")), F.coalesce("draft", F.lit("")))
            # A part of several is made of words already.
            return F.flatten(F.transform(F.arrays_zip(texts.alias("t"), onto.alias("d")), lambda z, c: F.transform(F.when((F.size(z["t"]) == 1) & (F.size(texts) > 1), F.array(z["d"])).otherwise(across_runs(z["t"], z["d"])), lambda d: F.struct(c.alias("column"), d.alias("draft")))))

        given = lambda d: F.transform(s["runs"], lambda r, k: F.struct(r["ord"].alias("ord"), F.get(d, k)["column"].alias("column"), F.get(d, k)["draft"].alias("draft")))
        return let(let(texts, parts), given)

    out = let(F.sort_array("runs"), lambda runs: let(F.struct(runs.alias("runs"), begins(runs).alias("begins")), dealt_out))
    # No line is empty; a plain inline would ask for that, and deal twice.
    return lines.select(*LINE, F.inline_outer(out))


def raw_text_of(member_raw: Column, patch_raw: Column, needle: Column) -> Column:
    """The raw text that goes with one member: its own, else its patch's if that is the member's text by a key. What a joined row shows
    isn't one column's."""
    parent, own = F.trim(F.coalesce(patch_raw, F.lit(""))), F.trim(F.coalesce(needle, F.lit("")))
    same = (parent != "") & (own != "") & ((normalize(parent) == normalize(own)) | (soft_match_key(parent) == soft_match_key(own)))
    return F.when(F.coalesce(member_raw, F.lit("")) != "", member_raw).otherwise(F.when(same, parent))


def flattened(patches: DataFrame, members: DataFrame) -> DataFrame:
    """patches(doc_id, page, patch_id, x, y, width, height, font_size, original, raw_text, text) and their members(doc_id, page,
    patch_id, ord, x, y, width, height, font_size, original, raw_text, text, to_x, to_y) -> one patch for each member that is written
    anew or moved, from the right, `nth` in that order; a patch without members is its own, one whose members all stay goes."""
    key = ("doc_id", "page", "patch_id")
    m = members.select(*key, *[F.col(c).alias(f"m_{c}") for c in ("ord", "x", "y", "width", "height", "font_size", "original", "raw_text", "text", "to_x", "to_y")])
    d = patches.join(m, [*key], "left")
    own, none = F.col("m_ord").isNull(), F.lit("")
    changed = (F.coalesce("m_text", none) != F.coalesce("m_original", none)) | F.col("m_to_x").isNotNull() | F.col("m_to_y").isNotNull()
    size = F.coalesce("m_font_size", "font_size", F.lit(10.0))
    shown = F.when(F.coalesce("m_original", none) != "", F.col("m_original")).otherwise(F.coalesce("m_text", none))
    wide = F.when(F.col("m_width") > 0, F.col("m_width")).otherwise(F.greatest(size * 0.6, F.length(shown) * size * 0.5))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(b)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("m_x"), "m_ord")) - 1
    return d.where(own | changed).select(
        *key, nth.alias("nth"), pick("x", F.col("m_x")).alias("x"), pick("y", F.col("m_y")).alias("y"), pick("width", wide).alias("width"),
        pick("height", F.when(F.col("m_height") > 0, F.col("m_height")).otherwise(F.col("height"))).alias("height"), pick("font_size", F.coalesce("m_font_size", "font_size")).alias("font_size"),
        pick("original", F.when(F.coalesce("m_original", none) != "", F.col("m_original")).otherwise(F.col("original"))).alias("original"),
        pick("raw_text", raw_text_of(F.col("m_raw_text"), F.col("raw_text"), F.coalesce("m_original", "m_text"))).alias("raw_text"), pick("text", F.coalesce("m_text", none)).alias("text"), F.col("m_to_x").alias("to_x"), F.col("m_to_y").alias("to_y"),
    )


def selection_runs(runs: DataFrame, selected: DataFrame) -> DataFrame:
    """runs(doc_id, page, line, ord, text, x, y, width, height, ...) of selected(doc_id, page, selection, line): a line's runs if it has
    several, else those of its whole row if that has, else the line's. One join by page and row answers both.
    Rows are written first, since they are read three times."""
    banded = cut(visual_bands(runs))
    lines = banded.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_own"), F.min("band").alias("band"))
    rows = banded.groupBy("doc_id", "page", "band").agg(F.count(F.lit(1)).alias("n_row"))
    want = selected.join(lines, [*LINE]).join(rows, ["doc_id", "page", "band"])
    want = want.select("doc_id", "page", "band", "selection", F.col("line").alias("wanted"), ((F.col("n_own") < 2) & (F.col("n_row") > 1)).alias("whole"))
    met = banded.join(want, ["doc_id", "page", "band"]).where(F.col("whole") | (F.col("line") == F.col("wanted")))
    return met.select("selection", *runs.columns)


def selection_rows(runs: DataFrame, by: tuple[str, ...] = ("doc_id", "page", "selection")) -> DataFrame:
    """Rows of each selection's runs, from the top: by, row, text, x, y, width, height, font_size, n_runs. Blank runs don't count;
    heights cover the largest type."""
    banded = visual_bands(runs.where(F.trim("text") != ""), by)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "text"))), lambda r: r["text"]), " ")
    g = banded.groupBy(*by, F.col("band").alias("row")).agg(
        F.trim(F.regexp_replace(text, r"[ \t]+", " ")).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.max(F.col("y") + F.col("height")).alias("top"), F.max("font_size").alias("font_size"), F.count(F.lit(1)).alias("n_runs"),
    )
    size = F.col("font_size")
    return g.select(*by, "row", "text", "x", "y", F.greatest(F.col("right") - F.col("x"), size * 0.6).alias("width"), F.greatest(F.col("top") - F.col("y"), size * 1.18).alias("height"), "font_size", "n_runs")
