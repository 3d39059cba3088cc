"""Reading order: runs grouped from text items, columns of a line, bands of lines, labels, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import looks_like_amount, looks_like_money

# Characters that glue neighbours, and the distances (in font sizes or points) of a new column.
PUNCTUATION_ONLY = r"^[\s,.;:!?%'\"“”‘’()\[\]{}\-/–—−$€£¥]+$"
TRAILING_MONEY = r"[,$€£¥.\-–—−]$"
LEADING_PUNCTUATION = r"^[,.;:!?%'\"”’)\]}-]"
COLUMN_EM, COLUMN_GAP, COLUMN_FAR = 3.2, 36.0, 200.0
LINE = ("doc_id", "page", "line")


def new_column(prev_x: Column, prev_width: Column, prev_text: Column, x: Column, text: Column, em: Column) -> Column:
    """Whether a box begins a new column after the box before it: a gutter, a far start, two amounts, or a description
    followed by money."""
    return _new_column(prev_x, prev_width, (looks_like_money(prev_text), looks_like_amount(prev_text)), x, (looks_like_money(text), looks_like_amount(text)), em)


def _new_column(prev_x: Column, prev_width: Column, prev: tuple[Column, Column], x: Column, own: tuple[Column, Column], em: Column) -> Column:
    """The same from whether either text is money, and an amount."""
    gap, delta = x - (prev_x + prev_width), x - prev_x
    wide = F.greatest(COLUMN_EM * em, F.lit(COLUMN_GAP))
    near = F.greatest(F.lit(24.0), em * 2.5)
    (prev_money, prev_amount), (money, amount) = prev, own
    # Distances first, since texts are looked at only where these leave it open.
    return (
        (delta > F.greatest(wide * 3, F.lit(COLUMN_FAR)))
        | ((gap > wide) & ((gap > wide * 2) | prev_money | money))
        | ((delta > near) & prev_amount & amount)
        | (money & ~prev_money & (delta > near))
    )


def columns_of_lines(runs: DataFrame) -> DataFrame:
    """runs(doc_id, page, line, ord, x, width, font_size, text) with `column`, from 0, by islands of neighbours."""
    w = Window.partitionBy(*LINE).orderBy("x", "ord")
    em = F.greatest(F.col("font_size"), F.lag("font_size").over(w), F.lit(8.0))
    text = F.coalesce("text", F.lit(""))
    d = runs.withColumns({"is_money": looks_like_money(text), "is_amount": looks_like_amount(text)})  # once for each run, not for its neighbour again
    own, prev = (F.col("is_money"), F.col("is_amount")), tuple(F.coalesce(F.lag(c).over(w), F.lit(False)) for c in ("is_money", "is_amount"))
    fresh = _new_column(F.lag("x").over(w), F.lag("width").over(w), prev, F.col("x"), own, em)
    d = d.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    return d.withColumn("column", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("fresh", "is_money", "is_amount")


def column_fields(runs: DataFrame) -> DataFrame:
    """One row for each column of a line: text, box and label (Description, Amount, Balance, Amount / Balance, Column N);
    lines of one column have none."""
    cols = columns_of_lines(runs).groupBy(*LINE, "column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "text"))), lambda r: r["text"]), " ").alias("text"),
        F.min("x").alias("x"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), F.count(F.lit(1)).alias("n_runs"),
    )
    tokens = F.filter(F.split(F.trim("text"), r"\s+"), lambda t: t != "")
    every = (F.size(tokens) > 0) & F.forall(tokens, looks_like_amount)
    cols = cols.withColumn("amount", looks_like_amount(F.col("text")) | every).withColumn("several", every & (F.size(tokens) > 1))
    line = Window.partitionBy(*LINE)
    amounts, count = F.sum(F.col("amount").cast("int")).over(line), F.count(F.lit(1)).over(line)
    last = F.max(F.when(F.col("amount"), F.col("column"))).over(line)
    label = (
        F.when(F.col("amount") & F.col("several"), "Amount / Balance")
        .when(F.col("amount") & (F.col("column") == last) & ((amounts > 1) | ((count >= 3) & (last != 0))), "Balance")
        .when(F.col("amount"), "Amount").when(F.col("column") == 0, "Description")
        .otherwise(F.concat(F.lit("Column "), (F.col("column") + 1).cast("string")))
    )
    return cols.withColumn("label", label).withColumn("count", count).where("count >= 2").select(*LINE, "column", "label", "text", "x", "width", "n_runs")


def group_text_items(items: DataFrame) -> DataFrame:
    """items(doc_id, page, ord, text, x, y, width, height, font) to runs. An item joins the one before it (top to bottom,
    left to right) on the same baseline, in the same font, at a word's distance, unless a column begins."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "ord")
    # What a text looks like is told once for each item, not for its neighbour again.
    own = F.coalesce("text", F.lit(""))
    looks = {"is_money": looks_like_money(own), "is_amount": looks_like_amount(own), "is_marks": own.rlike(PUNCTUATION_ONLY), "ends_money": own.rlike(TRAILING_MONEY), "is_figure": own.rlike(r"^\d")}
    d = items.withColumns(looks)
    prev = {c: F.lag(c).over(w) for c in ("x", "y", "width", "height", "font")}
    before = {c: F.coalesce(F.lag(c).over(w), F.lit(False)) for c in looks}
    high = F.greatest("height", prev["height"])
    gap, delta = F.col("x") - (prev["x"] + prev["width"]), F.col("x") - prev["x"]
    glue = F.col("is_marks") | before["is_marks"] | (before["ends_money"] & F.col("is_figure"))
    near = F.greatest(F.lit(24.0), high * 2.5)
    joins = (
        (F.abs(prev["y"] - F.col("y")) <= F.greatest(F.lit(3.0), high * 0.45)) & (prev["font"] == F.col("font"))
        & (gap >= -F.greatest(F.lit(1.0), high * 0.65)) & ((gap <= F.greatest(F.lit(10.0), high * 1.65)) | glue)
        & ~(delta > F.greatest(F.lit(200.0), high * 8)) & ~(before["is_amount"] & F.col("is_amount") & (delta > near))
        & ~(F.col("is_money") & ~before["is_money"] & (delta > near))
    )
    d = d.withColumn("fresh", (~F.coalesce(joins, F.lit(False))).cast("int"))
    d = d.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    groups = d.groupBy("doc_id", "page", "run").agg(
        F.sort_array(F.collect_list(F.struct("x", "ord", "text", "width", "height"))).alias("items"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"),
        F.min("y").alias("y"), F.max("height").alias("font_size"), F.min_by("font", F.struct("x", "ord")).alias("font"),
    )
    size = F.col("font_size")
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("cursor"))

    def add(a: Column, i: Column) -> Column:
        gap = i["x"] - a["cursor"]
        settled = a["cursor"].isNull() | a["text"].endswith(" ") | a["text"].endswith(",")
        # Distances first, since texts are looked at only where these allow it.
        comma = (gap >= -1) & (gap <= size * 0.55) & ~((i["x"] - F.col("x")) > F.greatest(F.lit(36.0), size * 4)) & i["text"].rlike(r"^\d{3}(?:\D|$)") & a["text"].rlike(r"\d$")
        space = (gap > size * 0.22) & ~i["text"].rlike(LEADING_PUNCTUATION) & ~(i["text"].rlike(r"^\d") & a["text"].rlike(TRAILING_MONEY))
        between = F.when(settled, "").when(comma, ",").when(space, " ").otherwise("")
        return F.struct(F.concat(a["text"], between, F.coalesce(i["text"], F.lit(""))).alias("text"), (i["x"] + i["width"]).alias("cursor"))

    text = F.trim(F.regexp_replace(F.aggregate("items", start, add)["text"], r"[ \t]+", " "))
    return groups.select(
        "doc_id", "page", F.col("run").cast("int").alias("run"), text.alias("text"), "x", "y", F.greatest(F.col("right") - F.col("x"), size * 0.6).alias("width"),
        (size * 1.18).alias("height"), "font_size", "font", F.size("items").alias("n_items"),
    )


def align(runs: DataFrame, kind: str, by: tuple[str, ...] = LINE) -> DataFrame:
    """runs with `new_x`: left, right, center or justify within the box of their group."""
    g = Window.partitionBy(*by)
    left, right = F.min("x").over(g), F.max(F.col("x") + F.col("width")).over(g)
    if kind == "left":
        x = left
    elif kind == "right":
        x = right - F.col("width")
    elif kind == "center":
        x = left + (right - left - F.col("width")) / 2
    else:
        o = Window.partitionBy(*by).orderBy("x", "ord").rowsBetween(Window.unboundedPreceding, -1)
        count = F.count(F.lit(1)).over(g)
        gap = F.try_divide(right - left - F.sum("width").over(g), count - 1)
        x = F.when(count == 1, left).otherwise(left + F.coalesce(F.sum("width").over(o), F.lit(0.0)) + F.count(F.lit(1)).over(o) * gap)
    return runs.withColumn("new_x", x)


def visual_bands(runs: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """runs with `band`: rows of a page from the top, each compared with the first run of the current band. A fold over
    the sorted runs of a page, since the first run of a band cannot be had from a lag."""
    key = F.struct((-F.col("y")).alias("k"), "x", "ord")
    rows = runs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), *[F.col(c) for c in runs.columns if c not in by]))).alias("rows"))
    begin = F.struct(F.lit(-1).alias("band"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, r: Column) -> Column:
        same = (a["band"] >= 0) & (F.abs(a["y"] - r["y"]) <= F.greatest(F.lit(3.0), F.greatest(a["h"], r["height"]) * 0.45))
        band = F.when(same, a["band"]).otherwise(a["band"] + 1)
        return F.struct(
            band.alias("band"), F.when(same, a["y"]).otherwise(r["y"]).alias("y"), F.when(same, a["h"]).otherwise(r["height"]).alias("h"),
            F.concat(a["out"], F.array(band)).alias("out"),
        )

    banded = rows.withColumn("bands", F.aggregate("rows", begin, add)["out"])
    # No group is empty; a plain explode would ask for that, and fold twice.
    flat = banded.select(*by, F.explode_outer(F.arrays_zip("rows", "bands")).alias("z"))
    return flat.select(*by, *[F.col(f"z.rows.{c}").alias(c) for c in runs.columns if c not in by], F.col("z.bands").alias("band"))
