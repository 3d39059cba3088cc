"""Phrase search over the glyphs of a page: a hit knows the very glyphs it covers, whatever white space or line ends lie
between, so that boxes over it hide all of it and nothing else."""

from __future__ import annotations

import bisect
import functools
import itertools
import operator
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import OTHER_WIDTH, SPACE, WIDTHS

# How far boxes reach beyond glyphs, how deep letters hang, and the least box.
PAD, DESCENT, LEAST_WIDTH, LEAST_HEIGHT = 1.6, 0.25, 4.0, 10.0
HIT = "doc_id long, page int, first int, last int, matched string, rects array<struct<x:double,y:double,width:double,height:double>>"


def glyphs(items: DataFrame) -> DataFrame:
    """items(doc_id, page, ord, text, x, y, width, height, has_eol) -> doc_id, page, g, ch, x, y, width, height, from 0 in
    reading order. Widths follow the classes of the characters, scaled to the item's width; an item that ends a line adds a
    line end without extent."""
    i = items.where((F.length("text") > 0) | F.col("has_eol"))
    size = F.greatest("height", F.lit(6.0))

    def weight(c: Column) -> Column:
        w = F.lit(OTHER_WIDTH)
        for pattern, value in reversed(WIDTHS):
            w = F.when(c.rlike(f"^{pattern}$"), value).otherwise(w)
        return w

    chars = F.filter(F.split("text", ""), lambda c: c != "")
    i = i.select("doc_id", "page", "ord", "x", "y", "width", "has_eol", size.alias("size"), chars.alias("chars")).withColumn("weights", F.transform("chars", weight))
    total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    i = i.withColumn("scale", F.when(F.col("width") > 0, F.try_divide(F.col("width"), total)).otherwise(F.col("size")))
    made = F.transform("chars", lambda c, k: F.struct(k.alias("k"), c.alias("ch"), F.greatest(F.get("weights", k) * F.col("scale"), F.lit(0.2)).alias("w"), F.aggregate(F.slice("weights", 1, k), F.lit(0.0), lambda a, w: a + w).alias("before")))
    end = F.struct(F.size("chars").alias("k"), F.lit("\n").alias("ch"), F.lit(0.0).alias("w"), total.alias("before"))
    g = i.withColumn("glyph", F.explode(F.when(F.col("has_eol"), F.concat(made, F.array(end))).otherwise(made)))
    live = F.col("glyph.w") > 0
    return g.select(
        "doc_id", "page", "ord", F.col("glyph.k").alias("k"), F.col("glyph.ch").alias("ch"),
        (F.col("x") + F.col("glyph.before") * F.col("scale") - F.when(live, PAD).otherwise(0.0)).alias("x"), (F.col("y") - DESCENT * F.col("size") - PAD).alias("y"),
        F.when(live, F.col("glyph.w") + 2 * PAD).otherwise(0.0).alias("width"), F.when(live, F.greatest(F.lit(LEAST_HEIGHT), F.col("size") * (1 + DESCENT) + PAD)).otherwise(0.0).alias("height"),
    )


def _bands(rows: list[tuple]) -> list[list[tuple]]:
    """Glyphs by baseline, each compared with the first of a band."""
    bands: list[list[tuple]] = []
    for r in sorted((r for r in rows if r[0] != "\n" and r[3] > 0), key=lambda r: (-r[2], r[1])):
        near = next((b for b in bands if abs(b[0][2] - r[2]) <= max(3.0, 0.45 * r[4])), None)
        if near is None:
            bands.append([r])
        else:
            near.append(r)
    return bands


def _box(rows: list[tuple]) -> dict:
    x, y = min(r[1] for r in rows), min(r[2] for r in rows)
    right, top = max(r[1] + r[3] for r in rows), max(r[2] + r[4] for r in rows)
    return {"x": x, "y": y, "width": max(LEAST_WIDTH, right - x), "height": max(LEAST_HEIGHT, top - y)}


class Page:
    """The items of one page, in order."""

    def __init__(self):
        self.items: list[tuple] = []

    def text(self) -> str:
        return "".join(i[0] + "\n" if i[5] else i[0] for i in self.items)

    def glyphs(self, k: int) -> list[tuple]:
        """ch, x, y, width, height of an item's glyphs, as `glyphs` has them."""
        text, x, y, width, size, eol = self.items[k]
        weights = [_weight(c) for c in text]
        total = functools.reduce(operator.add, weights, 0.0)  # one after the other; `sum` evens out errors
        scale, before, out = (width / total if text else 0.0) if width is not None and width > 0 else size, 0.0, []
        for c, w in zip(text, weights):
            out.append((c, x + before * scale - PAD, y - DESCENT * size - PAD, max(w * scale, 0.2) + 2 * PAD, max(LEAST_HEIGHT, size * (1 + DESCENT) + PAD)))
            before += w
        return [*out, ("\n", x, y, 0.0, 0.0)] if eol else out


@functools.cache
def _weight(c: str) -> float:
    return next((value for pattern, value in WIDTHS if re.fullmatch(pattern, c)), OTHER_WIDTH)


def _hits(page: Page, needle: str, blank: re.Pattern) -> Iterator[tuple]:
    """first, last, matched and rects of a page's hits. Only a page that holds the needle is taken apart, and of it only the glyphs
    of hits."""
    whole = page.text()
    lower = whole.lower() if whole.isascii() else "".join(c.lower() for c in whole)
    if not needle or needle not in blank.sub(" ", lower):
        return
    text, owner = [], []
    for k, ch in enumerate(whole):
        if blank.match(ch):
            if not text or text[-1] != " ":
                text.append(" ")
                owner.append(k)
            continue
        for c in ch.lower():
            text.append(c)
            owner.append(k)
    ends = list(itertools.accumulate(len(i[0]) + i[5] for i in page.items))
    joined, at = "".join(text), 0
    while (at := joined.find(needle, at)) >= 0:
        first, last = owner[at], owner[at + len(needle) - 1]
        low, high = bisect.bisect_right(ends, first), bisect.bisect_right(ends, last)
        begin = ends[low - 1] if low else 0
        part = [g for k in range(low, high + 1) for g in page.glyphs(k)][first - begin : last - begin + 1]
        bands = _bands(part)
        if bands:
            yield first, last, "".join(r[0] for r in part), [_box(b) for b in bands]
        at += len(needle)


def find_hits(items: DataFrame, query: str) -> DataFrame:
    """Hits of a query on each page, in any case, white space collapsed, leftmost and without overlap: first and last glyph,
    the text as it stands there, and a box for each line it touches. Items come page by page and in order, a batch of columns at a
    time, and become glyphs only where a hit is."""
    import pyarrow as pa

    blank = re.compile(SPACE.replace(r"\x0B", "\x0b") + "+")
    needle = " ".join(p for p in blank.split(query) if p).lower()
    box = pa.struct([(c, pa.float64()) for c in ("x", "y", "width", "height")])
    schema = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("matched", pa.string()), ("rects", pa.list_(box))])

    def walk(batches):
        key, page = None, Page()
        for batch in itertools.chain(batches, [None]):
            out: list = []
            columns = [[None]] * 8 if batch is None else [batch.column(c).to_pylist() for c in ("doc_id", "page", "text", "x", "y", "width", "size", "has_eol")]
            for doc, number, *item in zip(*columns):
                if (doc, number) != key:
                    if key is not None:
                        out.extend((*key, *h) for h in _hits(page, needle, blank))
                    key, page = (doc, number), Page()
                page.items.append(tuple(item))
            filled = list(zip(*out)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(filled, schema)], schema=schema)

    i = items.where(F.col("text").isNotNull() & ((F.length("text") > 0) | F.col("has_eol")))
    # The window puts a page's items into one partition, in order.
    i = i.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))).where("nth > 0")
    told = i.select("doc_id", "page", "text", "x", "y", "width", F.greatest("height", F.lit(6.0)).alias("size"), F.coalesce("has_eol", F.lit(False)).alias("has_eol"))
    return told.mapInArrow(walk, HIT)


def erase_marks(hits: DataFrame) -> DataFrame:
    """A mark for each box of each hit."""
    h = hits.select("doc_id", "page", "first", F.posexplode("rects").alias("n", "r"))
    return h.select("doc_id", "page", F.concat_ws("-", F.col("first").cast("string"), F.col("n").cast("string")).alias("id"), F.lit("erase").alias("kind"), "r.*")


def kept_text(items: DataFrame, holes: DataFrame, pad: float = 0.35) -> DataFrame:
    """What is left of each item's text when glyphs under a hole go: items and holes meet in buckets of the page, then the glyphs of
    items that a hole touches. Others keep their text."""
    from paperloom.operators import joins

    key = ("doc_id", "page", "ord")
    holes = holes.select("doc_id", "page", "x", "y", "width", "height")
    size, n = F.greatest("height", F.lit(6.0)), F.length("text")
    # A box about all glyphs of an item: the last may be wider than its share, and a unit is left at each side.
    wide = F.when(F.col("width") > 0, F.col("width")).otherwise(size * n) + 0.2 * n + 2
    own = F.struct(*[F.col(c) for c in items.columns]).alias("item")
    around = items.where(n > 0).select(*key, own, (F.col("x") - 1).alias("x"), (F.col("y") - DESCENT * size - 1).alias("y"), wide.alias("width"), (F.greatest(F.lit(LEAST_HEIGHT), size * (1 + DESCENT)) + 2).alias("height"))
    touched = joins.overlapping(around, joins.renamed(holes), pad).dropDuplicates([*key]).select("item.*")
    # Glyph boxes carry the search pad; what is compared with a hole is the glyph itself.
    g = glyphs(touched).withColumns({"x": F.col("x") + PAD, "width": F.greatest(F.col("width") - 2 * PAD, F.lit(0.0)), "y": F.col("y") + PAD, "height": F.greatest(F.col("height") - PAD, F.lit(0.0))})
    g = g.where("ch <> '\\n'")
    gone = joins.overlapping(g, joins.renamed(holes), pad).select(*key, "k").distinct().withColumn("gone", F.lit(True))
    left = F.collect_list(F.when(F.col("gone").isNull(), F.struct("k", "ch")))
    text = g.join(gone, [*key, "k"], "left").groupBy(*key).agg(F.array_join(F.transform(F.sort_array(left), lambda r: r["ch"]), "").alias("kept"))
    plain = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    return items.select(*key, "text").join(text, [*key], "left").select(*key, F.coalesce("kept", plain, F.lit("")).alias("kept"))
