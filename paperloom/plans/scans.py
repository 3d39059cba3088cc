"""Queries over pages as paint and pixels: states of content streams, evidence of scans, sheets in images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import pixels, sheets, views
from paperloom.plans import sql
from paperloom.plans.registry import query, rounded
from paperloom.session import table
from paperloom.sources import content


def _streams(spark: SparkSession, d: str) -> DataFrame:
    """A stream for each order: a picture as large as the page for those with an even key, every line moved up by a saved
    transform with a gray fill, its second run hidden within its text object, its third hidden before it, its first shown
    twice; octal and hexadecimal strings, and a white box over the last."""
    r, doc = views.runs(spark, d), F.col("doc_id")
    place = F.concat(F.lit(" 1 0 0 1 "), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(" Tm "))
    lit = content.literal(F.col("text"))
    show = (
        F.when(F.col("ord") == 0, F.concat(F.lit("q 1 0 0 1 0 100 cm 0.5 g BT /F#31 9 Tf 80 Tz"), place, lit, F.lit(" Tj ET BT"), place, lit, F.lit(" Tj ET Q")))
        .when(F.col("ord") == 1, F.concat(F.lit("BT 3 Tr /F2 9 Tf"), place, F.lit("(\\061"), F.substring(lit, F.lit(2), F.length(lit)), F.lit(" Tj ET")))
        .when(F.col("ord") == 2, F.concat(F.lit("q 3 Tr BT /F2 9 Tf"), place, F.lit("<313"), F.lit("> Tj ET Q")))
        .otherwise(F.concat(F.lit("0 Tr 1 1 1 rg "), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(" 20 9 re f 0 g BT /F2 9 Tf"), place, F.lit("[(a) -200 (b)] TJ ET")))
    )
    parts = r.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "ord", show.alias("show")))).alias("s"))
    picture = F.when(doc % 2 == 0, "q 595 0 0 842 0 0 cm /Im1 Do Q ").otherwise("q 100 0 0 842 0 0 cm /Im1 Do Q ")
    return parts.select("doc_id", "page", F.concat(picture, F.array_join(F.transform("s", lambda x: x["show"]), "\n")).alias("stream"))


STATES = f"""WITH {sql.RUNS}, e AS (SELECT doc_id, line, ord, x, y, text, unnest(CASE WHEN ord = 0 THEN [0, 1] ELSE [0] END) AS again FROM runs)
SELECT doc_id, CASE ord WHEN 0 THEN text WHEN 1 THEN '1' || text WHEN 2 THEN '10' ELSE 'a b' END AS text, CASE WHEN ord = 0 THEN 'F1' ELSE 'F2' END AS font, CASE ord WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 0 END AS mode,
  ord = 1 AS in_text, round(x, 6) AS x, round(CASE WHEN ord = 0 THEN y + 100 ELSE y END, 6) AS y, 0.8::DOUBLE AS scale, CASE WHEN ord = 0 THEN 0.5::DOUBLE ELSE 0.0 END AS red FROM e"""


@query("painted_shows", STATES)
def painted_shows(spark: SparkSession, d: str) -> DataFrame:
    """Every show with the state it stands in."""
    p = content.painted(_streams(spark, d), ("show",), ("doc_id", "text", "font", "mode", "in_text", "x", "y", "scale", "red"))
    return rounded(p.select("doc_id", "text", "font", "mode", "in_text", "x", "y", "scale", "red"), "x", "y")


PAINT = f"""WITH {sql.RUNS}, k AS (SELECT doc_id, line, min(text) FILTER (WHERE ord = 0) AS name FROM runs GROUP BY doc_id, line),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(name) >= 8) AS pairs FROM k GROUP BY doc_id)
SELECT doc_id, n * 5 AS shows, n * 4 AS visible, n AS hidden, CAST(doc_id % 2 = 0 AS BIGINT) AS full_images, n AS modes_inside, n * 2 AS modes_outside, pairs, pairs > 0 AS stacked FROM g"""


@query("scan_paint", PAINT)
def scan_paint(spark: SparkSession, d: str) -> DataFrame:
    """What the paint of every page says about a scan."""
    g = content.scan_paint(content.painted(_streams(spark, d), names=content.SCANNED), 595.0, 842.0)
    return g.select("doc_id", "shows", "visible", "hidden", "full_images", "modes_inside", "modes_outside", "pairs", "stacked")


LAYERS = f"""WITH {sql.RUNS} SELECT doc_id, count(*) + count(*) FILTER (WHERE ord = 0) AS n, string_agg(CASE ord WHEN 0 THEN text || text WHEN 1 THEN '1' || text WHEN 2 THEN '10' ELSE 'a b' END, '' ORDER BY line, ord) AS joined FROM runs GROUP BY doc_id"""


@query("text_layers", LAYERS)
def text_layers(spark: SparkSession, d: str) -> DataFrame:
    """Shows of each page, counted and joined end to end."""
    g = content.painted(_streams(spark, d), ("show",), ("doc_id", "ord", "text")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("s"))
    return g.select("doc_id", "n", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("joined"))


WHITE = f"WITH {sql.RUNS} SELECT DISTINCT a.doc_id, a.line * 10 + a.ord AS box_id FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND b.ord = 3 AND b.x <= a.x + a.width AND b.x + 20 >= a.x AND b.y <= a.y + a.height AND b.y + 9 >= a.y"


@query("white_covers", WHITE)
def white_covers(spark: SparkSession, d: str) -> DataFrame:
    """Runs that a white box touches."""
    boxes = views.runs(spark, d).select("doc_id", "page", (F.col("line") * 10 + F.col("ord")).alias("box_id"), "x", "y", "width", "height")
    return content.covered_white(content.painted(_streams(spark, d), ("box",), ("doc_id", "page", "kind", "white", "x", "y", "wide", "high")), boxes).select("doc_id", "box_id")


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as images eight wide: red from their values, green its opposite, blue half of it."""
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x.cast("double") * 400.0 + 128.0).cast("double"))))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), v.alias("red"))
    return e.withColumns({"green": F.transform("red", lambda x: 255.0 - x), "blue": F.transform("red", lambda x: F.floor(x / 2).cast("double"))})


_PIXELS = """px AS (SELECT vec_id AS image_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS k, greatest(0.0, least(255.0, floor(unnest(embedding)::DOUBLE * 400.0::DOUBLE + 128.0))) AS v FROM embeddings),
gr AS (SELECT image_id, k, k % 8 AS x, k // 8 AS y, CAST(floor((v * 77 + (255 - v) * 150 + floor(v / 2) * 29) / 256) AS INTEGER) AS g, v, count(*) OVER (PARTITION BY image_id) // 8 AS h FROM px)"""
GRAYS = f"WITH {_PIXELS} SELECT image_id, CAST(sum(g) AS BIGINT) AS total, CAST(sum(g * k) AS BIGINT) AS spread FROM gr GROUP BY image_id"


@query("gray_levels", GRAYS)
def gray_levels(spark: SparkSession, d: str) -> DataFrame:
    i = _images(spark, d).select("image_id", F.posexplode(sheets.gray(F.col("red"), F.col("green"), F.col("blue"))).alias("k", "g"))
    return i.groupBy("image_id").agg(F.sum("g").alias("total"), F.sum(F.col("g") * F.col("k")).alias("spread"))


def _at(dx: int, dy: int) -> str:
    return f"n[k + {1 + dx + 8 * dy}]"


EDGES = f"""WITH {_PIXELS}, l AS (SELECT image_id, list(g ORDER BY k) AS n FROM gr GROUP BY image_id), m AS (SELECT gr.image_id, k, x, y, h, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND h - 2 THEN
  sqrt(({_at(1, -1)} - {_at(-1, -1)} + 2 * {_at(1, 0)} - 2 * {_at(-1, 0)} + {_at(1, 1)} - {_at(-1, 1)}) ** 2 + ({_at(-1, -1)} + 2 * {_at(0, -1)} + {_at(1, -1)} - {_at(-1, 1)} - 2 * {_at(0, 1)} - {_at(1, 1)}) ** 2) ELSE 0.0 END AS e FROM gr JOIN l ON gr.image_id = l.image_id),
c AS (SELECT *, e >= greatest(max(e) OVER (PARTITION BY image_id), 1) / 2 AS hot FROM m),
d AS (SELECT image_id, k, e, hot OR (x BETWEEN 1 AND 6 AND y BETWEEN 1 AND h - 2 AND (lag(hot) OVER w OR lead(hot) OVER w OR lag(hot, 8) OVER w OR lead(hot, 8) OVER w)) AS grown FROM c WINDOW w AS (PARTITION BY image_id ORDER BY k))
SELECT image_id, round(sum(e), 4) AS edges, count(*) FILTER (WHERE grown) AS grown FROM d GROUP BY image_id"""


@query("image_edges", EDGES)
def image_edges(spark: SparkSession, d: str) -> DataFrame:
    """Gradients, summed, and cells near strong ones, counted."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return sheets.edges_of(_images(spark, d)).select("image_id", F.round(total("edges"), 4).alias("edges"), F.aggregate("grown", F.lit(0).cast("long"), lambda a, v: a + v).alias("grown"))


TURNED = f"WITH {_PIXELS} SELECT image_id, CAST(sum(v * (x * h + h - 1 - y)) AS BIGINT) AS right_turn, CAST(sum(v * (63 - k)) AS BIGINT) AS half_turn, CAST(sum(v * ((7 - x) * h + y)) AS BIGINT) AS left_turn, CAST(sum(CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 1 AND 3 THEN 0 ELSE v * k END) AS BIGINT) AS punched FROM gr GROUP BY image_id"


@query("turned_images", TURNED)
def turned_images(spark: SparkSession, d: str) -> DataFrame:
    """Images after quarter turns and with a rectangle painted black, each as its levels times their places."""
    sign = lambda c: F.aggregate(F.transform(c, lambda v, k: v * k), F.lit(0.0), lambda a, v: a + v).cast("long")
    red, w = F.col("red"), F.col("width")
    hole = tuple(F.lit(v) for v in (2, 1, 3, 3))
    return _images(spark, d).select(
        "image_id", *[sign(sheets.turned(red, w, k)).alias(n) for k, n in ((1, "right_turn"), (2, "half_turn"), (3, "left_turn"))], sign(sheets.punched(red, w, hole)).alias("punched")
    )


ADAPTED = f"""WITH {_PIXELS}, m AS (SELECT a.image_id, a.k, a.g, avg(b.g) AS mean FROM gr a JOIN gr b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8 GROUP BY a.image_id, a.k, a.g)
SELECT image_id, CAST(sum(CASE WHEN g < mean - 8 THEN 0 ELSE 255 * (k + 1) END) AS BIGINT) AS total FROM m GROUP BY image_id"""


@query("black_and_white", ADAPTED)
def black_and_white(spark: SparkSession, d: str) -> DataFrame:
    out = sheets.processed(_images(spark, d), "bw")
    return out.select("image_id", F.aggregate(F.transform("red", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))


@query("enhanced_images")
def enhanced_images(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each colour after each enhancement."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    out = None
    for name in ("color", "whiteboard", "receipt"):
        one = sheets.processed(_images(spark, d), name).select("image_id", F.lit(name).alias("preset"), *[total(c).alias(c) for c in ("red", "green", "blue")])
        out = one if out is None else out.unionByName(one)
    return out


@query("detected_sheets")
def detected_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheet in every image, and the size of its upright picture after it is cut, enhanced and turned."""
    i = _images(spark, d)
    found = sheets.detected(i)
    cut = sheets.processed(i.join(found, "image_id"), "receipt", 1).select("image_id", F.col("width").alias("out_width"), F.size("red").alias("n_pixels"))
    return found.join(cut, "image_id").select("image_id", F.round("confidence", 6).alias("confidence"), *[F.round(F.col("quad")[k], 4).alias(f"q{k}") for k in range(8)], "out_width", "n_pixels")


LEVELS = f"""WITH px AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE * 127.0::DOUBLE + 128.0::DOUBLE AS v FROM embeddings), l AS (SELECT image_id, list_sort(list(v)) AS s, list(v) AS p FROM px GROUP BY image_id),
b AS (SELECT *, s[CAST(floor(len(s) * 0.05) AS INTEGER) + 1] AS lo, s[CAST(ceil(len(s) * 0.95) AS INTEGER)] AS hi FROM l)
SELECT image_id, round(list_sum([least(255.0, greatest(0.0, (v - lo) * 255.0::DOUBLE / (hi - lo))) FOR v IN p]), 4) AS total FROM b"""


@query("auto_levels", LEVELS)
def auto_levels(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: v.cast("double") * 127.0 + 128.0).alias("pixels"))
    out = pixels.auto_levels(i, 0.05)
    return out.select("image_id", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


HISTOGRAM = f"WITH {_PIXELS} SELECT image_id, CAST(v AS INTEGER) AS level, count(*) AS n FROM gr GROUP BY image_id, v"


@query("histograms", HISTOGRAM)
def histograms(spark: SparkSession, d: str) -> DataFrame:
    return pixels.histogram(_images(spark, d), "image_id", "red")
