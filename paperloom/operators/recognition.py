"""Recognized words and scanned pages: grouping to lines, uncertain snippets, the verify gate, page classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCERTAIN = 72.0


def group_words(words: DataFrame) -> DataFrame:
    """words(doc_id, page, ord, text, confidence, x0, y0, x1, y1) to lines: a word joins the current line if it overlaps the
    line's height by over 0.4 of the lower of both and begins within a column gap. A fold over a page's sorted words."""
    one = F.struct("y0", "x0", "ord", "text", "confidence", "x1", "y1")
    pages = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(one)).alias("words"))
    begin = F.struct(F.lit(-1).alias("line"), *[F.lit(0.0).alias(c) for c in ("y0", "y1", "x1")], F.array().cast("array<int>").alias("out"))

    def add(a: Column, w: Column) -> Column:
        shared = F.least(a["y1"], w["y1"]) - F.greatest(a["y0"], w["y0"])
        low = F.least(a["y1"] - a["y0"], w["y1"] - w["y0"])
        gap = w["x0"] - a["x1"]
        same = (a["line"] >= 0) & (shared > 0.4 * low) & (gap <= F.greatest(F.lit(18.0), 1.6 * (w["y1"] - w["y0"]))) & (gap > -1000)
        line = F.when(same, a["line"]).otherwise(a["line"] + 1)
        return F.struct(
            line.alias("line"), F.when(same, F.least(a["y0"], w["y0"])).otherwise(w["y0"]).alias("y0"), F.when(same, F.greatest(a["y1"], w["y1"])).otherwise(w["y1"]).alias("y1"),
            F.when(same, F.greatest(a["x1"], w["x1"])).otherwise(w["x1"]).alias("x1"), F.concat(a["out"], F.array(line)).alias("out"),
        )

    lines = pages.withColumn("line", F.aggregate("words", begin, add)["out"])
    flat = lines.select("doc_id", "page", F.explode(F.arrays_zip("words", "line")).alias("z")).select("doc_id", "page", "z.line", "z.words.*")
    return flat.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda r: r["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_words"),
    )


def uncertain_words(words: DataFrame, least: float = UNCERTAIN) -> DataFrame:
    return words.where(F.col("confidence") < least)


def verify_gate(words: DataFrame, decided: DataFrame, least: float = UNCERTAIN) -> DataFrame:
    """Pages with the number of uncertain words that decided(doc_id, page, ord) lacks; a page is blocked while one is left."""
    pending = uncertain_words(words, least).join(decided, ["doc_id", "page", "ord"], "left_anti").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("pending"))
    pages = words.select("doc_id", "page").distinct().join(pending, ["doc_id", "page"], "left")
    return pages.select("doc_id", "page", F.coalesce("pending", F.lit(0)).alias("pending"), (F.coalesce("pending", F.lit(0)) > 0).alias("blocked"))


def classify_page(shows: Column, images: Column, lines: Column, match: Column, garbled: Column) -> Column:
    """image-only, no-operators, ocr-ghost or ok, from counts and ratios of a page."""
    ghost = (images > 0) & (lines >= 1) & (match < 0.35) & (garbled < 0.45) & ~((shows >= 8) & (lines >= 8))
    return F.when((shows == 0) & (images > 0), "image-only").when(shows == 0, "no-operators").when(ghost, "ocr-ghost").otherwise("ok")


def otsu(histogram: DataFrame, by: str = "image_id") -> DataFrame:
    """histogram(image_id, level, n) -> the level, 0 to 255, that parts dark from light with the largest variance between
    both; the first on a tie. Levels are few, so a window over them is small whatever the image's size."""
    from pyspark.sql import Window

    upto, whole = Window.partitionBy(by).orderBy("level").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    level, n = F.col("level").cast("double"), F.col("n").cast("double")
    h = histogram.select(by, "level", F.sum(n).over(upto).alias("w0"), F.sum(n * level).over(upto).alias("s0"), F.sum(n).over(whole).alias("w"), F.sum(n * level).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    apart = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("s") - F.col("s0"), w1)
    h = h.withColumn("between", F.when(w1 > 0, F.col("w0") * w1 * apart * apart).otherwise(0.0))
    return h.groupBy(by).agg(F.max_by("level", F.struct("between", -F.col("level"))).alias("threshold"))
