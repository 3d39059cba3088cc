"""Joins of boxes on a page. The page is the join key and boxes meet within buckets of their height, so a page with many
boxes on both sides isn't compared box by box; the exact condition follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import geometry as g

BUCKET = 48.0
PAGE = ("doc_id", "page")


def _bucketed(df: DataFrame, y: str, h: str, pad: float) -> DataFrame:
    ends = F.col(y), F.col(y) + F.col(h)  # a height may be negative
    low, high = F.floor((F.least(*ends) - pad) / BUCKET).cast("int"), F.floor((F.greatest(*ends) + pad) / BUCKET).cast("int")
    return df.withColumn("bucket", F.explode(F.sequence(low, high))).withColumn("low", low)


def overlapping(a: DataFrame, b: DataFrame, pad: float = 0.0) -> DataFrame:
    """Pairs of a (x, y, width, height) and b (b_x, b_y, b_width, b_height) on one page that overlap; each pair once, in
    the first bucket that both share."""
    left, right = _bucketed(a, "y", "height", pad), _bucketed(b, "b_y", "b_height", pad).withColumnRenamed("low", "b_low")
    joined = left.join(right, [*PAGE, "bucket"]).where(F.col("bucket") == F.greatest("low", "b_low"))
    return joined.where(g.overlap(g.box(), g.box("b_"), pad)).drop("bucket", "low", "b_low")


def renamed(df: DataFrame) -> DataFrame:
    """A table's box columns as those of the second side."""
    return df.select(*PAGE, *[F.col(c).alias(f"b_{c}") for c in df.columns if c not in PAGE])


def select_in_rect(runs: DataFrame, rects: DataFrame) -> DataFrame:
    """Runs that a marquee touches, with the marquee's columns."""
    return overlapping(runs, renamed(rects))


def kept_after_erase(runs: DataFrame, holes: DataFrame, pad: float = 0.35, key: tuple[str, ...] = ("doc_id", "page", "line", "ord")) -> DataFrame:
    """Runs that no erase box overlaps."""
    gone = overlapping(runs, renamed(holes), pad).select(*key).distinct()
    return runs.join(gone, [*key], "left_anti")


def best_match(a: DataFrame, b: DataFrame, key: tuple[str, ...], least: float = 0.0) -> DataFrame:
    """For each box of a the box of b with the largest intersection over union; ties go to the lower b_ord."""
    pairs = overlapping(a, renamed(b)).withColumn("iou", g.iou(g.box(), g.box("b_")))
    best = pairs.where(F.col("iou") > least).groupBy(*key).agg(F.max_by(F.struct("b_ord", "iou"), F.struct("iou", -F.col("b_ord"))).alias("m"))
    return best.select(*key, F.col("m.b_ord").alias("b_ord"), F.col("m.iou").alias("iou"))


def overlapping_pairs(runs: DataFrame, share: float = 0.55, by: tuple[str, ...] = ("doc_id", "page", "line")) -> DataFrame:
    """Pairs of runs of a line that lie over each other for at least a share of the narrower one's width."""
    b = runs.select(*by, *[F.col(c).alias(f"b_{c}") for c in ("ord", "x", "width", "text")])
    shared = F.least(F.col("x") + F.col("width"), F.col("b_x") + F.col("b_width")) - F.greatest("x", "b_x")
    return runs.join(b, [*by]).where((F.col("ord") < F.col("b_ord")) & (shared >= share * F.least("width", "b_width")))
