"""Images drawn on pages: which one a patch means, which pixels holes take, and pages that patches replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import gates
from paperloom.functions import geometry as g

#: Least intersection over union of an image that is meant by its box.
ALIKE = 0.55


def find_image(draws: DataFrame, patches: DataFrame) -> DataFrame:
    """draws(doc_id, page, name, x, y, width, height) and patches(doc_id, page, patch_id, name, x, y, width, height): the
    image of a patch by a usable name, else by the box it shares most of, else the page's only one; null if none."""
    d = draws.select("doc_id", "page", F.col("name").alias("b_name"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "width", "height")])
    j = patches.join(d, ["doc_id", "page"], "left").withColumn("iou", g.iou(g.box(), g.box("b_")))
    named = F.min(F.when(gates.is_object_name(F.col("name")) & (F.col("name") == F.col("b_name")), F.col("b_name")))
    boxed = F.max_by(F.when(F.col("iou") >= ALIKE, F.col("b_name")), F.struct(F.col("iou") >= ALIKE, "iou", "b_name"))
    only = F.when(F.count("b_name") == 1, F.min("b_name"))
    return j.groupBy("doc_id", "page", "patch_id").agg(F.coalesce(named, boxed, only).alias("image"), F.when(named.isNotNull(), "name").when(boxed.isNotNull(), "box").when(only.isNotNull(), "only").otherwise("none").alias("by"))


def punched(draws: DataFrame, holes: DataFrame) -> DataFrame:
    """The pixel boxes that the holes of a page take of each image(…, object, pixel_w, pixel_h), as one row for each object."""
    h = holes.select("doc_id", "page", *[F.col(c).alias(f"h_{c}") for c in ("x", "y", "width", "height")])
    j = draws.join(h, ["doc_id", "page"]).withColumn("hole", g.pixel_box(g.box(), (F.col("pixel_w"), F.col("pixel_h")), g.box("h_"))).where("hole is not null")
    area = F.aggregate("holes", F.lit(0).cast("long"), lambda a, b: a + b["width"] * b["height"])
    return j.groupBy("doc_id", "object").agg(F.array_sort(F.collect_set("hole")).alias("holes")).select("doc_id", "object", F.size("holes").alias("n_holes"), area.alias("pixels"))


def replaced_pages(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """Pages with the picture of their last patch(doc_id, pos, patch_ord, picture), or as they are."""
    last = patches.groupBy("doc_id", "pos").agg(F.max_by("picture", "patch_ord").alias("picture"))
    return pages.join(last, ["doc_id", "pos"], "left").select("doc_id", "pos", "page_id", F.coalesce("picture", F.lit("")).alias("picture"), F.col("picture").isNotNull().alias("replaced"))


def in_file_order(slots: DataFrame, files: DataFrame) -> DataFrame:
    """slots(strip, pos, doc_id, page) and files(strip, file_ord, doc_id, pages): whether each strip holds the pages of its
    files, all of them, in order. Places before a file come from a running sum over the files."""
    w = Window.partitionBy("strip").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    f = files.withColumn("before", F.coalesce(F.sum("pages").over(w), F.lit(0)))
    total = f.groupBy("strip").agg(F.sum("pages").alias("total"))
    j = slots.join(f, ["strip", "doc_id"], "left").withColumn("right", F.coalesce(F.col("pos") == F.col("before") + F.col("page"), F.lit(False)))
    g_ = j.groupBy("strip").agg(F.count(F.lit(1)).alias("n"), F.bool_and("right").alias("right"))
    return total.join(g_, "strip", "left").select("strip", (F.coalesce("n", F.lit(0)) == F.col("total")).alias("complete"), (F.coalesce("right", F.lit(True)) & (F.coalesce("n", F.lit(0)) == F.col("total"))).alias("in_order"))


def swapped(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Pages after moves(doc_id, pos, step): one page a document changes places with its neighbour; a step beyond either end
    changes nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    d = pages.withColumn("n", n).join(moves.select("doc_id", F.col("pos").alias("from"), (F.col("pos") + F.col("step")).alias("to")), "doc_id", "left")
    ok = F.coalesce(F.col("to").between(1, F.col("n")) & F.col("from").between(1, F.col("n")), F.lit(False))
    return d.withColumn("pos", F.when(ok & (F.col("pos") == F.col("from")), F.col("to")).when(ok & (F.col("pos") == F.col("to")), F.col("from")).otherwise(F.col("pos")).cast("int")).drop("n", "from", "to")
