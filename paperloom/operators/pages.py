"""Page algebra over tables of pages (doc_id, pos, ...). Order is the column pos, from 1, without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renumbered(pages: DataFrame, order: tuple = ("pos",), by: str = "doc_id") -> DataFrame:
    return pages.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def split(pages: DataFrame, size: int) -> DataFrame:
    """pages with `part`, from 0, `part_pos` and the part's name "first-last"."""
    part = F.floor((F.col("pos") - 1) / size).cast("int")
    last = F.max("pos").over(Window.partitionBy("doc_id"))
    first = part * size + 1
    name = F.concat_ws("-", first.cast("string"), F.least(first + size - 1, last).cast("string"))
    return pages.select(*pages.columns, part.alias("part"), ((F.col("pos") - 1) % size + 1).cast("int").alias("part_pos"), name.alias("part_name"))


def extract(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pages in wanted(doc_id, pos), in their own order."""
    return _renumbered(pages.join(wanted.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_semi"))


def delete(pages: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Pages not in unwanted(doc_id, pos); a document never loses all pages: it is left as it is then."""
    left = pages.join(unwanted.select("doc_id", "pos").distinct().withColumn("gone", F.lit(1)), ["doc_id", "pos"], "left")
    none = F.count_if(F.col("gone").isNull()).over(Window.partitionBy("doc_id")) == 0
    return _renumbered(left.withColumn("none", none).where(F.col("gone").isNull() | F.col("none")).drop("gone", "none"))


def reorder(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Pages by order(doc_id, pos, new_pos); documents whose order isn't a permutation are left out."""
    joined = pages.join(order, ["doc_id", "pos"], "full")
    doc = Window.partitionBy("doc_id")
    n = F.count(F.lit(1)).over(doc)
    good = F.min(F.col("new_pos").between(1, n) & F.col("page_id").isNotNull()).over(doc) & (F.size(F.collect_set("new_pos").over(doc)) == n)
    return joined.withColumn("good", good).where("good").drop("good", "pos").withColumnRenamed("new_pos", "pos")


def move(pos: Column, start: Column, to: Column) -> Column:
    """Where a page goes when the page at `start` moves to `to`."""
    return (
        F.when(pos == start, to).when((start < to) & (pos > start) & (pos <= to), pos - 1)
        .when((start > to) & (pos >= to) & (pos < start), pos + 1).otherwise(pos)
    )


def merge(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Documents end to end by files(merged_id, file_ord, doc_id): merged_id, pos, doc_id, page. A running count of the
    files' pages places each file, so the pages of a merged document are never sorted together."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    placed = files.join(counts, "doc_id")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("merged_id").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.select("merged_id", "doc_id", before.alias("before"))
    return pages.join(offsets, "doc_id").select("merged_id", (F.col("before") + F.col("pos")).alias("pos"), "doc_id", F.col("pos").alias("page"))


def rotated(pages: DataFrame, changes: DataFrame, relative: bool = True) -> DataFrame:
    """Rotations after changes(doc_id, pos, turn), relative or absolute; pages without a change keep theirs."""
    from paperloom.functions.geometry import rotation

    j = pages.join(changes, ["doc_id", "pos"], "left")
    turn = F.col("rotation") + F.coalesce("turn", F.lit(0)) if relative else F.coalesce("turn", "rotation")
    return j.withColumn("rotation", rotation(turn.cast("double"))).drop("turn")


def is_identity(order: DataFrame) -> DataFrame:
    """order(doc_id, pos, new_pos) -> doc_id, identity."""
    return order.groupBy("doc_id").agg(F.bool_and(F.col("pos") == F.col("new_pos")).alias("identity"))
