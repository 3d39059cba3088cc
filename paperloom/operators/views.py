"""Layout tables made from the driver's tables: lines, positioned runs, pages, marks, signers and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import estimate_width
from paperloom.session import parts_of, table

MONEY = "decimal(18,2)"


def money(c: str) -> Column:
    return F.col(c).cast(MONEY).cast("string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, text: the lines of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))


def order_items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Items of orders with their part; order and line number don't identify an item in the driver's tables, so lines are
    numbered anew. `more`: further columns of items. Parts are met first and lines numbered last, so that what comes of it lies
    by order, and operators by document or page don't shuffle it again. In a stated number of partitions that follows the number of
    items, since much is made of an item, which sizes don't tell. Items are numbered before those without a part go and those with several are repeated."""
    item = table(spark, sf_dir, "lineitem").select(*more, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice")).alias("parts"))
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    met = item.join(part, item.l_partkey == part.p_partkey, "left").drop("p_partkey")
    met = met.repartition(parts_of(table(spark, sf_dir, "lineitem")), "l_orderkey").withColumn("line", line)
    return met.select(*item.columns, "line", F.inline("parts"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, text: an invoice for each order, a row for each item and a total line at the end."""
    rows = order_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("line").alias("seq"),
        F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"), money("p_retailprice"), money("l_extendedprice")).alias("text"),
    )
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1000).alias("seq"), F.concat(F.lit("Total due "), money("o_totalprice")).alias("text"))
    return rows.union(totals)


def rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, page, line, cells: each item as a line of four cells (ord, x, text) from the left. `more`: further columns of items."""
    cells = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit(56.0).alias("x"), F.col("p_name").alias("text")),
        F.struct(F.lit(1).alias("ord"), F.lit(360.0).alias("x"), F.col("l_quantity").cast("int").cast("string").alias("text")),
        F.struct(F.lit(2).alias("ord"), F.lit(420.0).alias("x"), money("p_retailprice").alias("text")),
        F.struct(F.lit(3).alias("ord"), F.lit(490.0).alias("x"), money("l_extendedprice").alias("text")),
    )
    return order_items(spark, sf_dir, *more).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "line", *more, cells.alias("cells"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, line, ord, text, x, y, width, height, font_size, font: four positioned runs for each item."""
    flat = rows(spark, sf_dir).select("doc_id", "page", "line", F.explode("cells").alias("c"))
    return flat.select(
        "doc_id", "page", "line", "c.ord", "c.text", "c.x", (F.lit(700.0) - 18.0 * F.col("line")).alias("y"),
        estimate_width(F.col("c.text"), 9.0).alias("width"), F.lit(9.0).alias("height"), F.lit(9.0).alias("font_size"),
        F.when(F.col("c.ord") == 0, "F1").otherwise("F2").alias("font"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over runs: an erase mark where doc and line sum to a multiple of 7, a highlight for multiples of 5."""
    r = runs(spark, sf_dir).where("ord = 3")
    key = F.col("doc_id") + F.col("line")
    kind = F.when(key % 7 == 0, "erase").when(key % 5 == 0, "highlight")
    return r.select("doc_id", "page", "line", kind.alias("kind"), (F.col("x") - 8).alias("x"), "y", (F.col("width") + 4).alias("width"), "height").where("kind is not null")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, page_id, rotation: a customer's orders as the pages of a document, in order of their key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id"))
    return o.select("doc_id", place.alias("pos"), "page_id", (F.col("page_id") % 4 * 90).cast("int").alias("rotation"))


def sign_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signer, stage, field, required, filled: fields of events, signers are users, stage their id modulo 5."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("signer"), (F.col("user_id") % 50).alias("packet"), (F.col("user_id") % 5).alias("stage"), F.col("event_id").alias("field"),
        (F.col("event_id") % 3 != 0).alias("required"), (F.col("event_type") == "purchase").alias("filled"), "ts",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ord, text, confidence, x0, y0, x1, y1: words of conversation turns as a recognizer would give them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "text"))
    conf = F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17 + F.col("i") * 13, F.lit(101)).cast("double")
    x0, y0 = (F.col("i") % 12 * 40).cast("double"), (F.floor(F.col("i") / 12) * 14 + F.col("i") % 3).cast("double")
    return c.where("text <> ''").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("i").alias("ord"), "text", conf.alias("confidence"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10).alias("y1"),
    )
