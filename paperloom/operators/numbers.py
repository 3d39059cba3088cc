"""Number checks over lines of text: sums that do not hold, and totals that do not match the amounts above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import ARITHMETIC, NUMBER, TOTAL, number

#: Amounts above a total that are read, and how far figures may differ.
MOST_ABOVE = 40
TOLERANCE = 0.005


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) < TOLERANCE


def arithmetic(lines: DataFrame) -> DataFrame:
    """Lines(doc_id, seq, text) with "a op b = c" that does not hold: the figures, and the severity."""
    part = lambda k: F.regexp_extract("text", ARITHMETIC, k)
    m = lines.where(F.col("text").rlike(ARITHMETIC)).select(
        "doc_id", "seq", number(part(1)).alias("left"), part(2).alias("op"), number(part(3)).alias("right"), number(part(4)).alias("claimed")
    )
    a, b = F.col("left"), F.col("right")
    actual = F.when(F.col("op") == "+", a + b).when(F.col("op") == "-", a - b).when(F.col("op").isin("/", "÷"), F.try_divide(a, b)).otherwise(a * b)
    m = m.withColumn("actual", actual).where(F.col("actual").isNotNull() & ~_near(F.col("actual"), F.col("claimed")))
    return m.select("doc_id", "seq", F.lit("arithmetic").alias("kind"), F.lit("error").alias("severity"), F.lit(2).cast("long").alias("n"), "actual", "claimed")


def totals(lines: DataFrame) -> DataFrame:
    """Total lines whose amount differs from the sum of up to 40 amounts above, read upwards until the previous total line
    or, after two amounts, until a line that isn't a row of figures. An amount is the last figure of a row of two or more.

    One shuffle by document serves all windows; a document's lines are its unit of work.
    """
    down, up = Window.partitionBy("doc_id").orderBy("seq"), Window.partitionBy("doc_id", "island").orderBy(F.desc("seq"))
    d = lines.where("text is not null and text <> ''").select(
        "doc_id", "seq", F.col("text").rlike(TOTAL).alias("total"), F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)).alias("nums")
    )
    d = d.withColumn("last", F.try_element_at("nums", F.lit(-1)))
    # A total line closes its own island.
    d = d.withColumn("island", F.coalesce(F.sum(F.col("total").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = ~F.col("total") & (F.size("nums") >= 2)
    d = d.withColumn("amount", row & ~(~F.col("last").rlike("[.,]") & (number(F.col("last")) < 10)))
    below = F.coalesce(F.sum(F.col("amount").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("below", below)
    stop = ~F.col("total") & (F.size("nums") < 2) & (F.col("below") >= 2)
    stopped = F.coalesce(F.max(stop.cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    d = d.withColumn("counts", F.col("amount") & (F.col("below") < MOST_ABOVE) & (stopped == 0))
    g = d.groupBy("doc_id", "island").agg(
        F.count_if("counts").alias("n"), F.sum(F.when(F.col("counts"), number(F.col("last")))).alias("actual"),
        F.max(F.when(F.col("total"), F.col("seq"))).alias("seq"), F.max(F.when(F.col("total"), number(F.col("last")))).alias("claimed"),
    )
    wrong = (F.col("n") >= 2) & F.col("claimed").isNotNull() & ~_near(F.col("actual"), F.col("claimed"))
    apart = F.abs(F.col("actual") - F.col("claimed")) > F.greatest(F.lit(0.5), F.abs(F.col("claimed")) * 0.005)
    return g.where(wrong).select("doc_id", "seq", F.lit("total").alias("kind"), F.when(apart, "error").otherwise("warning").alias("severity"), "n", "actual", "claimed")


def check_numbers(lines: DataFrame) -> DataFrame:
    return arithmetic(lines).unionByName(totals(lines))
