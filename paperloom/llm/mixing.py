"""Mixing sources to target weights (operator 8).

Each source gets a share of all words by weight, at most `cap` times its own size; what a cap leaves over is shared
again among the others by weight. A source first takes as many complete epochs as fit in its target. The rest is drawn
without replacement by Efraimidis and Spirakis: every document gets the key -ln(u) / quality, u a hash of its id, and
documents are taken in order of the key until the remaining words are used up; the last one is taken in part.

Order within a source is never put into one task: keys are cut into many fixed ranges, sizes are summed by range, and the
running sum within a range starts from the sum of the ranges before.

Nulls: a null text has size 0 and takes 0; a null source is a source of its own, last in order. Empty tables give empty
results; a source with only empty texts has target 0. Rows that repeat are each drawn on their own. Columns named like
the results are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import SPACES, WORD, cut, fresh

#: Words by document over which keys spread: about so many documents fall in one range.
DOCS_A_RANGE = 128
MOST_RANGES = 1 << 16


def quality(text: Column) -> Column:
    """A document's quality weight, 0.1 to 1.1: the share of letters among what isn't white space, times the share of
    distinct lines, times a share that is whole where every line ends as a sentence does."""
    plain = F.regexp_replace(text, rf"{SPACES}+", "")
    letters = (F.length(plain) - F.length(F.regexp_replace(plain, r"\p{L}+", ""))) / F.greatest(F.length(plain), F.lit(1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def weight(found: Column) -> Column:
        n = F.greatest(F.size(found), F.lit(1))
        ended = F.size(F.filter(found, lambda x: x.rlike(r"[.!?…:\"”»)]\s*$"))) / n
        return (F.size(F.array_distinct(found)) / n) * (0.5 + 0.5 * ended)

    return F.lit(0.1) + letters * F.transform(F.array(lines), weight)[0]  # the lines are split once


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place`, from 0 in order of source (null last). Ranges of sources are sorted each on their own; what
    comes before a range is summed over the ranges, whose number doesn't grow with the sources."""
    names = (F.col("source").isNull(), F.col("source"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sources.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    placed = cut(placed.withColumn("row", F.monotonically_increasing_id()))  # written, so that ranges stay as they were
    part = F.shiftright("row", 33)
    before = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.withColumn("place", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("part", "row", "before")


def targets(sizes: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> the same with weight and target. One row for each source; sources are told apart as in
    groupBy. Each round of sharing is an aggregate over the table of sources; nothing but its sums comes to the driver."""
    rows = ranked(sizes)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    rows = cut(rows.withColumn("source_size", F.col("source_size").cast("long")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    left, parts = total, None
    while True:
        # A source is capped if its share at the present level is above its cap; a level only rises, so caps stay.
        # Sizes are longs throughout: a weight times all words of a few GB is beyond an int.
        capped = F.lit(False) if parts is None else F.col("weight").cast("long") * F.lit(left) >= F.col("source_size") * F.lit(cap) * F.lit(parts)
        held, free = rows.agg(
            F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("weight").cast("long")))
        ).first()
        now = (total - (held or 0), free or 0)
        if now == (left, parts) or not now[1]:
            break
        left, parts = now
    level = left / parts if parts else 0.0
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(cap))).cast("double"))


def mix(docs: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 8) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken for each row of docs(doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text")), 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(uniform) / F.coalesce(quality(F.col("text")), F.lit(1.0))
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    plan = targets(sizes, cap, weights).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
        F.least(F.lit(MOST_RANGES), F.ceil(F.col("docs") / DOCS_A_RANGE)).cast("long").alias("ranges"),
    )
    plan = plan.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    same = F.col("p.source").eqNullSafe(F.col("r.source"))
    joined = rows.alias("r").join(plan.alias("p"), same).select("r.*", "source_size", "target", "epochs", "rest", "ranges")
    # exp(-key) keeps the order of keys (reversed) and is spread over (0, 1), so ranges get similar numbers of documents.
    joined = joined.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges")).cast("long"))
    sums = joined.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "range", F.coalesce(before, F.lit(0)).alias("before"))
    placed = joined.alias("j").join(
        offsets.alias("o"), F.col("j.source").eqNullSafe(F.col("o.source")) & (F.col("j.range") == F.col("o.range"))
    ).select("j.*", "before")
    run = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("before") + F.sum("size").over(run)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("until") - F.col("size"))))
    return placed.withColumn("until", until).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    )


TAKEN = ("mix_words", "mix_epochs", "mix_taken")


def taken_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which the mixture takes words, with mix_words (size), mix_epochs and mix_taken; columns of docs
    with these names are replaced. Rows that share doc_id, source and size get one number each, larger ones first in order
    of a hash of the text."""
    at = fresh(docs, "_mix")
    key = [f"{at}_id", f"{at}_source", f"{at}_size"]
    mixed = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]), "epochs", "taken")
    docs = docs.drop(*TAKEN)
    d = docs.withColumn(f"{at}_words", F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0)))
    same = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (F.col(f"{at}_words") == F.col(key[2]))
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        d = d.withColumn(f"{at}_row", F.row_number().over(Window.partitionBy("doc_id", "source", f"{at}_words").orderBy(F.xxhash64("text"))))
        mixed = mixed.withColumn(f"{at}_nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("taken"))))
        same = same & (F.col(f"{at}_row") == F.col(f"{at}_nth"))
    return d.join(mixed, same).select(*[F.col(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip((key[2], "epochs", "taken"), TAKEN)])
