"""Edited text back onto the runs and columns it came from, text that must fit a width, and lines matched with shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import clean_copy, estimate_width, let, looks_like_amount, normalize

# Phrases that a text can do without, in the order in which they go, and what stands for them.
FILLERS = (
    ("please note that", ""), ("in order to", "to"), ("at this point in time", "now"), ("as a matter of fact", ""), ("kindly", ""), ("very", ""), ("just", ""), ("really", ""), ("that", ""),
)


def split_across_runs(runs: DataFrame, drafts: DataFrame, by: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """runs(by, ord, text) and one draft a line: each run gets as many words as it had (one at least), the last run the rest."""
    w = Window.partitionBy(*by).orderBy("ord")
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    take = F.greatest(F.size(words("text")), F.lit(1))
    r = runs.withColumn("take", take).withColumn("from", F.coalesce(F.sum("take").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    r = r.withColumn("is_last", F.lead("ord").over(w).isNull()).join(drafts.select(*by, words("draft").alias("words")), [*by])
    count = F.when(F.col("is_last"), F.size("words")).otherwise(F.col("take"))
    part = F.when(F.col("from") < F.size("words"), F.slice("words", F.col("from") + 1, F.greatest(count, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return r.select(*by, "ord", F.array_join(part, " ").alias("draft"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")


def _alike(token: Column, text: Column) -> Column:
    """Whether a token and a text are the same by their key. A token of plain characters is its own key, which a text of plain ones must hold
    as it stands, so most pairs are told apart without keys."""
    plain = (F.octet_length(token) == F.length(token)) & (F.octet_length(text) == F.length(text))
    return (token == text) | ((~plain | F.contains(text, token)) & (normalize(token) == normalize(text)))


def across_columns(columns: Column, draft: Column) -> Column:
    """A draft dealt onto a line's columns (texts from the left), from the right: a column that held an amount takes the
    last token left if that is an amount or the same text; another takes as many as it had; the first takes the rest. What a column
    takes is asked once."""

    def dealt(s: Column) -> Column:
        begin = F.struct(F.size(s["w"]).alias("end"), F.array().cast("array<string>").alias("out"))

        def add(a: Column, c: Column) -> Column:
            own = let(F.coalesce(F.get(s["w"], a["end"] - 1), F.lit("")), lambda last: (looks_like_amount(last) | _alike(last, c)).cast("int"))
            n = F.when(a["end"] == 0, 0).when(looks_like_amount(c), own).otherwise(F.least(F.greatest(F.size(_words(c)), F.lit(1)), a["end"]))
            part = lambda n: F.when(n == 1, F.get(s["w"], a["end"] - 1)).when(n > 0, F.array_join(F.slice(s["w"], a["end"] - n + 1, n), " ")).otherwise("")
            return let(n, lambda n: F.struct((a["end"] - n).alias("end"), F.concat(F.array(part(n)), a["out"]).alias("out")))

        done = F.aggregate(F.reverse(F.slice(s["c"], F.lit(2), F.greatest(F.size(s["c"]) - 1, F.lit(0)))), begin, add)
        return let(done, lambda x: F.concat(F.array(F.array_join(F.slice(s["w"], F.lit(1), x["end"]), " ")), x["out"]))

    spread = let(F.struct(columns.alias("c"), _words(draft).alias("w")), dealt)
    return F.when(F.size(columns) == 1, F.array(draft)).otherwise(spread)


def across_runs(texts: Column, draft: Column) -> Column:
    """The same as split_across_runs for the texts of one line's runs in order, as an array of drafts."""

    def dealt(words: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def add(a: Column, text: Column) -> Column:
            return let(F.greatest(F.size(_words(text)), F.lit(1)), lambda n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(F.array_join(F.slice(words, a["at"] + 1, n), " "))).alias("out")))

        done = F.aggregate(F.slice(texts, F.lit(1), F.size(texts) - 1), begin, add)
        return let(done, lambda x: F.concat(x["out"], F.array(F.array_join(F.slice(words, x["at"] + 1, F.greatest(F.size(words), F.lit(1))), " "))))

    return let(_words(F.coalesce(draft, F.lit(""))), dealt)


def wrapped(text: Column, size: float, width: float) -> Column:
    """Lines of whole words that fit a width; a word that is too wide has a line of its own."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def add(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        longer = F.concat_ws(" ", last, word)
        return F.when(last.isNotNull() & (estimate_width(longer, size) <= width), F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(longer))).otherwise(F.concat(lines, F.array(word)))

    return F.aggregate(words, F.array().cast("array<string>"), add)


def shortened(rows: DataFrame, text: str, size: float, width: float) -> DataFrame:
    """`text` cleaned and, while too wide, without fillers one by one, then cut after the last word that fits with an ellipsis.
    One projection for each filler, so that every step is computed once."""
    d = rows.withColumn(text, clean_copy(F.col(text)))
    for phrase, to in FILLERS:
        now = F.col(text)
        shorter = clean_copy(F.regexp_replace(now, rf"(?i)(?<![A-Za-z0-9_]){phrase}(?![A-Za-z0-9_])", to))
        d = d.withColumn(text, F.when(estimate_width(now, size) <= width, now).otherwise(shorter))
    words = F.split(text, " ")
    # The most words that fit; one at least.
    fits = F.filter(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: (n == 1) | (estimate_width(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…")), size) <= width))
    cut = F.concat(F.array_join(F.slice(words, F.lit(1), F.get(fits, F.lit(0))), " "), F.lit("…"))
    return d.withColumn(text, F.when(estimate_width(F.col(text), size) <= width, F.col(text)).otherwise(cut))


def match_lines(lines: DataFrame, shows: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """For each page the number of lines, of lines that equal some show after normalisation, and their ratio (1 without
    lines)."""
    keys = shows.select(*by, normalize(F.col("text")).alias("key")).where("key <> ''").distinct().withColumn("met", F.lit(1))
    j = lines.select(*by, normalize(F.col("text")).alias("key")).join(keys, [*by, "key"], "left")
    g = j.groupBy(*by).agg(F.sum((F.col("key") != "").cast("int")).alias("n_lines"), F.coalesce(F.sum("met"), F.lit(0)).alias("n_matched"))
    return g.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_matched"), F.col("n_lines")), F.lit(1.0)))
