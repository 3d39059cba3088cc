"""Phrase search: every place where a query stands in a text, white space collapsed, in any case, by an index of words and
their places; and boxes over hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import SPACE, snippet
from paperloom.session import cut

PAD = 1.6


def normalized_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def occurrences(text: Column, needle: Column) -> Column:
    """Starts (code points, from 0) of all occurrences, leftmost and without overlap; none for an empty needle."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("")), F.lit("\\E")), -1)
    lengths = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: F.length(g) + F.length(needle))
    return F.when(F.length(needle) > 0, F.transform(running(lengths), lambda e: e - F.length(needle))).otherwise(F.array().cast("array<int>"))


def running(steps: Column, block: int = 64) -> Column:
    """Running sums of an array of ints: sums of whole blocks first, then within the block, so long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def placed(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / block).cast("int")), lambda b: total(F.slice(n, b * block + 1, F.lit(block))))
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return F.transform(F.array(before), lambda r: F.transform(n, lambda _, k: F.get(r, F.floor(k / block).cast("int")) + total(F.slice(n, (k - k % block + 1).cast("int"), (k % block + 1).cast("int")))))[0]

    return F.transform(F.array(steps), placed)[0]


#: Longest gram by which parts of words are looked up.
GRAM = 3


class Index:
    """Where words stand in texts(*keys, text): `texts`, lower-cased and with white space collapsed; `words`, a row for each word
    of each text with its place and the words beside it; `vocabulary`, distinct words with their numbers of places. Texts are
    stored in the shared folder, as several steps read them; words, too, if the index is to serve several searches."""

    def __init__(self, texts: DataFrame, keys: tuple[str, ...], stored: bool = False):
        keep = cut if stored else lambda df: df
        self.keys = keys
        self.texts = cut(texts.select(*keys, normalized_query(F.lower("text")).alias("text"))).where("text <> ''")
        # A plain explode would ask whether there are words, and part a text twice.
        alone = self.texts.select(*keys, F.split("text", " ").alias("w"))
        beside = F.transform("w", lambda x, k: F.struct(x.alias("word"), F.get("w", k - 1).alias("before"), F.get("w", k + 1).alias("after")))
        self.words = keep(alone.select(*keys, F.posexplode_outer(beside).alias("place", "x")).select(*keys, "place", "x.*"))
        self.vocabulary = cut(alone.select(F.explode_outer("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def _grams(word: Column) -> Column:
    """The parts of a word of up to GRAM characters, each once; its beginnings are marked `<`, its ends `>`."""
    sizes = [F.lit(n) for n in range(1, GRAM + 1)]
    inner = F.flatten(F.transform(F.array(*sizes), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.concat(F.lit("*"), F.substring(word, i, n)))))
    return F.array_distinct(F.concat(inner, F.transform(F.array(*sizes), lambda n: F.concat(F.lit("<"), F.left(word, n))), F.transform(F.array(*sizes), lambda n: F.concat(F.lit(">"), F.right(word, n)))))


def _probes(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, needle, anchor (0 and 1), k, word: the words of the vocabulary that may stand where the query's rarest word
    stands, and where its second rarest does. Inner words of a query stand as they are; its first is the end of a word, its
    last a beginning, an only one a part. Those of three words or more are looked for by inner words alone, of which the rarest is the
    only anchor: `before` and `after` are the inner words that must stand beside it, where it has such."""
    q = queries.select("query_id", normalized_query(F.lower("query")).alias("needle")).where("needle <> ''").withColumn("parts", F.split("needle", " "))
    n = F.size("parts")
    how = F.when(n == 1, "*").when(F.col("k") == 0, ">").when(F.col("k") == n - 1, "<").otherwise("=")
    parts = q.select("query_id", "needle", "parts", F.posexplode("parts").alias("k", "part")).withColumn("how", how).where((n < 3) | (F.col("how") == "="))
    parts = parts.withColumn("looked_for", F.when(n < 3, n).otherwise(n - 2)).drop("parts")
    same = parts.where("how = '='").join(vocabulary, F.col("part") == F.col("word"))
    loose = parts.where("how <> '='")
    # The longest end or beginning that grams tell; of the grams within an only word one from its middle, where words differ most.
    size = F.least(F.length("part"), F.lit(GRAM))
    middle = F.floor((F.length("part") - size) / 2).cast("int") + 1
    gram = F.concat("how", F.when(F.col("how") == "<", F.left("part", size)).when(F.col("how") == ">", F.right("part", size)).otherwise(F.substring(F.col("part"), middle, size)))
    grams = vocabulary.select("word", "n", F.explode_outer(_grams(F.col("word"))).alias("gram"))  # a plain explode would make them twice
    fits = F.when(F.col("how") == "<", F.startswith("word", "part")).when(F.col("how") == ">", F.endswith("word", "part")).otherwise(F.contains("word", "part"))
    near = loose.withColumn("gram", gram).join(grams, "gram").where(fits).drop("gram")
    met = cut(same.unionByName(near))  # read twice
    # A query of which some word stands nowhere has no hits. The parts of a query are few, so a window holds them.
    of_part = met.groupBy("query_id", "needle", "looked_for", "k").agg(F.sum("n").alias("places"))
    one = Window.partitionBy("query_id", "needle")
    rank = of_part.withColumn("anchor", F.row_number().over(one.orderBy("places", "k")) - 1).withColumn("met", F.count(F.lit(1)).over(one))
    words = F.split("needle", " ")
    long = F.size(words) > 2
    inner = lambda k: F.when(long & (k > 0) & (k < F.size(words) - 1), F.get(words, k))
    rank = rank.where((F.col("met") == F.col("looked_for")) & (F.col("anchor") < F.when(long, 1).otherwise(2)))
    rank = rank.select("query_id", "needle", "k", "anchor", F.when(long, 1).otherwise(F.least("met", F.lit(2))).alias("anchors"), inner(F.col("k") - 1).alias("before"), inner(F.col("k") + 1).alias("after"))
    return rank.join(met.select("query_id", "needle", "k", "word"), ["query_id", "needle", "k"])


def find(index: Index, queries: DataFrame) -> DataFrame:
    """Hits of queries(query_id, query) in an index's texts: query_id, keys, start, end, text. Words are met by equality only.
    Where the rarest inner word of a query stands with its neighbours beside it, or the two words of a short one at their distance, the text is
    looked through; any white space of the text, line ends too, parts words."""
    probes = cut(_probes(queries, index.vocabulary)).alias("p")
    words = index.words.alias("w")
    beside = lambda side: F.col(f"p.{side}").isNull() | F.coalesce(F.col(f"p.{side}") == F.col(f"w.{side}"), F.lit(False))
    at = words.join(probes, (F.col("w.word") == F.col("p.word")) & beside("before") & beside("after")).select("query_id", "needle", *index.keys, (F.col("place") - F.col("k")).alias("at"), "anchor", "anchors")
    places = at.where("anchor = 0")
    second = at.where("anchor = 1").select("query_id", "needle", *index.keys, "at")
    both = places.where("anchors = 2").join(second, ["query_id", "needle", *index.keys, "at"], "left_semi")
    met = both.unionByName(places.where("anchors = 1")).select("query_id", "needle", *index.keys).distinct()
    # Most texts don't hold the query; a plain explode would ask for places, and look for them twice.
    hits = met.join(index.texts, [*index.keys]).where(F.contains("text", "needle")).withColumn("start", F.explode_outer(occurrences(F.col("text"), F.col("needle")))).where("start is not null")
    return hits.select("query_id", *index.keys, "start", (F.col("start") + F.length("needle")).alias("end"), "text")


def find_lines(lines: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of queries(query_id, query) in lines(doc_id, seq, text): place and snippet."""
    hits = find(Index(lines, ("doc_id", "seq")), queries)
    return hits.select("query_id", "doc_id", "seq", "start", "end", snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


def find_pages(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of queries(query_id, query) in pages(doc_id, page, text), over line ends too: place and snippet."""
    hits = find(Index(pages, ("doc_id", "page")), queries)
    return hits.select("query_id", "doc_id", "page", "start", "end", snippet(F.col("text"), F.col("start"), F.col("end")).alias("snippet"))


def hit_boxes(runs: DataFrame, query: str) -> DataFrame:
    """Boxes of a query in the runs of a line: text runs end to end, blanks between runs, box by proportional widths."""
    line = runs.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x", "ord", "text", "y", "width", "height"))).alias("runs"))
    needle = normalized_query(F.lower(F.lit(query)))
    text = F.lower(F.array_join(F.transform("runs", lambda r: r["text"]), " "))
    d = line.withColumn("start", F.explode(occurrences(text, needle))).withColumn("end", F.col("start") + F.length(needle))
    # Each run's characters begin one after the end of the run before it.
    at = F.transform(running(F.transform("runs", lambda r: F.length(r["text"]) + 1)), lambda e, k: e - F.length(F.get("runs", k)["text"]) - 1)
    d = d.withColumn("piece", F.explode(F.arrays_zip("runs", at.alias("at"))))
    r, begin = F.col("piece.runs"), F.col("piece.at")
    n = F.length(r["text"])
    low, high = F.greatest(F.col("start") - begin, F.lit(0)), F.least(F.col("end") - begin, n)
    step = F.try_divide(r["width"], n)
    d = d.where(low < high)
    return d.select(
        "doc_id", "page", "line", "start", (r["x"] + low * step - PAD).alias("x"), (r["y"] - PAD).alias("y"), ((high - low) * step + 2 * PAD).alias("width"), (r["height"] + 2 * PAD).alias("height")
    )
