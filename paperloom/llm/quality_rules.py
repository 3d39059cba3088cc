"""Line-first quality rules (operator 7), with DataFrame functions only.

Every line is judged first: too many symbols or exclamation marks for its words, the brackets of code, capitals
throughout, navigation (bars, or nothing but links), boilerplate notices, and lines equal to an earlier line of the text
fail. Failing lines are removed; a document that loses more than `most_lost` of its
characters so, or that fails the base rules (under 50 words; over half of the words in repeated 3-word windows), is
rejected. Arrays stay within a row, so there is no shuffle at all; sorting replaces every search for an equal element, so
the work for a text grows as n log n.

Nulls: a null text has no words and lines and is rejected (n_words < 50); its cleaned text stays null. Lines without a
word never fail and are kept as they are. Rows that repeat are each judged; extra columns stay in `judge` and `clean`,
whatever their names, and are dropped by `report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SPACES, WORD, fresh

SYMBOLS = r"[#*$%&|<>]"
# Notices found at the foot or head of web pages in four languages, as words of their own, and the words of
# links by which pages are walked.
NOTICES = (
    r"licen[cs]ed under", r"copyright(?:s|ed)?", r"all rights reserved", r"cookies", r"cookie (?:polic(?:y|ies)|settings|notice|consent)", r"privacy polic(?:y|ies)", r"terms of (?:use|service)", r"subscribe(?:d|rs?|s)?",
    r"log ?ins?", r"sign ?ups?", r"click here", r"javascript",
    r"alle rechte vorbehalten", r"datenschutz(?:erklärung)?", r"impressum", r"nutzungsbedingungen", r"newsletter",
    r"tous droits réservés", r"politique de confidentialité", r"mentions légales", r"conditions d.utilisation",
    r"todos los derechos reservados", r"política de privacidad", r"aviso legal", r"términos de uso",
)
LINKS = (
    "home", "news", "contact", "contact us", "about", "about us", "next", "previous", "back", "back to top", "menu", "search", "share", "read more", "more", "help", "faq", "sitemap",
    "startseite", "kontakt", "über uns", "weiter", "zurück", "suche", "mehr", "hilfe", "accueil", "à propos", "suivant", "précédent", "recherche", "plus", "aide",
    "inicio", "contacto", "acerca de", "siguiente", "anterior", "buscar", "más", "ayuda",
)
#: A line is boilerplate if it holds a notice and has at most NOTICE_WORDS words, or if notices make up half of its words.
BOILERPLATE = r"(?iu)(?<!\p{L})(?:" + "|".join(NOTICES) + r")(?!\p{L})"
#: A line of nothing but links is navigation; so is one parted by three or more bars.
#: Longer links first and groups possessive, so that Java goes through a line of any length in a loop instead of by calls.
NAVIGATION = r"(?iu)^[\s|/>»›·•–-]*+(?:(?:" + "|".join(sorted(LINKS, key=len, reverse=True)) + r")(?:[\s|/>»›·•–-]++|$))++$"
BARS = r" [|»›·•] "
#: Shares beyond which a line's punctuation isn't that of prose: brackets and slashes of code, and letters that shout.
CODE = r"[{}\[\]()\\/=;^~`@_]"
MOST_CODE, SHOUT_LETTERS, MOST_UPPER = 0.2, 20, 0.8
NOTICE_WORDS = 25
MOST_LOST = 0.5
MIN_WORDS = 50


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, pattern: str) -> Column:
    """Characters of text that match a one-character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("long")


def unnoticed(line: Column) -> Column:
    """Words of a line, marks aside, that belong to no notice."""
    return F.size(F.regexp_extract_all(F.regexp_replace(line, BOILERPLATE, " "), F.lit(rf"{WORD[:-1]}*[\p{{L}}\p{{N}}]{WORD[:-1]}*"), F.lit(0)))


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more. Windows are sorted with their places, by a hash of 64 bits that
    is compared within the text alone; those equal to a neighbour repeat, and each covers three words less what the next
    one covers too."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i")),
        )

    def places(s: Column) -> Column:
        alike = F.filter(s, lambda x, k: (F.get(s, k - 1)["w"].eqNullSafe(x["w"])) | (F.get(s, k + 1)["w"].eqNullSafe(x["w"])))
        return F.array_sort(F.transform(alike, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, n: a + n)

    # Whatever a lambda reads is bound first: an expression inside one would be computed for each element if a filter on
    # the result is moved below the projection.
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(let(F.array_sort(windows(w)), places), covered)))


def judged_lines(text: Column) -> Column:
    """Lines in sorted order with their place, whether they hold a word, equal an earlier line, and fail."""

    def judge(s: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            line = x["line"]
            word = line.rlike(WORD)
            dup = word & F.get(s, k - 1)["line"].eqNullSafe(line)
            words = F.size(F.split(F.trim(line), f"{SPACES}+"))
            symbols = count_of(line, SYMBOLS)
            marks = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!")))
            # So many capitals are asked for first, as hardly a line has them: what the rest names is counted anew each time.
            letters, upper = count_of(line, r"\p{L}"), count_of(line, r"\p{Lu}")
            fails = word & (
                dup
                | ((symbols >= 3) & (symbols > 0.3 * words))
                | (F.regexp_count(line, F.lit(BARS)) >= 3)
                | line.rlike(NAVIGATION)
                | ((marks >= 3) & (marks >= 0.3 * words))
                | (count_of(line, CODE) > MOST_CODE * F.length(line))
                | ((upper > MOST_UPPER * SHOUT_LETTERS) & (letters >= SHOUT_LETTERS) & (upper > MOST_UPPER * letters))
                | (line.rlike(BOILERPLATE) & ((words <= NOTICE_WORDS) | (2 * unnoticed(line) <= words)))
            )
            return F.struct(x["i"].alias("i"), line.alias("line"), word.alias("word"), dup.alias("dup"), fails.alias("fails"))

        return F.transform(s, one)

    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    return let(F.array_sort(lines), judge)


def judge(docs: DataFrame, most_lost: float = MOST_LOST, at: str = "_rules") -> DataFrame:
    """docs with a struct column `at`: the counts, base_failed, lost (share of characters in failing lines) and kept; and
    {at}_lines, the judged lines in their order. `at` must begin no name of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn(f"{at}_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    d = d.withColumn(f"{at}_lines", F.array_sort(judged_lines(text)))
    n_words = F.size(f"{at}_words").cast("long")
    count = lambda f: F.size(F.filter(f"{at}_lines", f)).cast("long")
    chars = lambda f: F.aggregate(f"{at}_lines", F.lit(0).cast("long"), lambda a, x: a + F.when(f(x), F.length(x["line"])).otherwise(0))
    d = d.select(
        *docs.columns,
        f"{at}_lines",
        n_words.alias(f"{at}_n_words"),
        F.aggregate(f"{at}_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias(f"{at}_word_chars"),
        count_of(text, SYMBOLS).alias(f"{at}_n_symbols"),
        count(lambda x: x["dup"]).alias(f"{at}_n_dup_lines"),
        repeated_words(F.col(f"{at}_words")).alias(f"{at}_n_repeat_words"),
        chars(lambda x: x["fails"]).alias(f"{at}_lost"),
        chars(lambda x: x["word"]).alias(f"{at}_all"),
    )
    failed = (F.col(f"{at}_n_words") < MIN_WORDS) | (100 * F.col(f"{at}_n_repeat_words") > 50 * F.col(f"{at}_n_words"))
    lost = F.col(f"{at}_lost") / F.greatest(F.col(f"{at}_all"), F.lit(1))
    rules = F.struct(
        *[F.col(f"{at}_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"), lost.alias("lost"), (~failed & (lost <= most_lost)).alias("kept"),
    )
    return d.select(*docs.columns, f"{at}_lines", rules.alias(at))


def report(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    return judge(docs.select("doc_id", "text"), most_lost).select("doc_id", "_rules.*")


def clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The kept documents without their failing lines; same columns (n_chars follows the text where there is one). A rejected
    document is an empty array that is exploded to no row: a filter by the verdict would be moved below, and texts judged
    twice."""
    at = fresh(docs, "_rules")
    left = F.array_join(F.transform(F.filter(f"{at}_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    left = F.when(F.col("text").isNotNull(), left)
    kept = F.explode(F.when(F.col(f"{at}.kept"), F.array(left)).otherwise(F.array().cast("array<string>"))).alias(f"{at}_left")
    out = judge(docs, most_lost, at).select(*[F.col(c) for c in docs.columns if c != "text"], kept).withColumnRenamed(f"{at}_left", "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
