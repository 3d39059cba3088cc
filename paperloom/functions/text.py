"""Text scalars of the layout engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the document format's scripts see it, number and total patterns, and width classes.
SPACE = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
TOTAL = r"(?i)\b(total|subtotal|sum|amount due|balance due|grand total)\b"
ARITHMETIC = r"(-?\d[\d,]*(?:\.\d+)?)\s*([x×*+\-/÷])\s*(-?\d[\d,]*(?:\.\d+)?)\s*=\s*(-?\d[\d,]*(?:\.\d+)?)"
AMOUNT = r"^-?\$?-?[\d,]+(?:\.\d+)?%?-?$"
MONEY = r"^-?\$?-?[\d,]+\.\d{2}%?-?$"
NO_AMOUNT = f"[^{SPACE[1:-1]}\u0085\u2013\u2014\u2212()$%,.0-9-]"
PRINTABLE = r"[^\x20-\x7E\t\u00A0-\x{10FFFF}]"
ESCAPE = r"\\[A-Za-z]"
GROUPS = r"(?<=\d)[, ](?=\d{3}(?:\D|$))"
MONEY_MARKS = r"[,$€£¥]"
WIDTHS = ((r"[ ]", 0.28), (r"[iljtfr.,:;'\"|!\[\]()]", 0.31), (r"[A-Z0-9]", 0.63), (r"[mw]", 0.85))
OTHER_WIDTH = 0.52


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a column that only its parts are read of would be worked out for each part. The end of an empty
    fold, since an item taken of an array has its type told anew for each row, which walks through all of the body."""
    return F.aggregate(F.array(), value, lambda v, _: v, body)


def number(raw: Column) -> Column:
    """A figure with thousands separators as a double."""
    return F.replace(raw, F.lit(","), F.lit("")).cast("double")


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)


def estimate_width(text: Column, size: Column | float) -> Column:
    """Rough width: a class width for each character, times the font size; the first class that fits counts."""
    units, counted = F.lit(0.0), F.lit(0)
    for pattern, width in WIDTHS:
        n = F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))
        units, counted = units + n * width, counted + n
    units = units + (F.length(text) - counted) * OTHER_WIDTH
    return units * (F.lit(size) if isinstance(size, (int, float)) else size)


def fit_font_size(text: Column, size: Column, width: Column) -> Column:
    """The largest size, in steps of a quarter down from the given one and not under 4, at which the text fits."""
    units = estimate_width(text, 1.0)
    steps = F.greatest(F.ceil((size - F.try_divide(width, units)) / 0.25 - 1e-9), F.lit(0))
    return F.when(units * size <= width, F.greatest(size, F.lit(4.0))).otherwise(F.greatest(size - steps * 0.25, F.lit(4.0)))


def fold_punctuation(text: Column) -> Column:
    """Odd spaces, dashes and quotes to their plain forms; the soft hyphen goes."""
    return F.translate(F.translate(text, "\u00ad", ""), "\u00a0\u202f\u2007\u2009\u2212\u2010\u2011\u2012\u2013\u2018\u2019\u201c\u201d", "    -----''\"\"")


def normalize(text: Column) -> Column:
    """Folded, white space collapsed, trimmed: the key under which texts are matched."""
    return F.trim(F.regexp_replace(fold_punctuation(text), f"{SPACE}+", " "))


def loose_amount_key(text: Column) -> Column:
    """The key without separators before groups of three digits."""
    return F.regexp_replace(normalize(text), GROUPS, "")


def soft_match_key(text: Column) -> Column:
    """The key without blanks around hyphens."""
    return F.regexp_replace(normalize(text), r"\s*-\s*", "-")


def same_visible_run(a: Column, b: Column) -> Column:
    return (normalize(a) == normalize(b)) | (loose_amount_key(a) == loose_amount_key(b)) | (soft_match_key(a) == soft_match_key(b))


def compact_money(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, f"{SPACE}+", ""), "\u2013\u2014\u2212", "---")


def _amount(text: Column, pattern: str) -> Column:
    """Most texts are told by one look: figures as they stand, or a character that no amount has. Only others are made compact."""
    c = compact_money(text)
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    wrapped = c.startswith("(") & c.endswith(")") & (F.length(c) > 2)
    odd = c.rlike(r"\d") & F.when(wrapped, ~inner.rlike(r"[()]") & inner.rlike(pattern)).otherwise(~c.rlike(r"[()]") & c.rlike(pattern))
    return text.rlike(f"^(?=\\D*\\d){pattern[1:]}") | (~text.rlike(NO_AMOUNT) & odd)


def looks_like_amount(text: Column) -> Column:
    """An accounting amount: sign before or after, dollar, percent, thousands separators, or in parentheses."""
    return _amount(text, AMOUNT)


def looks_like_money(text: Column) -> Column:
    """The same with exactly two decimals."""
    return _amount(text, MONEY)


def looks_garbled(text: Column) -> Column:
    """Blank, with backslashes, or with under four fifths printable characters."""
    t = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    n = F.length(t)
    printable = F.length(F.regexp_replace(t, PRINTABLE, ""))
    return (n == 0) | (n - F.length(F.replace(t, F.lit("\\"), F.lit(""))) >= 2) | t.rlike(ESCAPE) | (printable < 0.8 * n)


def readable(stream: Column, visual: Column) -> Column:
    """Of a stream's and a viewer's text for one run the one to show: what isn't garbled; of two good ones that are the same
    run the one with money marks, else the longer; the viewer's if they differ."""
    a, b = (F.trim(F.regexp_replace(c, r"[ \t]+", " ")) for c in (stream, visual))
    bad_a, bad_b = looks_garbled(a), looks_garbled(b)
    same = F.when(a.rlike(MONEY_MARKS) & ~b.rlike(MONEY_MARKS), a).when(F.length(a) >= F.length(b), a).otherwise(b)
    return F.when((b == "") | (a == b), a).when(a == "", b).when(~bad_a & ~bad_b & same_visible_run(a, b), same).when(bad_b, a).otherwise(b)


def sanitized(text: Column) -> Column:
    """Without control characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), f"{SPACE}+", " "))


def format_like(sample: Column, value: Column) -> Column:
    """A figure with the sample's number of decimals and its grouping. Halves of the shortest decimal form go up."""
    decimals = F.when(sample.contains("."), F.length(F.split(sample, r"\.")[1])).otherwise(0)
    fixed = F.round(value.cast("decimal(30,12)"), 12)
    out = F.lit(None).cast("string")
    for d in range(7):
        plain = F.round(fixed, d).cast(f"decimal(30,{d})").cast("string")
        out = F.when(decimals == d, plain).otherwise(out)
    whole, rest = F.regexp_extract(out, r"^(-?\d+)", 1), F.regexp_extract(out, r"^-?\d+(.*)$", 1)
    return F.when(sample.contains(","), F.concat(F.regexp_replace(whole, r"\B(?=(?:\d{3})++$)", ","), rest)).otherwise(out)


def aligned(text: Column) -> Column:
    """The characters that count when texts are laid over each other, folded, with their places: no white space, hyphens
    and commas between digits."""
    chars = F.split(text, "(?!^)")

    def kept(c: Column) -> Column:
        at = lambda k: F.coalesce(F.get(c, k), F.lit(""))
        told = F.transform(c, lambda ch, k: F.struct(fold_punctuation(ch).alias("ch"), k.alias("at"), ((ch == ",") & at(k - 1).rlike(r"^\d$") & at(k + 1).rlike(r"^\d$")).alias("comma")))
        return F.filter(told, lambda x: (x["ch"] != "") & ~x["ch"].rlike(f"^{SPACE}$") & (x["ch"] != "-") & ~x["comma"])

    return F.transform(F.array(chars), kept)[0]


def aligned_key(text: Column) -> Column:
    """The characters that count, as one text."""
    return F.regexp_replace(fold_punctuation(text), f"[{SPACE[1:-1]}-]|(?<=[0-9]),(?=[0-9])", "")


#: Least number of counting characters of a text that is looked for by alignment.
LEAST_ALIGNED = 6


def fuzzy_span(text: Column, needle: Column) -> Column:
    """Where a needle stands in a text, as a struct of start and end: as it is, with folded punctuation, or laid over it
    without white space, hyphens and grouping commas (six characters at least). Null where it doesn't."""
    folded = fold_punctuation(needle)
    span = lambda at, n: F.struct((at - 1).alias("start"), (at - 1 + n).alias("end"))

    def over(p: Column) -> Column:
        joined = lambda side: F.array_join(F.transform(p[side], lambda x: x["ch"]), "")
        n = F.size(p["n"])
        return F.transform(
            F.array(F.instr(joined("t"), joined("n"))),
            lambda at: F.when((n >= LEAST_ALIGNED) & (at > 0), F.struct(F.get(p["t"], at - 1)["at"].alias("start"), (F.get(p["t"], at + n - 2)["at"] + 1).alias("end"))),
        )[0]

    laid = F.transform(F.array(F.struct(aligned(text).alias("t"), aligned(needle).alias("n"))), over)[0]
    found = F.when(F.contains(text, needle), span(F.instr(text, needle), F.length(needle))).when((folded != "") & F.contains(text, folded), span(F.instr(text, folded), F.length(folded))).otherwise(laid)
    return F.when((text != "") & (F.trim(needle) != ""), found)


def spliced(text: Column, needle: Column, new: Column) -> Column:
    """The text with the needle's place taken by another text; null where it has none."""
    at = fuzzy_span(text, needle)
    return F.transform(F.array(at), lambda s: F.concat(F.substring(text, F.lit(1), s["start"]), new, F.substring(text, s["end"] + 1, F.length(text))))[0]


def same_text(stream: Column, visual: Column) -> Column:
    """Whether a stream's text and a viewer's are the same run, or one holds the other."""
    held = fuzzy_span(stream, visual).isNotNull() | fuzzy_span(visual, stream).isNotNull()
    return (stream == visual) | same_visible_run(stream, visual) | ((F.trim(stream) != "") & (F.trim(visual) != "") & held)


def clean_copy(text: Column) -> Column:
    """Plain spaces, none before punctuation, one after ; : and commas outside figures, repeated words once."""
    out = F.translate(text, "\u00a0", " ")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, f"{SPACE}+([,.;:!?%])", "$1")
    out = F.regexp_replace(out, f"([;:])(?=[^{SPACE[1:-1]}])", "$1 ")
    out = F.regexp_replace(out, f",(?=[^{SPACE[1:-1]}])(?!(?<=[0-9],)[0-9])", ", ")
    edge, after = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    return F.trim(F.regexp_replace(out, rf"(?iu){edge}(\p{{L}}++)(?:{SPACE}++\1{after})++", "$1"))


def page_ranges(text: Column, pages: Column) -> Column:
    """Pages named by "1-3, 7", first seen first; null if a part isn't a page or a range within the document."""
    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda p: p != "")
    good = lambda p: F.when(p.rlike(r"^\d{1,9}$"), p.cast("int").between(1, pages)).when(
        p.rlike(r"^\d{1,9}-\d{1,9}$"),
        (F.split(p, "-")[0].cast("int") >= 1) & (F.split(p, "-")[1].cast("int") <= pages) & (F.split(p, "-")[0].cast("int") <= F.split(p, "-")[1].cast("int")),
    ).otherwise(F.lit(False))
    expand = lambda p: F.when(p.contains("-"), F.sequence(F.split(p, "-")[0].cast("int"), F.try_element_at(F.split(p, "-"), F.lit(2)).cast("int"))).otherwise(F.array(p.cast("int")))
    return F.when((F.size(parts) > 0) & F.forall(parts, good), F.array_distinct(F.flatten(F.transform(parts, expand))))


def snippet(text: Column, start: Column, end: Column, radius: int = 28) -> Column:
    """The text around [start, end), with ellipses where it is cut."""
    low, high = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(text, low + 1, high - low), F.when(high < F.length(text), "…").otherwise(""))
