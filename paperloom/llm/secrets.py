r"""Secret scans (operator 4), with DataFrame functions only.

Base spans come from three patterns. The method adds spans for strings that look drawn at random:

1. Candidates are runs of 20 or more letters, digits and +/_=- with a letter and a digit, apart from base spans and UUIDs.
2. The encoding is inferred from the symbols: hex, base32, or base64 (with the URL alphabet); symbols become numbers.
3. A battery tests each against uniform draws from that alphabet: chi-squared over eight equal bins, runs above and below
   the middle, and serial correlation at lag 1. Their least p-value, times three, is the battery's.
4. The null hypothesis that a discovery rejects is ordinary text, a chain that tends to stay in a class of symbols. The
   p-value is 1 where the battery's is under BATTERY (the string is no uniform draw), else the inverse likelihood ratio of
   uniform draws against the chain: P(ratio >= c) <= 1/c at every length, and a condition can only make that rarer.
5. Benjamini and Hochberg's rule at FDR picks the accepted ones, by length class over all documents, so the rate holds for
   what is returned. Only the counts by length class and p-value bin (a fixed number of bins) are gathered.

Positions are code points, end exclusive. They come from the lengths of what lies between matches, summed in two levels,
so that many matches in a long text stay cheap.

Nulls: a null text is empty and has no spans. Rows that repeat are each scanned; extra columns stay in `scan` and
`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: The battery's level, the false-discovery rate, and the lower ends of the length classes.
BATTERY, FDR = 0.001, 0.01
LENGTHS = (20, 32, 64)
#: p-values are kept as whole tenths of -log10(p), at most MOST_BINS.
MOST_BINS = 3000
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def sums_before(steps: Column) -> Column:
    """For each element the sum of those before it: sums of whole blocks, then within the block."""

    def placed(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / BLOCK).cast("int")), lambda b: _sum(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        running = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(
            running,
            lambda r: F.transform(n, lambda x, k: F.get(r, F.floor(k / BLOCK).cast("int")) + _sum(F.slice(n, (k - k % BLOCK + 1).cast("int"), (k % BLOCK).cast("int")))),
        )

    return let(steps, placed)


def spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start, kind, end and found (the text of the group, else the match);
    those whose found is shorter than `least` are dropped afterwards."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else matches

    def located(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(
            F.struct(F.transform(gaps, lambda g: F.length(g).cast("long")).alias("g"), found.alias("f")),
            lambda s: let(
                sums_before(F.transform(s["g"], lambda g, k: g + F.coalesce(F.length(F.get(m, k)), F.lit(0)))),
                lambda at: F.transform(
                    m,
                    lambda x, k: F.struct(
                        (F.get(at, k) + F.get(s["g"], k)).alias("start"), F.lit(kind).alias("kind"),
                        (F.get(at, k) + F.get(s["g"], k) + F.length(x)).alias("end"), F.get(s["f"], k).alias("found"),
                    ),
                ),
            ),
        )

    return F.filter(let(matches, located), lambda x: F.length(x["found"]) >= least)


NONE = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"


def _where(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.array().cast(NONE))


def scan(docs: DataFrame, at: str = "_secret") -> DataFrame:
    """docs with {at}_base (spans of the three kinds, by start and kind) and {at}_candidates (strings that were tested).
    `at` must begin no name of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains(lower, F.lit(word))
    d = docs.withColumn(f"{at}_named", named)
    base = F.concat(
        _where(F.col(f"{at}_named"), spans(text, ASSIGN, 0, 2, 8)),
        _where(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1, None, 16)),
        _where(text.rlike(HEX), spans(text, HEX, 2, None, 32)),
    )
    d = d.withColumn(f"{at}_base", F.array_sort(base)).withColumn(f"{at}_maybe", _where(text.rlike(CANDIDATE), spans(text, CANDIDATE, 3)))
    apart = let(
        F.col(f"{at}_base"),
        lambda base: F.filter(
            f"{at}_maybe", lambda c: ~c["found"].rlike(UUID) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        ),
    )
    d = d.withColumn(f"{at}_candidates", F.transform(apart, tested)).drop(f"{at}_named", f"{at}_maybe")
    place = lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"))
    return d.withColumn(f"{at}_base", F.transform(f"{at}_base", place))


def _codes(symbols: Column, encoding: Column) -> Column:
    """Each symbol's number in its alphabet, scaled to 0..63."""
    def code(c: Column) -> Column:
        plain = F.instr(F.lit(BASE64), F.translate(c, "-_", "+/")) - 1
        hexed = (F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1) * 4
        based = (F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), c) - 1) * 2
        return F.when(encoding == "hex", hexed).when(encoding == "base32", based).otherwise(plain).cast("double")

    return F.transform(symbols, code)


def _two_sided(z: Column) -> Column:
    """Two-sided normal tail, by the logistic approximation of the normal distribution."""
    a = F.abs(z)
    return 2 / (1 + F.exp(0.07056 * a * a * a + 1.5976 * a))


def tested(c: Column) -> Column:
    """A candidate with its length class and the bin of its p-value; the battery's p-values enter it as a condition: what
    they reject as random has p = 1 (bin 0)."""
    body = F.regexp_replace(c["found"], "=+$", "")
    encoding = (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    )

    def battery(s: Column) -> Column:
        codes, n, enc = s["codes"], F.size(s["codes"]), s["encoding"]

        def figures(v: Column) -> Column:
            bins = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(v, lambda x: F.floor(x / 8) == b)))
            chi = F.aggregate(bins, F.lit(0.0), lambda a, o: a + (o - n / 8) * (o - n / 8) / (n / 8))
            # Wilson and Hilferty: the cube root of chi-squared over its degrees is near normal.
            z_chi = (F.pow(chi / 7, F.lit(1 / 3)) - (1 - 2 / 63)) / F.sqrt(F.lit(2 / 63))
            turns = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda a, k: a + F.when((F.get(v, k) >= 32) != (F.get(v, k - 1) >= 32), 1).otherwise(0))
            z_runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
            serial = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, k: a + (F.get(v, k) - 31.5) * (F.get(v, k - 1) - 31.5))
            z_serial = serial / (F.sqrt(n.cast("double") - 1) * (64 * 64 - 1) / 12)
            one_sided = F.when(z_chi > 0, _two_sided(z_chi)).otherwise(1.0)
            return F.least(one_sided, _two_sided(z_runs), _two_sided(z_serial))

        size = F.when(enc == "hex", 16).when(enc == "base32", 32).otherwise(64)
        # Ordinary text: the class of the symbol before is kept with probability 0.9, else one of the other classes follows.
        ratio = F.aggregate(
            F.sequence(F.lit(1), n - 1), F.lit(0.0),
            lambda a, k: a + F.when(
                F.get(s["kinds"], k) == F.get(s["kinds"], k - 1), F.log10(F.get(s["widths"], k) / (0.9 * size))
            ).otherwise(F.log10(F.get(s["widths"], k) / (0.1 / 3 * size))),
        )
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.when(n >= LENGTHS[2], 2).when(n >= LENGTHS[1], 1).otherwise(0).alias("long"),
            F.when(
                F.coalesce(figures(codes), F.lit(0.0)) * 3 >= BATTERY, F.greatest(F.lit(0), F.least(F.lit(MOST_BINS), F.floor(10 * ratio))).cast("int")
            ).otherwise(0).alias("bin"),
        )

    symbols = F.split(body, "(?!^)")
    kind = lambda x: F.when(x.rlike("[a-z]"), 0).when(x.rlike("[A-Z]"), 1).when(x.rlike("[0-9]"), 2).otherwise(3)

    def prepared(sy: Column, enc: Column) -> Column:
        width = lambda x: F.when(kind(x) == 2, 10.0).when(kind(x) == 3, 4.0).otherwise(F.when(enc == "hex", 6.0).otherwise(26.0))
        return F.struct(enc.alias("encoding"), _codes(sy, enc).alias("codes"), F.transform(sy, kind).alias("kinds"), F.transform(sy, width).alias("widths"))

    return let(let(F.struct(symbols.alias("s"), encoding.alias("e")), lambda x: prepared(x["s"], x["e"])), battery)


def accepted_from(scanned: DataFrame, fdr: float = FDR, at: str = "_secret") -> dict[int, int]:
    """For each length class the least bin that the false-discovery rule accepts; classes without one are left out. Every
    candidate is a test; one that the battery rejects has p = 1 and can be no discovery."""
    tests = scanned.select(F.explode(f"{at}_candidates").alias("c"))
    counts: dict[int, dict[int, int]] = {}
    for r in tests.groupBy("c.long", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.long, {})[r.bin] = r.n
    limits = {}
    for length, by_bin in counts.items():
        total, below, best = sum(by_bin.values()), 0, None
        for b in sorted(by_bin, reverse=True):
            below += by_bin[b]
            if b > 0 and 10 ** (-b / 10) <= fdr * below / total:
                best = b
        if best is not None:
            limits[length] = best
    return limits


def with_spans(scanned: DataFrame, limits: dict[int, int], at: str = "_secret") -> DataFrame:
    """A scan with {at}_all (base and accepted random spans, by start and kind) instead of the candidates."""
    least = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map(F.lit(-1), F.lit(0))
    chosen = F.filter(f"{at}_candidates", lambda c: c["bin"] >= F.try_element_at(least, c["long"]))
    added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.withColumn(f"{at}_all", F.array_sort(F.concat(f"{at}_base", added))).drop(f"{at}_candidates")


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and spans for each row of docs(doc_id, text). Texts are scanned once; what
    was found in them is written, counted by bin and then listed."""
    scanned = cut(scan(docs.select("doc_id", "text")).drop("text"))
    found = with_spans(scanned, accepted_from(scanned))
    count = lambda k: F.size(F.filter("_secret_all", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed("_secret_base"), 256).alias("base_sha256"), _listed("_secret_all").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span replaced by a mark; overlapping spans are replaced as one."""
    at = fresh(docs, "_secret")
    scanned = cut(scan(docs, at))
    found = with_spans(scanned, accepted_from(scanned, at=at), at)

    def merged(s: Column) -> Column:
        """Spans joined where they overlap: a fold over the spans in order that keeps the last one open."""
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")

        def add(a: Column, x: Column) -> Column:
            last = F.try_element_at(a, F.lit(-1))
            one = F.struct(x["start"].alias("start"), x["end"].alias("end"))
            wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when((F.size(a) > 0) & (x["start"] < F.try_element_at(a, F.lit(-1))["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(one)))

        return F.aggregate(s, none, add)

    text = F.col("text")
    parts = lambda m: F.concat(
        F.array_join(F.transform(m, lambda x, k: F.concat(F.substring(text, F.coalesce(F.get(m, k - 1)["end"], F.lit(0)).cast("int") + 1, (x["start"] - F.coalesce(F.get(m, k - 1)["end"], F.lit(0))).cast("int")), F.lit(mark))), ""),
        F.substring(text, F.element_at(m, -1)["end"].cast("int") + 1, F.length(text)),
    )
    out = found.withColumn("text", F.when(F.size(f"{at}_all") > 0, let(let(F.col(f"{at}_all"), merged), parts)).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
