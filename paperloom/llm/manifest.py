"""A Merkle manifest of a dataset (operator 11).

Every row becomes a leaf, the sha256 of its length-prefixed columns. Within a source leaves stand in order of doc_id; every
`fanout` neighbours become the digest of their digests, level by level, until one is left, the source's subroot. Subroots in
order of source become the root in the same way. A row's path (its place in each run, and the digests beside it) proves
that it is part of the dataset: folding it with the leaf gives the root.

Places are found without a sort of all rows. Ids are cut into digits of `DIGIT` bits; rows are counted by source and
leading digits, counts of shorter prefixes are sums of those of longer ones, and running sums among the at most 2**DIGIT
prefixes that share the next shorter one, carried from short to long, give the number of rows before each prefix. Only rows
that agree in all digits but the last are sorted, at most 2**DIGIT ids of a source. A place in digits of base `fanout` is the
key of a node in the trie: nodes that share all but the last `STRETCH` digits are reduced together, longest prefixes first, so
that one row of work holds fanout**STRETCH nodes however large a source is, and each round has that many times fewer rows.

Nulls: a null doc_id comes first, a null source is a source of its own and first; null columns are part of the leaf as `-`.
Rows that share source and doc_id stand in order of their leaf; rows that are equal in all five columns are counted until
they have places, and each gets a row. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.mixing import ranked

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Bits of doc_id by which prefixes get longer.
DIGIT = 8
#: Digits of a place that are reduced at once: 729 nodes.
STRETCH = 6
#: Equal rows that one element of an array stands for.
COPIES = 4096


def leaf_of(**columns: Column) -> Column:
    """The digest of columns by their names in COLUMNS."""

    def part(x: Column) -> Column:
        x = x.cast("string")
        return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))

    return F.sha2(F.concat(*[part(columns[c]) for c in COLUMNS]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(own: Column, step: Column) -> Column:
        before, after = F.slice(step["beside"], F.lit(1), step["at"]), F.slice(step["beside"], step["at"] + 1, F.size(step["beside"]))
        return F.sha2(F.concat(F.array_join(before, ""), own, F.array_join(after, "")), 256)

    return F.aggregate(path, leaf, up)


def proof(path: Column) -> Column:
    """The digest of all digests beside a path, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: step["beside"])), ""), 256)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f's lambdas read it."""
    return F.transform(F.array(value), f)[0]


def counted(start: int, n: Column) -> Column:
    """start, start + 1, ... of n numbers; none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(start), n + (start - 1))).otherwise(F.array().cast("array<int>"))


def levels(digests: Column, steps: Column, fanout: int) -> Column:
    """Digests of nodes, level by level: the given ones, and `steps` times those of their runs."""

    def up(so_far: Column, _: Column) -> Column:
        last = F.element_at(so_far, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / fanout).cast("int"))
        return F.concat(so_far, F.array(F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(last, k * fanout + 1, fanout), ""), 256))))

    return F.aggregate(counted(1, steps), F.array(digests).cast("array<array<string>>"), up)


def path_within(all_levels: Column, place: Column, steps: Column, fanout: int) -> Column:
    """The path of the node at a place (from 0) up through the levels."""
    sizes = F.array(*[F.lit(fanout**k) for k in range(STRETCH + 1)])

    def step(k: Column) -> Column:
        at = F.floor(place / sizes[k]).cast("int") % fanout
        run = F.slice(all_levels[k], F.floor(place / sizes[k + 1]).cast("int") * fanout + 1, fanout)
        return F.struct(at.alias("at"), F.filter(run, lambda x, i: i != at).alias("beside"))

    return F.transform(counted(0, steps), step)


def placed(leaves: DataFrame, digit: int = DIGIT) -> DataFrame:
    """leaves(grp, doc_id, leaf, n, ...) with n equal rows each -> with `place`, the number of rows before them in their
    group, and `total`, the number of the group's rows."""
    low, high = leaves.agg(F.min("doc_id"), F.max("doc_id")).first()
    prefix = F.shiftright("doc_id", digit)
    counts = [cut(leaves.groupBy("grp", prefix.alias("prefix")).agg(F.sum("n").alias("rows")))]
    bits = digit
    while low is not None and (high >> bits) - (low >> bits) >= 1 << digit:
        bits += digit
        counts.append(cut(counts[-1].groupBy("grp", F.shiftright("prefix", digit).alias("prefix")).agg(F.sum("rows").alias("rows"))))
    earlier = lambda *by: F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts[-1].select("grp", "prefix", earlier("grp").alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("total"))
    for longer in reversed(counts[:-1]):
        inner = longer.withColumn("short", F.shiftright("prefix", digit)).withColumn("inner", earlier("grp", "short"))
        outer = before.select(F.col("grp").alias("o_grp"), F.col("prefix").alias("o_prefix"), "before", "total")
        found = inner.join(outer, (F.col("grp") == F.col("o_grp")) & F.col("short").eqNullSafe(F.col("o_prefix")))
        before = found.select("grp", "prefix", (F.col("before") + F.col("inner")).alias("before"), "total")
    b = before.select(F.col("grp").alias("b_grp"), F.col("prefix").alias("b_prefix"), "before", "total")
    joined = leaves.withColumn("prefix", prefix).join(b, (F.col("grp") == F.col("b_grp")) & F.col("prefix").eqNullSafe(F.col("b_prefix")))
    within = Window.partitionBy("grp", "prefix").orderBy("doc_id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn("place", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).drop("b_grp", "b_prefix", "prefix", "before")


def depth_of(total: Column, fanout: int) -> Column:
    """Levels above `total` leaves."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < total))


def reduced(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes(grp, place, depth, digest, ...) -> tables of stretches(grp, block, depth, nodes), one for each round, and
    tops(grp, digest)."""
    extra = [c for c in nodes.columns if c not in ("grp", "place", "depth", "digest")]
    size = fanout**STRETCH
    rounds, tops = [], []
    while True:
        block = F.floor(F.col("place") / size).cast("long")  # places are counts of rows, so doubles hold them
        members = F.sort_array(F.collect_list(F.struct("place", "digest", *extra))).alias("nodes")
        table = cut(nodes.groupBy("grp", block.alias("block")).agg(F.min("depth").alias("depth"), members))
        rounds.append(table)
        steps = F.least("depth", F.lit(STRETCH))
        up = table.withColumn("digest", F.element_at(F.element_at(levels(F.col("nodes.digest"), steps, fanout), -1), 1))
        tops.append(up.where(F.col("depth") <= STRETCH).select("grp", "digest"))
        nodes, extra = up.where(F.col("depth") > STRETCH).select("grp", F.col("block").alias("place"), (F.col("depth") - STRETCH).alias("depth"), "digest"), []
        if (table.agg(F.max("depth")).first()[0] or 0) <= STRETCH:
            break
    found = tops[0]
    for t in tops[1:]:
        found = found.union(t)
    return rounds, found


def paths(rounds: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """Tables of stretches, and above(grp, path, ...) from each group's top on -> a row for each node of the first table:
    grp, its columns, its whole path, and what else `above` has."""
    carried = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.select("grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("top"), "path", *carried)
    lower, first = None, True
    for table in reversed(rounds):
        known = upper if first else upper.union(lower.select("grp", F.col("place").alias("block"), F.lit(False).alias("top"), "path", *carried))
        first = False
        steps = F.least("depth", F.lit(STRETCH))
        joined = table.withColumn("top", F.col("depth") <= STRETCH).join(known, ["grp", "block", "top"])
        fields = [f.name for f in table.schema["nodes"].dataType.elementType.fields]

        def node(x: Column, lv: Column) -> Column:
            own = path_within(lv, x["place"] - F.col("block") * fanout**STRETCH, steps, fanout)
            return F.struct(*[x[c].alias(c) for c in fields], F.concat(own, F.col("path")).alias("path"))

        rows = let(levels(F.col("nodes.digest"), steps, fanout), lambda lv: F.transform("nodes", lambda x: node(x, lv)))
        lower = joined.select("grp", *carried, F.inline(rows))
    return lower


def manifest(docs: DataFrame, fanout: int = FANOUT, digit: int = DIGIT, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path for each row of docs(doc_id, source, lang, n_chars, text); `carry`: more columns that
    the rows' own values decide, by name."""
    carry = carry or {}
    columns = {c: F.col(c) for c in COLUMNS}
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then in order of bytes
    rows = docs.select(grp.alias("grp"), "doc_id", leaf_of(**columns).alias("leaf"), *[x.alias(c) for c, x in carry.items()])
    leaves = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))  # the texts are read once
    found = placed(leaves, digit)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("chunk")
    found = found.select("*", chunk)
    each = F.explode(F.sequence(F.col("chunk") * COPIES, F.least(F.col("n") - 1, F.col("chunk") * COPIES + (COPIES - 1)))).alias("nth")
    found = found.select("*", each)
    nodes = found.select("grp", (F.col("place") + F.col("nth")).alias("place"), depth_of(F.col("total"), fanout).alias("depth"), F.col("leaf").alias("digest"), "doc_id", *carry)
    rounds, tops = reduced(nodes, fanout)
    subroots = cut(tops.withColumnRenamed("digest", "subroot"))
    n = subroots.count()
    order = ranked(subroots.withColumnRenamed("grp", "source"))
    above = order.select(F.lit("").alias("grp"), "place", depth_of(F.lit(n), fanout).alias("depth"), F.col("subroot").alias("digest"), F.col("source").alias("name"))
    source_rounds, top = reduced(above, fanout)
    root = F.lit((top.first() or [None, None])[1]).cast("string")  # one digest
    nothing = F.array().cast("array<struct<at:int,beside:array<string>>>")
    end = docs.sparkSession.range(1).select(F.lit("").alias("grp"), nothing.alias("path"))
    by_source = paths(source_rounds, end, fanout).select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"))
    result = paths(rounds, by_source, fanout)
    return result.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", *carry)


def report(docs: DataFrame) -> DataFrame:
    """The manifest, and what verifying it finds where line ends were deleted from the texts of every second row (those whose
    crc32 of the id 2 divides)."""
    columns = {c: F.col(c) for c in COLUMNS}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    altered = F.when(touched, leaf_of(**columns | {"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    m = manifest(docs, carry={"altered": altered})
    m = m.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return m.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
