"""Marks, forms and files: lanes, labels, values, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lane(kind: Column) -> Column:
    """Where a mark goes when a file is written: erase, burn, editor or native."""
    return F.when(kind == "erase", "erase").when(kind == "redact", "burn").when(kind.isin("highlight", "note"), "editor").otherwise("native")


def list_label(kind: Column, query: Column) -> Column:
    return F.when(kind == "redact", "cover box").when(kind == "erase", F.when(query.isNotNull(), "permanent redaction (found)").otherwise("permanent redaction")).when(kind == "rect", "rectangle").otherwise(kind)


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """x1, y1, x2, y2 with extents of at least 1."""
    return F.array(x, y, x + F.greatest(w, F.lit(1.0)), y + F.greatest(h, F.lit(1.0)))


def export_name(base: Column, erased: Column, marked: Column, filled: Column, rotated: Column, edited: Column) -> Column:
    """The written file's name: redacted before marked, filled, rotated and edited."""
    suffix = F.when(erased, "redacted").when(marked, "marked").when(filled & ~edited, "filled").when(rotated & ~edited, "rotated").otherwise("edited")
    return F.concat(base, F.lit("-"), suffix, F.lit(".pdf"))


def new_name(original: Column, suggested: Column) -> Column:
    """A name that never equals the source's."""
    strip = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.pdf$", ""))
    base = F.when(strip(original) == "", "document").otherwise(strip(original))
    wanted = F.trim(F.coalesce(suggested, F.lit("")))
    named = F.when(wanted.rlike(r"(?i)\.pdf$"), wanted).otherwise(F.concat(wanted, F.lit(".pdf")))
    edited = F.concat(base, F.lit("-edited.pdf"))
    return F.when((wanted == "") | (F.lower(strip(named)) == F.lower(base)), edited).otherwise(named)


def size_label(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with 0, 0, 1 and 2 decimals."""
    k, m, g = 1024.0, 1024.0**2, 1024.0**3
    fixed = lambda v, d: F.format_number(F.round(v, d), d)
    plain = lambda v, d: F.replace(fixed(v, d), F.lit(","), F.lit(""))
    return F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < m, F.concat(plain(n / k, 0), F.lit(" KB"))).when(n < g, F.concat(plain(n / m, 1), F.lit(" MB"))).otherwise(F.concat(plain(n / g, 2), F.lit(" GB")))


def stamp(ts: Column) -> Column:
    """A time as the document format writes it (UTC)."""
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'")


# Labels of fields to be signed.
FIELD_LABELS = {"signature": "Signature", "initials": "Initials", "date": "Date", "text": "Text"}


def signed_date(ts: Column) -> Column:
    """The day of signing as it is printed."""
    return F.date_format(ts, "dd MMM yyyy")


def field_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])[kind]


def checkbox_on(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("yes", "true", "on", "1"), F.lit(False))


def fill_form(fields: DataFrame, values: DataFrame) -> DataFrame:
    """fields(doc_id, name, kind, value, fillable, read_only) with values(doc_id, name, new_value): what is filled, and the
    value after. Fields that can't be filled keep theirs; the last value of a name counts (by new_value)."""
    v = values.groupBy("doc_id", "name").agg(F.max("new_value").alias("new_value"))
    j = fields.join(v, ["doc_id", "name"], "left")
    fills = F.col("new_value").isNotNull() & F.col("fillable") & ~F.col("read_only")
    box = F.when(checkbox_on(F.col("new_value")), "yes").otherwise("off")
    after = F.when(fills, F.when(F.col("kind") == "checkbox", box).otherwise(F.col("new_value"))).otherwise(F.col("value"))
    return j.select("doc_id", "name", "kind", fills.alias("filled"), after.alias("value"))


def sidecar(status: DataFrame, fields: DataFrame) -> DataFrame:
    """One JSON record for each packet: its signers with their state and their fields, in order."""
    f = fields.groupBy("packet", "signer").agg(F.array_sort(F.collect_list(F.struct("field", "required", "filled"))).alias("fields"))
    s = status.join(f, ["packet", "signer"])
    return s.groupBy("packet").agg(F.to_json(F.array_sort(F.collect_list(F.struct("stage", "signer", "complete", "unlocked", "fields")))).alias("signers"))
