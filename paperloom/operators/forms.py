"""Reports of form fields: a tree of dictionaries flattened to fields with full names, inherited attributes and widgets.

nodes(doc_id, obj, parent, name, type, flags, value, options, export, page_obj, actions, x, y, width, height): a node for each
dictionary of the form; `value` and `options` are arrays of texts, `export` is what a widget stands for when it is on, `page_obj` the
page that it says it is on. annotations(doc_id, page, obj): what each page lists; pages(doc_id, page, obj).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.gates import warnings
from paperloom.operators.trees import inherited
from paperloom.session import dealt

# Bits of a field's flags.
READ_ONLY, REQUIRED, MULTILINE, RADIO, PUSH, COMBO = 1, 2, 1 << 12, 1 << 15, 1 << 16, 1 << 17
FILLABLE = ("text", "checkbox", "radio", "dropdown", "optionList")
OFF = "Off"


def _flag(bit: int) -> Column:
    return F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(bit) != 0


def fields(nodes: DataFrame, annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each field: doc_id, obj, name, kind, value, checked, selected, options, read_only, required, multiline,
    fillable, has_actions, widgets (page, box and what each stands for, in order of their objects).

    A field is a node without named ones below it; those without a name below it are its widgets, and a field without any
    is its own. Type, flags, value and options come from the nearest ancestor that has them. Nodes that go round in a circle are
    no fields, as no list of fields leads to them."""
    named = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    d = inherited(nodes.withColumn("path", named), ("type", "flags", "value", "options"), "path", counted="name").where("rooted")
    field = (F.col("name").isNotNull() | F.col("parent").isNull()) & (F.col("n_named") == 0)
    kind = (
        F.when(F.col("type") == "Tx", "text").when(F.col("type") == "Sig", "signature")
        .when(F.col("type") == "Btn", F.when(_flag(PUSH), "button").when(_flag(RADIO), "radio").otherwise("checkbox"))
        .when(F.col("type") == "Ch", F.when(_flag(COMBO), "dropdown").otherwise("optionList"))
    )
    # A widget's page: the one that it names, else the first that lists it, else the first of all. A field and its widgets meet by grouping, once.
    d = d.withColumns({"kind": F.when(field, kind), "is_field": field})
    told = pages.groupBy("doc_id", F.col("obj").alias("page_obj")).agg(F.min("page").alias("told_page"))
    listed = annotations.groupBy("doc_id", "obj").agg(F.min("page").alias("listed_page"))
    w = d.where((~F.col("is_field") & F.col("name").isNull()) | F.col("kind").isNotNull())
    # Only nodes that name a page are looked up by it.
    by_page = w.where("page_obj is not null").join(dealt(told), ["doc_id", "page_obj"], "left").select(*w.columns, "told_page")
    w = by_page.unionByName(w.where("page_obj is null").withColumn("told_page", F.lit(None).cast("int")))
    w = w.join(dealt(listed), ["doc_id", "obj"], "left").withColumn("page", F.coalesce("told_page", "listed_page", F.lit(1)))
    one = F.struct("obj", "page", "x", "y", "width", "height", "export")
    kept = ("kind", "path", "flags", "value", "options", "actions")

    def grouped(rows: DataFrame, field: Column) -> DataFrame:
        own_one = ~F.col("is_field") | (F.col("n_below") == 0)
        return rows.groupBy("doc_id", field.alias("field")).agg(
            F.collect_list(F.when(F.col("is_field"), F.struct(*kept))).alias("fs"), F.array_sort(F.collect_list(F.when(own_one, one))).alias("widgets"), F.max(F.when(own_one, F.coalesce("actions", F.lit(False)))).alias("acts")
        )

    # A field with nothing below it is its own widget and lies by its number already; only others are dealt out by field.
    alone = F.col("is_field") & (F.col("n_below") == 0)
    g = grouped(w.where(alone), F.col("obj")).unionByName(grouped(w.where(~alone), F.when(F.col("is_field"), F.col("obj")).otherwise(F.col("parent"))))
    f = g.select("doc_id", F.col("field").alias("obj"), F.explode("fs").alias("f"), "widgets", "acts").select("doc_id", "obj", "f.*", "widgets", "acts")
    first = F.get("value", 0)
    exports = F.filter(F.transform("widgets", lambda x: x["export"]), lambda x: x.isNotNull())
    own = F.coalesce(F.col("options"), F.array().cast("array<string>"))
    on = F.get("widgets", 0)["export"]
    checked = F.when(F.col("kind") == "checkbox", F.coalesce(on == first, F.lit(False)))
    # A radio's value names what a widget stands for; where options are given they are told in its place.
    radio = F.when(first == OFF, None).otherwise(F.coalesce(F.get(own, F.when(F.size(own) > 0, F.array_position(exports, first).cast("int") - 1)), first))
    options = F.when(F.col("kind") == "radio", F.when(F.size(own) > 0, own).otherwise(exports)).when(F.col("kind").isin("dropdown", "optionList"), own).otherwise(F.array().cast("array<string>"))
    values = F.coalesce("value", F.array().cast("array<string>"))
    selected = F.when(F.col("kind") == "radio", F.array_compact(F.array(radio))).when(F.col("kind").isin("dropdown", "optionList"), values)
    value = (
        F.when(F.col("kind") == "text", F.coalesce(first, F.lit(""))).when(F.col("kind") == "checkbox", F.when(checked, "Yes").otherwise(OFF))
        .when(F.col("kind") == "optionList", F.array_join(selected, ", ")).when(selected.isNotNull(), F.coalesce(F.get(selected, 0), F.lit(""))).otherwise("")
    )
    return f.select(
        "doc_id", "obj", F.array_join("path", ".").alias("name"), "kind", value.alias("value"), checked.alias("checked"), selected.alias("selected"), options.alias("options"),
        _flag(READ_ONLY).alias("read_only"), _flag(REQUIRED).alias("required"), ((F.col("kind") == "text") & _flag(MULTILINE)).alias("multiline"),
        (F.col("kind").isin(*FILLABLE) & ~_flag(READ_ONLY)).alias("fillable"), (F.coalesce("actions", F.lit(False)) | F.coalesce("acts", F.lit(False))).alias("has_actions"), "widgets",
    )


def report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents(doc_id, has_form, dynamic) and their fields -> doc_id, has_form, dynamic, has_actions, field_count, fillable_count, warnings."""
    g = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("field_count"), F.count_if("fillable").alias("fillable_count"), F.max("has_actions").alias("has_actions"), F.max(F.col("kind") == "signature").alias("signature")
    )
    d = documents.join(dealt(g), "doc_id", "left")
    count = lambda c: F.when(F.col("has_form"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    yes = lambda c: F.col("has_form") & F.coalesce(c, F.lit(False))
    d = d.withColumns({"field_count": count("field_count"), "fillable_count": count("fillable_count"), "has_actions": yes("has_actions"), "signature": yes("signature"), "dynamic": yes("dynamic")})
    return d.select("doc_id", "has_form", "dynamic", "has_actions", "field_count", "fillable_count", warnings(F.col("dynamic"), F.col("has_actions"), F.col("signature"), F.col("fillable_count")).alias("warnings"))


def seeds(found: DataFrame) -> DataFrame:
    """doc_id, name, values: what a filled form starts from."""
    told = F.when(F.col("kind") == "checkbox", F.array(F.col("checked").cast("string"))).when(F.col("kind") == "optionList", F.col("selected")).otherwise(F.array("value"))
    return found.select("doc_id", "name", told.alias("values"))
