"""Decisions about edits as boolean columns: what may be applied, what is shown, what a page is written as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefers_overlay(enhancing: Column, recognized: Column, native: Column, scanned: Column) -> Column:
    """Whether recognized lines lie over the page: while enhancing, if there are any, unless the page has lines of its own
    and isn't a scan."""
    return enhancing & (recognized > 0) & ~((native > 0) & ~F.coalesce(scanned, F.lit(False)))


def edited_source(enhancing: Column, recognized: Column, native: Column, scanned: Column) -> Column:
    """Which lines are edited: recognized or native; the other kind where one has none."""
    first = F.when(prefers_overlay(enhancing, recognized, native, scanned), F.lit(True)).otherwise(native <= 0)
    return F.when(first, "recognized").otherwise("native")


def may_commit(draft: Column, original: Column, inspected: Column, deferred: Column, method: Column, missing: Column, unencodable: Column) -> Column:
    """An unchanged or empty draft may always be committed; else not into scans, not where blocked, and characters that the
    plain encoding lacks only where another face is drawn."""
    same = (F.trim(draft) == "") | (F.trim(draft) == original) | ~inspected
    drawn = method.isin("redraw-unicode", "redraw-system")
    return F.when(same, True).when(deferred | (method == "blocked"), False).when(unencodable > 0, drawn).otherwise(missing == 0)


def may_apply(pending: Column, recognized: Column, deferred: Column, scanned: Column, has_operator: Column, safe: Column) -> Column:
    """Words that wait to be verified block; recognized lines always apply; native ones only outside scans and if safe."""
    return F.when(pending, False).when(recognized, True).when(deferred, False).when(scanned & ~has_operator, False).otherwise(safe)


def flattens(native_edits: Column, has_image: Column, replaced: Column, recognized_edits: Column, recognized: Column, scanned: Column) -> Column:
    """Whether a page is written as a picture."""
    return ~native_edits & has_image & (replaced | recognized_edits | ((recognized > 0) & scanned))


def shown_text(selected: Column, draft: Column, applied: Column, original: Column) -> tuple[Column, Column, Column]:
    """edited, live preview, and the text on display of a line."""
    done = F.trim(applied)
    edited = F.coalesce((done != "") & (done != original), F.lit(False))
    live = F.when(selected, F.trim(draft)).otherwise("")
    settled = F.when(F.coalesce(done, F.lit("")) != "", done).otherwise(original)
    preview = (live != "") & (live != settled)
    return edited, preview, F.when(preview, draft).otherwise(F.coalesce(done, original))


def is_search_mark(kind: Column, query: Column) -> Column:
    return (kind == "erase") & F.coalesce(query != "", F.lit(False))


def same_values(a: Column, b: Column) -> Column:
    """Whether two form values, as arrays, are the same in the same order; empty and missing ones are equal."""
    none = F.array().cast("array<string>")
    plain = lambda v: F.filter(F.coalesce(v, none), lambda x: x != "")
    return plain(a) == plain(b)


def pending_edit(draft: Column, text: Column, moved: Column, changed_members: Column) -> Column:
    """Whether an edit has anything to write: other text, a run that moved, or a member with other text."""
    return (F.trim(draft) != text) | moved | (changed_members > 0)


def warnings(dynamic: Column, actions: Column, signature: Column, fillable: Column) -> Column:
    """Codes of what a form can't do here."""
    return F.array_compact(F.array(
        F.when(dynamic, "dynamic form"), F.when(actions, "field scripts"), F.when(signature, "signature fields"), F.when(dynamic & (fillable == 0), "nothing to fill"),
    ))


def image_type(data: Column) -> Column:
    """By the first bytes: jpeg or png (the default)."""
    return F.when(F.hex(F.substring(data, F.lit(1), F.lit(2))) == "FFD8", "image/jpeg").otherwise("image/png")


def is_object_name(name: Column) -> Column:
    """Whether an image's name is a resource's, not one that a viewer made up."""
    return F.coalesce((name != "") & ~name.startswith("inline-") & ~name.rlike(r"(?i)^img_p\d+_\d+$") & ~name.rlike(r"(?i)^g_\d+$"), F.lit(False))


def paints(mode: Column, within: Column) -> Column:
    """Whether a show paints glyphs: modes 3 and 7, set within its text object, hide it."""
    return ~(mode.isin(3, 7) & within)
