"""Catalogues of faces: merged from their sources, the closest face for a name, and faces that cover a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import fonts as f
from paperloom.functions.text import fold_punctuation

# The bias of each source, and the scores of names, twins, bundled and standard faces.
BIAS = {"embedded": 4, "system": 3, "bundled": 2, "standard": 1}
SELECTED, SAME_KEY, SAME_STEM = 10_000, 9_000, 8_000
TWIN_STEM, TWIN_WORD, TWIN_FAMILY = 700, 500, 300
BUNDLED_SANS, BUNDLED_SERIF, BUNDLED_WIDE, BUNDLED = 80, 40, 20, 10
STANDARD, STANDARD_LACKING = 15, 5
NAMED = 6


def catalogued(catalog: DataFrame) -> DataFrame:
    """catalog(font_id, source, label) as one row with an array of faces. A catalogue is a list of installed faces, short
    whatever the number of hints; every face is compared with every distinct hint."""
    label = F.col("label")
    face = F.struct(
        "font_id", "source", "label", f.face_key(label).alias("key"), f.face_stem(label).alias("stem"), f.family(label).alias("family"), f.is_bold(label).alias("bold"),
        f.is_subset(label).alias("narrow"), F.split(F.lower("label"), r"[\s-]")[0].alias("word"),
    )
    return catalog.agg(F.collect_list(face).alias("faces"))


def _scored(face: Column, hint: Column) -> Column:
    source = face["source"]
    own = F.when((face["key"] == hint["key"]) & (F.length(face["key"]) >= NAMED), SAME_KEY).when((face["stem"] == hint["stem"]) & (F.length(face["stem"]) >= NAMED), SAME_STEM).otherwise(0)
    own = F.when(face["font_id"] == hint["selected"], SELECTED).otherwise(own)
    alike = (F.length(hint["stem"]) >= NAMED) & (F.contains(face["stem"], hint["stem"]) | F.contains(hint["stem"], face["stem"]))
    kind = F.when(hint["family"] == "unknown", "helvetica").otherwise(hint["family"])
    twin = (
        F.when(alike, TWIN_STEM).when((F.length(face["word"]) >= 4) & F.contains(F.lower(hint["name"]), face["word"]), TWIN_WORD)
        .when((face["family"] == kind) & (face["bold"] == hint["bold"]), TWIN_FAMILY).otherwise(0)
    )
    upright = face["label"].contains("Liberation")
    bundled = F.when(upright & (kind == "helvetica"), BUNDLED_SANS).when(upright & (kind == "times"), BUNDLED_SERIF).when(face["label"].contains("Noto"), BUNDLED_WIDE).otherwise(BUNDLED)
    can = f.can_encode(source, F.lit(True), face["narrow"], hint["draft"], hint["original"])
    own, twin, bundled = (F.when(source == s, v).otherwise(0) for s, v in (("embedded", own), ("system", twin), ("bundled", bundled)))
    standard = F.when(source == "standard", F.when(can, STANDARD).otherwise(STANDARD_LACKING)).otherwise(0)
    bias = F.create_map(*[F.lit(x) for pair in BIAS.items() for x in pair])[source]
    total = (own + twin + bundled) * 10 + standard + bias + can.cast("int")
    return F.struct(
        (-total).alias("order"), face["label"].alias("label"), face["font_id"].alias("font_id"), source.alias("source"), own.alias("own"), twin.alias("twin"), can.alias("can"), face["narrow"].alias("narrow"),
        total.alias("score"),
    )


def closest(hints: DataFrame, catalog: DataFrame, prefer_bundled: bool = False) -> DataFrame:
    """hints(hint_id, name, draft, original, selected) -> hint_id, font_id, score, rank: the document's own face by name, a
    twin of the system, a bundled face, any that can write the draft, or the first. Every hint gets a row unless the
    catalogue is empty. With `prefer_bundled` a bundled face stands before anything but own faces and twins."""
    name = F.col("name")
    told = hints.select("name", "draft", "original", "selected").distinct()
    hint = F.struct("name", "draft", "original", "selected", f.face_key(name).alias("key"), f.face_stem(name).alias("stem"), f.family(name).alias("family"), f.is_bold(name).alias("bold"))
    s = told.withColumn("hint", hint).crossJoin(F.broadcast(catalogued(catalog)))  # one row
    s = s.withColumn("scored", F.array_sort(F.transform("faces", lambda x: _scored(x, F.col("hint")))))
    first = lambda rank, test: F.get(F.transform(F.filter("scored", test), lambda x: F.struct(x["font_id"].alias("font_id"), x["score"].alias("score"), F.lit(rank).alias("rank"))), 0)
    upright = lambda x: (x["source"] == "bundled") & x["label"].contains("Liberation")
    pick = F.coalesce(
        first("document", lambda x: (x["own"] >= SAME_STEM) & x["can"]), first("document", lambda x: (x["own"] >= SAME_STEM) & x["narrow"]), first("system", lambda x: (x["twin"] > 0) & x["can"]),
        first("bundled", upright), first("bundled", lambda x: x["source"] == "bundled"), *([first("other", upright)] if prefer_bundled else []),
        first("other", lambda x: x["can"]), first("other", lambda x: F.lit(True)),
    )
    s = s.select(*[F.col(c).alias(f"s_{c}") for c in ("name", "draft", "original", "selected")], pick.alias("pick"))
    same = None
    for c in ("name", "draft", "original", "selected"):
        one = F.col(c).eqNullSafe(F.col(f"s_{c}"))
        same = one if same is None else same & one
    return hints.join(s, same).select("hint_id", "pick.*")


def metric_twin(hints: DataFrame, fonts: DataFrame) -> DataFrame:
    """For each hint(hint_id, name) the first face of fonts(font_id, label) whose first word it holds, or of its family and
    weight."""
    label, name = F.col("label"), F.col("name")
    faces = F.array_sort(F.collect_list(F.struct("font_id", F.split(F.lower(label), " ")[0].alias("word"), f.family(label).alias("family"), f.is_bold(label).alias("bold"))))
    h = hints.select("name").distinct().crossJoin(F.broadcast(fonts.agg(faces.alias("faces"))))  # one row
    kind = F.when(f.family(name) == "unknown", "helvetica").otherwise(f.family(name))
    fits = F.filter("faces", lambda x: F.contains(F.lower(name), x["word"]) | ((x["family"] == kind) & (x["bold"] == f.is_bold(name))))
    return hints.join(h.select("name", F.get(fits, 0)["font_id"].alias("font_id")), "name").select("hint_id", "font_id")


def merged_catalog(*sources: DataFrame) -> DataFrame:
    """Faces(doc_id, font_id, label) of all sources in order; of one id the first source's counts. place: from 0."""
    every = None
    for rank, s in enumerate(sources):
        one = s.select("doc_id", "font_id", "label", F.lit(rank).alias("rank"))
        every = one if every is None else every.unionByName(one)
    one = every.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "font_id").orderBy("rank", "label"))).where("nth = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "label", "font_id")) - 1).select("doc_id", "font_id", "label", "rank", "place")


def fallback(texts: DataFrame, coverage: DataFrame, faces: list[str]) -> DataFrame:
    """texts(text_id, text) and coverage(face, first, last), ranges of code points: the first of `faces` that has every
    character, and the characters that the last one lacks if none has. Coverage is a short table."""
    chars = F.array_distinct(F.filter(F.split(fold_punctuation(F.col("text")), ""), lambda c: (c != "") & ~c.rlike(r"[\t\n\r ]")))
    t = texts.select("text_id", F.posexplode_outer(chars).alias("k", "ch")).withColumn("code", F.ascii("ch").cast("long"))
    codes = t.select("code").where("code is not null").distinct().join(F.broadcast(coverage), F.col("code").between(F.col("first"), F.col("last"))).select("code", "face").distinct()
    have = codes.groupBy("code").agg(F.collect_set("face").alias("faces"))
    j = t.join(have, "code", "left")
    lacks = lambda face: F.col("ch").isNotNull() & ~F.coalesce(F.array_contains("faces", face), F.lit(False))
    g = j.groupBy("text_id").agg(*[F.count_if(lacks(x)).alias(f"n{k}") for k, x in enumerate(faces)], F.array_sort(F.collect_list(F.when(lacks(faces[-1]), F.struct("k", "ch")))).alias("lacking"))
    face = F.coalesce(*[F.when(F.col(f"n{k}") == 0, x) for k, x in enumerate(faces)])
    return g.select("text_id", face.alias("face"), F.when(face.isNull(), F.array_join(F.transform("lacking", lambda x: x["ch"]), "")).otherwise("").alias("missing"))
