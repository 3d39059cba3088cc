"""Queries over edits: shows found and patched, lines joined, drafts carried, faces and images chosen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import fonts as ff
from paperloom.operators import edits, fonts, images, layout, lines, views
from paperloom.plans import sql
from paperloom.plans.registry import query, rounded
from paperloom.session import table


def _shows(spark: SparkSession, d: str) -> DataFrame:
    """Every run as a show, numbered through its page."""
    r = views.runs(spark, d)
    return r.select("doc_id", "page", F.lit(1).alias("stream"), (F.col("line") * 10 + F.col("ord")).alias("ord"), "text", "x", "y", "font_size")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch for every item that came back (its name), was accepted (its whole row) or is open (its name, spelled with a
    hyphen at its end), placed between two rows; what isn't on the page has quantity over 45."""
    i = views.order_items(spark, d, "l_returnflag")
    row = F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"), views.money("p_retailprice"), views.money("l_extendedprice"))
    flag, absent = F.col("l_returnflag"), F.col("l_quantity") > 45
    original = F.when(absent, F.concat(F.lit("missing text "), F.col("p_name"))).when(flag == "A", row).when(flag == "R", F.col("p_name")).otherwise(F.concat("p_name", F.lit("-")))
    return i.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("line").alias("patch_id"), F.lit(56.0).alias("x"), (F.lit(691.0) - 18.0 * F.col("line")).alias("y"),
        F.lit(10.0).alias("width"), F.lit(9.0).alias("height"), F.lit(9.0).alias("font_size"), original.alias("original"), F.lit(None).cast("string").alias("raw_text"),
        F.concat(F.lit("new "), F.col("p_name")).alias("text"),
    )


_FOUND = f"""{sql.RUNS}, p AS (SELECT l_orderkey AS doc_id, line AS patch_id, 56.0::DOUBLE AS x, 691.0::DOUBLE - 18.0::DOUBLE * line AS y, p_name,
  CASE WHEN l_quantity > 45 THEN 'missing text ' || p_name WHEN l_returnflag = 'A' THEN concat_ws(' ', p_name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), {sql.money('p_retailprice')}, {sql.money('l_extendedprice')})
    WHEN l_returnflag = 'R' THEN p_name ELSE p_name || '-' END AS original FROM items),
g AS (SELECT a.doc_id, a.line, a.ord, n, a.x, a.y, (SELECT string_agg(b.text, ' ' ORDER BY b.ord) FROM runs b WHERE b.doc_id = a.doc_id AND b.line = a.line AND b.ord >= a.ord AND b.ord < a.ord + n) AS t
  FROM runs a, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE a.ord + n <= 4),
c AS (SELECT p.*, g.line, g.ord, g.n, sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2) AS far, g.t = original AS eq,
  contains(replace(g.t, ' ', ''), replace(replace(original, ' ', ''), '-', '')) AS held, length(g.t) AS len FROM p JOIN g ON p.doc_id = g.doc_id),
s AS (SELECT *, CASE WHEN eq THEN 1000 WHEN held THEN CASE WHEN n = 1 THEN 740 ELSE 680 - 0.05::DOUBLE * greatest(0, len - n + 1 - length(original)) END END - far AS score FROM c),
f AS (SELECT doc_id, patch_id, line, ord, n, round(score, 6) AS score, original, p_name FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, patch_id ORDER BY round(score, 9) DESC, n DESC, line, ord) = 1)"""
FIND_SHOWS = f"WITH {_FOUND} SELECT doc_id, patch_id, line * 10 + ord AS first, n AS n_shows, score FROM f"


@query("find_shows", FIND_SHOWS)
def find_shows(spark: SparkSession, d: str) -> DataFrame:
    """The shows that each patch means, by text."""
    found = edits.by_text(_shows(spark, d), _patches(spark, d))
    return rounded(found.select("doc_id", "patch_id", F.col("members")[0]["ord"].alias("first"), F.size("members").alias("n_shows"), "score"), "score")


INSPECT = f"""WITH {_FOUND}, m AS (SELECT p.doc_id, p.patch_id, p.p_name, p.original, f.line, f.n, f.line % 5 = 0 AND f.ord = 0 AS unsafe, (SELECT count(*) = 3 FROM (SELECT unnest(['n', 'e', 'w']) AS c) WHERE contains(CASE WHEN f.n = 1 THEN p.p_name ELSE p.original END, c)) AS own FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.patch_id = f.patch_id),
i AS (SELECT *, CASE WHEN line IS NULL OR unsafe THEN 'blocked' WHEN own THEN 'in-place' ELSE 'redraw-standard' END AS method FROM m)
SELECT doc_id, patch_id, method, CASE WHEN line IS NULL THEN 'not found' WHEN unsafe THEN 'symbol face' ELSE '' END AS reason, CASE WHEN line IS NULL THEN '' ELSE 'new ' || p_name END AS text,
  CAST(coalesce(n, 0) AS INTEGER) AS n_shows, count(*) FILTER (WHERE method = 'blocked') OVER (PARTITION BY doc_id) = 0 AS applied FROM i"""


@query("plan_patches", INSPECT)
def plan_patches(spark: SparkSession, d: str) -> DataFrame:
    """How each patch would be written, and whether its document's patches go through together. Faces of every fifth line's
    names mustn't be replaced."""
    s = _shows(spark, d)
    inspected = edits.inspect(s, _patches(spark, d), s.where("ord % 50 = 0"))
    return edits.plan(inspected).select("doc_id", "patch_id", "method", "reason", "text", "n_shows", "applied")


APPLIED = f"""WITH {_FOUND}, m AS (SELECT p.doc_id, p.patch_id, p.p_name, f.line, f.ord, f.n FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.patch_id = f.patch_id),
ok AS (SELECT *, count(*) FILTER (WHERE line IS NULL) OVER (PARTITION BY doc_id) = 0 AS applied FROM m),
h AS (SELECT doc_id, line, ord + k AS ord, k, p_name FROM ok, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE applied AND k < n),
t AS (SELECT doc_id, line, ord, min(k) AS nth, max(p_name) FILTER (WHERE k = 0) AS name FROM h GROUP BY ALL)
SELECT r.doc_id, r.line * 10 + r.ord AS ord, coalesce('new ' || t.name, r.text) AS text FROM runs r LEFT JOIN t ON r.doc_id = t.doc_id AND r.line = t.line AND r.ord = t.ord WHERE t.nth IS NULL OR t.nth = 0"""


@query("apply_patches", APPLIED)
def apply_patches(spark: SparkSession, d: str) -> DataFrame:
    """Shows after the patches of documents of which none is blocked."""
    s, p = _shows(spark, d), _patches(spark, d)
    none = s.limit(0)
    planned = edits.plan(edits.inspect(s, p, none))
    return edits.apply_plan(s, planned).select("doc_id", "ord", "text")


BOXED = f"""WITH {sql.RUNS}, w AS (SELECT *, greatest(5.4::DOUBLE, length(text) * 4.5) AS w FROM runs),
hit AS (SELECT p.doc_id, p.line AS patch_id, s.line * 10 + s.ord AS first, s.x, s.y, 490 AS px, p.y AS py FROM runs p JOIN w s ON p.doc_id = s.doc_id WHERE p.ord = 3 AND least(s.x + s.w, 490 + 30 + 4) > greatest(s.x, 490 - 4)
  AND (least(s.y + 9, p.y + 9) > greatest(s.y, p.y) OR abs(s.y - p.y) <= 4.95::DOUBLE))
SELECT doc_id, patch_id, arg_min(first, x) AS first, count(*) AS n_shows, round(520 - arg_min(sqrt((x - px) ** 2 + (y - py) ** 2), x) + least(count(*), 40), 6) AS score FROM hit GROUP BY doc_id, patch_id"""


@query("find_shows_by_box", BOXED)
def find_shows_by_box(spark: SparkSession, d: str) -> DataFrame:
    """What a box about each line's last amount covers."""
    p = views.runs(spark, d).where("ord = 3").select("doc_id", "page", F.col("line").alias("patch_id"), F.lit(490.0).alias("x"), "y", F.lit(30.0).alias("width"), "height", "font_size")
    found = edits.by_box(_shows(spark, d), p).select("doc_id", "patch_id", F.col("members")[0]["ord"].alias("first"), F.size("members").cast("long").alias("n_shows"), "score")
    return rounded(found, "score")


PLACED = f"""WITH {sql.RUNS}, n AS (SELECT p.doc_id, p.line AS patch_id, s.line * 10 + s.ord AS first, 400 - sqrt((s.x - 470) ** 2 + (s.y - p.y - 3) ** 2) AS score FROM runs p JOIN runs s ON p.doc_id = s.doc_id
  WHERE p.ord = 3 AND abs(s.y - p.y - 3) <= 9 AND abs(s.x - 470) <= 80 AND (s.text = p.text OR (length(replace(p.text, '-', '')) >= 6 AND contains(s.text, p.text))))
SELECT doc_id, patch_id, arg_max(first, score) AS first, round(max(score), 6) AS score FROM n GROUP BY doc_id, patch_id"""


@query("find_shows_by_place", PLACED)
def find_shows_by_place(spark: SparkSession, d: str) -> DataFrame:
    p = views.runs(spark, d).where("ord = 3").select("doc_id", "page", F.col("line").alias("patch_id"), F.lit(470.0).alias("x"), (F.col("y") + 3).alias("y"), F.lit(30.0).alias("width"), F.col("text").alias("original"), F.lit("").alias("raw_text"))
    return rounded(edits.by_place(_shows(spark, d), p).select("doc_id", "patch_id", F.col("members")[0]["ord"].alias("first"), "score"), "score")


HINTS = f"WITH {sql.RUNS} SELECT doc_id, line, ord, CASE WHEN ord = 0 THEN 'stream ' || text ELSE text END AS shown, round(CASE WHEN ord = 3 THEN -1.0 ELSE y - 1 END::DOUBLE, 6) AS stream_y FROM runs"


@query("stream_hints", HINTS)
def stream_hints(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the texts that a stream a point lower shows at their place; it lacks the last amounts."""
    r = views.runs(spark, d)
    s = r.where("ord < 3").select("doc_id", "page", (F.col("line") * 10 + F.col("ord")).alias("ord"), F.when(F.col("ord") == 0, F.concat(F.lit("stream "), F.col("text"))).otherwise(F.col("text")).alias("text"), "x", (F.col("y") - 1).alias("y"), "font_size")
    garbled = r.withColumn("text", F.when(F.col("ord") == 0, F.lit("\\a\\b")).otherwise(F.col("text")))
    return rounded(edits.stream_hints(garbled, s).select("doc_id", "line", "ord", "shown", F.coalesce("stream_y", F.lit(-1.0)).alias("stream_y")), "stream_y")


FULL = f"WITH {sql.RUNS} SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS band, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_runs, round(max(x + width) - min(x), 6) AS width FROM runs GROUP BY doc_id, line"


@query("full_lines", FULL)
def full_lines(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.full_lines(views.runs(spark, d)).select("doc_id", F.col("band").cast("int").alias("band"), "text", F.col("n_runs").cast("long").alias("n_runs"), "width"), "width")


MERGED = f"WITH {sql.COLUMNS} SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS band, \"column\", string_agg(text, ' ' ORDER BY x, ord) AS text FROM columns0 GROUP BY doc_id, line, \"column\""


@query("merged_lines", MERGED)
def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.merged_lines(views.runs(spark, d)).select("doc_id", F.col("line").cast("int").alias("band"), "column", "text")


ORDER = f"WITH {sql.RUNS}, l AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY ord) AS text, min(x) AS x, max(x + width) AS r FROM runs GROUP BY doc_id, line) SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS text, round(max(r) - min(x), 6) AS width, count(*) AS n_rows FROM l GROUP BY doc_id"


@query("reading_order", ORDER)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lines.reading_order(views.runs(spark, d)).select("doc_id", "text", "width", "n_rows"), "width")


FLAT = f"WITH {sql.RUNS} SELECT doc_id, line * 10 + ord AS id, text FROM runs"


@query("flatten_runs", FLAT)
def flatten_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their runs as members, and every first run once more as a line of its own."""
    r = views.runs(spark, d).withColumn("id", F.col("line") * 10 + F.col("ord"))
    whole = r.groupBy("doc_id", "line").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("members")).select("doc_id", F.col("line").alias("seq"), F.lit(-1).alias("id"), F.lit("").alias("text"), "members")
    again = r.where("ord = 0").select("doc_id", (F.col("line") + 1000).alias("seq"), "id", "text", F.array().cast(whole.schema["members"].dataType).alias("members"))
    return lines.flattened(whole.unionByName(again))


AT = f"""WITH {sql.RUNS}, w AS (SELECT doc_id, line, ord, x, y, width * (ord + 1) AS width, height * (ord + 1) AS height FROM runs)
SELECT doc_id, line AS point_id, arg_min(w2.line, w2.width * w2.height * 1000 + w2.line) AS line, arg_min(w2.ord, w2.width * w2.height * 1000 + w2.line) AS ord FROM (SELECT doc_id, line AS point_id, 500.0 AS px, y + 5 AS py FROM w WHERE ord = 3) p JOIN w w2 USING (doc_id)
WHERE px BETWEEN w2.x AND w2.x + w2.width AND py BETWEEN w2.y AND w2.y + w2.height GROUP BY doc_id, point_id""".replace("line AS point_id, arg_min(w2.line", "point_id, arg_min(w2.line")


@query("run_at_point", AT)
def run_at_point(spark: SparkSession, d: str) -> DataFrame:
    """The smallest of the widened runs under a point in each line's last amount."""
    w = views.runs(spark, d).withColumns({"width": F.col("width") * (F.col("ord") + 1), "height": F.col("height") * (F.col("ord") + 1)})
    p = w.where("ord = 3").select("doc_id", "page", F.col("line").alias("point_id"), F.lit(500.0).alias("px"), (F.col("y") + 5).alias("py"))
    return lines.run_at(w, p).select("doc_id", "point_id", "line", "ord")


MOVED = f"""WITH {sql.RUNS}, m AS (SELECT *, CASE WHEN ord = 3 THEN x + 12 ELSE x END AS nx, CASE WHEN ord = 3 THEN y - 4 ELSE y END AS ny FROM runs)
SELECT doc_id, line, round(min(nx), 6) AS x, round(min(ny), 6) AS y, round(max(nx + width) - min(nx), 6) AS width, round(max(ny + height) - min(ny), 6) AS height, count(*) FILTER (WHERE ord = 3) AS n_moved FROM m GROUP BY doc_id, line"""


@query("moved_members", MOVED)
def moved_members(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of lines whose last amount was nudged."""
    r = views.runs(spark, d)
    moves = r.where("ord = 3").select("doc_id", "line", "ord", (F.col("x") + 12).alias("new_x"), (F.col("y") - 4).alias("new_y"))
    return rounded(lines.moved_members(r, moves), "x", "y", "width", "height")


_FIELDS = f"{sql.COLUMNS}, c AS (SELECT doc_id, line, \"column\", string_agg(text, ' ' ORDER BY x, ord) AS text FROM columns0 GROUP BY doc_id, line, \"column\"), e AS (SELECT *, CASE WHEN \"column\" = 0 THEN CASE WHEN line % 2 = 0 THEN ' ' ELSE upper(text) END ELSE text END AS draft FROM c)"
CHUNKS = f"WITH {_FIELDS} SELECT doc_id, line, string_agg(trim(draft), ' ' ORDER BY \"column\") FILTER (WHERE trim(draft) <> '') AS text, count(*) AS n_drafts FROM e GROUP BY doc_id, line"


def _fields(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Columns of every line, and the drafts stored for the first: capitals, or blank in even lines."""
    c = layout.columns_of_lines(views.runs(spark, d)).groupBy("doc_id", "line", "column").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "ord", "text"))), lambda r: r["text"]), " ").alias("text"), F.min("x").alias("x")
    )
    stored = c.where("column = 0").select("doc_id", "line", "column", F.when(F.col("line") % 2 == 0, " ").otherwise(F.upper("text")).alias("draft"))
    return c, stored


@query("chunk_drafts", CHUNKS)
def chunk_drafts(spark: SparkSession, d: str) -> DataFrame:
    rows = lines.chunk_drafts(*_fields(spark, d))
    return rows.select("doc_id", "line", "text", F.size("drafts").cast("long").alias("n_drafts"))


JOINED = f"WITH {_FIELDS}, r AS (SELECT doc_id, line, string_agg(trim(draft), ' ' ORDER BY \"column\") FILTER (WHERE trim(draft) <> '') AS text FROM e GROUP BY doc_id, line) SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS text, CAST(count(*) AS INTEGER) AS n_rows FROM r WHERE text <> '' GROUP BY doc_id"


@query("joined_chunks", JOINED)
def joined_chunks(spark: SparkSession, d: str) -> DataFrame:
    return lines.joined_chunks(lines.chunk_drafts(*_fields(spark, d)))


CARRIED = f"""WITH {_FIELDS} SELECT doc_id, line, "column" AS id, CASE WHEN "column" = 0 THEN CASE WHEN line % 2 = 0 THEN text ELSE upper(text) END ELSE text END AS text FROM c"""


@query("carried_drafts", CARRIED)
def carried_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of a line's first column carried onto columns that lie 5 points further and have other ids."""
    c, stored = _fields(spark, d)
    old = c.join(stored, ["doc_id", "line", "column"]).select("doc_id", "line", (F.col("column") + 100).alias("id"), "x", F.lit("Description").alias("label"), "draft")
    new = c.select("doc_id", "line", F.col("column").alias("id"), (F.col("x") + 5).alias("x"), F.lit("Amount").alias("label"), "text")
    return lines.carried_drafts(old, new)


_FACES = """faces(font_id, source, label, key, stem, family, bold) AS (VALUES (1, 'embedded', 'ABCDEF+Helvetica-Bold', 'helveticabold', 'helvetica', 'helvetica', true), (2, 'system', 'Arial', 'arial', 'arial', 'helvetica', false),
  (3, 'system', 'Times New Roman Bold', 'timesnewromanbold', 'timesnewroman', 'times', true), (4, 'bundled', 'Liberation Sans', 'liberationsans', 'liberationsans', 'helvetica', false),
  (5, 'bundled', 'Liberation Serif', 'liberationserif', 'liberationserif', 'times', false), (6, 'standard', 'Courier', 'courier', 'courier', 'courier', false))"""
CLOSEST = f"""WITH {sql.FONT_NAME}, {_FACES}, f AS ({sql.font_sql().split('FROM fonts0)')[0].split(', f AS (')[1]} FROM fonts0),
h AS (SELECT *, regexp_replace(regexp_replace(face_key, '{ff.WEIGHT_NUMBER}', ''), '{ff.STYLE_SUFFIX}', '') AS stem, CASE WHEN family = 'unknown' THEN 'helvetica' ELSE family END AS kind FROM f),
s AS (SELECT p_partkey AS hint_id, font_id, source, label, h.name, CASE WHEN source = 'embedded' THEN CASE WHEN c.key = face_key AND length(c.key) >= 6 THEN 9000 WHEN c.stem = h.stem AND length(c.stem) >= 6 THEN 8000 ELSE 0 END ELSE 0 END AS own,
  CASE WHEN source = 'system' THEN CASE WHEN length(h.stem) >= 6 AND (contains(c.stem, h.stem) OR contains(h.stem, c.stem)) THEN 700
    WHEN length(string_split(lower(label), ' ')[1]) >= 4 AND contains(lower(h.name), string_split(lower(label), ' ')[1]) THEN 500 WHEN c.family = h.kind AND c.bold = h.bold THEN 300 ELSE 0 END ELSE 0 END AS twin,
  CASE WHEN source = 'bundled' THEN CASE h.kind WHEN 'helvetica' THEN 80 WHEN 'times' THEN 40 ELSE 10 END ELSE 0 END AS bundled, source <> 'embedded' OR p_partkey % 2 = 0 AS can FROM h, faces c),
t AS (SELECT *, (own + twin + bundled) * 10 + CASE WHEN source = 'standard' THEN 15 ELSE 0 END + CASE source WHEN 'embedded' THEN 4 WHEN 'system' THEN 3 WHEN 'bundled' THEN 2 ELSE 1 END + can::INT AS score,
  CASE WHEN own >= 8000 THEN 1 WHEN twin > 0 AND can THEN 2 WHEN source = 'bundled' THEN 3 ELSE 4 END AS tier FROM s)
SELECT hint_id, font_id, score, CASE tier WHEN 1 THEN 'document' WHEN 2 THEN 'system' WHEN 3 THEN 'bundled' ELSE 'other' END AS rank FROM t QUALIFY row_number() OVER (PARTITION BY hint_id ORDER BY tier, score DESC, label) = 1"""


def _catalog(spark: SparkSession) -> DataFrame:
    faces = [(1, "embedded", "ABCDEF+Helvetica-Bold"), (2, "system", "Arial"), (3, "system", "Times New Roman Bold"), (4, "bundled", "Liberation Sans"), (5, "bundled", "Liberation Serif"), (6, "standard", "Courier")]
    return spark.createDataFrame(faces, "font_id int, source string, label string")


@query("closest_font", CLOSEST)
def closest_font(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.plans.catalog import _font_names

    original = F.when(F.col("p_partkey") % 2 == 0, "abc").otherwise("xyz")
    hints = _font_names(spark, d).select(F.col("p_partkey").alias("hint_id"), "name", F.lit("ab").alias("draft"), original.alias("original"), F.lit(None).cast("int").alias("selected"))
    return fonts.closest(hints, _catalog(spark))


TWINS = f"""WITH {sql.FONT_NAME}, {_FACES}, f AS ({sql.font_sql().split('FROM fonts0)')[0].split(', f AS (')[1]} FROM fonts0)
SELECT p_partkey AS hint_id, coalesce((SELECT min(font_id) FROM faces c WHERE source = 'system' AND (contains(lower(f.name), string_split(lower(label), ' ')[1]) OR (c.family = CASE WHEN f.family = 'unknown' THEN 'helvetica' ELSE f.family END AND c.bold = f.bold))), 0) AS font_id FROM f"""


@query("metric_twins", TWINS)
def metric_twins(spark: SparkSession, d: str) -> DataFrame:
    from paperloom.plans.catalog import _font_names

    hints = _font_names(spark, d).select(F.col("p_partkey").alias("hint_id"), "name")
    return fonts.metric_twin(hints, _catalog(spark).where("source = 'system'")).select("hint_id", F.coalesce("font_id", F.lit(0)).alias("font_id"))


CATALOGS = """WITH e AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS font_id, 'face ' || o_orderstatus AS label, 0 AS rank FROM orders), s AS (SELECT DISTINCT o_custkey AS doc_id, unnest(['O', 'F', 'Noto']) AS font_id, unnest(['open', 'filled', 'noto']) AS label, 1 AS rank FROM orders),
u AS (SELECT * FROM e UNION ALL SELECT * FROM s), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, font_id ORDER BY rank, label) = 1)
SELECT doc_id, font_id, label, rank, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, label, font_id) - 1 AS INTEGER) AS place FROM o"""


@query("merged_catalogs", CATALOGS)
def merged_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue for each customer: faces named after the states of its orders, then three of the system."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderstatus")
    own = o.select("doc_id", F.col("o_orderstatus").alias("font_id"), F.concat(F.lit("face "), F.col("o_orderstatus")).alias("label")).distinct()
    system = F.array(*[F.struct(F.lit(i).alias("font_id"), F.lit(n).alias("label")) for i, n in (("O", "open"), ("F", "filled"), ("Noto", "noto"))])
    return fonts.merged_catalog(own, o.select("doc_id").distinct().select("doc_id", F.inline(system)))


COVER = r"""WITH c AS (SELECT doc_id, unnest(list_distinct(string_split(translate(text, chr(9) || chr(10) || chr(13) || ' ' || chr(173), ''), ''))) AS ch FROM documents), d AS (SELECT doc_id, unicode(translate(ch, '    −‐‑‒–‘’“”', '    -----''''""')) AS u FROM c WHERE ch <> ''),
g AS (SELECT doc_id, count(*) FILTER (WHERE NOT u BETWEEN 32 AND 126) AS a, count(*) FILTER (WHERE NOT u BETWEEN 32 AND 591) AS b FROM d GROUP BY doc_id)
SELECT e.doc_id AS text_id, CASE WHEN coalesce(a, 0) = 0 THEN 'plain' WHEN coalesce(b, 0) = 0 THEN 'latin' ELSE 'none' END AS face, coalesce(b, 0) > 0 AS missing FROM documents e LEFT JOIN g ON e.doc_id = g.doc_id"""


@query("covering_faces", COVER)
def covering_faces(spark: SparkSession, d: str) -> DataFrame:
    """The first face that has every character of a document."""
    coverage = spark.createDataFrame([("plain", 32, 126), ("latin", 32, 591)], "face string, first long, last long")
    found = fonts.fallback(table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text"), coverage, ["plain", "latin"])
    return found.select("text_id", F.coalesce("face", F.lit("none")).alias("face"), (F.col("missing") != "").alias("missing"))


IMAGES = f"""WITH {sql.RUNS}, i AS (SELECT doc_id, line, 'Im' || line AS name, x, y, width, height FROM runs WHERE ord = 3),
p AS (SELECT doc_id, line, CASE line % 3 WHEN 0 THEN 'Im' || line WHEN 1 THEN 'inline-1' ELSE 'g_1' END AS name, x, CASE WHEN line % 3 = 2 THEN y + 400 ELSE y + 1 END AS y, width, height FROM i),
n AS (SELECT doc_id, count(*) AS n, min(name) AS sole FROM i GROUP BY doc_id)
SELECT p.doc_id, line AS patch_id, CASE line % 3 WHEN 0 THEN 'Im' || line WHEN 1 THEN 'Im' || line ELSE CASE WHEN n = 1 THEN sole ELSE 'none' END END AS image, CASE line % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'box' ELSE CASE WHEN n = 1 THEN 'only' ELSE 'none' END END AS by FROM p JOIN n USING (doc_id)"""


@query("find_images", IMAGES)
def find_images(spark: SparkSession, d: str) -> DataFrame:
    """Images where the last amounts stand; patches know them by name, by a box a point higher, or not at all."""
    i = views.runs(spark, d).where("ord = 3").select("doc_id", "page", "line", F.concat(F.lit("Im"), F.col("line").cast("string")).alias("name"), "x", "y", "width", "height")
    k = F.col("line") % 3
    p = i.select("doc_id", "page", F.col("line").alias("patch_id"), F.when(k == 0, F.col("name")).when(k == 1, "inline-1").otherwise("g_1").alias("name"), "x", (F.col("y") + F.when(k == 2, 400.0).otherwise(1.0)).alias("y"), "width", "height")
    return images.find_image(i.drop("line"), p).select("doc_id", "patch_id", F.coalesce("image", F.lit("none")).alias("image"), "by")


PUNCHED = f"""WITH {sql.MARKS}, h AS (SELECT DISTINCT doc_id, greatest(0, least(595, floor((greatest(x, 0) - 0) / 595 * 595)))::INT AS x0, greatest(0, least(595, ceil((least(x + width, 595)) / 595 * 595)))::INT AS x1,
  greatest(0, least(842, floor((1 - (least(y + height, 842)) / 842) * 842)))::INT AS y0, greatest(0, least(842, ceil((1 - greatest(y, 0) / 842) * 842)))::INT AS y1 FROM marks WHERE kind = 'erase' AND least(x + width, 595) - greatest(x, 0) > 0.01 AND least(y + height, 842) - greatest(y, 0) > 0.01)
SELECT doc_id, 1 AS object, CAST(count(*) AS INTEGER) AS n_holes, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS pixels FROM h WHERE x1 > x0 AND y1 > y0 GROUP BY doc_id"""


@query("punched_images", PUNCHED)
def punched_images(spark: SparkSession, d: str) -> DataFrame:
    """Pixels that the erase marks of a page take of a picture as large as the page."""
    m = views.marks(spark, d).where("kind = 'erase'")
    draws = m.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(1).alias("object"), *[F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("width", 595.0), ("height", 842.0))], F.lit(595).alias("pixel_w"), F.lit(842).alias("pixel_h"))
    return images.punched(draws, m)


REPLACED = f"""WITH {sql.PAGES} SELECT doc_id, pos, page_id, CASE WHEN page_id % 3 = 0 THEN 'second' WHEN page_id % 5 = 0 THEN 'first' ELSE '' END AS picture, page_id % 3 = 0 OR page_id % 5 = 0 AS replaced FROM pages0"""


@query("replaced_pages", REPLACED)
def replaced_pages(spark: SparkSession, d: str) -> DataFrame:
    p = views.pages(spark, d)
    first = p.where("page_id % 5 = 0 or page_id % 15 = 0").select("doc_id", "pos", F.lit(1).alias("patch_ord"), F.lit("first").alias("picture"))
    return images.replaced_pages(p, first.unionByName(p.where("page_id % 3 = 0").select("doc_id", "pos", F.lit(2).alias("patch_ord"), F.lit("second").alias("picture"))))


FILE_ORDER = f"""WITH {sql.PAGES}, n AS (SELECT doc_id, count(*) AS pages FROM pages0 GROUP BY doc_id), f AS (SELECT c_nationkey AS strip, c_custkey AS doc_id FROM customer WHERE c_custkey IN (SELECT doc_id FROM n))
SELECT strip, NOT bool_or(doc_id % 11 = 0) AS complete, NOT bool_or(doc_id % 11 = 0) AND strip % 2 = 0 AS in_order FROM f GROUP BY strip"""


@query("strips_in_order", FILE_ORDER)
def strips_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Strips of all pages of a nation's customers: odd ones start with their last page, some lack a file."""
    p = views.pages(spark, d)
    n = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    files = table(spark, d, "customer").select(F.col("c_nationkey").alias("strip"), F.col("c_custkey").alias("file_ord"), F.col("c_custkey").alias("doc_id")).join(n, "doc_id")
    from pyspark.sql import Window

    w = Window.partitionBy("strip").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("pages").over(Window.partitionBy("strip"))
    at = files.select("strip", "doc_id", F.coalesce(F.sum("pages").over(w), F.lit(0)).alias("before"), total.alias("total"))
    s = p.join(at, "doc_id").select("strip", "doc_id", F.col("pos").alias("page"), (F.col("before") + F.col("pos")).alias("pos"), "total").where("doc_id % 11 <> 0")
    s = s.withColumn("pos", F.when(F.col("strip") % 2 == 1, F.col("total") + 1 - F.col("pos") + 1000).otherwise(F.col("pos")))
    return images.in_file_order(s, files)


SWAPPED = f"""WITH {sql.PAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pages0) SELECT doc_id, CAST(CASE WHEN n > 1 AND pos = 1 THEN 2 WHEN n > 1 AND pos = 2 THEN 1 ELSE pos END AS INTEGER) AS pos, page_id FROM n"""


@query("swap_pages", SWAPPED)
def swap_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's second page moved one to the front."""
    p = views.pages(spark, d)
    return images.swapped(p, p.where("pos = 2").select("doc_id", "pos", F.lit(-1).alias("step"))).select("doc_id", "pos", "page_id")


SUBTYPES = f"WITH {sql.MARKS} SELECT doc_id, page, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM marks GROUP BY doc_id, page"


@query("mark_kinds", SUBTYPES)
def mark_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of marks that each page is expected to hold."""
    return views.marks(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


PAYLOADS = f"WITH {sql.MARKS} SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS key, round(x + greatest(width, 1), 6) AS x2 FROM marks WHERE kind = 'highlight'"


@query("mark_payloads", PAYLOADS)
def mark_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Highlights with a running key and their second corner."""
    from pyspark.sql import Window

    from paperloom.operators import marks

    m = views.marks(spark, d).where(marks.lane(F.col("kind")) == "editor")
    key = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).cast("int")
    return rounded(m.select("doc_id", "line", key.alias("key"), marks.corners(F.col("x"), F.col("y"), F.col("width"), F.col("height"))[2].alias("x2")), "x2")
