"""DuckDB SQL for the queries of the catalogue, over the driver's tables."""

from __future__ import annotations


def width(text: str, size: float) -> str:
    """The estimated width of a text."""
    n = lambda p: f"(length({text}) - length(regexp_replace({text}, '{p}', '', 'g')))"
    a, b, c, e = n("[ ]"), n("[iljtfr.,:;''\"|!\\[\\]()]"), n("[A-Z0-9]"), n("[mw]")
    return f"(({a} * 0.28 + {b} * 0.31 + {c} * 0.63 + {e} * 0.85 + (length({text}) - {a} - {b} - {c} - {e}) * 0.52) * {size})"


def money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
TOTAL = r"(?i)\b(total|subtotal|sum|amount due|balance due|grand total)\b"


def amount(t: str, money_only: bool) -> str:
    c = f"translate(regexp_replace({t}, '\\s+', '', 'g'), '–—−', '---')"
    p = r"^-?\$?-?[\d,]+\.\d{2}%?-?$" if money_only else r"^-?\$?-?[\d,]+(?:\.\d+)?%?-?$"
    inner = f"substring({c}, 2, length({c}) - 2)"
    return (
        f"(regexp_matches({c}, '\\d') AND CASE WHEN {c} LIKE '(%)' AND length({c}) > 2 THEN NOT regexp_matches({inner}, '[()]') AND regexp_matches({inner}, '{p}') "
        f"ELSE NOT regexp_matches({c}, '[()]') AND regexp_matches({c}, '{p}') END)"
    )


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS seq FROM documents)"
#: Order and line number don't identify an item in the driver's tables, so lines are numbered anew.
ITEMS = """items AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
INVOICE = f"""{ITEMS}, invoice AS (
  SELECT l_orderkey AS doc_id, line AS seq,
    concat_ws(' ', p_name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), {money('p_retailprice')}, {money('l_extendedprice')}) AS text FROM items
  UNION ALL SELECT o_orderkey, 1000, 'Total due ' || {money('o_totalprice')} FROM orders)"""
RUNS = f"""{ITEMS}, cells AS (
  SELECT l_orderkey AS doc_id, line, unnest([0, 1, 2, 3]) AS ord, unnest([56.0, 360.0, 420.0, 490.0]::DOUBLE[]) AS x,
    unnest([p_name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), {money('p_retailprice')}, {money('l_extendedprice')}]) AS text FROM items),
runs AS (SELECT doc_id, 1 AS page, line, ord, text, x, 700.0::DOUBLE - 18.0::DOUBLE * line AS y, {width('text', 9.0)}::DOUBLE AS width, 9.0::DOUBLE AS height FROM cells)"""
MARKS = f"""{RUNS}, marks AS (SELECT doc_id, page, line, CASE WHEN (doc_id + line) % 7 = 0 THEN 'erase' WHEN (doc_id + line) % 5 = 0 THEN 'highlight' END AS kind,
  x - 8 AS x, y, width + 4 AS width, height FROM runs WHERE ord = 3 AND ((doc_id + line) % 7 = 0 OR (doc_id + line) % 5 = 0))"""
PAGES = """pages0 AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, o_orderkey AS page_id,
  CAST(o_orderkey % 4 * 90 AS INTEGER) AS rotation FROM orders)"""
SIGN = """sign AS (SELECT user_id AS signer, user_id % 50 AS packet, user_id % 5 AS stage, event_id AS field, event_id % 3 <> 0 AS required, event_type = 'purchase' AS filled FROM events)"""
WORDS = """words AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, i AS ord, text, CAST((conv_id * 31 + turn * 17 + i * 13) % 101 AS DOUBLE) AS confidence FROM (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS text, CAST(unnest(range(len(string_split(text, ' ')))) AS INTEGER) AS i FROM conversations) WHERE text <> '')"""


def overlap(a: str, b: str, pad: float) -> str:
    return f"{a}.x - {pad} < {b}.x + {b}.width AND {a}.x + {a}.width + {pad} > {b}.x AND {a}.y - {pad} < {b}.y + {b}.height AND {a}.y + {a}.height + {pad} > {b}.y"


def new_column() -> str:
    money, amt = (lambda t: amount(t, True)), (lambda t: amount(t, False))
    gap, delta = "(x - (px + pw))", "(x - px)"
    return (
        f"(({gap} > 36.0 AND ({money('pt')} OR {money('text')} OR {gap} > 72.0)) OR {delta} > 200.0 OR ({amt('pt')} AND {amt('text')} AND {delta} > 24.0) "
        f"OR ({money('text')} AND NOT {money('pt')} AND {delta} > 24.0))"
    )


COLUMNS = f"""{RUNS}, lagged AS (SELECT *, lag(x) OVER w AS px, lag(width) OVER w AS pw, lag(text) OVER w AS pt FROM runs WINDOW w AS (PARTITION BY doc_id, line ORDER BY x, ord)),
columns0 AS (SELECT doc_id, line, ord, x, text, CAST(sum(CASE WHEN pt IS NOT NULL AND {new_column()} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS INTEGER) AS "column" FROM lagged)"""

CHECK_NUMBERS = f"""WITH {INVOICE},
n AS (SELECT doc_id, seq, regexp_matches(text, '{TOTAL}') AS total, regexp_extract_all(text, '{NUMBER}') AS nums FROM invoice WHERE text <> ''),
f AS (SELECT *, nums[len(nums)] AS last, coalesce(sum(total::INT) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM n),
a AS (SELECT *, NOT total AND len(nums) >= 2 AND NOT (NOT regexp_matches(last, '[.,]') AND CAST(replace(last, ',', '') AS DOUBLE) < 10) AS amount FROM f),
b AS (SELECT *, coalesce(sum(amount::INT) OVER (PARTITION BY doc_id, island ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a),
s AS (SELECT *, max((NOT total AND len(nums) < 2 AND below >= 2)::INT) OVER (PARTITION BY doc_id, island ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM b),
t AS (SELECT doc_id, island, count(*) FILTER (WHERE amount AND below < 40 AND stopped = 0) AS n,
  sum(CAST(replace(last, ',', '') AS DOUBLE)) FILTER (WHERE amount AND below < 40 AND stopped = 0) AS actual,
  max(seq) FILTER (WHERE total) AS seq, max(CAST(replace(last, ',', '') AS DOUBLE)) FILTER (WHERE total) AS claimed FROM s GROUP BY doc_id, island)
SELECT doc_id, seq, 'total' AS kind, CASE WHEN abs(actual - claimed) > greatest(0.5, abs(claimed) * 0.005) THEN 'error' ELSE 'warning' END AS severity, n,
  round(actual, 2) AS actual, round(claimed, 2) AS claimed FROM t WHERE n >= 2 AND claimed IS NOT NULL AND abs(actual - claimed) >= 0.005"""
CHECK_PROSE = """SELECT p_partkey AS doc_id, 'error' AS severity, CAST(p_size * 3 AS DOUBLE) AS actual, CAST(p_size * 3 + p_partkey % 2 AS DOUBLE) AS claimed FROM part WHERE p_partkey % 2 <> 0"""
NUMBERS_IN_LINES = f"""WITH {INVOICE}, n AS (SELECT doc_id, seq, regexp_extract_all(text, '{NUMBER}') AS nums FROM invoice)
SELECT doc_id, seq, len(nums) AS n, round(CAST(replace(nums[len(nums)], ',', '') AS DOUBLE), 2) AS last FROM n"""
ESTIMATE_WIDTH = f"SELECT p_partkey, round({width('p_name', 11.0)}::DOUBLE, 6) AS width FROM part"
FIT_FONT_SIZE = f"""WITH u AS (SELECT p_partkey, {width('p_name', 1.0)}::DOUBLE AS units, p_size * 2.0::DOUBLE AS w FROM part)
SELECT p_partkey, round(CASE WHEN units * 12.0 <= w THEN 12.0 ELSE greatest(12.0 - greatest(ceil((12.0 - w / units) / 0.25 - 1e-9), 0) * 0.25, 4.0) END::DOUBLE, 6) AS size FROM u"""
AMOUNT_TOKENS = f"""WITH {INVOICE}, tokens AS (SELECT unnest(string_split(text, ' ')) AS token FROM invoice),
k AS (SELECT token, CASE WHEN {amount('token', True)} THEN 'money' WHEN {amount('token', False)} THEN 'amount' ELSE 'text' END AS kind FROM tokens)
SELECT kind, count(*) AS n, count(DISTINCT token) AS n_distinct FROM k GROUP BY kind"""
ACCOUNTING_AMOUNTS = f"""WITH c AS (SELECT c_custkey, CAST(abs(CAST(c_acctbal AS DECIMAL(18,2))) AS VARCHAR) AS p FROM customer),
f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '(' || p || ')' WHEN 1 THEN p || '-' WHEN 2 THEN '$' || p ELSE '((' || p || '))' END AS text FROM c)
SELECT c_custkey, text, {amount('text', False)} AS amount, {amount('text', True)} AS money FROM f"""
MATCH_KEYS = """WITH k AS (SELECT p_partkey, trim(regexp_replace(p_type || '  - ' || p_brand || ' 1,234', '\\s+', ' ', 'g')) AS key FROM part)
SELECT p_partkey, key, regexp_replace(key, '(\\d)[, ](\\d{3})$', '\\1\\2') AS loose, regexp_replace(key, '\\s*-\\s*', '-', 'g') AS soft FROM k"""
GARBLED_LINES = r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT lang, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM l)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE length(t) = 0 OR length(t) - length(replace(t, '\', '')) >= 2 OR regexp_matches(t, '\\[A-Za-z]')
  OR length(regexp_replace(t, '[^\x20-\x7E\t\x{A0}-\x{10FFFF}]', '', 'g')) < length(t) * 0.8::DOUBLE) AS n_bad FROM t GROUP BY lang"""
PAGE_RANGES = """WITH s AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 + 1 AS a, o_orderkey % 7 + 3 AS b, o_orderkey % 11 + 1 AS c FROM orders),
r AS (SELECT *, CASE WHEN a <= b AND b <= 10 AND c <= 10 THEN list_concat(range(a, b + 1), CASE WHEN c BETWEEN a AND b THEN []::BIGINT[] ELSE [c] END) END AS p FROM s)
SELECT doc_id, a || '-' || b || ', ' || c AS spec, coalesce(array_to_string(p, ','), 'error') AS pages FROM r"""
_SHARED = """(CASE WHEN least(r.x + r.width, m.x + m.width) > greatest(r.x, m.x) AND least(r.y + r.height, m.y + m.height) > greatest(r.y, m.y)
  THEN (least(r.x + r.width, m.x + m.width) - greatest(r.x, m.x)) * (least(r.y + r.height, m.y + m.height) - greatest(r.y, m.y)) ELSE 0 END)"""
IOU = f"""WITH {MARKS}, p AS (SELECT r.doc_id, r.line, {_SHARED} AS shared, r.width * r.height + m.width * m.height AS total FROM runs r JOIN marks m ON r.doc_id = m.doc_id AND r.line = m.line WHERE r.ord = 3)
SELECT doc_id, line, round(shared / (total - shared), 6) AS iou, round(shared, 6) AS shared FROM p"""
MARQUEE = f"""WITH {RUNS} SELECT doc_id, line, ord, text FROM runs r WHERE r.x < 550 AND r.x + r.width > 400 AND r.y < 660 AND r.y + r.height > 640"""
REDACT_KEPT = f"""WITH {MARKS} SELECT doc_id, count(*) AS n_kept, count(*) FILTER (WHERE ord = 3) AS n_amounts FROM runs r
WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.kind = 'erase' AND m.doc_id = r.doc_id AND {overlap('r', 'm', 0.35)}) GROUP BY doc_id"""
MARKS_OFF_ERASE = f"""WITH {MARKS} SELECT doc_id, line FROM marks h WHERE kind = 'highlight'
AND NOT EXISTS (SELECT 1 FROM marks m WHERE m.kind = 'erase' AND m.doc_id = h.doc_id AND {overlap('h', 'm', 1.0)})"""
OVERLAPPING_RUNS = f"""WITH {RUNS}, w AS (SELECT doc_id, line, ord, x, CASE WHEN ord = 0 THEN 310.0 + line * 10 ELSE width END AS width FROM runs)
SELECT a.doc_id, a.line, a.ord, b.ord AS b_ord FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.line = b.line AND a.ord < b.ord
WHERE least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) >= 0.55 * least(a.width, b.width)"""
BEST_IOU = f"""WITH {MARKS}, p AS (SELECT m.doc_id, m.line, r.line * 10 + r.ord AS b_ord, {_SHARED} AS shared, r.width * r.height + m.width * m.height AS total FROM runs r JOIN marks m ON r.doc_id = m.doc_id WHERE {overlap('r', 'm', 0.0)}),
q AS (SELECT *, shared / (total - shared) AS iou FROM p)
SELECT doc_id, line, b_ord, round(iou, 6) AS iou FROM q WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY iou DESC, b_ord) = 1"""
CLUSTER_COLUMNS = f"""WITH {COLUMNS} SELECT doc_id, line, ord, "column" FROM columns0"""
COLUMN_LABELS = f"""WITH {COLUMNS},
c AS (SELECT doc_id, line, "column", string_agg(text, ' ' ORDER BY x, ord) AS text FROM columns0 GROUP BY doc_id, line, "column"),
e AS (SELECT *, len(list_filter(string_split(trim(text), ' '), lambda t: NOT {amount('t', False)})) = 0 AS every, len(string_split(trim(text), ' ')) > 1 AS many FROM c),
a AS (SELECT *, every OR {amount('text', False)} AS amount FROM e),
l AS (SELECT *, sum(amount::INT) OVER w AS amounts, count(*) OVER w AS n, max(CASE WHEN amount THEN "column" END) OVER w AS last FROM a WINDOW w AS (PARTITION BY doc_id, line))
SELECT doc_id, line, "column", CASE WHEN amount AND every AND many THEN 'Amount / Balance' WHEN amount AND "column" = last AND (amounts > 1 OR (n >= 3 AND last <> 0)) THEN 'Balance'
  WHEN amount THEN 'Amount' WHEN "column" = 0 THEN 'Description' ELSE 'Column ' || ("column" + 1) END AS label, text FROM l WHERE n >= 2"""
VISUAL_BANDS = f"WITH {RUNS} SELECT doc_id, line, ord, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY y DESC) - 1 AS INTEGER) AS band FROM runs"
_BOX = f"""WITH {RUNS}, b AS (SELECT *, min(x) OVER g AS lo, max(x + width) OVER g AS hi, sum(width) OVER g AS total, count(*) OVER g AS n,
  coalesce(sum(width) OVER o, 0) AS used, count(*) OVER o AS k FROM runs WINDOW g AS (PARTITION BY doc_id, line), o AS (PARTITION BY doc_id, line ORDER BY x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, line, ord, round(%s, 6) AS new_x FROM b"""
ALIGN = {
    "left": _BOX % "lo", "right": _BOX % "hi - width", "center": _BOX % "lo + (hi - lo - width) / 2",
    "justify": _BOX % "CASE WHEN n = 1 THEN lo ELSE lo + used + k * ((hi - lo - total) / (n - 1)) END",
}
SELECTION_BOUNDS = f"WITH {RUNS} SELECT doc_id, round(min(x), 6) AS x, round(min(y), 6) AS y, round(max(x + width) - min(x), 6) AS width, round(max(y + height) - min(y), 6) AS height FROM runs GROUP BY doc_id"
SPLIT_PAGES = f"""WITH {PAGES}, n AS (SELECT *, CAST((pos - 1) // 4 AS INTEGER) AS part, max(pos) OVER (PARTITION BY doc_id) AS last FROM pages0)
SELECT doc_id, pos, page_id, part, CAST((pos - 1) % 4 + 1 AS INTEGER) AS part_pos, (part * 4 + 1) || '-' || least(part * 4 + 4, last) AS part_name FROM n"""
EXTRACT_PAGES = f"WITH {PAGES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS pos, page_id FROM pages0 WHERE page_id % 3 = 0"
DELETE_PAGES = f"""WITH {PAGES}, k AS (SELECT *, page_id % 3 = 1 AS keep, bool_or(page_id % 3 = 1) OVER (PARTITION BY doc_id) AS any_kept FROM pages0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS pos, page_id FROM k WHERE keep OR NOT any_kept"""
REORDER_PAGES = f"WITH {PAGES} SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) + 1 - pos AS INTEGER) AS pos, page_id FROM pages0"
MOVE_PAGE = f"""WITH {PAGES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pages0)
SELECT doc_id, CAST(CASE WHEN pos = n THEN 1 ELSE pos + 1 END AS INTEGER) AS pos, page_id FROM n"""
MERGE_DOCUMENTS = f"""WITH {PAGES} SELECT c_nationkey AS merged_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, pos) AS pos, doc_id, pos AS page FROM pages0 JOIN customer ON doc_id = c_custkey"""
ROTATE_PAGES = f"WITH {PAGES} SELECT doc_id, pos, CAST(CASE WHEN pos % 2 = 0 THEN (rotation + 270) % 360 ELSE rotation END AS INTEGER) AS rotation FROM pages0"
ROTATE_ABSOLUTE = f"WITH {PAGES} SELECT CAST(CASE WHEN pos = 1 THEN 180 ELSE rotation END AS INTEGER) AS rotation, count(*) AS n FROM pages0 GROUP BY 1"
IDENTITY_ORDER = f"""WITH {PAGES} SELECT doc_id, doc_id % 2 = 0 OR count(*) = 1 AS identity FROM pages0 GROUP BY doc_id"""
SIGNER_STATUS = f"""WITH {SIGN}, s AS (SELECT packet, signer, stage, count(*) FILTER (WHERE required) AS required, count(*) FILTER (WHERE required AND filled) AS filled FROM sign GROUP BY packet, signer, stage)
SELECT packet, signer, stage, required, filled, required = filled AS complete,
  NOT EXISTS (SELECT 1 FROM s o WHERE o.packet = s.packet AND o.stage < s.stage AND o.required <> o.filled) AS unlocked FROM s"""
NEXT_SIGNER = f"""WITH {SIGN}, s AS (SELECT packet, signer, stage, count(*) FILTER (WHERE required) = count(*) FILTER (WHERE required AND filled) AS complete FROM sign GROUP BY packet, signer, stage)
SELECT packet, stage, signer FROM s WHERE NOT complete QUALIFY row_number() OVER (PARTITION BY packet ORDER BY stage, signer) = 1"""
SIDECAR = f"""WITH {SIGN}, s AS (SELECT packet, signer, stage, count(*) FILTER (WHERE required) AS n, count(*) FILTER (WHERE required AND filled) AS done,
  string_agg('{{"field":' || field || ',"required":' || required || ',"filled":' || filled || '}}', ',' ORDER BY field, required, filled) AS fields FROM sign GROUP BY packet, signer, stage),
u AS (SELECT *, NOT EXISTS (SELECT 1 FROM s o WHERE o.packet = s.packet AND o.stage < s.stage AND o.n <> o.done) AS unlocked FROM s)
SELECT packet, '[' || string_agg('{{"stage":' || stage || ',"signer":' || signer || ',"complete":' || (n = done) || ',"unlocked":' || unlocked || ',"fields":[' || fields || ']}}', ',' ORDER BY stage, signer) || ']' AS signers FROM u GROUP BY packet"""
UNCERTAIN_WORDS = f"WITH {WORDS} SELECT doc_id, page, count(*) AS n, min(confidence) AS least FROM words WHERE confidence < 72 GROUP BY doc_id, page"
VERIFY_GATE = f"""WITH {WORDS} SELECT doc_id, page, count(*) FILTER (WHERE confidence < 72 AND NOT (ord % 2 = 0 OR page = 0)) AS pending,
  count(*) FILTER (WHERE confidence < 72 AND NOT (ord % 2 = 0 OR page = 0)) > 0 AS blocked FROM words GROUP BY doc_id, page"""
CLASSIFY_PAGES = """WITH c AS (SELECT o_orderkey AS k, o_orderkey % 13 AS shows, o_orderkey % 3 AS images, o_orderkey % 11 AS lines, (o_orderkey % 10) / 10.0 AS match, (o_orderkey % 7) / 10.0 AS garbled FROM orders)
SELECT k AS doc_id, CASE WHEN shows = 0 AND images > 0 THEN 'image-only' WHEN shows = 0 THEN 'no-operators'
  WHEN images > 0 AND lines >= 1 AND match < 0.35 AND garbled < 0.45 AND NOT (shows >= 8 AND lines >= 8) THEN 'ocr-ghost' ELSE 'ok' END AS reason FROM c"""
OTSU = """WITH h AS (SELECT event_type AS image_id, CAST(least(255, greatest(0, floor(value))) AS INTEGER) AS level, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
c AS (SELECT image_id, level, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER t AS w, sum(n * level) OVER t AS s FROM h
  WINDOW u AS (PARTITION BY image_id ORDER BY level ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY image_id)),
v AS (SELECT image_id, level, CASE WHEN w > w0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE 0 END AS b FROM c)
SELECT image_id, level AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY b DESC, level) = 1"""
#: Searched phrases: the words of every benchmark item by five, and the longest word of every item.
QUERIES = r"""b AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
q AS (SELECT item_id * 100000 + k // 5 AS query_id, lower(array_to_string(w[k + 1 : k + 5], ' ')) AS needle FROM (SELECT item_id, w, unnest(range(0, len(w), 5)) AS k FROM b)
  UNION ALL SELECT item_id * 100000 + 99999, lower(list_filter(w, lambda x: length(x) = list_max([length(v) FOR v IN w]))[1]) FROM b)"""
HITS = f"""{LINES}, {QUERIES}, l AS (SELECT doc_id, seq, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS text FROM lines),
h AS (SELECT query_id, doc_id, seq, text, string_split(text, needle) AS gaps, length(needle) AS n FROM l JOIN q ON contains(text, needle)),
e AS (SELECT query_id, doc_id, seq, text, n, gaps, unnest(range(1, len(gaps))) AS k FROM h),
hits AS (SELECT query_id, doc_id, seq, text, CAST(list_sum([length(g) FOR g IN gaps[1:k]]) + (k - 1) * n AS INTEGER) AS start,
  CAST(list_sum([length(g) FOR g IN gaps[1:k]]) + k * n AS INTEGER) AS "end" FROM e)"""
PAGE_PHRASES = f"""WITH {HITS.replace("FROM lines)", "FROM (SELECT doc_id, 0 AS seq, text FROM documents))")}, c AS (SELECT *, greatest(start - 28, 0) AS lo, least("end" + 28, length(text)) AS hi FROM hits)
SELECT query_id, doc_id, start, "end", CASE WHEN lo > 0 THEN '…' ELSE '' END || substring(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS snippet FROM c"""
HIT_BOXES = f"""WITH {RUNS}, r AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY x, ord) - length(text) - 1 AS INTEGER) AS b FROM runs),
l AS (SELECT doc_id, line, string_split(lower(string_agg(text, ' ' ORDER BY x, ord)), 'widget 1') AS gaps FROM runs GROUP BY doc_id, line),
e AS (SELECT doc_id, line, gaps, unnest(range(1, len(gaps))) AS k FROM l WHERE len(gaps) > 1),
h AS (SELECT doc_id, line, CAST(list_sum([length(g) FOR g IN gaps[1:k]]) + (k - 1) * 8 AS INTEGER) AS start FROM e)
SELECT h.doc_id, 1 AS page, h.line, start, round(x + greatest(start - b, 0) * (width / length(text)) - 1.6, 6) AS x, round(y - 1.6, 6) AS y,
  round((least(start + 8 - b, length(text)) - greatest(start - b, 0)) * (width / length(text)) + 3.2, 6) AS width, round(height + 3.2, 6) AS height
FROM h JOIN r USING (doc_id, line) WHERE greatest(start - b, 0) < least(start + 8 - b, length(text))"""
PHRASE_SEARCH = f"""WITH {HITS} SELECT query_id, doc_id, seq, start, "end" FROM hits"""
PHRASE_SNIPPETS = f"""WITH {HITS}, c AS (SELECT *, greatest(start - 28, 0) AS lo, least("end" + 28, length(text)) AS hi FROM hits)
SELECT query_id, doc_id, seq, start, "end", CASE WHEN lo > 0 THEN '…' ELSE '' END || substring(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '…' ELSE '' END AS snippet FROM c"""
PAGE_VIEWPORT = f"""WITH {PAGES} SELECT doc_id, pos,
  CAST(CASE rotation WHEN 0 THEN 150.0 WHEN 90 THEN pos * 15.0 WHEN 180 THEN 892.5 - 150.0 ELSE 1263.0 - pos * 15.0 END AS DOUBLE) AS view_x,
  CAST(CASE rotation WHEN 0 THEN 1263.0 - pos * 15.0 WHEN 90 THEN 150.0 WHEN 180 THEN pos * 15.0 ELSE 892.5 - 150.0 END AS DOUBLE) AS view_y,
  CAST(100.0 AS DOUBLE) AS x, CAST(pos * 10.0 AS DOUBLE) AS y FROM pages0"""
CONTAIN_FIT = """WITH s AS (SELECT p_partkey, p_size + 10.0::DOUBLE AS sw, p_partkey % 50 + 5.0::DOUBLE AS sh FROM part), f AS (SELECT *, least(200.0::DOUBLE / sw, 100.0::DOUBLE / sh) AS k FROM s)
SELECT p_partkey, round((200.0::DOUBLE - sw * k) / 2, 6) + 0 AS x, round((100.0::DOUBLE - sh * k) / 2, 6) + 0 AS y, round(sw * k, 6) AS w, round(sh * k, 6) AS h FROM f"""
ORDER_QUAD = """WITH c AS (SELECT p_partkey, 10.0::DOUBLE + p_partkey % 7 AS tl_x, 12.0::DOUBLE + p_partkey % 3 AS tl_y, 184.0::DOUBLE - p_partkey % 5 AS tr_x, 8.0::DOUBLE + p_partkey % 4 AS tr_y,
  180.0::DOUBLE + p_partkey % 6 AS br_x, 90.0::DOUBLE + p_partkey % 8 AS br_y, 12.0::DOUBLE + p_partkey % 2 AS bl_x, 88.0::DOUBLE - p_partkey % 9 AS bl_y FROM part),
d AS (SELECT *, abs(tl_x * tr_y - tr_x * tl_y + tr_x * br_y - br_x * tr_y + br_x * bl_y - bl_x * br_y + bl_x * tl_y - tl_x * bl_y) / 2 AS area,
  sqrt((tl_x - tr_x) ** 2 + (tl_y - tr_y) ** 2) AS t, sqrt((tr_x - br_x) ** 2 + (tr_y - br_y) ** 2) AS r, sqrt((bl_x - br_x) ** 2 + (bl_y - br_y) ** 2) AS b, sqrt((tl_x - bl_x) ** 2 + (tl_y - bl_y) ** 2) AS l FROM c),
e AS (SELECT *, abs((bl_x - tl_x) * (tr_x - tl_x) + (bl_y - tl_y) * (tr_y - tl_y)) / (l * t) AS c1, abs((tl_x - tr_x) * (br_x - tr_x) + (tl_y - tr_y) * (br_y - tr_y)) / (t * r) AS c2,
  abs((tr_x - br_x) * (bl_x - br_x) + (tr_y - br_y) * (bl_y - br_y)) / (r * b) AS c3, abs((br_x - bl_x) * (tl_x - bl_x) + (br_y - bl_y) * (tl_y - bl_y)) / (b * l) AS c4 FROM d)
SELECT p_partkey, tl_x, tl_y, tr_x, tr_y, br_x, br_y, bl_x, bl_y, round(area, 6) AS area,
  round(least(1.0, greatest(0.0, (1 - abs(t - b) / greatest(t, b, 1) + 1 - abs(l - r) / greatest(l, r, 1) + (4 - c1 - c2 - c3 - c4) / 4) / 3)), 6) AS rectangularity FROM e"""

FONT_NAME = """fonts0 AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'ABCDEF+Helvetica-Bold' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'Arial,BoldItalic' WHEN 3 THEN 'CourierNewPSMT'
  WHEN 4 THEN p_name || ' Sans' WHEN 5 THEN 'HelveticaNeue65Medium' ELSE p_brand || ' Serif Oblique' END AS name FROM part)"""
_SUBSET = "regexp_replace(name, '^[A-Z]{6}\\+', '')"
_PLAIN = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({n}, '[,_{x}]', '-', 'g'), '\\s+', '-', 'g'), '(?i)mt$', ''), '(?i)ps$', ''))"


def font_sql() -> str:
    from paperloom.functions.fonts import FAMILIES, STYLE_SUFFIX, WEIGHT_NUMBER

    key = _PLAIN.replace("{n}", _SUBSET)
    face = f"regexp_replace({key.replace('{x}', '+')}, '[^a-z0-9]+', '', 'g')"
    whens = " ".join(f"WHEN regexp_matches(lower(name), '{p}') THEN '{k}'" for k, p in FAMILIES)
    return f"""WITH {FONT_NAME}, f AS (SELECT p_partkey, name, {key.replace('{x}', '')} AS font_key, {face} AS face_key,
  CASE {whens} WHEN regexp_matches(lower(name), '\\bserif\\b') AND NOT regexp_matches(lower(name), 'sans') THEN 'times' WHEN contains(lower(name), 'sans') THEN 'helvetica'
    WHEN contains(lower(name), 'mono') THEN 'courier' ELSE 'unknown' END AS family,
  regexp_matches(name, '(?i)bold|black|heavy|semibold|demi') AS bold, regexp_matches(name, '(?i)italic|oblique|obli') AS italic FROM fonts0)
SELECT p_partkey, name, font_key, face_key, regexp_replace(regexp_replace(face_key, '{WEIGHT_NUMBER}', ''), '{STYLE_SUFFIX}', '') AS face_stem, family, bold, italic,
  CASE family WHEN 'times' THEN 'Times' WHEN 'courier' THEN 'Courier' ELSE 'Helvetica' END ||
  CASE WHEN bold AND italic THEN CASE family WHEN 'times' THEN '-BoldItalic' ELSE '-BoldOblique' END WHEN bold THEN '-Bold' WHEN italic THEN CASE family WHEN 'times' THEN '-Italic' ELSE '-Oblique' END
    WHEN family = 'times' THEN '-Roman' ELSE '' END AS standard FROM f"""


MISSING_GLYPHS = """SELECT doc_id, length(regexp_replace(translate(text, '€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ', ''), '[\\t\\n\\r\\x20-\\x7e\\x{a0}-\\x{ff}]', '', 'g')) AS n_missing FROM documents"""
EXPORT_NAMES = f"""WITH {MARKS} SELECT doc_id, doc_id || CASE WHEN bool_or(kind = 'erase') THEN '-redacted.pdf' ELSE '-marked.pdf' END AS file,
  count(*) FILTER (WHERE kind = 'highlight') AS n_editor, count(*) FILTER (WHERE kind = 'erase') AS n_erase FROM marks GROUP BY doc_id"""
SIZE_LABELS = """SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(CAST(round(b / 1024.0) AS BIGINT) AS VARCHAR) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', round(b / 1048576.0, 1)) || ' MB'
  ELSE printf('%.2f', round(b / 1073741824.0, 2)) || ' GB' END AS label FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 701 AS BIGINT) AS b FROM orders)"""
STAMPS = "SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' AS stamp FROM orders"
NEW_NAMES = """WITH n AS (SELECT p_partkey, p_name || '.pdf' AS original, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(p_name) WHEN 2 THEN 'copy of ' || p_name ELSE ' ' || p_name || '.PDF ' END AS suggested FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN suggested || '.pdf' ELSE regexp_replace(original, '\\.pdf$', '') || '-edited.pdf' END AS name FROM n"""
FILL_FORM = """WITH f AS (SELECT c_custkey AS doc_id, unnest(['segment', 'balance', 'active']) AS name, unnest(['text', 'text', 'checkbox']) AS kind,
    unnest([c_mktsegment, 'none', 'off']) AS value, c_custkey % 5 <> 0 AS fillable, unnest([c_custkey % 3 = 0, false, false]) AS read_only FROM customer),
v AS (SELECT c_custkey AS doc_id, 'segment' AS name, 'S' || c_nationkey AS new_value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'active', CASE WHEN c_custkey % 4 = 0 THEN 'Yes' ELSE 'no' END FROM customer),
j AS (SELECT f.*, v.new_value, v.new_value IS NOT NULL AND fillable AND NOT read_only AS filled FROM f LEFT JOIN v ON f.doc_id = v.doc_id AND f.name = v.name)
SELECT doc_id, name, kind, filled, CASE WHEN filled THEN CASE WHEN kind = 'checkbox' THEN CASE WHEN lower(new_value) IN ('yes', 'true', 'on', '1') THEN 'yes' ELSE 'off' END ELSE new_value END ELSE value END AS value FROM j"""
CONTENT_SHOWS = f"WITH {RUNS} SELECT doc_id, text, CASE WHEN ord = 0 THEN 'F1' ELSE 'F2' END AS font, x, y FROM runs"
CONTENT_TOKENS = f"""WITH {RUNS}, k AS (SELECT unnest(['op', 'name', 'num', 'op', 'num', 'op', 'string', 'op', 'op']) AS kind, unnest([1, 1, 1, 1, 6, 1, 1, 1, 1]) AS n FROM runs)
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY kind"""
TONE = """WITH p AS (SELECT vec_id, [v * 127.0::DOUBLE + 128.0::DOUBLE FOR v IN embedding] AS px FROM embeddings)
SELECT vec_id, round(list_sum([least(255.0, greatest(0.0, floor((v * 2.0::DOUBLE ** 0.5 - 128.0) * 1.2 + 128.0 + 0.5))) FOR v IN px])::DOUBLE, 3) AS total FROM p"""
EVENT_WINDOWS = """SELECT epoch_ms(CAST(floor(epoch_ms(ts) / 3600000) * 3600000 AS BIGINT)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"""

SPLIT_DRAFTS = f"""WITH {RUNS}, l AS (SELECT doc_id, line, list_reverse(string_split(string_agg(text, ' ' ORDER BY ord), ' ')) AS w FROM runs GROUP BY doc_id, line),
t AS (SELECT doc_id, line, ord, len(string_split(text, ' ')) AS take FROM runs),
f AS (SELECT *, coalesce(sum(take) OVER (PARTITION BY doc_id, line ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skip FROM t)
SELECT doc_id, line, ord, array_to_string(w[CAST(skip AS BIGINT) + 1:CASE WHEN ord = 3 THEN len(w) ELSE CAST(skip + take AS BIGINT) END], ' ') AS draft FROM f JOIN l USING (doc_id, line)"""
WRAPPED = """WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS l FROM part) SELECT p_partkey, CAST(unnest(range(len(l))) AS INTEGER) AS n, unnest(l) AS line FROM w"""
MATCH_LINES = f"""WITH {RUNS}, s AS (SELECT DISTINCT doc_id, text FROM runs WHERE NOT (doc_id % 3 = 0 AND ord = 3)),
j AS (SELECT r.doc_id, s.text IS NOT NULL AS met FROM runs r LEFT JOIN s ON r.doc_id = s.doc_id AND r.text = s.text)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE met) AS n_matched, round(count(*) FILTER (WHERE met) / count(*), 6) AS ratio FROM j GROUP BY doc_id"""
