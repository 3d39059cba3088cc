"""DuckDB SQL of the operators that SQL can express."""

#: Nodes level by level; a row's proof joins each level's run. crc32 is spelled out, bit by bit, over the digits of doc_id.
MERKLE_MANIFEST = r"""
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER () AS row_no,
    coalesce(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1, false) AS touched
  FROM documents),
leaves AS (
  SELECT row_no, doc_id, source, touched,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS altered
  FROM (SELECT *, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM docs)),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes(source, level, place, n, digest) AS (
  SELECT source, 0, place, n, leaf FROM ranks
  UNION ALL
  SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY source, level, place // 3, n),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, place, n, digest) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 3, n),
powers AS (SELECT k AS level, (3 ** k)::BIGINT AS size FROM range(39) t(k)),
steps AS (
  SELECT r.row_no, n.level, r.place // p.size % 3 AS own, n.place % 3 AS other, n.digest
  FROM ranks r JOIN powers p ON true JOIN nodes n ON n.level = p.level AND n.source IS NOT DISTINCT FROM r.source AND n.n > 1 AND n.place // 3 = r.place // p.size // 3
  UNION ALL
  SELECT r.row_no, 100 + t.level, s.place // p.size % 3, t.place % 3, t.digest
  FROM ranks r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN powers p ON true JOIN tops t ON t.level = p.level AND t.n > 1 AND t.place // 3 = s.place // p.size // 3),
beside AS (
  SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY level) AS step,
    coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY other) FILTER (WHERE other > own), '') AS behind
  FROM steps GROUP BY row_no, level),
folded(row_no, step, digest) AS (
  SELECT row_no, 0, CASE WHEN touched THEN altered ELSE leaf END FROM ranks
  UNION ALL
  SELECT f.row_no, f.step + 1, sha256(b.before || f.digest || b.behind) FROM folded f JOIN beside b ON b.row_no = f.row_no AND b.step = f.step + 1),
proofs AS (SELECT r.row_no, sha256(coalesce(string_agg(b.before || b.behind, '' ORDER BY b.step), '')) AS proof_sha256 FROM ranks r LEFT JOIN beside b USING (row_no) GROUP BY r.row_no),
ends AS (SELECT row_no, arg_max(digest, step) AS folded_root FROM folded GROUP BY row_no)
SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, p.proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM ranks r JOIN subroots s ON s.source IS NOT DISTINCT FROM r.source JOIN tops t ON t.n = 1 JOIN proofs p USING (row_no) JOIN ends e USING (row_no)
"""

#: Distances are sums over joined components; a round's centroids are rows of the recursion.
CENTROID_CLUSTERING = r"""
WITH RECURSIVE kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
rounds(round, cluster, c) AS (
  SELECT 0, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1, v FROM (SELECT * FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT 8)
  UNION ALL
  SELECT o.round + 1, o.cluster, coalesce(m.c, o.c)
  FROM rounds o LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c
    FROM (SELECT cluster, dim, sum(x) AS s, count(*) AS n
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim
        FROM (SELECT k.row_no, any_value(k.v) AS v, arg_min(r.cluster, list_sum(list_transform(list_zip(k.v, r.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * 8 + r.cluster) AS cluster
          FROM kept k JOIN rounds r ON true GROUP BY k.row_no))
      GROUP BY cluster, dim) GROUP BY cluster) m ON m.cluster = o.cluster
  WHERE o.round < 10),
ends AS (SELECT cluster, c FROM rounds WHERE round = 10),
assigned AS (
  SELECT vec_id, k.row_no, arg_min(cluster, distance::HUGEINT * 8 + cluster) AS cluster, min(distance)::BIGINT AS distance
  FROM (SELECT k.row_no, k.vec_id, e.cluster, list_sum(list_transform(list_zip(k.v, e.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM kept k JOIN ends e ON true) k GROUP BY vec_id, k.row_no)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM assigned JOIN ends USING (cluster)
"""

WARC = r"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS nth, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN first END AS refers_to
FROM q
"""
