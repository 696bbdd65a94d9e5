"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

_WS = r"[^\x20\x09-\x0D]+"

SQL = {}

SQL["op9_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l
  FROM raw, unnest(range(1, len(ls) + 1)) AS u(i)
), seen AS (
  SELECT doc_id, i, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM line WHERE l <> ''
), win AS (
  SELECT doc_id, pos, l || chr(10) || lead(l) OVER w || chr(10) || lead(l, 2) OVER w AS body
  FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, first_value(doc_id) OVER f AS fd, first_value(pos) OVER f AS fp, row_number() OVER f AS rn
  FROM win WHERE body IS NOT NULL WINDOW f AS (PARTITION BY body ORDER BY doc_id, pos)
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, unnest([0, 1, 2]) AS t(k)
  WHERE rn > 1 AND NOT (doc_id = fd AND pos + k < fp + 3)
), gone_line AS (
  SELECT doc_id, i FROM seen JOIN gone USING (doc_id, pos)
), parts AS (
  SELECT l.doc_id, string_agg(r.ls[l.i], chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n_removed
  FROM line l JOIN raw r USING (doc_id) LEFT JOIN gone_line g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT r.doc_id, p.n_removed, CASE WHEN r.text IS NULL THEN NULL ELSE md5(coalesce(p.kept, '')) END AS text_md5
FROM raw r JOIN parts p USING (doc_id)
"""

SQL["op10_mix"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WS}')), 0) AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source
), fill AS (  -- sources by the share of weight at which they are full; the first ones are capped
  SELECT *, 2.0 * source_size AS cap,
         (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src
), unit AS (
  SELECT arg_min(level, source_size / w) FILTER (level * w <= cap) AS u FROM fill
), target AS (
  SELECT source, source_size, CASE WHEN u IS NULL OR u * w > cap THEN cap ELSE u * w END AS target FROM fill, unit
), placed AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (greatest(0, least(start + size, floor(target)) - start) + greatest(0, least(start + source_size + size, floor(target)) - start - source_size))::BIGINT AS taken
FROM placed
"""

SQL["op6_minhash"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), size AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), arc AS (
  SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, arc.b FROM reach JOIN arc ON arc.a = reach.b
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN size USING (doc_id)
"""

SQL["op5_near_vectors"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM good
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) >= 0.9
), arc AS (
  SELECT x AS a, y AS b FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, arc.b FROM reach JOIN arc ON arc.a = reach.b
), comp AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), deg AS (
  SELECT a AS vec_id, count(*) AS n FROM arc GROUP BY a
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""

SQL["op11_resample"] = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), words AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), gram AS (
  SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
), tally AS (
  SELECT side, row, g, count(*) AS n FROM gram GROUP BY ALL
), coded AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM tally)
), bucketed AS (
  SELECT g, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
                            lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 10000 AS bucket FROM coded, crc_table
), filled AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM tally JOIN bucketed USING (g) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS v FROM filled
), weighed AS (
  SELECT row, sum(n)::BIGINT AS n, floor(sum(n * v) / sum(n))::BIGINT AS weight
  FROM tally JOIN bucketed USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
  SELECT doc_id, row, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (row) WHERE side = 'd'
), ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""

SQL["op12_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_dot_product(a.e, x.e)::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
