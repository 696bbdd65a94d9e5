"""SQL fragments shared by oracle queries (DuckDB dialect).

They restate, in SQL, the definitions used by the Spark operators: the same
regular expressions (RE2 and Java agree on them) and the same derived views.
"""

from lectern.functions.html import NOISE_RE, TAG_RE
from lectern.functions.text import DIACRITICS_RE, STRIP_RE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_RE)}, '', 'g')"


def diacritics(x: str) -> str:
    return f"regexp_replace({x}, {q(DIACRITICS_RE)}, '', 'g')"


def sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))"


def decode(x: str) -> str:
    from lectern.functions.html import ENTITIES
    for ent, ch in ENTITIES:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def text_nodes(frag: str, sep: str) -> str:
    return (f"array_to_string(list_filter(list_transform(string_split_regex({frag}, {q(TAG_RE)}), "
            f"lambda t: {strip(decode('t'))}), lambda t: t <> ''), {q(sep)})")


def denoise(html: str) -> str:
    return f"regexp_replace({html}, {q(NOISE_RE)}, '', 'g')"


LECTURES = """(SELECT doc_id, lang AS category, source AS section,
        source || ' #' || CAST(doc_id AS VARCHAR) AS title,
        'doc/' || CAST(doc_id AS VARCHAR) AS url,
        'ROOT > ' || lang || ' > ' || source AS path,
        text AS content FROM documents)"""


def chunks_ctes(source: str = "documents") -> str:
    """CTEs (for WITH RECURSIVE) that end in ``chunk(doc_id, chunk_no, chunk)``: the chunker's rule for
    texts whose only separators are line feeds and blanks, jumping from chunk to chunk over running lengths."""
    from lectern.functions.fixed import CHUNK_OVERLAP, CHUNK_SIZE
    return f"""
long_line AS (
  SELECT doc_id, u.j, CASE WHEN u.j > 1 THEN chr(10) ELSE '' END || ls[u.j] AS piece
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source} WHERE length(text) > {CHUNK_SIZE}), unnest(range(1, len(ls) + 1)) AS u(j)
), piece AS (
  SELECT doc_id, j, 1 AS k, length(piece) AS n FROM long_line WHERE length(piece) <= {CHUNK_SIZE}
  UNION ALL
  SELECT doc_id, j, u.k, length(ws[u.k]) + CASE WHEN u.k > 1 THEN 1 ELSE 0 END
  FROM (SELECT doc_id, j, string_split(piece, ' ') AS ws FROM long_line WHERE length(piece) > {CHUNK_SIZE}), unnest(range(1, len(ws) + 1)) AS u(k)
), ruler AS (
  SELECT doc_id, list(e - n ORDER BY j, k) AS starts, list(e ORDER BY j, k) AS ends
  FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY j, k) AS e FROM piece WHERE n > 0) GROUP BY doc_id
), jump AS (
  SELECT doc_id, 0 AS s, len(list_filter(ends, lambda x: x <= {CHUNK_SIZE})) AS e FROM ruler
  UNION ALL
  SELECT doc_id, s2, len(list_filter(ends, lambda x: x - starts[s2 + 1] <= {CHUNK_SIZE}))
  FROM (SELECT r.doc_id, starts, ends,
               len(list_filter(starts, lambda x: x < greatest(starts[e + 1] - {CHUNK_OVERLAP}, ends[e + 1] - {CHUNK_SIZE}))) AS s2
        FROM jump JOIN ruler r ON r.doc_id = jump.doc_id WHERE e < len(ends))
), raw_chunk AS (
  SELECT doc_id, 0 AS a, {strip('text')} AS chunk FROM {source} WHERE length(text) <= {CHUNK_SIZE}
  UNION ALL
  SELECT jump.doc_id, starts[s + 1], {strip('substr(text, (starts[s + 1] + 1)::BIGINT, (ends[e] - starts[s + 1])::BIGINT)')}
  FROM jump JOIN ruler r ON r.doc_id = jump.doc_id JOIN {source} d ON d.doc_id = jump.doc_id
), chunk AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_no, chunk FROM raw_chunk WHERE chunk <> ''
)"""


def term_vectors(source: str, keys: str, text: str, dims: int = 256) -> str:
    """Subquery (keys, vec): L2-normed counts of word pairs hashed into ``dims`` places and rounded to 1/4096, as the offline embedder makes them."""
    folded = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
(SELECT {keys}, list_transform(range({dims}), lambda b: CASE WHEN m IS NULL THEN 0 ELSE floor(coalesce(m[b], 0) / sqrt(ss) * 4096 + 0.5) / 4096 END) AS vec
 FROM (SELECT {keys} FROM {source}) LEFT JOIN
   (SELECT {keys}, map_from_entries(list((b, n))) AS m, sum(n * n)::DOUBLE AS ss FROM
     (SELECT {keys}, ('0x' || md5(w)[1:8])::BIGINT % {dims} AS b, count(*) AS n
      FROM (SELECT {keys}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS w
            FROM (SELECT {keys}, regexp_extract_all({folded}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {source})) GROUP BY ALL)
    GROUP BY ALL) USING ({keys}))"""
