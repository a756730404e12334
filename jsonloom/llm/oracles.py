"""DuckDB SQL of the registered queries that SQL can express."""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT d.doc_id, d.pos, d.line, (f.k IS NOT NULL AND d.doc_id > f.first_doc) AS gone
  FROM keyed d LEFT JOIN firsts f ON d.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM by_source),
r AS (SELECT *, cap / weight AS ratio FROM w),
c AS (
  SELECT *, coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS capped, coalesce(sum(weight) OVER b, 0.0::DOUBLE) AS used,
         sum(source_size) OVER ()::DOUBLE AS all_sizes, sum(weight) OVER () AS all_weights
  FROM r WINDOW b AS (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_sizes * 1.5::DOUBLE - capped) / (all_weights - used) AS level FROM c),
a AS (SELECT level AS at_level FROM l WHERE level <= ratio ORDER BY ratio, n LIMIT 1),
goals AS (
  SELECT source, source_size, least(cap, coalesce((SELECT at_level FROM a) * weight, cap)) AS target FROM l),
g AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
p AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (g.epochs * p.size + greatest(0, least(p.size, g.budget - g.epochs * g.source_size - p.before)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""


#: Equal to jsonloom.llm.fingerprint.
OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
l AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
      FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT *, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) AS edited FROM l),
t AS (SELECT doc_id, 0 AS which, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
h AS (
  SELECT doc_id, which, list_transform(string_split(text, chr(10)), lambda x: sha256('0' || x) || sha256('1' || x)) AS p,
         list_transform(list_filter(list_transform(string_split_regex(text, '[
.,;:!?]+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: md5(x)) AS c
  FROM t),
v AS (
  SELECT doc_id, which, len(c) AS m,
         list_transform(range(0, 16), lambda k: (list_sum(list_transform(p, lambda x: ('0x' || substr(x, (8 * k + 1)::INT, 8))::BIGINT)) % 4294967296)::BIGINT) AS equal,
         list_transform(range(0, 48), lambda k: coalesce(list_sum(list_transform(c, lambda x: (('0x' || substr(x, CASE WHEN k < 24 THEN 1 ELSE 17 END, 15))::BIGINT >> (k % 24)::INT) & ONES)), 0)::BIGINT & LANES) AS words
  FROM h),
f AS (
  SELECT doc_id, which,
         list_aggregate(list_transform(equal, lambda x: printf('%08x', x)), 'string_agg', '') || list_aggregate(list_transform(words, lambda x: printf('%016x', x)), 'string_agg', '') || printf('%016x', m) AS fp,
         flatten(list_transform(words, lambda x: list_transform([0, 32], lambda s: ((x >> s) & 1073741823) * 2 - m))) AS signs
  FROM v),
n AS (SELECT *, list_sum(list_transform(signs, lambda x: x * x))::DOUBLE AS norm FROM f),
j AS (
  SELECT e.doc_id, e.n, e.edited, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.norm AS na, b.norm AS nb, c.norm AS nc,
         list_sum(list_transform(range(1, 97), lambda i: a.signs[i] * b.signs[i]))::DOUBLE AS ab,
         list_sum(list_transform(range(1, 97), lambda i: a.signs[i] * c.signs[i]))::DOUBLE AS ac
  FROM e JOIN n a ON a.doc_id = e.doc_id AND a.which = 0 JOIN n b ON b.doc_id = e.doc_id AND b.which = 1 JOIN n c ON c.doc_id = e.next_id AND c.which = 0)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN na * nb > 0 THEN least(0.999::DOUBLE, greatest(0.0::DOUBLE, ab / sqrt(na * nb))) ELSE 0.0::DOUBLE END AS near_edited,
       CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN na * nc > 0 THEN least(0.999::DOUBLE, greatest(0.0::DOUBLE, ac / sqrt(na * nc))) ELSE 0.0::DOUBLE END AS near_next
FROM j
""".replace("ONES", str(0x0000000100000001)).replace("LANES", str(0x3FFFFFFF3FFFFFFF))


OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
found AS (
  SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
         least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id))::BIGINT AS component_id
  FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_source_mix": OP3, "op4_fingerprint": OP4, "op7_jaccard_join": OP7, "op9_embedding_dedup": OP9}
