"""DuckDB SQL of the registered queries. Documents are built from table columns, so most oracles are those columns."""

from __future__ import annotations

from .golden import ACCESS, CROSSOVER, ENUMS, ERRORS, MAPS, NUMBERS, POSITIONS, SORTED, STRINGS, TAPE, TUPLES, WIDE


def _text(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def _values(rows: list[tuple], columns: str, casts: str) -> str:
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns})"


NESTED = "(SELECT o.o_orderkey AS doc_id, l.* FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)"


#: Documents before damage, the way they are damaged, and their length.
DAMAGED = """(SELECT doc_id, lang, CASE WHEN doc_id % 20 = 3 THEN (doc_id // 20) % 4 END AS way,
  length('{"id":' || doc_id || ',"lang":"' || lang || '","n":' || n_chars || '}') AS size FROM documents)"""


def oracle_sql() -> dict[str, str]:
    errors = [(i, policy, e, s if policy == "stage" else f) for i, (_, _, e, s, f) in enumerate(ERRORS) for policy in ("stage", "earliest")]
    sizes = "octet_length(encode(%s))"
    return {
        "flagship_events": "SELECT event_type, count(*) AS docs, sum((props->>'$.k')::BIGINT)::BIGINT AS sum_k, sum(1 + 2 * len(json_keys(props)))::BIGINT AS nodes FROM events GROUP BY event_type",
        "validate_counts": f"SELECT 'events' AS source, count_if(json_valid(props))::BIGINT AS good, count_if(NOT json_valid(props))::BIGINT AS bad FROM events UNION ALL SELECT 'orders', count(*), 0 FROM orders UNION ALL SELECT 'nested', count(DISTINCT doc_id), 0 FROM {NESTED} UNION ALL SELECT 'documents', count(*), 0 FROM documents",
        "error_report": _values(errors, "doc_id, policy, error, a", "doc_id::BIGINT AS doc_id, policy, error, a::BIGINT AS \"at\""),
        "token_counts": "SELECT count(*) AS docs, (count(*) * 21)::BIGINT AS tokens, (count(*) * 11)::BIGINT AS skeleton, (count(*) * 7)::BIGINT AS strings, (count(*) * 3)::BIGINT AS scalars, (count(*) * 15)::BIGINT AS tape_words FROM orders",
        "depth_profile": f"SELECT 1::INT AS depth, 'object' AS container, count(DISTINCT doc_id) AS n FROM {NESTED} UNION ALL SELECT 2, 'array', count(DISTINCT doc_id) FROM {NESTED} UNION ALL SELECT 3, 'object', count(*) FROM {NESTED}",
        "child_counts": f"SELECT doc_id, count(*) AS lines, true AS paired FROM {NESTED} GROUP BY doc_id",
        "number_kinds": _values(list(NUMBERS), "text, kind, bits", "text, kind, bits::BIGINT AS bits"),
        "string_errors": _values(list(STRINGS), "text, a, error", "text, a::BIGINT AS \"at\", error"),
        "unescape_roundtrip": "SELECT doc_id, text FROM documents",
        "record_offsets": f"SELECT o_orderkey AS doc_id, 7::BIGINT AS records, (length('o_orderkeyo_custkeyo_orderstatuso_totalpriceo_orderpriority') + length(o_orderstatus) + 6 * 5)::BIGINT AS last_offset, (length('o_orderkeyo_custkeyo_orderstatuso_totalpriceo_orderpriority') + length(o_orderstatus) + {sizes % 'o_orderpriority'})::BIGINT AS raw_bytes FROM orders",
        "get_path": "SELECT o_orderkey AS doc_id, o_totalprice AS price, o_orderstatus AS status FROM orders",
        "at_index": f"SELECT doc_id, (n - 1)::INT AS i, l_quantity AS quantity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_quantity, l_returnflag) AS n FROM {NESTED}) WHERE n IN (1, 3)",
        "row_local_navigation": f"SELECT doc_id, 3::BIGINT AS members, count(*) AS lines, min(l_linenumber)::BIGINT AS first_line, false AS has_absent, 'object' AS kind FROM {NESTED} GROUP BY doc_id",
        "entries": "SELECT key, ordinal::BIGINT AS ordinal, kind, (SELECT count(*) FROM orders) AS n FROM (VALUES ('o_orderkey', 0, 'int64'), ('o_custkey', 1, 'int64'), ('o_orderstatus', 2, 'string'), ('o_totalprice', 3, 'double'), ('o_orderpriority', 4, 'string')) t(key, ordinal, kind)",
        "elements": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_quantity, l_returnflag) - 1)::BIGINT AS ordinal, l_linenumber::BIGINT AS line, 3::BIGINT AS members FROM {NESTED}",
        "descendants": f"SELECT doc_id, (count(*) * 4)::BIGINT AS nodes FROM {NESTED} GROUP BY doc_id",
        "duplicates": "SELECT event_id AS doc_id, event_id AS first, event_id * 2 AS last, 2::BIGINT AS copies FROM events",
        "stats_walk": f"SELECT o_orderkey AS doc_id, 9::BIGINT AS node_count, (length('o_orderkeyo_custkeyo_orderstatuso_orderpriority') + {sizes % 'o_orderstatus'} + {sizes % 'o_orderpriority'})::BIGINT AS string_bytes, xor(o_orderkey, o_custkey) AS number_xor FROM orders",
        "typed_struct": "SELECT o_orderkey AS doc_id, o_orderkey AS orderkey, o_orderstatus AS status, o_totalprice AS price, NULL::INT AS absent FROM orders",
        "typed_array": f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_quantity, l_returnflag) - 1)::INT AS i, l_linenumber::INT AS line, l_quantity AS quantity, '' AS error FROM {NESTED}",
        "typed_positional": _values([(i, a, b, e) for i, (_, a, b, e) in enumerate(POSITIONS)], "doc_id, a, b, error", "doc_id::BIGINT AS doc_id, a::INT AS a, b, error"),
        "typed_map_keys": _values([(i, e, f) for i, (_, e, f) in enumerate(MAPS)], "doc_id, entries, failed", "doc_id::BIGINT AS doc_id, entries, failed"),
        "typed_enum": _values([(i, v, p, f) for i, (_, v, p, f) in enumerate(ENUMS)], "doc_id, variant, has_payload, failed", "doc_id::BIGINT AS doc_id, variant, has_payload, failed"),
        "tape_words": _values(list(enumerate(TAPE[1])), "idx, word", "idx::BIGINT AS idx, word::BIGINT AS word"),
        "tape_buffers": f"SELECT o_orderkey AS doc_id, 17::BIGINT AS words, (length('o_orderkeyo_custkeyo_orderstatuso_totalpriceo_orderpriority') + length(o_orderstatus) + {sizes % 'o_orderpriority'} + 7 * 5)::BIGINT AS bytes, 'o_orderkey' AS first_string, '{{' AS tag, 5::BIGINT AS members FROM orders".replace("{{", "{"),
        "gen_corpus": "WITH t AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS j, count(*) OVER () AS m FROM nation), r AS (SELECT i, j, 1 + sum(length(j) + 1) OVER (ORDER BY i) AS upto FROM range(1000) s(i) JOIN t ON i % m = k), c AS (SELECT i, j FROM (SELECT *, coalesce(lag(upto) OVER (ORDER BY i), 1) AS before FROM r) WHERE before < 5000) SELECT 0::BIGINT AS doc_id, length(d)::BIGINT AS bytes, n AS records, md5(d) AS md5 FROM (SELECT '[' || string_agg(j, ',' ORDER BY i) || ']' AS d, count(*) AS n FROM c)",
        "crossover": f"WITH s AS ({_values(list(CROSSOVER), 'dataset, contender, bytes, seconds', 'dataset, contender, bytes::BIGINT AS bytes, seconds::DOUBLE AS seconds')}), m AS (SELECT dataset, contender, bytes, median(seconds) AS seconds FROM s GROUP BY ALL), w AS (SELECT a.bytes, a.seconds - b.seconds AS d FROM m a JOIN m b USING (dataset) WHERE a.contender = 'a' AND b.contender = 'b'), l AS (SELECT bytes, d, lag(d) OVER (ORDER BY bytes) AS d0, lag(bytes) OVER (ORDER BY bytes) AS b0 FROM w) SELECT round(b0 + (bytes - b0) * d0 / (d0 - d), 3) AS bytes FROM l WHERE d0 > 0 AND d <= 0 ORDER BY 1 LIMIT 1",
        "errors_of_table": f"SELECT doc_id, way IS NULL AS ok, CASE way WHEN 2 THEN 'MissingColon' WHEN 3 THEN 'MissingComma' ELSE CASE WHEN way IS NULL THEN '' ELSE 'UnbalancedBrackets' END END AS error, a AS \"at\", CASE WHEN way IS NULL THEN -1 ELSE a * 4294967296 + CASE way WHEN 2 THEN 16 WHEN 3 THEN 17 ELSE 20 END END::BIGINT AS packed, error AS unpacked FROM (SELECT *, CASE way WHEN 0 THEN 0 WHEN 1 THEN size WHEN 2 THEN 5 WHEN 3 THEN size + 1 ELSE -1 END::BIGINT AS a FROM {DAMAGED})",
        "typed_in_one_call": f"SELECT doc_id, CASE WHEN error = '' THEN doc_id ELSE -1 END::INT AS id, CASE WHEN error = '' THEN lang END AS lang, error FROM (SELECT *, CASE WHEN way IS NOT NULL THEN 'Syntax' WHEN doc_id > 127 THEN 'Deserialize' ELSE '' END AS error FROM {DAMAGED})",
        "scalar_accessors": _values([(i, *r) for i, (_, *r) in enumerate(ACCESS)], "doc_id, u64, b, is_null, is_empty, raw_count", "doc_id::BIGINT AS doc_id, u64, b::BOOLEAN AS bool, is_null, is_empty::BOOLEAN AS is_empty, raw_count::BIGINT AS raw_count"),
        "typed_wide": _values([(i, *r) for i, (_, *r) in enumerate(WIDE)], "doc_id, r, whole, unit", "doc_id::BIGINT AS doc_id, r::DOUBLE AS real, whole, unit"),
        "typed_tuple": _values([(i, *r) for i, (_, *r) in enumerate(TUPLES)], "doc_id, a, b, error", "doc_id::BIGINT AS doc_id, a::BIGINT AS a, b, error"),
        "depth_sort": _values(list(enumerate(SORTED[1])), "skel, place", "skel::INT AS skel, place::INT AS place"),
        "record_checksum": "SELECT count(*) AS records, bit_xor(o_orderkey + (o_orderstatus = 'O')::BIGINT)::BIGINT AS id_xor, sum(strlen(o_orderpriority))::BIGINT AS bytes, CASE WHEN count(*) % 2 = 1 THEN 4607182418800017408 ELSE 0 END::BIGINT AS score_xor FROM orders",
        "feed_records": "SELECT count(*) AS docs, sum(i * 1000003 + 9007199254740993)::BIGINT AS ids, (count(*) * 2)::BIGINT AS unsigned, count_if(i % 5 = 0)::BIGINT AS without, count_if(i % 2 = 0)::BIGINT AS urls FROM range(200) t(i)",
        "sql_functions": "SELECT n_nationkey, 3::BIGINT AS nodes, n_name AS name FROM nation",
        "stream_counts": "SELECT event_type, count(*) AS docs FROM events GROUP BY event_type",
        "nodes_relational": "SELECT status, place::INT AS place, doc_id, price FROM (SELECT o_orderstatus AS status, o_orderkey AS doc_id, o_totalprice AS price, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
    }
