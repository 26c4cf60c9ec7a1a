"""DuckDB SQL of the queries that SQL can state, over whole tables."""

from __future__ import annotations

_FALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH b AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
 w AS (SELECT k, i, md5(substring(h, (2 * i + 1)::INT, 800)) AS g FROM (SELECT k, h, unnest(range(length(h) // 2 - 399)) AS i FROM b WHERE length(h) >= 800)),
 r AS (SELECT k, i FROM w QUALIFY count(*) OVER (PARTITION BY g) > 1),
 o AS (SELECT k, i, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + 400 THEN 1 ELSE 0 END AS apart FROM r),
 n AS (SELECT k, i, sum(apart) OVER (PARTITION BY k ORDER BY i) AS run FROM o),
 s AS (SELECT k, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY k, run),
 t AS (SELECT k, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY k),
 d AS (SELECT b.*, coalesce(a, []) AS a, coalesce(z, []) AS z, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans FROM b LEFT JOIN t ON b.k = t.k)
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans,
 sha256(unhex(array_to_string(list_transform(range(len(a) + 1), lambda j: substring(h, 2 * coalesce(list_extract(z, j), 0) + 1, 2 * (coalesce(list_extract(a, j + 1), length(h) // 2) - coalesce(list_extract(z, j), 0)))), ''))) AS kept_sha256 FROM d"""

OP3 = r"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.k, q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.k <> d.k WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

OP4 = r"""
WITH b AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 x AS (SELECT k, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM b WHERE len(w) >= 35)),
 r AS (SELECT k, i FROM x QUALIFY count(*) OVER (PARTITION BY g) > 1),
 c AS (SELECT DISTINCT k, j FROM (SELECT k, unnest(range(i, i + 35)) AS j FROM r)),
 p AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b),
 n AS (SELECT p.k, count(c.k) AS n_removed, coalesce(string_agg(CASE WHEN c.k IS NULL THEN word END, ' ' ORDER BY p.j), '') AS kept FROM p LEFT JOIN c ON p.k = c.k AND p.j = c.j GROUP BY p.k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM b LEFT JOIN n ON b.k = n.k"""

#: (kind, pattern without groups, length that counts, least length), in the order of kinds.
_SECRETS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _spans(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows ``k, a, place, z, kind``: a match starts after the texts and matches before it."""
    found = f"SELECT k, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS s FROM b WHERE regexp_matches(text, '{pattern}')"
    lengths = "list_transform(range(1, len(m) + 1), lambda i: length(s[i]) + CASE WHEN i > 1 THEN length(m[i - 1]) ELSE 0 END)"
    each = f"SELECT k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': list_sum(list_slice(l, 1, i))::BIGINT, 'n': length(m[i]), 'g': length(g[i])}})) AS x FROM (SELECT *, {lengths} AS l FROM ({found}))"
    return f"SELECT k, x.a AS a, {place} AS place, x.a + x.n AS z, '{kind}' AS kind FROM ({each}) WHERE x.g >= {least}"


_LINE = "string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place)"
OP9 = (
    "WITH b AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents), f AS ("
    + " UNION ALL ".join(_spans(i, *rule) for i, rule in enumerate(_SECRETS))
    + "), n AS (SELECT k, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, "
    + f"{_LINE} FILTER (place < 3) AS base, {_LINE} AS spans FROM f GROUP BY k) "
    + "SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM b LEFT JOIN n ON b.k = n.k"
)

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_FALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 q AS (SELECT item_id, regexp_extract_all({_FALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM q WHERE len(w) > 0)),
 x AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
 h AS (SELECT k, i, x.n, item_id FROM x JOIN p ON x.n = p.n AND x.g = p.g),
 c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
 t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN c ON d.k = c.k LEFT JOIN t ON d.k = t.k"""

#: CRC-32 of a string's ASCII characters, bit by bit with the usual reflected polynomial 0xEDB88320.
_STEP = "xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
_BYTE = f"list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: 0::UBIGINT)), lambda y, z: {_STEP})"
_CRC = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, x: {_BYTE}), 4294967295::UBIGINT)"
OP12 = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
 h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, ({_CRC} % 9)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM o)),
 r AS (SELECT h.conv_id AS c, o.pos AS p, role, text FROM h JOIN o ON o.conv_id = h.base AND o.pos <= h.h UNION ALL SELECT h.conv_id, h.h + o.pos, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
 d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, role, text FROM r),
 w AS (SELECT c, list({{'r': role, 't': text}} ORDER BY d) AS w FROM d GROUP BY c),
 f AS (SELECT h.conv_id AS c, coalesce(w.w, []) AS w FROM h LEFT JOIN w ON w.c = h.conv_id),
 m AS (SELECT c, d, len(w) = d AS ends, CASE WHEN d > 0 THEN octet_length(encode(w[d].t)) ELSE 0 END AS bytes, md5(w[1 : d]::VARCHAR) || d AS n, md5(w[1 : d - 1]::VARCHAR) || (d - 1) AS up FROM (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM f)),
 n AS (SELECT n, any_value(up) AS up, min(c) AS conv_id, any_value(d)::BIGINT AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS gain, coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM m GROUP BY n),
 k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
 s AS (SELECT top, count(*) FILTER (k.up IS NULL) AS n_leaves, sum(gain)::BIGINT AS saved_tokens FROM (SELECT DISTINCT a.n AS top, b.n FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d) x JOIN n ON n.n = x.n LEFT JOIN k ON k.up = x.n GROUP BY top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
 FROM n JOIN s ON s.top = n.n LEFT JOIN k ON k.up = n.n LEFT JOIN n q ON q.n = n.up AND n.depth > 0"""

OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.r AS u, b.r AS w FROM ok a JOIN ok b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
 reach AS (SELECT DISTINCT u, u AS w FROM l UNION SELECT reach.u, l.w FROM reach JOIN l ON l.u = reach.w),
 g AS (SELECT u, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.w GROUP BY u),
 n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(coalesce(least, vec_id) = vec_id, false) AS kept FROM v LEFT JOIN g ON g.u = v.r LEFT JOIN n ON n.u = v.r"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op3_dual_tree": OP3,
    "op4_substring_dedup": OP4,
    "op9_secrets": OP9,
    "op10_decontamination": OP10,
    "op12_prefix_trie": OP12,
    "op13_metric_join": OP13,
}
