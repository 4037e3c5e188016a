"""SQL, of another engine's dialect, for the numbered queries that SQL can express on whole tables."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item_id, array_to_string(list_slice(ws, k, k + 9), ' ') AS win, least(len(ws), 10) AS size FROM i, unnest(generate_series(1, greatest(len(ws) - 9, 1))) t(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, k, size, array_to_string(list_slice(ws, k, k + size - 1), ' ') AS win FROM d, sizes, unnest(generate_series(1, len(ws) - size + 1)) t(k)),
hit AS (SELECT DISTINCT doc_id, k, pos.size, item_id FROM pos JOIN win ON pos.win = win.win AND pos.size = win.size),
n AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, size FROM hit) h, unnest(generate_series(0, size - 1)) t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 2), ' ') AS g FROM d, unnest(generate_series(1, greatest(len(ws) - 2, 1))) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * m >= 85 * (a.n + b.n - m)),
edge AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT edge.v, r.root FROM r JOIN edge ON edge.u = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, min(root) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

_LETTERS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {shift}) & 31 AS INT) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, concat({_LETTERS}) AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p"""

OP7 = """
WITH d AS (SELECT doc_id, lower(hex(encode(text))) AS h, CAST(strlen(text) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2 * 355) AS part FROM d, unnest(generate_series(0, n - 100, 256)) t(b)),
w AS (SELECT doc_id, b + j AS k, row_number() OVER (PARTITION BY hash(substr(part, 2 * j + 1, 200)) ORDER BY doc_id, b + j) AS nth FROM p, unnest(generate_series(0, strlen(part) // 2 - 100)) t(j)),
c AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS fresh FROM w WHERE nth > 1),
g AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c),
s AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM g GROUP BY doc_id, run),
kept AS (SELECT s.doc_id, lag(b, 1, 0) OVER (PARTITION BY s.doc_id ORDER BY a) AS x, a AS y FROM s UNION ALL SELECT s.doc_id, max(b), max(d.n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id),
t AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS sha FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
m AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(unhex(h))) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""

# lines of 8 words or more by words, pairs with a shorter one by the characters of the words with one space between them
OP8 = r"""
WITH l AS (SELECT doc_id, CAST(k AS INT) AS pos, ls[k] AS line, regexp_extract_all(lower(regexp_replace(ls[k], '[\t\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', ' ', 'g')), '[^ ]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x, unnest(generate_series(1, len(ls))) t(k)),
o AS (SELECT *, array_to_string(w, ' ') AS name, row_number() OVER (ORDER BY doc_id, pos) AS place FROM l WHERE len(w) > 0),
f AS (SELECT name, min(place) AS first, any_value(w) AS w FROM o GROUP BY name),
v AS (SELECT name, first, len(w) AS n, 'words' AS unit, hash(array_to_string(list_slice(w, 1, j), ' '), j, array_to_string(list_slice(w, j + 1 + skip, len(w)), ' ')) AS key FROM f, unnest(generate_series(0, len(w))) t(j), (SELECT 0 AS skip UNION ALL SELECT 1) s WHERE len(w) >= 8 AND j + skip <= len(w)
  UNION SELECT name, first, len(w), 'chars', hash(substr(name, 1, j), j, substr(name, j + 1 + skip)) FROM f, unnest(generate_series(0, length(name))) t(j), (SELECT 0 AS skip UNION ALL SELECT 1) s WHERE len(w) <= 8 AND length(name) >= 12 AND j + skip <= length(name)),
e AS (SELECT unit, key, min(first) AS least, min(CASE WHEN n < 8 THEN first END) AS least_short FROM v GROUP BY unit, key),
c AS (SELECT DISTINCT name FROM v JOIN e ON e.unit = v.unit AND e.key = v.key WHERE CASE WHEN v.unit = 'words' OR n < 8 THEN least ELSE least_short END < first),
g AS (SELECT o.doc_id, o.pos, o.place <> f.first OR c.name IS NOT NULL AS gone FROM o JOIN f USING (name) LEFT JOIN c ON c.name = o.name),
k AS (SELECT l.doc_id, count(g.pos) AS n_lines, count(*) FILTER (WHERE g.gone) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.gone IS DISTINCT FROM true), '') AS rest FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, CAST(strlen(rest) AS BIGINT) AS n_kept_bytes, sha256(rest) AS kept_sha256 FROM k"""


def _clustering() -> str:
    """Rows of kept vectors by component, then rounds of nearest centroids and their floored means."""
    ctes = [
        "e AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT r, j, CAST(floor(256 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x FROM e, unnest(generate_series(1, 64)) t(j))",
        "s AS (SELECT r, row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), embedding) - 1 AS c FROM e QUALIFY c < 40)",
        "c0 AS MATERIALIZED (SELECT c, j, x FROM v JOIN s USING (r))",
    ]
    for n in range(6):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT r, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{n} m USING (j) GROUP BY r, c) y GROUP BY r)")
        if n < 5:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(f.x, o.x) AS x FROM c{n} o LEFT JOIN (SELECT c, j, CAST(sum(x) // count(*) AS BIGINT) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS x FROM v JOIN a{n} USING (r) GROUP BY c, j) f ON f.c = o.c AND f.j = o.j)")
    return "WITH " + ",\n".join(ctes) + """
SELECT vec_id, CAST(a5.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a5 JOIN e USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS sha FROM c5 GROUP BY c) h ON h.c = a5.c"""


def _vectorcodes() -> str:
    ctes = [
        "e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding, len(embedding) // 4 AS w FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        "v AS MATERIALIZED (SELECT r, (j - 1) // w AS p, (j - 1) % w AS j, CAST(floor(1024 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) AS x FROM e, unnest(generate_series(1, len(embedding))) t(j))",
        "c0 AS MATERIALIZED (SELECT p, r - 1 AS c, j, x FROM v WHERE r <= 256)",
    ]
    for n in range(5):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT r, v.p, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN c{n} m ON m.p = v.p AND m.j = v.j GROUP BY r, v.p, c) y GROUP BY r, p)")
        if n < 4:
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT o.p, o.c, o.j, coalesce(f.x, o.x) AS x FROM c{n} o LEFT JOIN (SELECT v.p, c, j, CAST(sum(x) // count(*) AS BIGINT) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS x FROM v JOIN a{n} a ON a.r = v.r AND a.p = v.p GROUP BY v.p, c, j) f ON f.p = o.p AND f.c = o.c AND f.j = o.j)")
    return "WITH " + ",\n".join(ctes) + """,
k AS (SELECT r, string_agg(lower(lpad(to_hex(c), 2, '0')), '' ORDER BY p) AS code, sum(d) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, c, j)) FROM c4) AS codebooks_sha256 FROM k JOIN e USING (r)"""


OP11, OP13 = _clustering(), _vectorcodes()

ORACLES = {"op1_decontaminate": OP1, "op5_neardup": OP5, "op6_warc": OP6, "op7_suffixdedup": OP7, "op8_linededup": OP8, "op11_clustering": OP11, "op13_vectorcodes": OP13}
