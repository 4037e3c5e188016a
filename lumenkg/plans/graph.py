"""Graph patterns and closures over the derived quads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.closure import closure
from .registry import Queries

Q = Queries()


def _minus_unbound(q):
    """Definitions with their notation, if any, less rows of which each binds one variable only."""
    t = G.triples(q)
    own = G.optional(G.pattern(t, "?x", "defines", "?y"), G.pattern(t, "?n", "notation-for", "?y"), F.col("n") == F.col("x"))
    some = G.union(G.pattern(t.where("o like '%3'"), "?x", "defines", None), G.pattern(t.where("o like '%5'"), "?n", "notation-for", None))
    return G.minus(own, some)


T = "t AS (SELECT DISTINCT s, p, o FROM {quads})"
LO = "SELECT s AS element, o AS symbol, 'definition' AS kind FROM t WHERE p = 'defines' UNION SELECT s, o, 'example' FROM t WHERE p = 'example-for'"

Q.add("kg_num_relations", "quads:", lambda q: G.triples(q).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o FROM {quads}) x")
Q.add("kg_pattern_scan", "quads", lambda q: G.pattern(G.triples(q), "?x", "defines", "?y"), "SELECT DISTINCT s AS x, o AS y FROM {quads} WHERE p = 'defines'")
Q.add("kg_bgp_join", "quads:contains,defines", lambda q: G.bgp(G.kept_triples(q, "contains", "defines"), ("?a", "contains", "?d"), ("?d", "contains", "?e"), ("?e", "defines", "?y")).select("a", "e", "y"), "WITH h AS (SELECT DISTINCT s, o FROM {quads} WHERE p = 'contains'), d AS (SELECT DISTINCT s, o FROM {quads} WHERE p = 'defines') SELECT a.s AS a, b.o AS e, d.o AS y FROM d JOIN h b ON b.o = d.s JOIN h a ON a.o = b.s")
Q.add("kg_union_bind", "quads:defines,example-for", lambda q: G.learning_objects(q), f"WITH {T} {LO}")
Q.add("kg_minus", "quads", lambda q: G.minus(G.pattern(G.triples(q), "?x", "crossrefs", "?y"), G.pattern(G.triples(q), "?x", "notation-for", "?y")), f"WITH {T} SELECT s AS x, o AS y FROM t WHERE p = 'crossrefs' AND NOT EXISTS (SELECT 1 FROM t u WHERE u.p = 'notation-for' AND u.s = t.s AND u.o = t.o)")
Q.add("kg_minus_unbound", "quads", _minus_unbound, f"WITH {T}, a AS (SELECT d.s AS x, d.o AS y, n.s AS n FROM t d LEFT JOIN t n ON n.p = 'notation-for' AND n.s = d.s AND n.o = d.o WHERE d.p = 'defines'), b AS (SELECT s AS x, CAST(NULL AS STRING) AS n FROM t WHERE p = 'defines' AND o LIKE '%3' UNION ALL SELECT NULL, s FROM t WHERE p = 'notation-for' AND o LIKE '%5') SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.x = a.x) AND NOT EXISTS (SELECT 1 FROM b WHERE b.n = a.n)")
Q.add("kg_optional", "quads", lambda q: G.optional(G.pattern(G.triples(q), "?x", "defines", "?y"), G.pattern(G.triples(q), "?n", "notation-for", "?y"), F.col("n") < F.col("x")), f"WITH {T} SELECT a.s AS x, a.o AS y, b.s AS n FROM t a LEFT JOIN t b ON b.p = 'notation-for' AND b.o = a.o AND b.s < a.s WHERE a.p = 'defines'")
Q.add("kg_filter_exists", "quads", lambda q: G.exists(G.pattern(G.triples(q), "?x", "type", "example"), G.pattern(G.triples(q), "?x", "notation-for", "?y")), f"WITH {T} SELECT s AS x FROM t WHERE p = 'type' AND o = 'example' AND EXISTS (SELECT 1 FROM t u WHERE u.p = 'notation-for' AND u.s = t.s)")
Q.add("kg_filter_regex", "quads", lambda q: G.pattern(G.triples(q), "?x", "extends", "?y").where(F.col("x").rlike(r"7$") & F.col("y").contains("1")), f"WITH {T} SELECT s AS x, o AS y FROM t WHERE p = 'extends' AND s LIKE '%7' AND o LIKE '%1%'")
Q.add("kg_values", "quads:", lambda q: G.values(G.pattern(G.triples(q), "?x", "?k", "?y"), q.sparkSession.createDataFrame([("type", "example"), ("extends", None)], "k string, y string")).select("x", "k", "y"), f"WITH {T} SELECT s AS x, p AS k, o AS y FROM t WHERE (p = 'type' AND o = 'example') OR p = 'extends'")
Q.add("kg_group_count", "quads:", lambda q: G.pattern(G.triples(q), "?x", "?k", "?y").groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("y").alias("objects"), F.min("x").alias("first")).where("n > 10"), f"WITH {T} SELECT p AS k, count(*) AS n, count(DISTINCT o) AS objects, min(s) AS first FROM t GROUP BY p HAVING count(*) > 10")
Q.add("kg_order_limit", "quads", lambda q: G.pattern(G.triples(q), "?x", "defines", "?y").groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").offset(5).limit(20), f"WITH {T} SELECT o AS y, count(*) AS n FROM t WHERE p = 'defines' GROUP BY o ORDER BY n DESC, y LIMIT 20 OFFSET 5")
Q.add("kg_named_graph", "quads", lambda q: G.pattern(q, None, "defines", None, "?g").groupBy("g").agg(F.count("*").alias("n")), "SELECT g, count(*) AS n FROM {quads} WHERE p = 'defines' GROUP BY g")
Q.add("kg_construct", "quads", lambda q: G.construct(G.bgp(G.triples(q), ("?d", "contains", "?e"), ("?e", "defines", "?y")), ("?y", "defined-in", "?d"), ("?d", "type", "glossary")), f"WITH {T}, x AS (SELECT a.s AS d, b.o AS y FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'contains' AND b.p = 'defines') SELECT y AS s, 'defined-in' AS p, d AS o FROM x UNION SELECT d, 'type', 'glossary' FROM x")
Q.add("kg_ask", "quads", lambda q: G.pattern(q, None, "antonym", "?y").limit(1).agg((F.count("*") > 0).alias("answer")), "SELECT count(*) > 0 AS answer FROM {quads} WHERE p = 'antonym'")
Q.add("kg_describe", "quads:", lambda q: G.triples(q).where("s = 'sym/4' or o = 'sym/4'"), f"WITH {T} SELECT s, p, o FROM t WHERE s = 'sym/4' OR o = 'sym/4'")
Q.add("kg_sub_select", "quads", lambda q: G.natural(G.pattern(G.triples(q), "?x", "notation-for", "?y"), G.pattern(G.triples(q), "?z", "defines", "?y").groupBy("y").agg(F.count("*").alias("n")).where("n >= 3")), f"WITH {T} SELECT a.s AS x, a.o AS y, b.n AS n FROM t a JOIN (SELECT o, count(*) AS n FROM t WHERE p = 'defines' GROUP BY o HAVING count(*) >= 3) b ON a.o = b.o WHERE a.p = 'notation-for'")
Q.add("kg_inverse_negated", "quads", lambda q: G.natural(G.path(q, ["hasPart"], kind="", inverse=True).withColumnsRenamed({"src": "child", "dst": "doc"}), G.negated(q, ["contains", "hasPart", "part-of", "type"]).withColumnsRenamed({"src": "doc", "dst": "x"})), "SELECT DISTINCT h.o AS child, h.s AS doc, n.o AS x FROM {quads} h JOIN {quads} n ON n.s = h.s WHERE h.p = 'hasPart' AND n.p NOT IN ('contains', 'hasPart', 'part-of', 'type')")
Q.add("kg_path_optional", "quads", lambda q: G.path(q, ["extends"], kind="?"), "SELECT s AS src, o AS dst FROM {quads} WHERE p = 'extends' UNION SELECT s, s FROM {quads} WHERE p = 'extends'")
Q.add("kg_json_bindings", "quads", lambda q: G.as_json(G.pattern(G.triples(q), "?x", "objective", "?b")), "SELECT DISTINCT concat('{{\"x\":{{\"type\":\"uri\",\"value\":\"', s, '\"}},\"b\":{{\"type\":\"bnode\",\"value\":\"', o, '\"}}}}') AS binding FROM {quads} WHERE p = 'objective'".replace("{{", "\x01").replace("}}", "\x02"))
Q.sql["kg_json_bindings"] = Q.sql["kg_json_bindings"].replace("\x01", "{").replace("\x02", "}")
Q.add("kg_scalar_functions", "quads", lambda q: G.pattern(G.triples(q), "?x", "extends", "?y").select("x", F.upper("y").alias("up"), F.length("x").cast("long").alias("n"), F.substring("x", 5, 3).alias("sub"), F.replace("y", F.lit("sym"), F.lit("s")).alias("short"), F.coalesce(F.when(F.col("y").endswith("0"), F.lit("ten")), F.lit("other")).alias("which"), F.md5("x").alias("hash")), f"WITH {T} SELECT s AS x, upper(o) AS up, CAST(length(s) AS BIGINT) AS n, substring(s, 5, 3) AS sub, replace(o, 'sym', 's') AS short, coalesce(CASE WHEN o LIKE '%0' THEN 'ten' END, 'other') AS which, md5(s) AS hash FROM t WHERE p = 'extends'")

Q.add("kg_learning_objects", "quads:defines,example-for", G.learning_objects, f"WITH {T} {LO}")
Q.add("kg_learning_objects_with_problems", "quads:defines,example-for,objective,po-symbol,cognitive-dimension,type", lambda q: G.learning_objects(q, True), f"WITH {T} {LO} UNION SELECT a.s, b.o, concat(CASE d.o WHEN 'subproblem' THEN 'subproblem' ELSE 'problem' END, ' ', c.o) FROM t a JOIN t b ON a.o = b.s JOIN t c ON a.o = c.s JOIN t d ON a.s = d.s WHERE a.p = 'objective' AND b.p = 'po-symbol' AND c.p = 'cognitive-dimension' AND d.p = 'type'")
Q.add("kg_notations_for", "quads elements", lambda q, e: G.pattern(G.triples(q), "?uri", "notation-for", "?symbol").join(e.select("uri", "doc", "ord"), "uri"), "SELECT DISTINCT s AS uri, o AS symbol, doc, ord FROM {quads} JOIN {elements} ON uri = s WHERE p = 'notation-for'")
Q.add("kg_first_notation", "quads", G.first_notation, "SELECT o AS symbol, min(s) AS element FROM {quads} WHERE p = 'notation-for' GROUP BY o")
Q.add("kg_definition_fragment", "quads elements", lambda q, e: G.pattern(G.triples(q), "?uri", "defines", "?symbol").join(e, "uri").groupBy("symbol").agg(F.min_by("uri", F.struct("k", "ord")).alias("element")), "SELECT symbol, element FROM (SELECT o AS symbol, s AS element, row_number() OVER (PARTITION BY o ORDER BY k, ord) AS n FROM {quads} JOIN {elements} ON uri = s WHERE p = 'defines') x WHERE n = 1")
Q.add("kg_extensions", "quads", lambda q: G.pattern(G.triples(q), "?x", "extends", "?structure").groupBy("structure").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("x"))).alias("by")), "SELECT o AS structure, count(*) AS n, string_agg(s, ',' ORDER BY s) AS by FROM (SELECT DISTINCT s, o FROM {quads} WHERE p = 'extends') x GROUP BY o")

_SEEDS = lambda q, start: G.triples(q).where(F.col("s").startswith(start)).select(F.col("s").alias("src"))
Q.add("kg_contains_plus", "quads", lambda q: G.path(q, ["contains"], _SEEDS(q, "arch/"), "+").groupBy("src").agg(F.count("*").alias("n")), "WITH RECURSIVE c AS (SELECT DISTINCT s AS src, o AS dst FROM {quads} WHERE p = 'contains' AND s LIKE 'arch/%' UNION SELECT c.src, q.o FROM c JOIN {quads} q ON q.s = c.dst AND q.p = 'contains') SELECT src, count(*) AS n FROM c GROUP BY src")
Q.add("kg_contains_or_part_star", "quads", lambda q: G.path(q, ["contains", "hasPart"], q.sparkSession.createDataFrame([("doc/100",), ("doc/7",)], "src string"), "*"), "WITH RECURSIVE c AS (SELECT x.src, x.src AS dst FROM (SELECT 'doc/100' AS src UNION ALL SELECT 'doc/7') x UNION SELECT c.src, q.o FROM c JOIN {quads} q ON q.s = c.dst AND q.p IN ('contains', 'hasPart')) SELECT src, dst FROM c")
# of types, only which nodes are documents is asked for
_held = lambda q, *predicates: G.kept_triples(q.where("p != 'type' or o = 'document'"), *predicates, once=False)
# what is below each document, at any depth
BELOW = "below AS (SELECT DISTINCT s AS doc, s AS x FROM {quads} WHERE p = 'type' AND o = 'document' UNION SELECT below.doc, q.o FROM below JOIN {quads} q ON q.s = below.x AND q.p IN (%s))"
DEEP = f"WITH RECURSIVE {BELOW % "'contains', 'hasPart'"}, refers AS (SELECT DISTINCT doc, x, q.o AS symbol FROM below JOIN {{quads}} q ON q.s = x AND q.p = 'crossrefs'), defines AS (SELECT DISTINCT doc, x, q.o AS symbol FROM below JOIN {{quads}} q ON q.s = x AND q.p = 'defines')"
DEPS = f"""WITH RECURSIVE {BELOW % "'contains'"}, d AS (SELECT DISTINCT s AS doc FROM {{quads}} WHERE p = 'type' AND o = 'document'),
held AS (SELECT DISTINCT s AS archive, o AS doc FROM {{quads}} WHERE p = 'contains' AND s LIKE 'arch/%' AND o IN (SELECT doc FROM d)),
used AS (SELECT DISTINCT archive, q.o AS m FROM held JOIN below USING (doc) JOIN {{quads}} q ON q.s = x AND q.p IN ('requires', 'imports', 'hasPart')),
owners AS (SELECT doc AS m, doc FROM d UNION SELECT o, s FROM {{quads}} WHERE p = 'contains' AND s IN (SELECT doc FROM d)),
e AS (SELECT DISTINCT used.archive AS src, held.archive AS dst FROM used JOIN owners USING (m) JOIN held ON held.doc = owners.doc UNION SELECT src, dst FROM {{metas}}),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r"""
Q.add("kg_archive_deps", "quads:contains,type,requires,imports,hasPart metas", lambda q, m: closure(G.archive_edges(_held(q, "contains", "type", "requires", "imports", "hasPart"), m)), DEPS)
Q.add("kg_unused_files", "quads:contains,hasPart,requires,imports", lambda q: G.unused_files(G.kept_triples(q, "contains", "hasPart", "requires", "imports")), "WITH RECURSIVE w AS (SELECT DISTINCT o AS m, s AS f FROM {quads} WHERE p = 'contains' AND o IN (SELECT o FROM {quads} WHERE p IN ('requires', 'imports')) UNION SELECT w.m, q.s FROM w JOIN {quads} q ON q.o = w.f AND q.p = 'contains') SELECT DISTINCT s AS archive, o AS file FROM {quads} WHERE p = 'contains' AND s LIKE 'arch/%' AND o NOT IN (SELECT o FROM {quads} WHERE p = 'hasPart') AND o NOT IN (SELECT f FROM w)")
_DEEP = ("contains", "hasPart", "type", "crossrefs", "defines")
Q.add("kg_referenced_symbols", "quads:contains,hasPart,type,crossrefs", lambda q: G.symbols_of(_held(q, *_DEEP), "crossrefs"), DEEP + " SELECT DISTINCT doc, symbol FROM refers")
Q.add("kg_defined_symbols", "quads:contains,hasPart,type,defines", lambda q: G.symbols_of(_held(q, *_DEEP), "defines"), DEEP + " SELECT DISTINCT doc, symbol FROM defines")
Q.add("kg_prerequisites", "quads:contains,hasPart,type,crossrefs,defines", lambda q: G.prerequisites(_held(q, *_DEEP)), DEEP + " SELECT DISTINCT doc, symbol FROM refers r WHERE NOT EXISTS (SELECT 1 FROM defines f WHERE f.doc = r.doc AND f.x = r.x AND f.symbol = r.symbol)")
Q.add("kg_prerequisites_intent", "quads:contains,hasPart,type,crossrefs,defines", lambda q: G.prerequisites(_held(q, *_DEEP), True), DEEP + " SELECT DISTINCT doc, symbol FROM refers r WHERE NOT EXISTS (SELECT 1 FROM defines f WHERE f.doc = r.doc AND f.symbol = r.symbol)")
Q.add("kg_export_closure", "quads", lambda q: G.path(q, ["hasPart"], q.sparkSession.createDataFrame([("doc/3",)], "src string"), "*").select(F.col("dst").alias("doc")), "WITH RECURSIVE c AS (SELECT 'doc/3' AS doc UNION SELECT q.o FROM c JOIN {quads} q ON q.s = c.doc AND q.p = 'hasPart') SELECT doc FROM c")
