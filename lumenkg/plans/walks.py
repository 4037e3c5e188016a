"""Regular paths and cycles over the derived graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles as C
from ..operators import graph as G
from ..operators.paths import inv, no, pairs, step
from .registry import Queries

Q = Queries()
T = "t AS (SELECT DISTINCT s, p, o FROM {quads})"


def _of(q, *predicates):
    return G.kept_triples(q, *predicates, once=False)


Q.add("kg_path_regular", "quads:hasPart,part-of,requires", lambda q: pairs(_of(q, "hasPart", "part-of", "requires"), (step("hasPart") / inv("part-of")).star | step("requires").opt), f"""WITH RECURSIVE {T}, n AS (SELECT s AS x FROM t WHERE p IN ('hasPart', 'part-of', 'requires') UNION SELECT o FROM t WHERE p IN ('hasPart', 'part-of', 'requires')),
two AS (SELECT DISTINCT a.s AS src, b.s AS dst FROM t a JOIN t b ON b.o = a.o AND b.p = 'part-of' WHERE a.p = 'hasPart'),
c AS (SELECT x AS src, x AS dst FROM n UNION SELECT c.src, two.dst FROM c JOIN two ON two.src = c.dst)
SELECT src, dst FROM c UNION SELECT s, o FROM t WHERE p = 'requires'""")
Q.add("kg_path_sequence", "quads:objective,po-symbol,extends", lambda q: pairs(_of(q, "objective", "po-symbol", "extends"), step("objective") / step("po-symbol") / step("extends").star), f"""WITH RECURSIVE {T},
c AS (SELECT DISTINCT a.s AS src, b.o AS dst FROM t a JOIN t b ON b.s = a.o AND b.p = 'po-symbol' WHERE a.p = 'objective' UNION SELECT c.src, t.o FROM c JOIN t ON t.s = c.dst AND t.p = 'extends') SELECT src, dst FROM c""")
_roots = lambda q: q.where("p = 'extends'").select(F.col("o").alias("dst")).distinct().join(q.where("p = 'extends'").select(F.col("s").alias("dst")), "dst", "left_anti")
Q.add("kg_path_to_ends", "quads:defines,example-for,extends", lambda q: pairs(_of(q, "defines", "example-for", "extends"), (step("defines", "example-for") / step("extends")).opt / step("extends").plus, ends=_roots(q)), f"""WITH RECURSIVE {T}, e AS (SELECT s, o FROM t WHERE p = 'extends'), r AS (SELECT DISTINCT o AS dst FROM e WHERE o NOT IN (SELECT s FROM e)),
c AS (SELECT e.s AS src, e.o AS dst FROM e UNION SELECT c.src, e.o FROM c JOIN e ON e.s = c.dst),
d AS (SELECT DISTINCT t.s AS src, c.dst FROM t JOIN e ON e.s = t.o JOIN c ON c.src = e.o WHERE t.p IN ('defines', 'example-for'))
SELECT src, dst FROM (SELECT * FROM c UNION SELECT * FROM d) x WHERE dst IN (SELECT dst FROM r)""")
Q.add("kg_path_negated", "quads:notation-for,extends,defines", lambda q: pairs(_of(q, "notation-for", "extends", "defines"), no("notation-for", "defines") / no("extends", "notation-for", inverse=True)), f"WITH {T} SELECT DISTINCT a.s AS src, b.s AS dst FROM t a JOIN t b ON b.o = a.o AND b.p = 'defines' WHERE a.p = 'extends'")

REACH = "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {circles}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), m AS (SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src)"
Q.add("graph_components", "circles", C.components, f"{REACH} SELECT node, component FROM m")
Q.add("graph_cycles", "circles", lambda e: C.cycles(e).select("component", "length", F.concat_ws(">", "path").alias("path")), f"""{REACH},
i AS (SELECT m.component, e.src, e.dst FROM e JOIN m ON m.node = e.src JOIN m k ON k.node = e.dst AND k.component = m.component),
l AS (SELECT component, dst AS node, 1 AS level FROM i WHERE src = component UNION SELECT i.component, i.dst, l.level + 1 FROM l JOIN i ON i.component = l.component AND i.src = l.node WHERE l.level < 80 AND l.node <> l.component),
f AS (SELECT component, node, min(level) AS level FROM l GROUP BY component, node),
w AS (SELECT component, level AS length, node, level, '' AS path FROM f WHERE node = component
UNION ALL SELECT component, length, src, level, path FROM (SELECT w.component, w.length, i.src, w.level - 1 AS level, concat('>', i.src, w.path) AS path, row_number() OVER (PARTITION BY w.component ORDER BY i.src) AS nth FROM w JOIN i ON i.component = w.component AND i.dst = w.node JOIN f ON f.component = w.component AND f.node = i.src AND f.level = w.level - 1 WHERE w.level > 1) x WHERE nth = 1)
SELECT component, length, concat(component, path) AS path FROM w WHERE level = 1""")
