"""Sources made of the derived elements: commands over several lines, environments, references, outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import braces as B
from .registry import Queries

Q = Queries()
#: Two lines and a half for each element: the symbol declared, an import or a use, a reference with nested braces over two lines.
ROW = ("\\symdecl{s", "}[name={x{y}z}, % \\symdecl{no}\n args=2]\n", "\\importmodule[a", "\\usemodule[a", "]{m", "}", "\\sr{", "}{text \\emph{over\ntwo} lines}\\% {\\{}\n")


def sources_of(e):
    """A source for each document: a module with a line of commands for each element; definitions of level 0 are in a module of their own."""
    deep = (F.col("kind") == "definition") & (F.col("level") == 0)
    use = F.when(F.col("kind") == "definition", ROW[2]).otherwise(ROW[3])
    one = F.concat(F.when(deep, F.concat(F.lit("\\begin{smodule}{n"), "ord", F.lit("}"))).otherwise(""), F.lit(ROW[0]), "ord", F.lit(ROW[1]), use, "level", F.lit(ROW[4]), "supplier", F.lit(ROW[5]), F.lit(ROW[6]), F.when(F.col("level") == 1, F.concat(F.lit("m"), "k", F.lit("?s1"))).otherwise(F.concat(F.lit("s"), F.col("ord") - 1)), F.lit(ROW[7]), F.when(deep, F.lit("\\end{smodule}")).otherwise(""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"]), "")
    return e.groupBy("k").agg(F.concat(F.lit("\\begin{smodule}{m"), F.col("k").cast("string"), F.lit("}\n"), body, F.lit("\\end{smodule}")).alias("text")).withColumnRenamed("k", "file")


def _refs(e):
    found = B.commands(sources_of(e))
    return B.references(found, B.within(found.where("kind = 'symbol'"), B.environments(found), "module")).select("file", "line", "symbol", "def_file", "def_line")


def _outline(e):
    found = B.commands(sources_of(e))
    return B.hierarchy(B.within(found.where("kind in ('import', 'use')"), B.environments(found), "module"))


_DEEP = "(kind = 'definition' AND level = 0)"
# lines before an element: the first, and four for each element before it; what opens and closes a module of its own is 18 and 13 characters long, and a number
COMMANDS = f"""WITH x AS (SELECT *, 1 + 4 * (ord - 1) AS l, CASE WHEN {_DEEP} THEN 18 + length(CAST(ord AS STRING)) ELSE 0 END + CASE WHEN lag({_DEEP}, 1, false) OVER (PARTITION BY k ORDER BY ord) THEN 13 ELSE 0 END AS w,
6 + length(CAST(level AS STRING)) + length(CAST(supplier AS STRING)) + CASE WHEN kind = 'definition' THEN 13 ELSE 10 END AS t, CASE WHEN kind = 'definition' THEN 'importmodule' ELSE 'usemodule' END AS use, CASE WHEN level = 1 THEN concat('m', k, '?s1') ELSE concat('s', ord - 1) END AS symbol FROM {{elements}})
"""
_OPTION = "concat('name=', chr(123), 'x', chr(123), 'y', chr(125), 'z', chr(125), ', % \\symdecl', chr(123), 'no', chr(125), chr(10), ' args=2')"
Q.add("lint_commands", "elements", lambda e: B.commands(sources_of(e)).where("name not in ('begin', 'end')").select("file", "name", "kind", "line", "col", "stop_line", "stop_col", F.coalesce("option", F.lit("")).alias("option"), F.array_join("args", "|").alias("args")), COMMANDS + f"""SELECT k AS file, 'symdecl' AS name, 'symbol' AS kind, l AS line, w AS col, l + 1 AS stop_line, 8 AS stop_col, {_OPTION} AS option, concat('s', ord) AS args FROM x
UNION ALL SELECT k, use, CASE use WHEN 'usemodule' THEN 'use' ELSE 'import' END, l + 2, 0, l + 2, t, concat('a', level), concat('m', supplier) FROM x
UNION ALL SELECT k, 'sr', 'reference', l + 2, t, l + 3, 11, '', concat(symbol, '|text \\emph', chr(123), 'over', chr(10), 'two', chr(125), ' lines') FROM x""")
Q.add("lint_environments", "elements", lambda e: B.environments(B.commands(sources_of(e))).select("file", "name", "kind", "line", "stop_line", "arg", "level"), f"SELECT k AS file, 'smodule' AS name, 'module' AS kind, 0 AS line, 1 + 4 * max(ord) AS stop_line, concat('m', k) AS arg, 1 AS level FROM {{elements}} GROUP BY k UNION ALL SELECT k, 'smodule', 'module', 1 + 4 * (ord - 1), 1 + 4 * ord, concat('n', ord), 2 FROM {{elements}} WHERE {_DEEP}")
Q.add("lint_symbol_uses", "elements", _refs, f"""WITH x AS (SELECT *, 1 + 4 * (ord - 1) AS l FROM {{elements}}), d AS (SELECT k, ord, l, CASE WHEN {_DEEP} THEN concat('n', ord) ELSE concat('m', k) END AS m FROM x),
u AS (SELECT k AS file, l + 2 AS line, ord, level FROM x)
SELECT u.file, u.line, concat('s', u.ord - 1) AS symbol, d.k AS def_file, d.l AS def_line FROM u LEFT JOIN d ON d.k = u.file AND d.ord = u.ord - 1 WHERE u.level <> 1
UNION ALL SELECT u.file, u.line, concat('m', u.file, '?s1'), d.k, d.l FROM u LEFT JOIN d ON d.k = u.file AND d.ord = 1 AND d.m = concat('m', u.file) WHERE u.level = 1""")
Q.add("lint_outline", "elements", _outline, f"SELECT CASE WHEN {_DEEP} THEN concat('n', ord) ELSE concat('m', k) END AS module, CASE kind WHEN 'definition' THEN 'import' ELSE 'use' END AS kind, concat('m', supplier) AS target, count(*) AS n FROM {{elements}} GROUP BY 1, 2, 3")
_tokens = lambda e: e.select(F.col("doc").alias("file"), F.col("ord").alias("nth"), F.col("line"), (F.col("level") * 3).alias("col"), (F.col("line") + (F.col("part") % 4 == 0).cast("int")).alias("stop_line"), (F.col("level") + F.col("supplier") % 9 * 2).cast("int").alias("stop_col"), F.col("kind").alias("type")).withColumn("line", F.when(F.col("nth") % 3 == 0, F.col("line") - 2).otherwise(F.col("line"))).where("line >= 0")
Q.add("lint_token_stream", "elements", lambda e: B.semantic_tokens(_tokens(e)), """WITH RECURSIVE t AS (SELECT doc AS file, ord AS nth, CASE WHEN ord % 3 = 0 THEN line - 2 ELSE line END AS line, level * 3 AS col, line + CASE WHEN part % 4 = 0 THEN 1 ELSE 0 END AS stop_line, CAST(level + supplier % 9 * 2 AS INT) AS stop_col, kind AS type FROM {elements} WHERE NOT (ord % 3 = 0 AND line < 2)),
r AS (SELECT file, CAST(0 AS BIGINT) AS nth, 0 AS line, 0 AS col, 0 AS d_line, 0 AS d_col, 0 AS length, '' AS type FROM t GROUP BY file
UNION ALL SELECT file, nth, line, col, d_line, d_col, length, type FROM (SELECT t.file, t.nth, t.line, t.col, t.line - r.line AS d_line, CASE WHEN t.line = r.line THEN t.col - r.col ELSE t.col END AS d_col, CASE WHEN t.line = t.stop_line AND t.stop_col >= t.col THEN t.stop_col - t.col ELSE 999 END AS length, t.type, row_number() OVER (PARTITION BY t.file ORDER BY t.nth) AS n FROM r JOIN t ON t.file = r.file AND t.nth > r.nth AND (t.line > r.line OR t.line = r.line AND t.col > r.col)) x WHERE n = 1)
SELECT file, CAST(nth AS INT) AS nth, d_line, d_col, length, type FROM r WHERE nth > 0""")
