"""Quizzes, structural views and outlines as nested JSON, over the derived elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import braces as B
from ..operators import forests as O
from .documents import _nodes
from .registry import Queries
from .sources import sources_of

Q = Queries()


def quiz_tree(e, plain=None):
    """plain: e as it is where nothing is to be numbered. A heap of elements in each document: definitions are sections, of which those of level 1 have no title; a document whose number is not 3 modulo 4 takes in the next one at its end."""
    kind = F.when(F.col("kind") == "definition", "section").when(F.col("kind").isin("problem", "subproblem"), "problem").otherwise("paragraph")
    turns = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("ord"))).cast("int")), lambda n: F.floor(F.col("ord") / F.pow(F.lit(2), n)).cast("int"))
    own = e.select("doc", "k", F.reverse(turns).alias("path"), kind.alias("kind"), F.when(F.col("level") != 1, F.concat(F.lit('Title "'), "ord", F.lit('" é'))).alias("title"), F.concat(F.lit("<p>"), "part", F.lit("</p>")).alias("html"), "uri", F.when(F.col("part") % 50 != 0, F.concat(F.lit("s"), "part")).alias("solution"), F.lit(None).cast("string").alias("target"))
    plain = e if plain is None else plain
    more = plain.where("k % 4 != 3").select("doc", "k").distinct().select("doc", "k", F.array(F.lit(100)).alias("path"), F.lit("inputref").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("title", "html", "uri", "solution")], F.concat(F.lit("doc/"), F.col("k") + 1).alias("target"))
    there = plain.select(F.col("doc").alias("target")).distinct()
    return own.unionByName(more.join(there, "target", "left_semi").select(*own.columns)).drop("k")


Q.add("content_quizzes", "elements:dealt elements", lambda e, plain: O.quizzes(O.opened(O.needed(quiz_tree(e, plain)), plain.select(F.col("doc").alias("root")).distinct(), ("paragraph",))))
_OWN = """concat('"uri":"', uri, '","kind":"', kind, '","children":[')"""
_LEVELS = "".join(f", l{d} AS (SELECT n.doc, n.ord, concat(chr(123), {_OWN}, coalesce(string_agg(c.j, ',' ORDER BY c.ord), ''), ']', chr(125)) AS j FROM n LEFT JOIN l{d + 1} c ON c.doc = n.doc AND c.ord // 2 = n.ord WHERE n.ord >= {1 << d} AND n.ord < {2 << d} GROUP BY n.doc, n.ord, uri, kind)" for d in range(4, -1, -1))
Q.add("content_structure", "elements", lambda e: O.structures(_nodes(e), "uri", "kind", tops=True).select("doc", F.col("value").alias("structure")), f"WITH n AS (SELECT doc, ord, uri, kind FROM {{elements}}), l5 AS (SELECT doc, ord, concat(chr(123), {_OWN}, ']', chr(125)) AS j FROM n WHERE ord >= 32 AND ord < 64){_LEVELS} SELECT doc, j AS structure FROM l0")


def _symbols(e):
    """Outlines of files: environments within environments, and the symbols that they declare."""
    found = B.commands(sources_of(e))
    envs = B.environments(found).where("close is not null")
    own = envs.select("file", F.col("at").alias("node"), "at", "close", F.col("arg").alias("name"), F.lit("module").alias("kind"), "line")
    own = own.unionByName(found.where("kind = 'symbol'").select("file", F.col("at").alias("node"), "at", F.col("at").alias("close"), F.get("args", F.lit(0)).alias("name"), F.lit("symbol").alias("kind"), "line"))
    return O.structures(B.nested(own).select(F.col("file").alias("doc"), "node", "parent", F.col("at").alias("ord"), "name", "kind", "line"), "name", "kind", "line", tops=True).select(F.col("doc").alias("file"), F.col("value").alias("outline"))


_DEEP = "(kind = 'definition' AND level = 0)"
_LEAF = """concat(chr(123), '"name":"s', ord, '","kind":"symbol","line":', 1 + 4 * (ord - 1), ',"children":[]', chr(125))"""
Q.add("lint_outlines", "elements", _symbols, f"""WITH x AS (SELECT k, ord, CASE WHEN {_DEEP} THEN concat(chr(123), '"name":"n', ord, '","kind":"module","line":', 1 + 4 * (ord - 1), ',"children":[', {_LEAF}, ']', chr(125)) ELSE {_LEAF} END AS j FROM {{elements}})
SELECT k AS file, concat(chr(123), '"name":"m', k, '","kind":"module","line":0,"children":[', string_agg(j, ',' ORDER BY ord), ']', chr(125)) AS outline FROM x GROUP BY k""")
