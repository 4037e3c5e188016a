"""Tables in the shape of the engine, derived from the tables at hand.

Each is one SQL text that Spark and other SQL engines read alike, so that results can be compared. An
order is a document, a line item an element of it, a part a symbol, a supplier a module, a nation an
archive in the group of its region.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names in braces are other tables.
TABLES = {
    "archives": """
SELECT concat(r_name, '/', n_name) AS id, r_name AS grp, n_nationkey AS nation FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "docs": """
SELECT o_orderkey AS k, concat('doc/', CAST(o_orderkey AS STRING)) AS uri, a.id AS archive, a.grp AS grp,
  concat('y', substring(CAST(o_orderdate AS STRING), 1, 4), '/m', substring(CAST(o_orderdate AS STRING), 6, 2), '/o', CAST(o_orderkey AS STRING), '.tex') AS rel_path,
  o_orderdate AS last_changed, o_orderstatus AS status, o_orderpriority AS priority
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {archives} a ON c_nationkey = a.nation""",
    "elements": """
SELECT k, ord, concat('doc/', CAST(k AS STRING), '/', CAST(ord AS STRING)) AS uri, concat('doc/', CAST(k AS STRING)) AS doc, part, supplier, line,
  CASE WHEN status = 'O' AND line % 4 = 3 THEN 'subproblem' WHEN status = 'O' AND line % 2 = 1 THEN 'problem' WHEN flag = 'R' THEN 'definition' WHEN flag = 'A' THEN 'example' ELSE 'paragraph' END AS kind,
  CAST(quantity AS INT) % 7 AS level, tax < 0.02 AS notation, shipped
FROM (SELECT l_orderkey AS k, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line, l_linestatus AS status, l_returnflag AS flag, l_quantity AS quantity, l_tax AS tax, l_shipdate AS shipped,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord FROM {lineitem}) x""",
    "metas": """
SELECT concat('arch/', id) AS src, concat('arch/', grp, '/meta-inf') AS dst FROM {archives} WHERE grp < 'B' OR grp > 'E'""",
    "modules": """
SELECT concat('mod/', CAST(s_suppkey AS STRING)) AS m, concat('mod/', CAST(s_suppkey + 1 AS STRING)) AS onward, uri AS host FROM {supplier} JOIN {docs} ON k = s_suppkey * 7""",
    "quads": """
SELECT uri AS g, concat('arch/', archive) AS s, 'contains' AS p, uri AS o FROM {docs}
UNION ALL SELECT uri, uri, 'type', 'document' FROM {docs}
UNION ALL SELECT doc, doc, 'contains', uri FROM {elements}
UNION ALL SELECT doc, uri, 'type', kind FROM {elements}
UNION ALL SELECT doc, uri, CASE kind WHEN 'definition' THEN 'defines' WHEN 'example' THEN 'example-for' ELSE 'crossrefs' END, concat('sym/', CAST(part AS STRING)) FROM {elements}
UNION ALL SELECT DISTINCT doc, doc, 'requires', concat('mod/', CAST(supplier AS STRING)) FROM {elements}
UNION ALL SELECT doc, uri, 'notation-for', concat('sym/', CAST(part AS STRING)) FROM {elements} WHERE notation
UNION ALL SELECT doc, uri, 'objective', concat('_:', uri) FROM {elements} WHERE kind IN ('problem', 'subproblem')
UNION ALL SELECT doc, concat('_:', uri), 'po-symbol', concat('sym/', CAST(part AS STRING)) FROM {elements} WHERE kind IN ('problem', 'subproblem')
UNION ALL SELECT doc, concat('_:', uri), 'cognitive-dimension', concat('cd-', CAST(line % 6 AS STRING)) FROM {elements} WHERE kind IN ('problem', 'subproblem')
UNION ALL SELECT host, host, 'contains', m FROM {modules}
UNION ALL SELECT host, m, 'type', 'theory' FROM {modules}
UNION ALL SELECT host, m, 'contains', concat(m, '/sub') FROM {modules}
UNION ALL SELECT host, concat(m, '/sub'), 'type', 'theory' FROM {modules}
UNION ALL SELECT host, concat(m, '/sub'), 'imports', onward FROM {modules}
UNION ALL SELECT DISTINCT doc, doc, 'requires', concat('mod/', CAST(supplier AS STRING), '/sub') FROM {elements} WHERE part % 5 = 0
UNION ALL SELECT 'parts', concat('sym/', CAST(p_partkey AS STRING)), 'extends', concat('sym/', CAST(CAST(floor((p_partkey - 1) / 2.0) AS BIGINT) AS STRING)) FROM {part} WHERE p_partkey > 0 AND p_size % 3 = 0
UNION ALL SELECT 'inputs', concat('doc/', CAST(c.o_orderkey AS STRING)), 'part-of', concat('doc/', CAST(CAST(floor((c.o_orderkey - 1) / 2.0) AS BIGINT) AS STRING)) FROM {orders} c WHERE c.o_orderkey > 0 AND c.o_orderkey % 8 <> 3
UNION ALL SELECT 'inputs', concat('doc/', CAST(CAST(floor((c.o_orderkey - 1) / 2.0) AS BIGINT) AS STRING)), 'hasPart', concat('doc/', CAST(c.o_orderkey AS STRING)) FROM {orders} c WHERE c.o_orderkey > 0 AND c.o_orderkey % 8 <> 3""",
    "literals": """
SELECT 'parts' AS g, concat('sym/', CAST(p_partkey AS STRING)) AS s, 'title' AS p, p_name AS o, CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'en-gb' END AS o_lang, CAST(NULL AS STRING) AS o_dtype FROM {part}
UNION ALL SELECT 'parts', concat('sym/', CAST(p_partkey AS STRING)), 'size', CAST(p_size AS STRING), NULL, 'http://www.w3.org/2001/XMLSchema#integer' FROM {part}
UNION ALL SELECT concat('doc/', CAST(o_orderkey AS STRING)), concat('doc/', CAST(o_orderkey AS STRING)), 'changed', substring(CAST(o_orderdate AS STRING), 1, 10), NULL, 'http://www.w3.org/2001/XMLSchema#date' FROM {orders}""",
    "circles": """
SELECT p_partkey AS src, (p_partkey * p_partkey + 3) % 1009 AS dst FROM {part}
UNION ALL SELECT p_partkey, p_partkey + 1 FROM {part} WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, p_partkey FROM {part} WHERE p_partkey % 101 = 5
UNION ALL SELECT s_suppkey + 1000000, CASE WHEN s_suppkey % 8 = 7 THEN s_suppkey + 999993 ELSE s_suppkey + 1000001 END FROM {supplier}
UNION ALL SELECT s_suppkey + 1000000, s_suppkey + 1000003 FROM {supplier} WHERE s_suppkey % 8 = 1""",
    "builds": """
SELECT k, uri, line AS target, max(shipped) AS last_built FROM {elements} GROUP BY k, uri, line""",
    "file_targets": """
SELECT d.archive, d.grp, d.rel_path, d.k, d.last_changed, t.target, b.last_built
FROM {docs} d CROSS JOIN (SELECT 'first' AS target, 1 AS lo, 3 AS hi UNION ALL SELECT 'second', 4, 7) t
LEFT JOIN (SELECT l_orderkey AS bk, CASE WHEN l_linenumber <= 3 THEN 'first' ELSE 'second' END AS bt, max(l_shipdate) AS last_built FROM {lineitem} GROUP BY 1, 2) b ON b.bk = d.k AND b.bt = t.target""",
    "tasks": """
SELECT p_partkey AS id, concat('t', CAST(p_partkey AS STRING), '.tex') AS rel_path, p_brand AS archive, p_size AS size, CASE WHEN p_size % 5 = 0 THEN 'done' WHEN p_size % 5 = 1 THEN 'running' WHEN p_size % 11 = 0 THEN 'failed' ELSE 'queued' END AS state FROM {part}""",
    "deps": """
SELECT p_partkey AS task, CAST(floor((p_partkey - 1) / 2.0) AS BIGINT) AS dep, p_partkey % 2 = 0 AS strict FROM {part} WHERE p_partkey > 0""",
    "log_lines": """
SELECT event_id, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'message' END AS tag, user_id AS span, ts,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE 'TRACE' END AS level, value, props FROM {events}""",
    "records": """
SELECT doc_id AS id, concat('text/', CAST(doc_id AS STRING)) AS uri, source AS title, text AS body, CAST(doc_id % 6 AS INT) AS kind, doc_id % 3 = 0 AS def_like FROM {documents}""",
}

_SYMBOL, _PROBLEM = "concat('sym/', CAST(part AS STRING))", "kind IN ('problem', 'subproblem')"
_CHILD, _ABOVE = "concat('doc/', CAST(o_orderkey AS STRING))", "concat('doc/', CAST(CAST(floor((o_orderkey - 1) / 2.0) AS BIGINT) AS STRING))"
_INPUT = "o_orderkey > 0 AND o_orderkey % 8 <> 3"
#: What a row of a table says in TABLES["quads"]: g, s, p, o, and where.
SAID = {
    "docs": (("uri", "concat('arch/', archive)", "contains", "uri", None), ("uri", "uri", "type", "'document'", None)),
    "elements": (
        ("doc", "doc", "contains", "uri", None), ("doc", "uri", "type", "kind", None), ("doc", "uri", "defines", _SYMBOL, "kind = 'definition'"), ("doc", "uri", "example-for", _SYMBOL, "kind = 'example'"),
        ("doc", "uri", "crossrefs", _SYMBOL, "kind NOT IN ('definition', 'example')"), ("doc", "doc", "requires", "concat('mod/', CAST(supplier AS STRING))", "first = 1"), ("doc", "uri", "notation-for", _SYMBOL, "notation"),
        ("doc", "uri", "objective", "concat('_:', uri)", _PROBLEM), ("doc", "concat('_:', uri)", "po-symbol", _SYMBOL, _PROBLEM), ("doc", "concat('_:', uri)", "cognitive-dimension", "concat('cd-', CAST(line % 6 AS STRING))", _PROBLEM),
        ("doc", "doc", "requires", "concat('mod/', CAST(supplier AS STRING), '/sub')", "part % 5 = 0 AND first_of_five = 1"),
    ),
    "modules": (("host", "host", "contains", "m", None), ("host", "m", "type", "'theory'", None), ("host", "m", "contains", "concat(m, '/sub')", None), ("host", "concat(m, '/sub')", "type", "'theory'", None), ("host", "concat(m, '/sub')", "imports", "onward", None)),
    "part": (("'parts'", "concat('sym/', CAST(p_partkey AS STRING))", "extends", "concat('sym/', CAST(CAST(floor((p_partkey - 1) / 2.0) AS BIGINT) AS STRING))", "p_partkey > 0 AND p_size % 3 = 0"),),
    "orders": (("'inputs'", _CHILD, "part-of", _ABOVE, _INPUT), ("'inputs'", _ABOVE, "hasPart", _CHILD, _INPUT)),
}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(r"\{(\w+)\}")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or one of TABLES as a logical plan over base tables. quads:p,q are the rows of quads with these predicates, quads: all, by one reading of each table; elements:dealt are elements that groups by k and doc need not deal again."""
    if name == "elements:dealt":
        return _dealt_elements(spark, sf_dir)
    if name.startswith("quads:"):
        return quads(spark, sf_dir, *filter(None, name[len("quads:") :].split(",")))
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TABLES[name], **{n: table(spark, sf_dir, n) for n in _needs(TABLES[name])})


def _dealt_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TABLES["elements"] with line items dealt by order beforehand: all windows over k need no other shuffle."""
    return spark.sql(TABLES["elements"], lineitem=table(spark, sf_dir, "lineitem").repartition("l_orderkey"))


def quads(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    """The rows of TABLES["quads"], of the predicates alone where some are given: a row of a table gives all that it says, so that elements are derived once."""
    out = None
    for name, every in SAID.items():
        said = [x for x in every if not predicates or x[2] in predicates]
        if not said:
            continue
        own = table(spark, sf_dir, name) if name != "elements" else _dealt_elements(spark, sf_dir)
        if name == "elements" and any(x[2] == "requires" for x in said):  # once for a document and supplier
            first = lambda *by: F.row_number().over(Window.partitionBy("k", "supplier", *by).orderBy("ord"))
            own = own.withColumns({"first": first(), "first_of_five": first(F.col("part") % 5 == 0)})
        one = lambda x: F.struct(F.expr(x[0]).alias("g"), F.expr(x[1]).alias("s"), F.lit(x[2]).alias("p"), F.expr(x[3]).alias("o"))
        if all(x[4] for x in said):  # rows that say nothing go before what is said is made
            own = own.where(" OR ".join(f"({w})" for w in dict.fromkeys(x[4] for x in said)))
        if len(said) == 1:
            own = own.select(one(said[0]).alias("q"))
        else:
            own = own.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(x[4]), one(x)) if x[4] else one(x) for x in said]))).alias("q"))
        out = own.select("q.*") if out is None else out.unionByName(own.select("q.*"))
    return out


def sql(text: str) -> str:
    """The query with the derived tables it names in braces as common table expressions; columns and functions as in the text."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in found:
            return
        for n in _needs(TABLES[name]):
            add(n)
        found[name] = _NAME.sub(r"\1", TABLES[name]).strip()

    for n in _needs(text):
        add(n)
    body = _NAME.sub(r"\1", text).strip()
    ctes = ", ".join(f"{name} AS ({own})" for name, own in found.items())
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:].strip()}"
    return f"WITH {ctes} {body}"
