"""Queries over stored quads: terms with kinds, languages and data types, joins in the order of their sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import store as S
from .registry import Queries

Q = Queries()


def _store(quads, literals=None):
    own = S.quads_of(quads)
    return S.build(own if literals is None else own.unionByName(S.quads_of(literals.withColumn("o_kind", F.lit("literal")))))


def _texts(store, solutions):
    """The texts of the solutions' terms."""
    own = S.resolved(store, solutions)
    return own.select(*[F.col(c)["value"].alias(c) for c in own.columns])


def _only(quads, *predicates):
    return quads.where(F.col("p").isin(*predicates))


def _join(q):
    store = _store(_only(q, "contains", "defines", "notation-for"))
    return _texts(store, S.bgp(store, ("?d", "contains", "?e"), ("?a", "contains", "?d"), ("?e", "notation-for", "?y"), ("?e", "defines", "?y")))


def _languages(lits):
    store = S.build(S.quads_of(lits.withColumn("o_kind", F.lit("literal"))))
    own = S.resolved(store, S.match(store, "?x", None, "?o"), "o")
    return own.groupBy(T.lang(F.col("o")).alias("lang"), T.dtype(F.col("o")).alias("dtype")).agg(F.count("*").alias("n"), F.count_if(T.lang_matches(F.col("o"), "en")).alias("english"), F.count_if(T.is_numeric(F.col("o"))).alias("numbers"))


def _groups(q, lits):
    """SUM, AVG, MIN, MAX, SAMPLE and GROUP_CONCAT of the sizes of what documents define."""
    store = _store(_only(q, "defines"), lits)
    own = S.resolved(store, S.bgp(store, ("?e", "defines", "?y"), ("?y", "size", "?n"), ("?y", "title", "?t")))
    n = T.number(F.col("n"))
    return own.groupBy(F.col("y")["value"].alias("y")).agg(F.sum(n).alias("sum"), F.avg(n).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"), F.min(F.col("t")["value"]).alias("sample"), F.concat_ws(" ", F.array_sort(F.collect_set(F.col("e")["value"]))).alias("all"))


def _functions(lits):
    store = S.build(S.quads_of(lits.withColumn("o_kind", F.lit("literal"))))
    own = S.resolved(store, S.bgp(store, ("?x", "title", "?t"), ("?x", "size", "?n")))
    t, n, x = T.text(F.col("t")), T.number(F.col("n")), T.text(F.col("x"))
    return own.select(
        x.alias("x"), F.length(t).cast("long").alias("strlen"), F.substring(t, 2, 3).alias("substr"), F.upper(t).alias("ucase"), F.lower(t).alias("lcase"), F.startswith(t, F.lit("P")).alias("strstarts"), F.endswith(t, F.lit("1")).alias("strends"), F.contains(t, F.lit("a")).alias("contains"),
        T.before(x, "/").alias("strbefore"), T.after(x, "/").alias("strafter"), F.concat(t, F.lit("!")).alias("concat"), F.regexp_replace(t, "[aeiou]", "-").alias("replace"), F.regexp_like(t, F.lit("[0-9]{2}")).alias("regex"), F.abs(n - 25).alias("abs"), T.sparql_round(n / 4).cast("long").alias("round"), F.ceil(n / 4).alias("ceil"), F.floor(n / 4).alias("floor"),
        F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), T.is_kind(F.col("x"), "iri").alias("isiri"), T.is_kind(F.col("t"), "literal").alias("isliteral"), T.lang_matches(F.col("t"), "en").alias("english"), F.coalesce(F.col("t")["lang"], F.lit("none")).alias("coalesce"),
    )


def _dates(lits):
    """Filters on typed values: documents changed in a range of dates, by year."""
    store = S.build(S.quads_of(lits.withColumn("o_kind", F.lit("literal"))))
    own = S.resolved(store, S.match(store, "?d", "changed", "?o"), "o")
    since = T.literal(F.lit("1995-06-01"), None, F.lit(f"{T.XSD}date"))
    return own.where(T.less(since, F.col("o"))).groupBy(F.year(F.col("o")["value"].cast("date")).cast("long").alias("year"), F.month(F.col("o")["value"].cast("date")).cast("long").alias("month")).agg(F.count("*").alias("n"))


def _graphs(q, lits):
    """A graph that is loaded again, and one that is cleared: triples by graph."""
    store = _store(_only(q, "extends", "part-of"), lits.where("g = 'parts'"))
    again = S.quads_of(lits.where("g = 'parts' and p = 'size'").withColumn("o_kind", F.lit("literal")))
    store = S.cleared(S.replaced(store, again), "inputs")
    return _texts(store, S.match(store, "?s", None, "?o", "?g")).groupBy("g").agg(F.count("*").alias("n"))


def _constant(q, lits):
    store = _store(_only(q, "defines", "extends"), lits)
    size = T.literal(F.lit("7"), None, F.lit(f"{T.XSD}integer"))
    return _texts(store, S.bgp(store, ("?e", "defines", "?y"), ("?y", "size", size)))


T_ = "t AS (SELECT DISTINCT s, p, o FROM {quads})"
L = "l AS (SELECT DISTINCT s, p, o, o_lang, o_dtype FROM {literals})"
Q.add("kg_store_join", "quads:contains,defines,notation-for", _join, f"WITH {T_} SELECT a.s AS a, a.o AS d, e.o AS e, y.o AS y FROM t a JOIN t e ON e.s = a.o AND e.p = 'contains' JOIN t y ON y.s = e.o AND y.p = 'defines' JOIN t n ON n.s = e.o AND n.p = 'notation-for' AND n.o = y.o WHERE a.p = 'contains'")
Q.add("kg_store_languages", "literals", _languages, f"WITH {L} SELECT coalesce(o_lang, '') AS lang, coalesce(o_dtype, CASE WHEN o_lang IS NULL THEN 'http://www.w3.org/2001/XMLSchema#string' ELSE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' END) AS dtype, count(*) AS n, count(*) FILTER (WHERE o_lang LIKE 'en%') AS english, count(*) FILTER (WHERE o_dtype LIKE '%integer') AS numbers FROM l GROUP BY 1, 2")
Q.add("kg_store_groups", "quads literals", _groups, f"WITH {T_}, {L} SELECT t.o AS y, sum(CAST(a.o AS DOUBLE)) AS sum, avg(CAST(a.o AS DOUBLE)) AS avg, min(CAST(a.o AS DOUBLE)) AS min, max(CAST(a.o AS DOUBLE)) AS max, min(b.o) AS sample, string_agg(DISTINCT t.s, ' ' ORDER BY t.s) AS \"all\" FROM t JOIN l a ON a.s = t.o AND a.p = 'size' JOIN l b ON b.s = t.o AND b.p = 'title' WHERE t.p = 'defines' GROUP BY t.o")
Q.add("kg_store_functions", "literals", _functions, f"WITH {L} SELECT t.s AS x, length(t.o) AS strlen, substr(t.o, 2, 3) AS substr, upper(t.o) AS ucase, lower(t.o) AS lcase, starts_with(t.o, 'P') AS strstarts, ends_with(t.o, '1') AS strends, contains(t.o, 'a') AS contains, split_part(t.s, '/', 1) AS strbefore, split_part(t.s, '/', 2) AS strafter, concat(t.o, '!') AS concat, regexp_replace(t.o, '[aeiou]', '-', 'g') AS replace, regexp_matches(t.o, '[0-9][0-9]') AS regex, abs(CAST(n.o AS DOUBLE) - 25) AS abs, CAST(floor(CAST(n.o AS DOUBLE) / 4 + 0.5) AS BIGINT) AS round, CAST(ceil(CAST(n.o AS DOUBLE) / 4) AS BIGINT) AS ceil, CAST(floor(CAST(n.o AS DOUBLE) / 4) AS BIGINT) AS floor, sha1(t.o) AS sha1, sha256(t.o) AS sha256, true AS isiri, true AS isliteral, coalesce(t.o_lang, '') IN ('en', 'en-gb') AS english, coalesce(t.o_lang, 'none') AS coalesce FROM l t JOIN l n ON n.s = t.s AND n.p = 'size' WHERE t.p = 'title'")
Q.add("kg_store_dates", "literals", _dates, f"WITH {L} SELECT year(CAST(o AS DATE)) AS year, month(CAST(o AS DATE)) AS month, count(*) AS n FROM l WHERE p = 'changed' AND o > '1995-06-01' GROUP BY 1, 2")
Q.add("kg_store_graphs", "quads literals", _graphs, "SELECT g, count(*) AS n FROM (SELECT DISTINCT g, s, p, o FROM {quads} WHERE p = 'extends' AND g <> 'parts' UNION SELECT g, s, p, o FROM {literals} WHERE g = 'parts' AND p = 'size') x GROUP BY g")
Q.add("kg_store_constant", "quads literals", _constant, f"WITH {T_}, {L} SELECT t.s AS e, t.o AS y FROM t JOIN l ON l.s = t.o AND l.p = 'size' AND l.o = '7' WHERE t.p = 'defines'")
Q.add("kg_store_json", "quads literals", lambda q, lits: S.as_json(S.resolved(st := _store(_only(q, "extends"), lits.where("p = 'title'")), S.bgp(st, ("?x", "extends", "?y"), ("?x", "title", "?t")))), f"""WITH {T_}, {L}, b AS (SELECT concat('<"x":<"type":"uri","value":"', t.s, '">,"y":<"type":"uri","value":"', t.o, '">,"t":<"type":"literal","value":"', l.o, '"', CASE WHEN o_lang IS NULL THEN '' ELSE concat(',"xml:lang":"', o_lang, '"') END, '>>') AS b FROM t JOIN l ON l.s = t.s AND l.p = 'title' WHERE t.p = 'extends')
SELECT translate(concat('<"head":<"vars":["x","y","t"]>,"results":<"bindings":[', string_agg(b, ',' ORDER BY translate(b, '<>', chr(123) || chr(125))), ']>>'), '<>', chr(123) || chr(125)) AS json FROM b""")
Q.add("kg_store_ask", "quads", lambda q: S.ask_json(S.bgp(st := _store(_only(q, "extends", "defines")), ("?e", "defines", "?y"), ("?y", "extends", "?z"))), """SELECT concat(chr(123), '"head":', chr(123), chr(125), ',"boolean":', CAST(count(*) > 0 AS STRING), chr(125)) AS json FROM {quads} a JOIN {quads} b ON b.p = 'extends' AND b.s = a.o WHERE a.p = 'defines'""")
