"""Quads as a stored table: terms are 64-bit names, triples lie twice, by subject and by object, in parts by predicate.

A store is a folder. A pattern reads the part of its predicate, and of that, by the ranges that Parquet keeps
of its files and row groups, what may hold its constant. Joins are on names; texts are looked up for results
only. Joins begin with the pattern that has the fewest triples by the counts of its predicate.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..storage import shared_dir
from .graph import natural

#: Triples of a file, about.
FILE_ROWS = 4_000_000
COLUMNS = ("g", "s", "p", "o")
Pattern = tuple[str | Column | None, str | Column | None, str | Column | None]


@dataclass(frozen=True)
class Store:
    """names: id, kind, value, lang, dtype.  by_subject, by_object: g, s, o (ids), default (whether the triple counts in the union of all graphs), p (text).  counts: p, n, subjects, objects."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    names = property(lambda self: self._read("names"))
    counts = property(lambda self: self._read("counts"))

    def side(self, by_object: bool) -> DataFrame:
        return self.spark.read.schema("g long, s long, o long, default boolean, p string").parquet(f"{self.path}/{'by_object' if by_object else 'by_subject'}")


def quads_of(rows: DataFrame) -> DataFrame:
    """g, s, p, o as terms, of columns of text: s_kind, o_kind, o_lang and o_dtype where there are such. Without kinds, what starts with _: is a blank node and the rest are iris."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    kind = lambda c: F.coalesce(has(f"{c}_kind"), F.when(F.col(c).startswith("_:"), "bnode").otherwise("iri"))
    return rows.select(T.iri(F.col("g")).alias("g"), T.term(kind("s"), F.col("s")).alias("s"), F.col("p"), T.term(kind("o"), F.col("o"), has("o_lang"), has("o_dtype")).alias("o"))


def build(quads: DataFrame, path: str | None = None) -> Store:
    """A store of quads (g, s, o terms, p text) in a new folder. Rows with a null part are left out, repeated rows count once.

    Two terms with one name are an error; by chance that is one in a million for six million terms.
    """
    spark = quads.sparkSession
    path = path or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    whole = F.col("g.value").isNotNull() & F.col("s.value").isNotNull() & F.col("p").isNotNull() & F.col("o.value").isNotNull()
    quads.where(whole).select(*COLUMNS).write.parquet(f"{path}/given")  # what they are derived from is read once
    given = spark.read.parquet(f"{path}/given")
    names = given.select(F.explode(F.array(*[F.col(c) for c in "gso"])).alias("t")).select(T.ident(F.col("t")).alias("id"), "t.*").distinct()
    names.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/names")
    store = Store(spark, path)
    clash = store.names.groupBy("id").count().where("count > 1").limit(1)
    if not clash.isEmpty():
        raise ValueError("two terms have one name")
    ids = given.select(*[T.ident(F.col(c)).alias(c) for c in "gso"], "p").distinct()
    first = F.row_number().over(Window.partitionBy("s", "p", "o").orderBy("g")) == 1
    ids.withColumn("default", first).write.parquet(f"{path}/ids")
    coded = spark.read.parquet(f"{path}/ids")
    files = max(1, coded.count() // FILE_ROWS)
    for name, key in (("by_subject", "s"), ("by_object", "o")):
        coded.repartitionByRange(files, "p", key).sortWithinPartitions("p", key).write.partitionBy("p").parquet(f"{path}/{name}")
    coded.where("default").groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects")).write.parquet(f"{path}/counts")
    return store


def replaced(store: Store, new: DataFrame) -> Store:
    """A new store in which the graphs of new (quads) are as new has them; the old one stays until its readers are done."""
    old = store.spark.read.parquet(f"{store.path}/given")
    return build(old.join(new.select("g").distinct(), "g", "left_anti").unionByName(new.select(*COLUMNS)))


def cleared(store: Store, graph: str) -> Store:
    """A new store without a graph."""
    return build(store.spark.read.parquet(f"{store.path}/given").where(F.col("g.value") != graph))


def _name(term: str | Column) -> Column:
    return T.ident(term if isinstance(term, Column) else T.term(F.lit("bnode" if term.startswith("_:") else "iri"), F.lit(term)))


def _variable(term: str | Column | None) -> bool:
    return isinstance(term, str) and term.startswith("?")


def match(store: Store, s: str | Column | None, p: str | Column | None, o: str | Column | None, g: str | None = None) -> DataFrame:
    """Solutions of a triple pattern in names (of a predicate: its text). Terms: "?x", None for any, a text for an iri or _:blank, a Column for other terms. Without g the union of all graphs."""
    fixed = lambda t: t is not None and not _variable(t)
    data = store.side(fixed(o) and not fixed(s))
    data = data.where("default") if g is None else data
    variables: dict[str, str] = {}
    for column, term in (("p", p), ("s", s), ("o", o), ("g", g)):
        if term is None:
            continue
        if not _variable(term):
            data = data.where(F.col(column) == (F.lit(term) if column == "p" else _name(term)))
        elif term[1:] not in variables:
            variables[term[1:]] = column
        elif column == "p" or variables[term[1:]] == "p":
            raise ValueError("a variable is a predicate or another term, not both")
        else:
            data = data.where(F.col(column) == F.col(variables[term[1:]]))
    return data.select(*[F.col(column).alias(name) for name, column in variables.items()])


def _sizes(store: Store, patterns: tuple[Pattern, ...]) -> list[tuple[int, int, int]]:
    """Triples, subjects and objects of each pattern's predicate; as many rows as there are patterns reach the driver."""
    wanted = [p for _, p, _ in patterns if p is not None and not _variable(p)]
    found = {r["p"]: (r["n"], r["subjects"], r["objects"]) for r in store.counts.where(F.col("p").isin(wanted)).collect()}
    every = store.counts.agg(F.sum("n"), F.sum("subjects"), F.sum("objects")).first()
    return [found.get(p, (0, 1, 1)) if p in wanted else tuple(x or 1 for x in every) for _, p, _ in patterns]


def order(store: Store, *patterns: Pattern) -> list[int]:
    """In which order the patterns are joined: the one with the fewest triples first, then the one that makes the fewest rows of each row so far; those without a shared variable last."""
    sizes, left, bound, out = _sizes(store, patterns), list(range(len(patterns))), set(), []

    def rows(n: int) -> float:
        (s, _, o), (triples, subjects, objects) = patterns[n], sizes[n]
        known = lambda t: t is not None and (not _variable(t) or t in bound)
        return triples / (max(subjects, 1) if known(s) else 1) / (max(objects, 1) if known(o) else 1)

    while left:
        linked = [n for n in left if any(_variable(t) and t in bound for t in patterns[n])] or left
        best = min(linked, key=lambda n: (rows(n), n))
        left.remove(best)
        out.append(best)
        bound |= {t for t in patterns[best] if _variable(t)}
    return out


def bgp(store: Store, *patterns: Pattern) -> DataFrame:
    """Solutions, in names, of all patterns."""
    first, *rest = order(store, *patterns)
    out = match(store, *patterns[first])
    for n in rest:
        out = natural(out, match(store, *patterns[n]))
    return out


def resolved(store: Store, solutions: DataFrame, *variables: str) -> DataFrame:
    """solutions with the terms of the variables (all, where none are given) in place of their names; unbound ones stay null."""
    own = store.names.select(F.col("id").alias("__id"), F.struct("kind", "value", "lang", "dtype").alias("__term"))
    for v in variables or solutions.columns:
        columns = solutions.columns
        solutions = solutions.join(own, F.col(v) == F.col("__id"), "left").withColumn(v, F.col("__term")).select(*columns)
    return solutions


def as_json(solutions: DataFrame) -> DataFrame:
    """One row: the result of a query in the JSON form of results, head and bindings; solutions hold terms. Rows are written by all tasks; the whole text is for results that are shown."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.when(F.col(c)["kind"] == "iri", "uri").otherwise(F.col(c)["kind"]).alias("type"), F.col(c)["value"].alias("value"), F.col(c)["lang"].alias("xml:lang"), F.col(c)["dtype"].alias("datatype"))).alias(c)
    own = solutions.select(F.to_json(F.struct(*[cell(c) for c in solutions.columns])).alias("b"))
    head = '{"head":{"vars":[' + ",".join(f'"{c}"' for c in solutions.columns) + "]}"
    return own.agg(F.concat(F.lit(head + ',"results":{"bindings":['), F.array_join(F.array_sort(F.collect_list("b")), ","), F.lit("]}}")).alias("json"))


def ask_json(solutions: DataFrame) -> DataFrame:
    """One row: whether there is a solution, in the JSON form of results."""
    return solutions.limit(1).agg(F.concat(F.lit('{"head":{},"boolean":'), (F.count("*") > 0).cast("string"), F.lit("}")).alias("json"))
