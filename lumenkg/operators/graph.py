"""Graph patterns over quads (g, s, p, o) as DataFrame operations.

A solution is a row, a variable a column; an unbound variable is null. Joins are on shared variables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir, stored
from .closure import closure


def triples(quads: DataFrame) -> DataFrame:
    """The union of all graphs: a triple that several graphs hold counts once."""
    return quads.select("s", "p", "o").distinct()


def pattern(data: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Solutions of one triple pattern. Terms: "?x" is a variable, None anything, all else a constant; a repeated variable must agree."""
    variables: dict[str, str] = {}
    for column, term in (("s", s), ("p", p), ("o", o), ("g", g)):
        if term is None:
            continue
        if not term.startswith("?"):
            data = data.where(F.col(column) == term)
        elif term[1:] in variables:
            data = data.where(F.col(column) == F.col(variables[term[1:]]))
        else:
            variables[term[1:]] = column
    return data.select(*[F.col(column).alias(name) for name, column in variables.items()])


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the shared variables, which must be bound on both sides; a cross join only where nothing is shared."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared, how) if shared else a.crossJoin(b)


def bgp(data: DataFrame, *patterns: tuple[str | None, str | None, str | None]) -> DataFrame:
    """Join of triple patterns. The next pattern is the first that shares a variable with those before it, so that only patterns without any link are crossed; Catalyst and AQE choose the kinds of join."""
    left = [pattern(data, *t) for t in patterns]
    out = left.pop(0)
    while left:
        linked = next((n for n, p in enumerate(left) if set(p.columns) & set(out.columns)), 0)
        out = natural(out, left.pop(linked))
    return out


def kept_triples(quads: DataFrame, *predicates: str, once: bool = True) -> DataFrame:
    """The triples of the predicates as a table that is laid out by predicate: each pattern reads its own part, and the quads are derived once. once: a triple that several graphs hold counts once; without, what follows must not count."""
    own = quads.where(F.col("p").isin(*predicates)).select("s", "p", "o")
    own = own.distinct() if once else own
    path = f"{shared_dir(quads.sparkSession)}/triples-{uuid.uuid4().hex}"
    own.write.partitionBy("p").parquet(path)
    return quads.sparkSession.read.schema(own.schema).parquet(path)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a that agree with none of b. Without shared variables nothing goes; an unbound shared variable agrees with anything, but one must be bound in both.

    Rows are taken apart by which of the shared variables they bind (few patterns); for each two patterns
    that is an anti join on what both bind.
    """
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        return a
    right = b.select(*shared).distinct()
    bound = F.array(*[F.col(c).isNotNull() for c in shared])
    kinds = [{tuple(r[0]) for r in side.select(bound.alias("bound")).distinct().collect()} for side in (a, right)]
    out = a.limit(0)
    for here in sorted(kinds[0]):
        rows = a.where(reduce(Column.__and__, [F.col(c).isNotNull() == is_bound for c, is_bound in zip(shared, here, strict=True)]))
        for there in sorted(kinds[1]):
            both = [c for c, x, y in zip(shared, here, there, strict=True) if x and y]
            if both:
                own = right.where(reduce(Column.__and__, [F.col(c).isNotNull() == is_bound for c, is_bound in zip(shared, there, strict=True)]))
                rows = bound_minus(rows, own.select(*both))
        out = out.unionByName(rows)
    return out.select(*a.columns)


def bound_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """minus() where the shared variables are bound in both: a plain anti join."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b.select(*shared).distinct(), shared, "left_anti").select(*a.columns) if shared else a


def optional(a: DataFrame, b: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left join on the shared variables; the condition belongs to the join. Without shared variables that is a nested loop over all of b: for a b of few rows only."""
    shared = [c for c in a.columns if c in b.columns]
    right = b.select(*[F.col(c).alias(f"_{c}" if c in shared else c) for c in b.columns])
    on = [F.col(c) == F.col(f"_{c}") for c in shared] + ([condition] if condition is not None else [])
    return a.join(right, reduce(Column.__and__, on) if on else F.lit(True), "left").drop(*[f"_{c}" for c in shared])


def exists(a: DataFrame, b: DataFrame, negate: bool = False) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b.select(*shared).distinct(), shared, "left_anti" if negate else "left_semi")


def values(a: DataFrame, rows: DataFrame) -> DataFrame:
    """Join with inline rows in which null stands for any value."""
    shared = [c for c in a.columns if c in rows.columns]
    right = rows.select(*[F.col(c).alias(f"_{c}" if c in shared else c) for c in rows.columns])
    on = reduce(Column.__and__, [F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")) for c in shared])
    return a.join(F.broadcast(right), on).drop(*[f"_{c}" for c in shared])  # rows are written out by hand


def path(data: DataFrame, predicates: list[str], seeds: DataFrame | None = None, kind: str = "+", inverse: bool = False) -> DataFrame:
    """Pairs (src, dst) of the property path (p|q|...) with kind "", "?", "+" or "*", from seeds (src) or all subjects."""
    edges = data.where(F.col("p").isin(predicates)).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    if inverse:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if kind in "+*" and kind:
        return closure(edges, seeds, kind == "*")
    edges = edges.distinct() if seeds is None else edges.join(seeds.select("src").distinct(), "src").distinct()
    if kind == "?":
        starts = (edges if seeds is None else seeds).select("src", F.col("src").alias("dst"))
        edges = edges.unionByName(starts).distinct()
    return edges


def negated(data: DataFrame, predicates: list[str]) -> DataFrame:
    return data.where(~F.col("p").isin(predicates)).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def construct(solutions: DataFrame, *templates: tuple[str, str, str]) -> DataFrame:
    """Triples made from solutions; those with an unbound part are left out, each comes once."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    parts = [solutions.select(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in templates]
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


def as_json(solutions: DataFrame) -> DataFrame:
    """One row per solution: the bindings in the JSON form of query results. Unbound variables are left out."""
    kind = lambda c: F.when(F.col(c).startswith("_:"), "bnode").otherwise("uri")
    cells = [F.when(F.col(c).isNotNull(), F.struct(kind(c).alias("type"), F.col(c).alias("value"))).alias(c) for c in solutions.columns]
    return solutions.select(F.to_json(F.struct(*cells)).alias("binding"))


def learning_objects(quads: DataFrame, problems: bool = False) -> DataFrame:
    """symbol, element and kind: what defines a symbol, is an example for it or, with problems, has it as an objective (with its dimension)."""
    t = triples(quads)
    out = pattern(t, "?element", "defines", "?symbol").withColumn("kind", F.lit("definition"))
    out = out.unionByName(pattern(t, "?element", "example-for", "?symbol").withColumn("kind", F.lit("example")))
    if problems:
        found = bgp(t, ("?element", "objective", "?b"), ("?b", "po-symbol", "?symbol"), ("?b", "cognitive-dimension", "?dim"), ("?element", "type", "?type"))
        kind = F.concat(F.when(F.col("type") == "subproblem", "subproblem").otherwise("problem"), F.lit(" "), "dim")
        out = out.unionByName(found.select("element", "symbol", kind.alias("kind")))
    return out.distinct()


def first_notation(quads: DataFrame) -> DataFrame:
    """The first notation of each symbol, by name of the element."""
    return pattern(triples(quads), "?element", "notation-for", "?symbol").groupBy("symbol").agg(F.min("element").alias("element"))


def lifted(found: DataFrame, quads: DataFrame, up: list[str]) -> DataFrame:
    """doc, term, each once: found (node, term) at the document, or at what it holds over one or more of the predicates of up.

    Terms go up to the nearest documents first, over holders that are none, and documents with them, each to
    the nearest above it: all edges are dealt by their lower end once for both. Holders that nothing holds are
    not followed. From document to document terms then go by jumps.
    """
    return _lifted(found, quads, up).distinct()


def _lifted(found: DataFrame, quads: DataFrame, up: list[str]) -> DataFrame:
    """lifted(), some rows more than once."""
    docs = documents(quads)
    edges = quads.where(F.col("p").isin(up)).select(F.col("o").alias("at"), F.col("s").alias("holder")).dropna()
    key = ["at", "item", "is_term"]

    def marked(rows: DataFrame) -> DataFrame:
        return stored(rows.join(docs, F.col("at") == F.col("doc"), "left").distinct(), "lifted")

    reached = marked(found.select(F.col("node").alias("at"), F.col("term").alias("item"), F.lit(True).alias("is_term")))
    near = reached.where("doc is not null")
    new = reached.where("doc is null").select(key).unionByName(docs.select(F.col("doc").alias("at"), F.col("doc").alias("item"), F.lit(False).alias("is_term")))
    known, ahead = new, edges
    while True:
        reached = marked(new.join(ahead, "at").select(F.col("holder").alias("at"), "item", "is_term"))
        near = near.unionByName(reached.where("doc is not null"))
        new = reached.where("doc is null").select(key)
        ahead = stored(edges.join(stored(new.select("at").distinct(), "tops"), "at", "left_semi"), "ahead")
        if ahead.isEmpty():
            break
        new = stored(new.join(known, key, "left_anti"), "lifted")
        known = known.unionByName(new)
    above = near.where("not is_term").select(F.col("item").alias("src"), F.col("doc").alias("dst"))
    return raised(near.where("is_term").select("doc", F.col("item").alias("term")), above)


def raised(rows: DataFrame, above: DataFrame) -> DataFrame:
    """rows (doc and others) at doc, and at all that is reached from it over above (src, dst).

    A jump of level n is 2 ** n steps; a row stays or jumps at each level, the longest first, so that it comes
    to each distance once, and few rows are carried through the first levels. Where no src has two dst and
    there is no cycle, no row comes twice that was there once; else rows are made distinct at each level.
    """
    jumps = [stored(above.where("src != dst").distinct(), "jumps")]
    single, most = jumps[0].groupBy("src").count().where("count > 1").isEmpty(), jumps[0].count()
    while len(jumps) < most.bit_length() and not jumps[-1].isEmpty():
        far = jumps[-1].join(jumps[-1].select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        jumps.append(stored(far if single else far.distinct(), "jumps"))
    once = single and jumps[-1].isEmpty()
    rest = [c for c in rows.columns if c != "doc"]
    for jump in reversed(jumps):
        if not jump.isEmpty():
            rows = rows.join(jump.select(F.col("src").alias("doc"), F.col("dst").alias("up")), "doc", "left").select(F.explode(F.array_compact(F.array("doc", "up"))).alias("doc"), *rest)
            rows = rows if once else rows.distinct()
    return rows.select("doc", *rest)


def documents(quads: DataFrame) -> DataFrame:
    return quads.where("p = 'type' and o = 'document'").select(F.col("s").alias("doc")).distinct()


def archive_edges(quads: DataFrame, metas: DataFrame | None = None, prefix: str = "arch/") -> DataFrame:
    """src, dst: a document of the archive src, or what it contains, requires, imports or has as a part what is, or is contained in, a document of dst.

    metas (src, dst): archives for meta data, which all archives of their groups depend on.
    """
    docs = documents(quads)
    contains = quads.where("p = 'contains'")
    held = stored(contains.where(F.col("s").startswith(prefix)).select(F.col("s").alias("archive"), F.col("o").alias("doc")).join(docs, "doc", "left_semi").select("archive", "doc").distinct(), "held")
    uses = quads.where("p in ('requires', 'imports', 'hasPart')").select(F.col("s").alias("node"), F.col("o").alias("term"))
    of = lifted(uses.select("node", F.col("node").alias("term")).distinct(), quads, ["contains"])
    of = of.join(held, "doc").select("archive", F.col("term").alias("node")).distinct()
    used = stored(of.join(uses, "node").select("archive", "term").distinct(), "used")
    holders = used.join(contains.select(F.col("o").alias("term"), F.col("s").alias("doc")), "term").select("archive", "doc")
    wanted = used.select("archive", F.col("term").alias("doc")).unionByName(holders).distinct()
    out = wanted.join(held.withColumnRenamed("archive", "dst"), "doc").select(F.col("archive").alias("src"), "dst")
    return (out if metas is None else out.unionByName(metas)).distinct()


def unused_files(quads: DataFrame, prefix: str = "arch/") -> DataFrame:
    """archive, file: held by an archive, no part of any document, and not above anything that is required or imported."""
    t = triples(quads)
    files = t.where((F.col("p") == "contains") & F.col("s").startswith(prefix)).select(F.col("s").alias("archive"), F.col("o").alias("file"))
    parts = t.where("p = 'hasPart'").select(F.col("o").alias("file")).distinct()
    wanted = t.where("p in ('requires', 'imports')").select(F.col("o").alias("src")).distinct()
    above = path(t, ["contains"], wanted, "+", inverse=True).select(F.col("dst").alias("file")).distinct()
    return files.join(parts.unionByName(above).distinct(), "file", "left_anti").select("archive", "file")


def symbols_of(quads: DataFrame, predicate: str) -> DataFrame:
    """doc, symbol: the document, or what it contains or has as a part at any depth, has a triple of the predicate with the symbol."""
    found = quads.where(F.col("p") == predicate).select(F.col("s").alias("node"), F.col("o").alias("term"))
    return lifted(found, quads, ["contains", "hasPart"]).withColumnRenamed("term", "symbol")


def prerequisites(quads: DataFrame, intent: bool = False) -> DataFrame:
    """doc, symbol: referenced in the document, at any depth, and not defined; as written down, a definition counts in the same element only, with intent anywhere in the document."""
    if intent:
        # both go up at once, told apart by a sign before the name; a name that is null is no definition of another
        named, defined = F.col("o").isNotNull(), F.col("p") == "defines"
        sign = F.when(defined, "d").when(named, "c").otherwise("x")
        found = quads.where(F.col("p").isin("crossrefs", "defines") & (named | ~defined)).select(F.col("s").alias("node"), F.concat(sign, F.coalesce("o", F.lit(""))).alias("term"))
        reached = _lifted(found, quads, ["contains", "hasPart"])
        symbol = F.when(~F.col("term").startswith("x"), F.substr("term", F.lit(2)))
        return reached.groupBy("doc", symbol.alias("symbol")).agg(F.bool_or(F.col("term").startswith("d")).alias("defined")).where("not defined").select("doc", "symbol")
    refers, defines = (quads.where(F.col("p") == p).select("s", "o") for p in ("crossrefs", "defines"))
    own = bound_minus(refers, defines).withColumn("p", F.lit("crossrefs")).select("s", "p", "o")
    return symbols_of(own.unionByName(quads.where("p in ('contains', 'hasPart', 'type')").select("s", "p", "o")), "crossrefs")
