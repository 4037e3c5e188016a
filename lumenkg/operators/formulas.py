"""Terms and notations of annotated pages as forests, and terms as text by their notations and precedences.

Nested tags become trees by interval labels: a tag lies in the smallest one around it. A term has a head,
arguments with places and modes, and bound variables; a notation has components, places of arguments and of
argument separators. Terms are written level by level from the leaves, by the fold of forests; a term is put
in brackets where its precedence is above the one that its place allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import around
from ..storage import stored
from .forests import folded

#: What a place allows that says nothing: any term stays without brackets.
ANY = 1 << 30


def terms(rows: DataFrame) -> DataFrame:
    """doc, node, parent (term around it, null for outermost ones), tag (OMID, OMV, OMA, OMBIND, ...), head, notation, number (of the argument that it is), mode (i, a, b or B), ord, trail (the terms around it, outermost first).

    rows: those of annotated pages. A term within an argument tag is that argument of the term around both; of
    an argument tag without a term, its variable or nothing is kept as a leaf of the tag ARG. The head of a
    term that is written out (headterm) is a child with the number 0. Numbers such as 12 are place 2 in the
    sequence 1.
    """
    own = stored(around(rows, {"in_term": ("term",), "in_arg": ("arg", "headterm")}, "in_term"), "terms")
    a = F.col("attrs")
    args = own.where("kind in ('arg', 'headterm')").select("doc", "nth", F.when(F.col("kind") == "headterm", "0").otherwise(a["arg"]).alias("number"), F.coalesce(a["argmode"], F.lit("i")).alias("mode"), F.col("in_term").alias("of"), "trail").distinct()
    found = own.where("kind = 'term'").select("doc", F.col("nth").alias("node"), a["term"].alias("tag"), a["head"].alias("head"), a["notationid"].alias("notation"), "in_arg", "in_term", "trail").distinct()
    # both at one tag: a term that is an argument itself
    at = args.select("doc", F.col("nth").alias("node"), F.struct("number", "mode", "of").alias("same"))
    near = args.select("doc", F.col("nth").alias("in_arg"), F.struct("number", "mode", "of").alias("around"))
    met = found.join(at, ["doc", "node"], "left").join(near, ["doc", "in_arg"], "left")
    holder = F.when(F.col("in_term") == F.col("node"), F.lit(None)).otherwise(F.col("in_term"))
    arg = F.coalesce(F.col("same"), F.when(F.col("around.of").eqNullSafe(holder), F.col("around")))
    out = met.select("doc", "node", holder.alias("parent"), "tag", "head", "notation", arg["number"].alias("number"), arg["mode"].alias("mode"), "trail")
    full = out.where("number is not null").select("doc", F.col("parent").alias("of"), "number").distinct()
    bare = args.where("of is not null").join(full, ["doc", "of", "number"], "left_anti").select("doc", F.col("nth").alias("node"), F.col("of").alias("parent"), F.lit("ARG").alias("tag"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("notation"), "number", "mode", "trail")
    every = out.unionByName(bare)
    place, rest = (F.substring("number", *at).try_cast("long") for at in ((1, 1), (2, 9)))
    return every.withColumn("ord", F.coalesce(place * 1_000_000_000 + F.coalesce(rest, F.lit(0)), F.lit(1 << 40))).withColumn("bound", F.coalesce(F.col("mode").isin("b", "B"), F.lit(False)) & (F.col("tag") == "OMV"))


def symbols(found: DataFrame) -> DataFrame:
    """doc, symbol, n, depth: the heads of all terms of a document that are symbols, how often, and the least depth at which one is."""
    deep = found.withColumn("depth", F.size("trail"))
    return deep.where("tag in ('OMID', 'OMA', 'OMBIND') and head is not null").groupBy("doc", F.col("head").alias("symbol")).agg(F.count("*").alias("n"), F.min("depth").alias("depth"))


def free_variables(found: DataFrame) -> DataFrame:
    """doc, node, name: uses of variables that no binding term around them binds. Each term is met with those around it along its path, not with all of its document."""
    deep = stored(found.select("doc", "node", "parent", "tag", "head", "bound", F.concat("trail", F.array("node")).alias("path")), "paths")
    binds = deep.where("bound").select("doc", F.col("parent").alias("at"), F.col("head").alias("name")).distinct()
    uses = deep.where("tag = 'OMV' and not bound").select("doc", "node", F.col("head").alias("name"), "path")
    around = uses.select("doc", "node", "name", F.explode("path").alias("at"))
    caught = around.join(binds, ["doc", "at", "name"], "left_semi").select("doc", "node")
    return uses.join(caught, ["doc", "node"], "left_anti").select("doc", "node", "name")


def written(found: DataFrame, notations: DataFrame) -> DataFrame:
    """found (terms()) with text. notations: name, template, precedence, argprecs.

    In a template $1 stands for the first argument, and ${1, } for the arguments of the sequence 1 with the
    text after the number between them. An argument is in brackets where its own precedence is above what
    argprecs has for its place, or where it has none and the place has one below ANY. Without a notation a
    term is its name, and its arguments in brackets; leaves are their names.
    """
    name = F.coalesce(F.element_at(F.split("head", r"[?/]"), -1), F.lit("?"))
    own = found.withColumn("depth", F.size("trail")).join(notations.dropDuplicates(["name"]).withColumnRenamed("name", "head"), "head", "left")
    own = own.select("doc", "node", "parent", "ord", "depth", "number", "tag", name.alias("__name"), "template", "precedence", F.coalesce("argprecs", F.array().cast("array<bigint>")).alias("argprecs"))

    def make(kids: Column) -> Column:
        kids = kids.cast("array<struct<number:string,text:string,precedence:bigint>>")
        args = F.filter(kids, lambda k: k["number"].isNotNull() & (k["number"] != "0"))
        place = lambda k: k["number"].substr(1, 1).cast("int")
        allowed = lambda k: F.coalesce(F.get("argprecs", place(k) - 1), F.lit(ANY))
        text = lambda k: F.when(k["precedence"] > allowed(k), F.concat(F.lit("("), k["text"], F.lit(")"))).otherwise(k["text"])
        one = lambda n: F.transform(F.filter(args, lambda k: place(k) == n), text)

        # a template is pieces: places of arguments, and what stands between them
        digit = lambda x, at: F.substring(x, at, 1).try_cast("int")
        piece = lambda x: F.when(x.startswith("${"), _joined(one(digit(x, 3)), F.substr(x, F.lit(4), F.length(x) - 4))).when(x.rlike(r"^\$\d"), F.array_join(one(digit(x, 2)), ",")).otherwise(x)
        filled = F.array_join(F.transform(F.regexp_extract_all("template", F.lit(r"\$\{\d[^}]*\}|\$\d|[^$]+|\$"), F.lit(0)), piece), "")
        plain = F.concat("__name", F.when(F.size(args) > 0, F.concat(F.lit("("), F.array_join(F.transform(args, lambda k: k["text"]), ","), F.lit(")"))).otherwise(""))
        prec = F.when(F.col("template").isNotNull() & (F.size(args) > 0), F.coalesce("precedence", F.lit(0)).cast("long")).otherwise(F.lit(-ANY).cast("long"))
        return F.struct(F.col("number").alias("number"), F.when(F.size(args) > 0, F.coalesce(filled, plain)).otherwise(F.coalesce(F.when(~F.contains(F.coalesce("template", F.lit("$")), F.lit("$")), F.col("template")), "__name")).alias("text"), prec.alias("precedence"))

    return folded(own, make).select("doc", "node", "parent", F.col("value.text").alias("text"))


def _joined(texts: Column, between: Column) -> Column:
    """array_join with a text that is a column."""
    return F.aggregate(texts, F.lit(None).cast("string"), lambda t, x: F.when(t.isNull(), x).otherwise(F.concat(t, between, x)), lambda t: F.coalesce(t, F.lit("")))


def components(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, notation (nth of its tag), nth, parent, kind (comp, maincomp, arg, argsep, argmap, text), number, mode, text: the tree of what notations are made of; of a leaf its own text."""
    own = stored(around(rows, {"notation": ("notationcomp", "notationopcomp"), "up": ("arg", "argsep", "argmap", "comp", "maincomp")}), "components")
    kinds = ("comp", "maincomp", "arg", "argsep", "argmap")
    mine = own.where(F.col("kind").isin(*kinds) & F.col("notation").isNotNull() & F.col("stop").isNotNull())
    holds = mine.where("up is not null and up != nth").select("doc", F.col("up").alias("nth")).distinct().withColumn("holds", F.lit(True))
    raw = pages.select("doc", F.encode("html", "UTF-8").alias("raw"))
    leaf = F.decode(F.substring("raw", F.col("inner_start") + 1, F.col("inner_stop") - F.col("inner_start")), "UTF-8")
    met = mine.join(holds, ["doc", "nth"], "left").join(raw, "doc")
    order = F.row_number().over(Window.partitionBy("doc", "nth").orderBy("turn"))
    first = met.withColumn("__n", order).where("__n = 1")
    return first.select("doc", "notation", "nth", F.when(F.col("up") != F.col("nth"), F.col("up")).alias("parent"), "kind", F.col("attrs")["arg"].alias("number"), F.col("attrs")["argmode"].alias("mode"), F.when(F.col("holds").isNull(), F.regexp_replace(leaf, "<[^>]*>", "")).alias("text"))
