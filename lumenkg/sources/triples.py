"""Quads from and to lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uri import escaped, unescaped

#: Between the parts of a line; where a line begins with it, it is none of the kind looked for.
MARK = "\x01"
_LINE = r'^\s*(<[^<>"{}|^`\\\x00-\x20]*>|_:[A-Za-z0-9]+)\s+<([^<>"{}|^`\\\x00-\x20]*)>\s+(<[^<>"{}|^`\\\x00-\x20]*>|_:[A-Za-z0-9]+|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*$'


# Escapes of one character in literals.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _literal(text: Column) -> Column:
    """The text of a literal with its escapes read, each once and from the left."""
    pieces = F.regexp_extract_all(text, F.lit(r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)|[^\\]++"), F.lit(0))

    def read(x: Column) -> Column:
        code = F.substring(x, 2, 1)
        wide = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        known = F.coalesce(*[F.when(code == c, F.lit(to)) for c, to in _ESCAPES.items()], x)
        return F.when(~x.startswith("\\"), x).when(code.isin("u", "U") & (F.length(x) > 2), wide).otherwise(known)

    return F.array_join(F.transform(pieces, read), "")


def split_once(lines: DataFrame, value: Column, pattern: str, name: str) -> DataFrame:
    """lines whose value the pattern (of a whole line, with three groups) fits, with name: an array of "" and the three groups. A line is matched once.

    The array is exploded, as what follows asks for its parts many times and would match as often.
    """
    cut = F.split(F.regexp_replace(value, f"{pattern}(?s:.*)", f"{MARK}$1{MARK}$2{MARK}$3"), MARK, 4)
    own = lines.select("*", F.explode(F.array(F.when(~F.startswith(value, F.lit(MARK)), cut))).alias(name))
    return own.where((F.size(name) == 4) & (F.get(name, F.lit(0)) == ""))


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """s, s_kind, p, o, o_kind, o_lang, o_dtype of lines of N-Triples, with the other columns; other lines are left out."""
    kind = lambda c: F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("literal")
    own = split_once(lines, F.col(value), _LINE, "__t").drop(value)
    s, p, o = (F.get("__t", F.lit(n)) for n in (1, 2, 3))

    def bare(c: Column, whole: bool = False) -> Column:
        inner = c if whole else F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
        return F.when(F.contains(c, F.lit("%")), unescaped(inner)).otherwise(inner)

    literal = o.startswith('"')
    quoted = F.when(F.contains(o, F.lit("\\")), F.regexp_extract(o, r'^"((?:[^"\\]++|\\.)*+)"', 1)).otherwise(F.substring_index(F.substr(o, F.lit(2)), '"', 1))
    text = F.when(F.contains(o, F.lit("\\")), _literal(quoted)).otherwise(quoted)
    tail = F.when(literal, F.substr(o, F.length(quoted) + 3)).otherwise("")
    lang, dtype = F.when(tail.startswith("@"), F.substr(tail, F.lit(2))), F.when(tail.startswith("^"), F.substr(tail, F.lit(4), F.length(tail) - 4))
    blank = lambda c: F.nullif(c, F.lit(""))
    return own.withColumns({"s": bare(s), "s_kind": kind(s), "p": bare(p, True), "o_kind": kind(o), "o": F.when(literal, text).otherwise(bare(o)), "o_lang": blank(lang), "o_dtype": blank(dtype)}).drop("__t")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Quads of files of N-Triples; the graph is the name of the file."""
    return parsed(spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("g")))


def parts(quads: DataFrame) -> tuple[Column, Column, Column]:
    """Subject, predicate and object as N-Triples has them."""
    iri = lambda c, k: F.when(F.col(k) == "bnode", F.col(c)).otherwise(F.concat(F.lit("<"), escaped(F.col(c)), F.lit(">")))
    text = F.col("o")
    for code in ("\\", '"', "n", "r"):  # the backslash first
        text = F.replace(text, F.lit(_ESCAPES[code]), F.lit(f"\\{code}"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dtype").isNotNull(), F.concat(F.lit("^^<"), "o_dtype", F.lit(">"))).otherwise(""))
    return iri("s", "s_kind"), F.concat(F.lit("<"), escaped(F.col("p")), F.lit(">")), F.when(F.col("o_kind") == "literal", literal).otherwise(iri("o", "o_kind"))


def line(quads: DataFrame) -> Column:
    s, p, o = parts(quads)
    return F.concat(s, F.lit(" "), p, F.lit(" "), o, F.lit(" ."))


def write(quads: DataFrame, path: str) -> None:
    """N-Triples, a folder for each graph; graphs that were written before are written over."""
    own = quads.sparkSession
    before = own.conf.get("spark.sql.sources.partitionOverwriteMode")
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        quads.select("g", line(quads).alias("value")).write.mode("overwrite").partitionBy("g").text(path)
    finally:
        own.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def replaced(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the graphs of new in place of its own of those names; a set."""
    return store.join(new.select("g").distinct(), "g", "left_anti").unionByName(new).distinct()
