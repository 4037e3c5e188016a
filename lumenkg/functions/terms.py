"""Functions on terms of a graph: structs of kind (iri, bnode, literal), value, lang and dtype.

Null is an unbound variable or an error; both make a result null, as in filters that do not hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "struct<kind:string,value:string,lang:string,dtype:string>"
# Names of data types.
XSD = "http://www.w3.org/2001/XMLSchema#"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")


def term(kind: Column, value: Column, lang: Column | None = None, dtype: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), value.alias("value"), (none if lang is None else F.lower(lang)).alias("lang"), (none if dtype is None else dtype).alias("dtype"))


def iri(value: Column) -> Column:
    return term(F.lit("iri"), value)


def literal(value: Column, lang: Column | None = None, dtype: Column | None = None) -> Column:
    return term(F.lit("literal"), value, lang, dtype)


def ident(t: Column) -> Column:
    """64 bits that name a term. The same function names constants, so that no join is needed to find them."""
    return F.xxhash64(t["kind"], t["value"], F.coalesce(t["lang"], F.lit("")), F.coalesce(t["dtype"], F.lit("")))


def text(t: Column) -> Column:
    """STR: the text of a literal or the name of an iri; blank nodes have none."""
    return F.when(t["kind"] != "bnode", t["value"])


def lang(t: Column) -> Column:
    """LANG: the language of a literal, empty where it has none; null for other terms."""
    return F.when(t["kind"] == "literal", F.coalesce(t["lang"], F.lit("")))


def dtype(t: Column) -> Column:
    """DATATYPE: of a literal; one with a language has its own, and one with neither is a string."""
    return F.when(t["kind"] == "literal", F.coalesce(t["dtype"], F.when(t["lang"].isNotNull(), LANG_STRING).otherwise(f"{XSD}string")))


def is_kind(t: Column, kind: str) -> Column:
    """isIRI, isBlank, isLiteral."""
    return t["kind"] == kind


def is_numeric(t: Column) -> Column:
    return (t["kind"] == "literal") & F.coalesce(t["dtype"], F.lit("")).isin(*[XSD + n for n in NUMERIC]) & t["value"].try_cast("double").isNotNull()


def number(t: Column) -> Column:
    """The number of a numeric literal."""
    return F.when(is_numeric(t), t["value"].try_cast("double"))


def lang_matches(t: Column, wanted: str) -> Column:
    """LANGMATCHES: * is any language; en is en and en-gb."""
    own = lang(t)
    return own != "" if wanted == "*" else (own == wanted.lower()) | own.startswith(f"{wanted.lower()}-")


def before(value: Column, part: str) -> Column:
    """STRBEFORE: empty where the part does not occur."""
    return F.when(F.contains(value, F.lit(part)), F.substring_index(value, part, 1)).otherwise("")


def after(value: Column, part: str) -> Column:
    """STRAFTER: empty where the part does not occur."""
    at = F.instr(value, part)
    return F.when(at > 0, F.substr(value, at + len(part))).otherwise("")


def sparql_round(value: Column) -> Column:
    """ROUND: halves go up."""
    return F.floor(value + 0.5)


def same(a: Column, b: Column) -> Column:
    """= : numbers by value, other terms by kind, text, language and type."""
    return F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b)).otherwise(ident(a) == ident(b))


def less(a: Column, b: Column) -> Column:
    """< : numbers by value, else plain strings and dates by text; null for terms that have no order."""
    plain = lambda t: (t["kind"] == "literal") & t["lang"].isNull()
    return F.when(number(a).isNotNull() & number(b).isNotNull(), number(a) < number(b)).when(plain(a) & plain(b) & (dtype(a) == dtype(b)), a["value"] < b["value"])
