"""Identifiers: base?a=archive[&p=path](&m=module[&s=symbol] | &d=document[&l=language][&e=element]), as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages that a file name or an identifier may carry, and the keys in their order.
LANGUAGES = ("en", "de", "fr", "ro", "ar", "bg", "ru", "fi", "tr", "sl")
KEYS = ("a", "p", "m", "s", "d", "l", "e")
_VALUE = r"((?![\n\r\x{85}\x{2028}\x{2029}])[^&]+)"
_DOCUMENT = rf"&d={_VALUE}(?:&l=({'|'.join(LANGUAGES)})(?=&|\z))?(?:&e={_VALUE})?"
_WHOLE = rf"\A([a-z][a-z0-9+.-]*://[^/?#]+[^?]*)(?:\?a={_VALUE}(?:&p={_VALUE})?(?:&m={_VALUE}(?:&s={_VALUE})?|{_DOCUMENT})?)?\z"
_KINDS = {"s": "symbol", "m": "module", "e": "element", "d": "document", "p": "path", "a": "archive"}
# Characters that an IRI may not hold, and their escapes.
ESCAPES = {" ": "%20", "\\": "%5C", "^": "%5E", "[": "%5B", "]": "%5D"}


def parse(uri: Column) -> Column:
    """struct<base, a, p, m, s, d, l, e, kind, error>. Parts come in the order of KEYS, each once; a document without a language is English.

    kind: base, archive, path, module, symbol, document or element; null with an error (the reason) for what is no identifier.
    """
    good, of = uri.rlike(_WHOLE), {k: n for n, k in enumerate(("base", *KEYS), 1)}
    part = {k: F.when(good, F.nullif(F.regexp_extract(uri, _WHOLE, n), F.lit(""))) for k, n in of.items()}
    part["l"] = F.when(good & part["d"].isNotNull(), F.coalesce(part["l"], F.lit("en")))
    kind = F.when(good, F.coalesce(*[F.when(part[k].isNotNull(), name) for k, name in _KINDS.items()], F.lit("base")))
    error = F.when(~good, F.coalesce(_reason(uri), F.lit("empty part")))
    return F.struct(F.coalesce(part["base"], F.substring_index(uri, "?", 1)).alias("base"), *[part[k].alias(k) for k in KEYS], kind.alias("kind"), error.alias("error"))


def _reason(uri: Column) -> Column:
    """Why a text is no identifier."""
    base = F.substring_index(uri, "?", 1)
    query = F.when(F.contains(uri, F.lit("?")), F.substring(uri, F.length(base) + 2, F.length(uri)))
    return _let(F.struct(uri.alias("uri"), base.alias("base"), query.alias("query"), F.split(query, "&").alias("parts")), _checked)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _checked(x: Column) -> Column:
    keys = F.transform(x["parts"], lambda y: F.substring_index(y, "=", 1))
    order = F.transform(keys, lambda k: F.array_position(F.array(*map(F.lit, KEYS)), k))
    has = {k: F.array_contains(keys, k) for k in KEYS}
    return (
        F.when(x["uri"].isNull(), None)
        .when(~x["base"].rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+"), "base")
        .when(x["query"].isNull(), None)
        .when(F.exists(order, lambda i: i == 0), "unknown part")
        .when(F.concat_ws(",", F.array_distinct(F.array_sort(order))) != F.concat_ws(",", order), "order")
        .when(~has["a"], "archive")
        .when(has["m"] & has["d"], "too many parts")
        .when(has["s"] & ~has["m"] | (has["l"] | has["e"]) & ~has["d"], "partial")
        .when(F.exists(x["parts"], lambda y: ~y.rlike("=.")), "empty part")
        .when(F.exists(x["parts"], lambda y: y.startswith("l=") & ~F.substring(y, 3, 99).isin(*LANGUAGES)), "language")
    )


def compose(base: Column, **parts: Column) -> Column:
    """The identifier of the given parts (a, p, m, s, d, l, e); null parts are left out."""
    return F.concat(base, F.lit("?"), F.concat_ws("&", *[F.when(parts[k].isNotNull(), F.concat(F.lit(f"{k}="), parts[k])) for k in KEYS if k in parts]))


def language(rel_path: Column) -> Column:
    """The language in a file name (name.xx.ext), else English."""
    found = F.regexp_extract(rel_path, r"\.([a-z]{2})\.[^./]+$", 1)
    return F.when(found.isin(*LANGUAGES), found).otherwise("en")


def document_of(base: Column, archive: Column, rel_path: Column) -> Column:
    """The document that a source file makes: its folders are the path, its name without extension and language the document."""
    name = F.regexp_replace(F.element_at(F.split(rel_path, "/"), -1), r"\.[^.]+$", "")
    tongue = language(rel_path)
    name = F.when(name.rlike(rf"\.({'|'.join(LANGUAGES)})$"), F.regexp_replace(name, r"\.[a-z]{2}$", "")).otherwise(name)
    folders = F.regexp_extract(rel_path, "^(.*)/[^/]*$", 1)
    return compose(base, a=archive, p=F.when(folders != "", folders), d=name, l=tongue)


def module_in(path: Column, document: Column, module: Column) -> Column:
    """The path of a module: that of its document if they have one name, else the document's name is put at its end."""
    return F.when(module == document, path).otherwise(F.concat_ws("/", F.when(path != "", path), document))


def top_module(module: Column) -> Column:
    return F.substring_index(module, "/", 1)


def escaped(iri: Column) -> Column:
    for c, code in ESCAPES.items():
        iri = F.replace(iri, F.lit(c), F.lit(code))
    return iri


def unescaped(iri: Column) -> Column:
    for c, code in ESCAPES.items():
        iri = F.replace(iri, F.lit(code), F.lit(c))
    return iri


def from_components(uri: Column, archive: Column, rel_path: Column, base: Column) -> Column:
    """A request names an identifier, or an archive and a file in it; a mix of both, or neither, gives null."""
    return F.when(uri.isNotNull() & archive.isNull() & rel_path.isNull(), uri).when(uri.isNull() & archive.isNotNull() & rel_path.isNotNull(), document_of(base, archive, rel_path))
