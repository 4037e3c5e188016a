"""Identifiers of an older form, made into those of today.

Old forms are place?module?symbol, place?module (a module may end in -module) and place/name.lang.tex; a place is a
root, an archive and folders. A symbol from a structure is module?[place?structure]/name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uri import LANGUAGES, compose, language
from .states import ancestors

_MODULE = r"^(.*)\?([^?]*)$"


def _attempt(rank: int, good: Column, place: Column, also: Column | None = None, **parts: Column) -> Column:
    """What an identifier may be: the place that must be known, and the parts; also: a second place that must be known."""
    none = F.lit(None).cast("string")
    places = F.array(place) if also is None else F.array(place, also)
    return F.when(good, F.struct(F.lit(rank).alias("rank"), F.transform(places, lambda p: F.regexp_replace(p, "/$", "")).alias("places"), *[parts.get(k, none).alias(k) for k in "msdl"]))


def _bare(module: Column) -> Column:
    return F.regexp_replace(module, "-module$", "")


def _attempts(uri: Column) -> Column:
    """Attempts in their order: symbol, module, document."""
    part = lambda x, pattern, n: F.regexp_extract(x, pattern, n)
    outer = r"^([^\[]*)\?[^?\[]*\[(.*)\]/?([^\]]*)$"
    module, inner = part(uri, outer, 1), part(uri, outer, 2)
    nested = uri.rlike(outer) & module.rlike(_MODULE) & inner.rlike(_MODULE)
    symbol = r"^(.*)\?([^?]*)\?([^?]*)$"
    plain = ~F.contains(uri, F.lit("["))
    stem = F.regexp_replace(uri, r"\.tex$", "")
    document = "^(.*)/([^/]*)$"
    name = part(stem, document, 2)
    tongue = language(F.concat(name, F.lit(".tex")))
    bare = F.when(name.rlike(rf"\.({'|'.join(LANGUAGES)})$"), F.regexp_replace(name, r"\.[a-z]{2}$", "")).otherwise(name)
    return F.array_compact(
        F.array(
            _attempt(0, nested, part(module, _MODULE, 1), part(inner, _MODULE, 1), m=_bare(part(module, _MODULE, 2)), s=F.concat(_bare(part(inner, _MODULE, 2)), F.lit("/"), part(uri, outer, 3))),
            _attempt(0, plain & uri.rlike(symbol), part(uri, symbol, 1), m=_bare(part(uri, symbol, 2)), s=part(uri, symbol, 3)),
            _attempt(1, uri.rlike(_MODULE), part(uri, _MODULE, 1), m=_bare(part(uri, _MODULE, 2))),
            _attempt(2, stem.rlike(document), part(stem, document, 1), d=bare, l=tongue),
        )
    )


def converted(uris: DataFrame, archives: DataFrame, roots: tuple[str, ...] = (), fixed: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """uri (each once) and id, its identifier of today; id is null where no attempt has an archive that is known.

    uris: uri.  archives: base, id.  An archive is known by base/id, and by root/id for each of the old roots; fixed
    has old places as a whole: (place, base, archive). What begins with several known places belongs to the shortest.
    Places end at separators. Empty names, and names and
    places with a ?, [ or ], make no identifier. A null uri has no row; repeated archives count once.
    """
    text = lambda *cs: [c.cast("string").alias(n) for c, n in zip(cs, ("prefix", "base", "archive"), strict=True)]
    base, own = F.col("base"), F.col("id")
    known = [archives.select(*text(F.concat(base, F.lit("/"), own), base, own))]
    known += [archives.select(*text(F.concat(F.lit(root.rstrip("/") + "/"), own), base, own)) for root in roots]
    if fixed:
        known.append(archives.sparkSession.createDataFrame([(place.rstrip("/"), b, a) for place, b, a in fixed], "prefix string, base string, archive string"))
    known = reduce(DataFrame.unionByName, known).dropna().groupBy("prefix").agg(F.min(F.struct("base", "archive")).alias("of"))
    tried = uris.select("uri").where("uri is not null").distinct().select("uri", F.explode(_attempts(F.col("uri"))).alias("t"))
    odd = F.concat_ws("", F.array_join("t.places", ""), "t.m", "t.s", "t.d").rlike(r"[?\[\]]")
    tried = tried.where("coalesce(t.m, t.d) != '' and coalesce(t.s, 'x') != ''").where(~odd)
    places = tried.select("uri", "t", F.posexplode("t.places").alias("nth", "place"))
    met = places.withColumn("prefix", F.explode(ancestors(F.col("place"), itself=True))).join(known, "prefix")
    one = met.groupBy("uri", "t", "nth", "place").agg(F.min_by(F.struct("of", "prefix"), F.length("prefix")).alias("x"))
    rest = F.regexp_replace(F.substr("place", F.length("x.prefix") + 1), "^/+", "")
    whole = one.groupBy("uri", "t").agg(F.count("*").alias("n"), F.min_by(F.struct("x.of", rest.alias("rest")), "nth").alias("y")).where(F.col("n") == F.size("t.places"))
    id_ = compose(F.col("y.of.base"), a=F.col("y.of.archive"), p=F.nullif(F.col("y.rest"), F.lit("")), **{k: F.col(f"t.{k}") for k in "msdl"})
    best = whole.groupBy("uri").agg(F.min_by(id_, F.col("t.rank")).alias("id"))
    return uris.select("uri").where("uri is not null").distinct().join(best, "uri", "left")
