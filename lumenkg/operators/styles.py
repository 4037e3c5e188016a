"""Style sheets of documents: their order, and the union of those of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and classes that come after all others, by how their names begin or what they are.
KINDS = ("link", "inline", "class")
BEGINNINGS = ("subproblem", "problem", "example", "definition", "paragraph")
NAMES = ("subsubsection", "subsection", "section", "chapter", "part")


def order(kind: Column, name: Column, css: Column, prefix: str = "kg-") -> Column:
    """A struct by which style sheets are ordered: links, then inline sheets, then classes, of which general ones come first and sections, from the lowest, last."""
    known = F.coalesce(*[F.when(name.startswith(prefix + b), n + 1) for n, b in enumerate(BEGINNINGS)], *[F.when(name == prefix + b, n + 1 + len(BEGINNINGS)) for n, b in enumerate(NAMES)], F.lit(0))
    place = F.array_position(F.array(*map(F.lit, KINDS)), kind)
    return F.struct(place.alias("kind"), F.when(kind == "class", known).otherwise(0).alias("rank"), F.when(kind == "class", name).alias("name"), css.alias("css"))


def merged(sheets: DataFrame, *keys: str, prefix: str = "kg-") -> DataFrame:
    """keys and sheets: an array of (kind, name, css), each once, in order; sheets (keys, kind, name, css). Null texts of a kind are left out."""
    own = sheets.where("kind is not null and css is not null").select(*keys, order(F.col("kind"), F.col("name"), F.col("css"), prefix).alias("o"), F.struct("kind", "name", "css").alias("sheet")).distinct()
    return own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "sheet"))), lambda x: x["sheet"]).alias("sheets"))
