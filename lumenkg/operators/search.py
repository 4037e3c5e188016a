"""Ranked full-text search: an inverted index as tables, and BM25 as joins and sums.

Robertson and Zaragoza (2009): k1 = 1.2, b = 0.75, idf = ln(1 + (N - n + 0.5) / (n + 0.5)). Title and body
are fields of their own whose scores are added. Equal scores are ordered by uri.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import stored

K1, B = 1.2, 0.75
# Kinds of records in their order.
KINDS = ("document", "paragraph", "definition", "example", "assertion", "problem")


def def_like(kind: Column, styles: Column) -> Column:
    """Whether a paragraph is a definition or an assertion, or has a style whose first step says so."""
    return kind.isin("definition", "assertion") | F.exists(styles, lambda s: F.substring_index(s, "-", 1).isin("symdoc", "decl"))


@dataclass(frozen=True)
class Index:
    """postings: term, field, uri, tf, positions.  lengths: uri, field, length.  records: all columns of the records.  averages: field, n, average (length), where these are known."""

    postings: DataFrame
    lengths: DataFrame
    records: DataFrame
    averages: DataFrame | None = None


def _fields(records: DataFrame, arranged: Callable[[Column], Column] = lambda ts: ts) -> DataFrame:
    """uri, field, ts: the words of each field of records."""
    return records.select("uri", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), arranged(tokens(F.coalesce(c, F.lit("")))).alias("ts")) for c in ("title", "body")])).alias("f")).select("uri", "f.*")


def index(records: DataFrame, keep: bool = True, positions: bool = False) -> Index:
    """records: uri (unique), title, body, kind (number), def_like and others. Nulls are empty. keep: write the tables, so that searches do not build them again."""
    fields = _fields(records)
    lengths = fields.select("uri", "field", F.size("ts").cast("long").alias("length"))
    places = fields.select("uri", "field", F.posexplode("ts").alias("at", "term")).groupBy("term", "field", "uri")
    postings = places.agg(F.count("*").alias("tf"), *([F.array_sort(F.collect_list("at")).alias("positions")] if positions else []))
    return Index(stored(postings, "postings"), stored(lengths, "lengths"), records) if keep else Index(postings, lengths, records)


def by_record(records: DataFrame) -> DataFrame:
    """Postings (term, field, uri, tf) as index() makes them, counted within each record, so that nothing is shuffled; those of equal uris are not added up. A posting of the term '' has the length of the field."""
    # equal words lie side by side: each run begins where a word differs from the one before it
    ts, size = F.col("ts"), F.size("ts")
    first = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(ts, i) != F.get(ts, i - 1)))
    runs = _fields(records, F.sort_array).withColumn("starts", F.when(size > 0, first).otherwise(F.array().cast("array<int>")))
    posting = lambda term, tf: F.struct(term.alias("term"), tf.cast("long").alias("tf"))
    ends = F.slice(F.concat("starts", F.array(size)), F.lit(2), F.size("starts"))
    every = F.concat(F.array(posting(F.lit(""), size)), F.zip_with("starts", ends, lambda a, b: posting(F.get(ts, a), b - a)))
    return runs.select("uri", "field", F.explode(every).alias("p")).select("p.term", "field", "uri", "p.tf")


def statistics(found: Index) -> DataFrame:
    """Per field: records, their average length, distinct terms."""
    terms = found.postings.groupBy("field").agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))
    return found.lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("average")).join(terms, "field", "left")


def scored(found: Index, terms: list[str], allowed: DataFrame | None = None, every: bool = True) -> DataFrame:
    """uri, score. every: all terms must occur, in whichever field. Statistics are those of all records, whatever is allowed (uri)."""
    terms = list(dict.fromkeys(terms))
    hits = found.postings.where(F.col("term").isin(terms))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    average = found.averages if found.averages is not None else found.lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    weights = F.broadcast(df.join(average, "field"))  # a row for each term of the query and field
    if allowed is not None:
        hits = hits.join(allowed.select("uri"), "uri", "left_semi")
    own = hits.join(weights, ["field", "term"]).join(found.lengths, ["uri", "field"])
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    out = own.withColumn("part", part).groupBy("uri").agg(F.sum("part").alias("score"), F.countDistinct("term").alias("met"))
    return out.where(F.col("met") == len(terms)).drop("met") if every else out.drop("met")


def search(found: Index, query: str, kinds: tuple[int, ...] | None = None, definition_like: bool = False, k: int = 0, every: bool = True) -> DataFrame:
    """uri, score of the best k records (0: all), best first. Words of the query are terms; a query without words finds nothing; no kind allowed finds nothing."""
    from re import findall

    terms = [t for t in findall(r"[^\W_]+", query.lower())]
    allowed = None
    if kinds is not None or definition_like:
        allowed = found.records
        if kinds is not None:
            allowed = allowed.where(F.col("kind").isin(list(kinds)) if kinds else F.lit(False))
        if definition_like:
            allowed = allowed.where("def_like")
    out = scored(found, terms, allowed, every).orderBy(F.desc("score"), "uri")
    return out.limit(k) if k else out


def phrase(found: Index, words: list[str], field: str = "body") -> DataFrame:
    """uri of records in which the words follow each other. The index must hold positions."""
    out = None
    for n, word in enumerate(words):
        own = found.postings.where((F.col("term") == word) & (F.col("field") == field)).select("uri", F.explode("positions").alias("at")).select("uri", (F.col("at") - n).alias("start"))
        out = own if out is None else out.join(own, ["uri", "start"])
    return out.select("uri").distinct()


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank by an order, from 1: ranges of the order are numbered by themselves, and begin after all before them; no task orders all rows."""
    parts = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("__part").count()  # a row for each range
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn("rank", (F.col("__before") + F.col("__within")).cast("int")).drop("__part", "__within", "__before")


def search_symbols(found: Index, query: str, k: int = 0, **options) -> DataFrame:
    """symbol, rank, uris: hits (2k of them) by the symbols they are for, in the order of their first hits, the first k (0: all)."""
    top = search(found, query, k=2 * k, **options)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "uri"))) if k else placed(top, F.desc("score"), F.col("uri"))
    hits = ranked.join(found.records.select("uri", "fors"), "uri").select("rank", "uri", F.posexplode("fors").alias("nth", "symbol"))
    out = hits.groupBy("symbol").agg(F.min(F.struct("rank", "nth")).alias("first"), F.array_sort(F.collect_list(F.struct("rank", "uri"))).alias("hits"))
    out = out.select("symbol", F.col("first.rank").alias("rank"), F.col("first.nth").alias("nth"), F.concat_ws(",", F.transform("hits", lambda h: h["uri"])).alias("uris")).orderBy("rank", "nth")
    return out.limit(k) if k else out
