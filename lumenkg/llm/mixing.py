"""Mixing sources to target weights, by fitting a budget of words exactly.

A source's target is met by whole repeats of all its documents and by some documents once more. Which ones
follows from counts of documents by exact length: of each length the same share is taken, and what is left of
the budget is filled by a bounded knapsack over lengths. Of each length the documents with the least seeded
hashes are taken. One task sees the lengths of a source with their counts, never its documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words that a knapsack fills at most; its tables take 16 bytes a word.
MOST_WORDS = 1 << 18
#: Documents of one length and source that one task orders, about.
BUCKET_ROWS = 50_000
#: Sums by source, or counts, that are sent to all executors; more of them are joined by a shuffle.
MOST_SENT = 100_000


def knapsack(lengths: list[int], counts: list[int], budget: int, most: int) -> list[int]:
    """How many of each length to take, at most its count, so that the sum comes as near to the budget as can be and is not above ``most``.

    Each sum remembers the length by which it was first reached and how many were taken of it; the search
    ends when the budget itself is reached. Lengths are positive.
    """
    by = np.full(most + 1, -1, dtype=np.int64)
    used = np.zeros(most + 1, dtype=np.int64)
    by[0] = len(lengths)
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if by[budget] >= 0:
            break
        fresh = np.flatnonzero(by >= 0)
        for n in range(1, min(count, most // length) + 1):
            fresh = fresh[fresh + length <= most] + length
            fresh = fresh[by[fresh] < 0]
            if not len(fresh):
                break
            by[fresh], used[fresh] = i, n
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.abs(reached - budget).argmin()])
    out = [0] * len(lengths)
    while at:
        i = int(by[at])
        out[i] = int(used[at])
        at -= out[i] * lengths[i]
    return out


def fitted(lengths: list[int], counts: list[int], budget: int, most_words: int = MOST_WORDS) -> list[int]:
    """How many documents of each length to take so that their sum is as near to the budget as lengths allow.

    The same share of each length, rounded down; then some documents more, or fewer, of the longest first,
    until what is left is a knapsack of a few of the longest, or of ``most_words`` at most.
    """
    every = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= every:
        return list(counts)
    out = [c * budget // every if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * k for n, k in zip(lengths, out, strict=True))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    wide = min(most_words, 4 * lengths[order[0]], budget)  # room in which lengths can make up for each other
    again = True
    while rest < wide and again:
        again = False
        for i in order:
            if out[i] and rest + lengths[i] <= most_words:
                out[i], rest, again = out[i] - 1, rest + lengths[i], True
                if rest >= wide:
                    break
    again = True
    while rest > wide and again:
        again = False
        for i in order:
            more = min(counts[i] - out[i], 1, rest // lengths[i])
            out[i], rest, again = out[i] + more, rest - more * lengths[i], again or more > 0
            if rest <= wide:
                break
    small = [i for i in order if counts[i] > out[i] and lengths[i] <= most_words]
    if small and rest <= most_words:
        last = lengths[small[-1]]
        for i, k in zip(small, knapsack([lengths[i] for i in small], [counts[i] - out[i] for i in small], rest, min(rest + last, most_words)), strict=True):
            out[i] += k
    # documents that are longer than a knapsack, or than what is left: one more where that comes nearer
    rest = budget - sum(n * k for n, k in zip(lengths, out, strict=True))
    while rest > 0 and (free := [i for i in order if counts[i] > out[i] and abs(rest - lengths[i]) < rest]):
        best = min(free, key=lambda i: abs(rest - lengths[i]))
        out[best], rest = out[best] + 1, rest - lengths[best]
    return out


def _numbered(sources: DataFrame) -> DataFrame:
    """sources (source, total) with at: their place by code point, null last, from 0. No task gets all of them."""
    own = sources.withColumn("last", F.col("source").isNull())
    parts = stored(own.repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    return parts.withColumn("within", within).join(F.broadcast(before.select("part", "before")), "part").select("source", "total", (F.col("before") + F.col("within") - 1).alias("at"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sources (source, total) with target: shares of the sum of all totals by weights, which repeat over the sources in order.

    No target is above ``most`` times the source's total; what is above is shared by weight among those that
    have room, until none is above. Each round adds up the rows once and is a job of one row.
    """
    weighed = stored(_numbered(sources).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("at") % len(weights))), "weighed")
    every = weighed.agg(F.sum("total")).first()[0] or 0
    rest, free = every, weighed.agg(F.sum("weight")).first()[0] or 0
    full = F.lit(False)
    while free:
        full = F.col("weight").cast("decimal(20,0)") * F.lit(rest) > F.col("total").cast("decimal(20,0)") * (most * free)
        held, left = weighed.agg(F.sum(F.when(full, F.col("total") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if every - (held or 0) == rest and left == free:
            break
        rest, free = every - (held or 0), left or 0
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(free or 1))
    return weighed.select("source", "total", F.when(full, F.col("total") * float(most)).otherwise(share).alias("target"))


def _sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    df = stored(df, "counts")
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 12, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, size (words), source, source_size, target (its source's), times (how often the mix takes it), taken (times x size).

    Words are runs of other characters than ASCII white space; a null or empty text has none, and such a
    document is taken as often as all its source's documents are. A null source is a source, the last. The
    targets are those of targets(). Of rows that repeat a doc_id in one source, any as many as are wanted are
    taken, so the rows of the result are the same in each run; nothing else depends on the order or the
    partitions of the rows. A source whose documents are all long comes as near to its target as they allow.
    Other columns are left out; an empty table gives no rows.
    """
    of = ("source", "size")
    named = lambda df, *also: df.withColumnsRenamed({c: f"{c}_" for c in (*of, *also)})
    same = lambda *also: F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & reduce(Column.__and__, [F.col(c) == F.col(f"{c}_") for c in also], F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.col(source).alias("source"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("hash"), F.spark_partition_id().alias("part"))
    rows = stored(rows, "sized")
    lengths = stored(rows.groupBy(*of).agg(F.count("*").alias("n")), "lengths")
    goals = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), weights, most)
    wide = named(lengths).join(_sent(goals), F.col("source").eqNullSafe(F.col("source_"))).select("source", F.col("size_").alias("size"), "n", "total", "target")
    plan = stored(wide.groupBy("source").applyInPandas(_fit(most), "source string, size long, n long, total long, target double, times int, more long"), "plan")

    # of a length, whole buckets of hashes are taken once more, and the least hashes of one bucket
    wanted = rows.join(_sent(named(plan)), same()).drop("source_", "size_").withColumn("bucket", _bucket(F.col("hash"), F.col("n")))
    buckets = wanted.where("more > 0").groupBy(*of, "more", "bucket").count().withColumn("before", _ahead(of, "bucket")).where("before < more")
    cuts = buckets.withColumn("cut", F.when(F.col("before") + F.col("count") <= F.col("more"), F.lit(-1)).otherwise(F.col("more") - F.col("before")))
    near = stored(wanted.join(_sent(named(cuts.select(*of, "bucket", "cut"), "bucket")), same("bucket"), "left").select("doc_id", *of, "total", "target", "times", "bucket", "hash", "part", "cut"), "near")
    # rows with one hash are of one doc_id, and apart by the task that read them
    edge = near.where("cut > 0")
    fine = edge.groupBy(*of, "bucket", "cut", "hash", "part").count().withColumn("before", _ahead((*of, "bucket"), "hash", "part"))
    room = named(fine.select(*of, "hash", "part", (F.col("cut") - F.col("before")).alias("room")), "hash", "part")
    nth = F.row_number().over(Window.partitionBy(*of, "hash", "part").orderBy("doc_id"))
    last = edge.join(room, same("hash", "part")).withColumn("more", (nth <= F.col("room")).cast("int"))
    done = last.unionByName(near.where("cut is null or cut < 0").withColumn("more", F.when(F.col("cut") < 0, 1).otherwise(0)), allowMissingColumns=True)
    times = F.col("times") + F.col("more")
    return done.select("doc_id", "size", "source", F.col("total").alias("source_size"), "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def _fit(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(own: pd.DataFrame) -> pd.DataFrame:
        """The lengths of one source."""
        own = own.sort_values("size")
        total, target = int(own.total.iloc[0]), float(own.target.iloc[0])
        times = min(int(target) // total, most) if total else 1
        budget = round(target) - times * total
        return own.assign(times=times, more=fitted(own["size"].tolist(), own.n.tolist(), budget) if budget > 0 and times < most else 0)

    return fit


def _ahead(keys: tuple[str, ...], *order: str) -> Column:
    """The sum of the counts of earlier rows of the keys."""
    return F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _bucket(hashed: Column, n: Column) -> Column:
    """A number that rises with the hash, so that each has about BUCKET_ROWS of n rows."""
    return F.floor((hashed.cast("double") / float(1 << 64) + 0.5) * F.ceil(n / BUCKET_ROWS)).cast("long")
