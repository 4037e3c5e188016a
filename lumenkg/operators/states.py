"""States of source files and their roll-ups over folders, archives and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States in their order.
DELETED, NEW, STALE, UP_TO_DATE = range(4)


def state(last_changed: Column, last_built: Column) -> Column:
    """Of one target: new if never built, up to date if built later than changed, else stale."""
    return F.when(last_built.isNull(), NEW).when(last_built > last_changed, UP_TO_DATE).otherwise(STALE)


def file_states(targets: DataFrame, keys: tuple[str, ...] = ("archive", "rel_path")) -> DataFrame:
    """Per file: the lowest state of its targets (new if it has none), and when it was last built and changed."""
    own = targets.withColumn("state", state(F.col("last_changed"), F.col("last_built")))
    return own.groupBy(*keys).agg(F.coalesce(F.min("state"), F.lit(NEW)).alias("state"), F.max("last_built").alias("last_built"), F.max("last_changed").alias("last_changed"))


def counters() -> list[Column]:
    """Aggregates of files: counts by state, and the latest times; files that are up to date do not count for last_changed."""
    n = lambda k, name: F.count_if(F.col("state") == k).alias(name)
    return [n(NEW, "new"), n(STALE, "stale"), n(DELETED, "deleted"), n(UP_TO_DATE, "up_to_date"), F.max("last_built").alias("last_built"), F.max(F.when(F.col("state") != UP_TO_DATE, F.col("last_changed"))).alias("last_changed")]


def summary(files: DataFrame, *keys: str) -> DataFrame:
    return files.groupBy(*keys).agg(*counters())


def across_formats(summaries: DataFrame, *keys: str) -> DataFrame:
    """Of summaries by format: the highest counts, not their sum, without the deleted."""
    return summaries.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("new", "stale", "up_to_date", "last_built", "last_changed")])


def ancestors(path: Column, itself: bool = False) -> Column:
    """The folders above a path, from the root (the empty path)."""
    steps = F.split(path, "/")
    upto = F.sequence(F.lit(0), F.size(steps) - (0 if itself else 1))
    return F.transform(upto, lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def rollup(files: DataFrame, path: str, *keys: str) -> DataFrame:
    """Each file counts in every folder above it. Counts are added up in the map tasks, so the root is no hot key."""
    return files.withColumn("folder", F.explode(ancestors(F.col(path)))).groupBy(*keys, "folder").agg(*counters())


def children(files: DataFrame, archive: str, folder: str, allowed: bool = True) -> DataFrame:
    """Entries of a folder (name, whether a folder) with their summaries, which only those allowed to see get."""
    prefix = f"{folder}/" if folder else ""
    own = files.where((F.col("archive") == archive) & F.col("rel_path").startswith(prefix)).withColumn("rest", F.substring(F.col("rel_path"), F.lit(len(prefix) + 1), F.length("rel_path")))
    out = own.groupBy(F.substring_index("rest", "/", 1).alias("name"), F.contains("rest", F.lit("/")).alias("is_dir")).agg(*counters())
    return out if allowed else out.select("name", "is_dir")


def changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("archive", "rel_path")) -> DataFrame:
    """Files whose state differs between two snapshots: created, deleted or changed."""
    a, b = (df.select(*keys, F.col("state").alias(name)) for df, name in ((before, "old"), (after, "new")))
    met = a.join(b, list(keys), "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return met.withColumn("event", F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").otherwise("changed"))


def owner(paths: DataFrame, archives: DataFrame) -> DataFrame:
    """path and the archive (root, id) that it lies in: one whose root is a prefix that ends at a separator; the shortest, as the outer archive is found first."""
    own = paths.withColumn("prefix", F.explode(ancestors(F.col("path"), itself=True)))
    met = own.join(archives.select(F.col("root").alias("prefix"), F.col("id")), "prefix")
    return met.groupBy("path").agg(F.min_by("id", F.length("prefix")).alias("id"))


def catalog(entries: DataFrame) -> DataFrame:
    """Index entries, each once: institutions by title, documents by the key of their kind; the first by ord stays."""
    key = F.when(F.col("kind").isin("library"), F.col("archive")).when(F.col("kind").isin("book", "paper"), F.col("file")).when(F.col("kind").isin("course", "self-study"), F.col("notes")).otherwise(F.col("title"))
    nth = F.row_number().over(Window.partitionBy("kind", "key").orderBy("ord"))
    return entries.withColumn("key", key).withColumn("nth", nth).where("nth = 1").drop("nth")


def source_file(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For each wanted (archive, path, name, lang): the file that has its source: name.lang.tex before name.tex, and in a folder of that name before beside it."""
    stem = lambda *parts: F.concat_ws("/", *[F.when(p != "", p) for p in parts])
    path, name, lang = F.col("path"), F.col("name"), F.col("lang")
    nested, beside = stem(path, name, name), stem(path, name)
    tries = F.array(F.concat(nested, F.lit("."), lang, F.lit(".tex")), F.concat(nested, F.lit(".tex")), F.concat(beside, F.lit("."), lang, F.lit(".tex")), F.concat(beside, F.lit(".tex")))
    own = wanted.select("archive", "path", "name", "lang", F.posexplode(tries).alias("nth", "rel_path"))
    return own.join(files.select("archive", "rel_path").distinct(), ["archive", "rel_path"]).groupBy("archive", "path", "name", "lang").agg(F.min_by("rel_path", "nth").alias("rel_path"))
