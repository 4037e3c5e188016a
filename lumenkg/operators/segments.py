"""A search index that grows: segments, tombstones, merged statistics, and a manifest that is swapped at once.

What is added becomes a segment of its own, in files that each hold the postings of some records, sorted by term: words
are counted where the records lie, and a word is looked up in those pages of each file that may hold it. Lengths of
fields are postings of the term ''. A tombstone says from which version on a uri is dead in older segments; adding
a uri again buries what older segments hold of it. The manifest of a version lists its segments and tombstones, and per field how many records are alive and their length; it comes to be with one
rename, so readers see a version or the one before, and of two writers of one version the second fails.
Compaction writes the living of all segments as one, and deletes nothing that a reader may still need.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from . import search as S


@dataclass(frozen=True)
class Version:
    """number; segments and tombstones: names of folders; sums: by field, the records that are alive and the sum of their lengths."""

    number: int
    segments: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    sums: tuple[tuple[str, int, int], ...] = ()


def records(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """What is indexed: uri, title, body, kind, def_like, fors; a record for each document (doc, html) and for each of its paragraphs.

    elements: doc, uri, kind, start, stop (bytes), fors, styles, title (range). Bodies are the visible text of
    the html, titles that of the title's range; a document has the title of its doctitle, if elements has one.
    """
    raw = pages.select("doc", F.encode("html", "UTF-8").alias("__raw"))
    cut = lambda a, b: html_to_text(F.decode(F.substring("__raw", a + 1, b - a), "UTF-8"))
    kinds = {k: n for n, k in enumerate(S.KINDS)}
    own = elements.where(F.col("kind").isin("paragraph", "definition", "example", "assertion") & F.col("stop").isNotNull()).join(raw, "doc")
    kind = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in kinds.items()])
    parts = own.select("uri", cut(F.col("title.start"), F.col("title.stop")).alias("title"), cut(F.col("start"), F.col("stop")).alias("body"), kind.alias("kind"), S.def_like(F.col("kind"), F.col("styles")).alias("def_like"), "fors")
    titles = elements.where("kind = 'doctitle'").groupBy("doc").agg(F.min_by("title", "start").alias("title"))
    docs = raw.join(titles, "doc", "left").select(F.col("doc").alias("uri"), cut(F.col("title.start"), F.col("title.stop")).alias("title"), html_to_text(F.decode("__raw", "UTF-8")).alias("body"), F.lit(0).alias("kind"), F.lit(False).alias("def_like"), F.array().cast("array<string>").alias("fors"))
    return docs.unionByName(parts)


class Segments:
    """An index in a folder. add() and delete() return the version that they have made; open() gives the index of a version, for search()."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, number: int | None = None) -> Version:
        """The latest version, or the one with the number; version 0 is empty."""
        folder = self._paths(f"{self.path}/manifests")
        known = [int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()] if self._fs.exists(folder) else []
        number = max(known, default=0) if number is None else number
        if number == 0:
            return Version(0)
        own = json.loads(self.spark.read.text(f"{self.path}/manifests/{number}").first()[0])
        return Version(number, tuple(own["segments"]), tuple(own["tombstones"]), tuple((f, n, s) for f, n, s in own["sums"]))

    def _commit(self, new: Version) -> Version:
        text = json.dumps({"segments": new.segments, "tombstones": new.tombstones, "sums": new.sums})
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(draft)
        self._fs.mkdirs(self._paths(f"{self.path}/manifests"))
        target = self._paths(f"{self.path}/manifests/{new.number}")
        if self._fs.exists(target) or not self._fs.rename(self._paths(draft), target):
            raise RuntimeError(f"version {new.number} was made by another writer")
        return new

    def _buried(self, at: Version) -> DataFrame:
        """uri, dead: in segments of a smaller version than dead, the uri is dead."""
        parts = [self.spark.read.parquet(f"{self.path}/{t}") for t in at.tombstones]
        every = parts[0] if parts else self.spark.createDataFrame([], "uri string, dead int")
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("uri").agg(F.max("dead").alias("dead"))

    def _read(self, segment: str, name: str) -> DataFrame:
        if name != "lengths":
            return self.spark.read.parquet(f"{self.path}/{segment}/{name}")
        return self._read(segment, "postings").where("term = ''").select("uri", "field", F.col("tf").alias("length"), "version")

    def _table(self, at: Version, name: str) -> DataFrame:
        parts = [self._read(s, name) for s in at.segments]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        if not at.tombstones:
            return every
        buried = self._buried(at)
        return every.join(buried.withColumnRenamed("uri", "uri_"), (F.col("uri") == F.col("uri_")) & (F.col("version") < F.col("dead")), "left_anti")

    def _sums(self, lengths: DataFrame) -> dict[str, tuple[int, int]]:
        return {r["field"]: (r["n"], r["s"] or 0) for r in lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("s")).collect()}  # a row for each field

    def _bury(self, uris: DataFrame, at: Version, number: int) -> tuple[Version, dict[str, tuple[int, int]]]:
        """A tombstone of the uris (uri) that are alive in a version, and what goes out of its sums."""
        name = f"tombstones-{uuid.uuid4().hex}"
        if not at.segments:
            return at, {}
        gone = self._table(at, "lengths").join(uris.select("uri").distinct(), "uri", "left_semi")
        gone.select("uri").distinct().withColumn("dead", F.lit(number)).write.parquet(f"{self.path}/{name}")
        return replace(at, tombstones=(*at.tombstones, name)), self._sums(gone)

    def _merged(self, at: Version, more: dict[str, tuple[int, int]], less: dict[str, tuple[int, int]]) -> tuple[tuple[str, int, int], ...]:
        sums = {f: (n, s) for f, n, s in at.sums}
        for field in {*sums, *more}:
            n, s = (sums.get(field, (0, 0))[k] + more.get(field, (0, 0))[k] - less.get(field, (0, 0))[k] for k in range(2))
            sums[field] = (n, s)
        return tuple((f, n, s) for f, (n, s) in sorted(sums.items()))

    def _write(self, postings: DataFrame, records: DataFrame, number: int) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        of = lambda df: df.withColumn("version", F.lit(number))
        of(postings).sortWithinPartitions("term").write.parquet(f"{self.path}/{name}/postings")
        of(records).write.parquet(f"{self.path}/{name}/records")
        return name

    def add(self, new: DataFrame) -> Version:
        """Records (uri unique, title, body, kind, def_like, fors) as a new segment, in place of older ones with their uris."""
        at = self.version()
        number = at.number + 1
        name = self._write(S.by_record(new), new, number)
        added = self._read(name, "lengths")
        buried, less = self._bury(added, at, number)
        return self._commit(Version(number, (*at.segments, name), buried.tombstones, self._merged(at, self._sums(added), less)))

    def delete(self, uris: DataFrame) -> Version:
        at = self.version()
        buried, less = self._bury(uris, at, at.number + 1)
        return self._commit(Version(at.number + 1, at.segments, buried.tombstones, self._merged(at, {}, less)))

    def compact(self) -> Version:
        """The living of all segments as one segment. Older versions can still be read."""
        at = self.version()
        if not at.segments:
            return at
        postings, records = (self._table(at, t).drop("version") for t in ("postings", "records"))
        return self._commit(Version(at.number + 1, (self._write(postings, records, at.number + 1),), (), at.sums))

    def open(self, number: int | None = None) -> S.Index:
        """The index of a version. Words are looked up in all segments; how many records there are, and how long they are, is known from the manifest."""
        at = self.version(number)
        averages = self.spark.createDataFrame([(f, n, s / n if n else None) for f, n, s in at.sums], "field string, n long, average double")
        if not at.segments:
            empty = self.spark.createDataFrame([], "uri string, title string, body string, kind int, def_like boolean, fors array<string>")
            return replace(S.index(empty, keep=False), averages=averages)
        postings, lengths, records = (self._table(at, t).drop("version") for t in ("postings", "lengths", "records"))
        return S.Index(postings.where("term != ''").groupBy("term", "field", "uri").agg(F.sum("tf").alias("tf")), lengths, records, averages)

    def vacuum(self) -> int:
        """Delete segments and tombstones that the latest version does not have, for when no older one is read; how many went."""
        at = self.version()
        kept = {*at.segments, *at.tombstones, "manifests", "drafts"}
        gone = [f.getPath() for f in self._fs.listStatus(self._paths(self.path)) if f.getPath().getName() not in kept]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
