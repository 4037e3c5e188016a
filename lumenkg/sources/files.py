"""Archives of sources: folders, manifests, catalogs and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.states import ancestors

# The schema of catalog entries.
CATALOG = "kind string, type string, title string, archive string, file string, notes string, url string, authors array<string>, teaser string, thumbnail string, landing string, slides string, venue string, institution string, quizzes boolean, homeworks boolean"


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root), modified, length of all files. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select(below(F.col("path"), root).alias("path"), F.col("modificationTime").alias("modified"), "length")


def below(path: Column, root: str) -> Column:
    return F.regexp_replace(path, rf"^.*{root.rstrip('/').split('/')[-1]}/", "")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Archives: root (folder), id, formats, dependencies, ignore, attributes and error (null if all is well).

    An archive is a folder with META-INF/MANIFEST.MF that lies in no other archive and in no folder with
    a dot. Its id must be its place; it needs a format unless it holds meta data only; it does not
    depend on itself.
    """
    lines = spark.read.text(root, wholetext=True, pathGlobFilter="MANIFEST.MF", recursiveFileLookup=True).select(below(F.col("_metadata.file_path"), root).alias("path"), "value")
    own = lines.where(F.col("path").endswith("META-INF/MANIFEST.MF") & ~F.col("path").rlike(r"(^|/)\.")).select(F.regexp_replace("path", "/?META-INF/MANIFEST.MF$", "").alias("root"), "value")
    return outermost(own.select("root", parsed_manifest(F.col("value")).alias("attributes"))).select("root", *_fields(), "attributes")


def parsed_manifest(text: Column) -> Column:
    """Lines "key: value" as a map; of a key that comes twice the last counts."""
    pairs = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def outermost(archives: DataFrame) -> DataFrame:
    inner = archives.select("root", F.explode(ancestors(F.col("root"))).alias("above")).join(archives.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    return archives.join(inner, "root", "left_anti")


def _fields() -> list[Column]:
    a = F.col("attributes")
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    error = F.when(a["id"].isNull(), "no id").when(~F.col("root").eqNullSafe(a["id"]), "id is not the place").when((F.size(words(a["format"])) == 0) & ~a["id"].endswith("meta-inf"), "no format").when(a["url-base"].isNotNull() & ~a["url-base"].rlike("^[a-z]+://"), "url base")
    return [a["id"].alias("id"), words(a["format"]).alias("formats"), F.array_remove(words(a["dependencies"]), a["id"]).alias("dependencies"), a["ignore"].alias("ignore"), error.alias("error")]


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Entries of META-INF/archive.json, an array of documents and institutions each."""
    return spark.read.schema(CATALOG).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "archive.json").json(root)


def ignore_pattern(ignore: Column) -> Column:
    """The pattern of an ignore list: parts by "|", * for anything, dots as they are, from the source folder on."""
    text = F.regexp_replace(F.replace(ignore, F.lit("."), F.lit(r"\.")), r"\*", ".*")
    return F.concat(F.lit("^(?:"), F.array_join(F.transform(F.split(text, r"\|"), lambda x: F.trim(x)), "|"), F.lit(")"))


def sources(files: DataFrame, archives: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Files (path, modified) of the source folders: archive, rel_path, format, modified. Unknown extensions and ignored files are left out."""
    own = archives.select(F.concat("root", F.lit("/source")).alias("folder"), F.col("id").alias("archive"), "ignore")
    placed = files.withColumn("folder", F.explode(ancestors(F.col("path")))).join(own, "folder").withColumn("rel_path", F.substring(F.col("path"), F.length("folder") + 2, F.length("path")))
    kinds = F.create_map(*[F.lit(x) for kv in formats.items() for x in kv])
    placed = placed.withColumn("format", F.try_element_at(kinds, F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
    ignored = F.coalesce(F.rlike(F.concat(F.lit("/"), "rel_path"), ignore_pattern(F.col("ignore"))), F.lit(False))
    return placed.where(F.col("format").isNotNull() & ~ignored).select("archive", "rel_path", "format", "modified")


def merged(paths: list[DataFrame]) -> DataFrame:
    """Archives of several library folders; of one id the first folder's stays."""
    rows = None
    for n, df in enumerate(paths):
        own = df.withColumn("nth", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    first = F.min("nth").over(Window.partitionBy("id"))
    return rows.withColumn("first", first).where("nth = first").drop("nth", "first")
