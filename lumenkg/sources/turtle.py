"""Quads from and to Turtle: one statement a line, names shortened by prefixes, a folder of files for each graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .triples import parsed, parts, split_once

# Prefixes, and the characters of local names that need a backslash.
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/", "xsd": "http://www.w3.org/2001/XMLSchema#"}
_SPECIAL = r"""([~.\-!$&'()*+,;=/?#@%])"""
_NAME = r"[A-Za-z][A-Za-z0-9]*:(?:[A-Za-z0-9_-]++|\\.)*+"
_PLACE = rf'<[^<>"\x00-\x20]*>|_:[A-Za-z0-9]+|{_NAME}'
_STATEMENT = rf'^\s*({_PLACE})\s+({_PLACE}|a)\s+({_PLACE}|"(?:[^"\\]++|\\.)*+"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|{_NAME}))?)\s*\.\s*$'
_DECLARED = r"^\s*@prefix\s+([A-Za-z][A-Za-z0-9]*):\s*<([^<>]*)>\s*\.\s*$"
_TYPE = f"<{PREFIXES['rdf']}type>"


def _short(iri: Column, prefixes: dict[str, Column]) -> Column:
    """<iri>, or name:rest with the first prefix that fits; rests with other than ASCII characters stay whole."""
    tries = []
    for name, base in prefixes.items():
        rest = F.substr(iri, F.length(base) + 2, F.length(iri) - F.length(base) - 2)
        tries.append(F.when((F.length(base) > 0) & F.startswith(iri, F.concat(F.lit("<"), base)) & rest.rlike(r"""^[A-Za-z0-9_~.\-!$&'()*+,;=/?#@%]*$"""), F.concat(F.lit(f"{name}:"), F.regexp_replace(rest, _SPECIAL, r"\\$1"))))
    return F.coalesce(*tries, iri)


def statements(quads: DataFrame, prefixes: dict[str, Column]) -> DataFrame:
    """quads (g, s, s_kind, p, o, o_kind, o_lang, o_dtype and others) with value, the line of each."""
    s, p, o = parts(quads)
    typed = F.regexp_extract("__o", r"\^\^(<[^>]*>)$", 1)
    literal = F.when(F.col("o_dtype").isNotNull() & F.col("o_lang").isNull(), F.concat(F.substr("__o", F.lit(1), F.length("__o") - F.length(typed)), _short(typed, prefixes))).otherwise(F.col("__o"))
    own = quads.withColumns({"__s": s, "__p": p, "__o": o})
    value = F.concat_ws(" ", _short(F.col("__s"), prefixes), F.when(F.col("__p") == _TYPE, "a").otherwise(_short(F.col("__p"), prefixes)), F.when(F.col("o_kind") == "literal", literal).otherwise(_short(F.col("__o"), prefixes)), F.lit("."))
    return own.withColumn("value", value).drop("__s", "__p", "__o")


def write(quads: DataFrame, path: str, prefixes: dict[str, str] | None = None, namespace: str | None = "ns", file_rows: int = 1_000_000) -> None:
    """Turtle of quads, a folder for each graph (g=...), in files of about file_rows statements by subject, each with its prefixes at its head.

    namespace: the prefix that stands for the name of the graph itself, None for no such. Rows with a null part
    are left out and repeated rows written once; a graph of no rows has no folder; other columns are left out.
    """
    columns = ["g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype"]
    own = quads.select(*columns).dropna(subset=["g", "s", "p", "o"]).distinct()
    own = stored(own, "statements")  # what they are derived from is read once
    known = {} if namespace is None else {namespace: F.col("g")}
    known |= {name: F.lit(base) for name, base in sorted((PREFIXES if prefixes is None else prefixes).items(), key=lambda x: -len(x[1]))}
    large = own.groupBy("g").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("files")).where("files > 1")
    own = own.join(stored(large, "large"), "g", "left").withColumn("part", F.pmod(F.xxhash64("s"), F.coalesce("files", F.lit(1))).cast("int"))
    body = statements(own, known).select("g", "part", F.lit(1).alias("nth"), "value")
    heads = F.concat_ws("\n", *[F.concat(F.lit(f"@prefix {name}: <"), base, F.lit("> .")) for name, base in known.items()])
    first = own.select("g", "part").distinct().select("g", "part", F.lit(0).alias("nth"), heads.alias("value"))
    # all of a file in one task, its head first
    laid = first.unionByName(body).repartition("g", "part").sortWithinPartitions("g", "part", "nth", "value")
    laid.select("value", "g", "part").write.partitionBy("g", "part").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """g, s, s_kind, p, o, o_kind, o_lang, o_dtype of files that write() made, or of others in folders g=.../part=... with one statement a line.

    What is no statement, or has a prefix that its file does not declare, is left out.
    """
    folders = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/g=*")
    if not folders.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folders):
        return spark.createDataFrame([], "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string")
    lines = spark.read.schema("value string, g string, part int").text(path).select("value", "g", F.col("_metadata.file_path").alias("file"))
    declared = lines.where(F.startswith(F.ltrim("value"), F.lit("@prefix"))).select("file", F.regexp_extract("value", _DECLARED, 1).alias("name"), F.regexp_extract("value", _DECLARED, 2).alias("base")).where("name != ''")
    names = declared.groupBy("file", "name").agg(F.max("base").alias("base")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "base"))).alias("names"))
    # a row for each file: as a table its size is known, so that lines are not dealt by file where it is small
    own = lines.where(~F.startswith(F.ltrim("value"), F.lit("@prefix"))).join(stored(names, "names"), "file", "left")
    own = split_once(own, F.col("value"), _STATEMENT, "__t").select("g", "names", *[F.get("__t", F.lit(n)).alias(f"t{n}") for n in (1, 2, 3)])
    a, b, c = F.col("t1"), F.col("t2"), F.col("t3")

    def whole(t: Column) -> Column:
        local = F.substr(t, F.length(F.substring_index(t, ":", 1)) + 2)
        local = F.when(F.contains(local, F.lit("\\")), F.regexp_replace(local, r"\\(.)", "$1")).otherwise(local)
        named = F.concat(F.lit("<"), F.try_element_at("names", F.substring_index(t, ":", 1)), local, F.lit(">"))
        return F.when(F.substring(t, 1, 1).isin("<", "_", '"'), t).otherwise(named)

    typed = F.when(c.startswith('"'), F.regexp_extract(c, rf'"\^\^({_NAME})$', 1)).otherwise("")
    last = F.when(typed != "", F.concat(F.substr(c, F.lit(1), F.length(c) - F.length(typed)), whole(typed))).otherwise(whole(c))
    full = own.select("g", F.concat(whole(a), F.lit(" "), F.when(b == "a", _TYPE).otherwise(whole(b)), F.lit(" "), last, F.lit(" .")).alias("value"))
    return parsed(full).select("g", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype")
