"""File states and identifiers over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import uri as U
from ..operators import legacy
from ..operators import states as S
from .registry import Queries

Q = Queries()
ONE = "one AS (SELECT archive, rel_path, target, last_built, last_changed, CASE WHEN last_built IS NULL THEN 1 WHEN last_built > last_changed THEN 3 ELSE 2 END AS state FROM {file_targets})"
FILES = ONE + ", f AS (SELECT archive, rel_path, min(state) AS state, max(last_built) AS last_built, max(last_changed) AS last_changed FROM one GROUP BY archive, rel_path)"
COUNTS = 'sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) AS "new", sum(CASE WHEN state = 2 THEN 1 ELSE 0 END) AS stale, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END) AS deleted, sum(CASE WHEN state = 3 THEN 1 ELSE 0 END) AS up_to_date, max(last_built) AS last_built, max(CASE WHEN state <> 3 THEN last_changed END) AS last_changed'

Q.add("fs_file_states", "file_targets", lambda t: t.select("archive", "rel_path", "target", S.state(F.col("last_changed"), F.col("last_built")).alias("state"), "last_built"), f"WITH {ONE} SELECT archive, rel_path, target, state, last_built FROM one")
Q.add("fs_format_state", "file_targets", S.file_states, f"WITH {FILES} SELECT * FROM f")
Q.add("fs_archive_summary", "file_targets", lambda t: S.summary(S.file_states(t), "archive"), f"WITH {FILES} SELECT archive, {COUNTS} FROM f GROUP BY archive")
Q.add("fs_summary_across_formats", "file_targets", lambda t: S.across_formats(S.summary(S.file_states(t.withColumn("format", F.col("target")), ("archive", "rel_path", "format")), "archive", "format"), "archive"), f'WITH {ONE}, s AS (SELECT archive, target, {COUNTS} FROM one GROUP BY archive, target) SELECT archive, max("new") AS "new", max(stale) AS stale, max(up_to_date) AS up_to_date, max(last_built) AS last_built, max(last_changed) AS last_changed FROM s GROUP BY archive')
Q.add("fs_rollup_dirs", "file_targets", lambda t: S.rollup(S.file_states(t), "rel_path", "archive"), f"WITH {FILES}, e AS (SELECT archive, '' AS folder, state, last_built, last_changed FROM f UNION ALL SELECT archive, split_part(rel_path, '/', 1), state, last_built, last_changed FROM f UNION ALL SELECT archive, concat(split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2)), state, last_built, last_changed FROM f) SELECT archive, folder, {COUNTS} FROM e GROUP BY archive, folder")
Q.add("fs_rollup_groups", "file_targets", lambda t: S.rollup(S.file_states(t).withColumn("path", F.concat_ws("/", "archive", F.lit("file"))), "path"), f"WITH {FILES}, e AS (SELECT '' AS folder, f.* FROM f UNION ALL SELECT split_part(archive, '/', 1), f.* FROM f UNION ALL SELECT archive, f.* FROM f) SELECT folder, {COUNTS} FROM e GROUP BY folder")
Q.add("fs_lookup", "file_targets", lambda t: S.file_states(t).where((F.col("archive") == "AFRICA/NATION_0") & F.col("rel_path").startswith("y1995/m03/")), f"WITH {FILES} SELECT * FROM f WHERE archive = 'AFRICA/NATION_0' AND rel_path LIKE 'y1995/m03/%'")
Q.add("fs_children", "file_targets", lambda t: S.children(S.file_states(t), "AFRICA/NATION_0", "y1995"), f"WITH {FILES} SELECT split_part(rel_path, '/', 2) AS name, true AS is_dir, {COUNTS} FROM f WHERE archive = 'AFRICA/NATION_0' AND rel_path LIKE 'y1995/%' GROUP BY 1")
Q.add("fs_build_status", "file_targets", lambda t: S.summary(S.file_states(t.withColumn("format", F.col("target")), ("archive", "rel_path", "format")).withColumn("grp", F.substring_index("archive", "/", 1)), "grp", "format"), f"WITH {ONE} SELECT split_part(archive, '/', 1) AS grp, target AS format, {COUNTS} FROM one GROUP BY 1, 2")


def _changes(t):
    old = S.file_states(t.where("target = 'first' and k % 10 != 0"))
    return S.changes(old, S.file_states(t.where("k % 10 != 1"))).fillna(-1, ["old", "new"])


Q.add("fs_changes", "file_targets", _changes, "WITH x AS (SELECT k, archive, rel_path, target, CASE WHEN last_built IS NULL THEN 1 WHEN last_built > last_changed THEN 3 ELSE 2 END AS state FROM {file_targets}), a AS (SELECT archive, rel_path, min(state) AS old FROM x WHERE target = 'first' AND k % 10 <> 0 GROUP BY archive, rel_path), b AS (SELECT archive, rel_path, min(state) AS \"new\" FROM x WHERE k % 10 <> 1 GROUP BY archive, rel_path) SELECT coalesce(a.archive, b.archive) AS archive, coalesce(a.rel_path, b.rel_path) AS rel_path, coalesce(old, -1) AS old, coalesce(\"new\", -1) AS \"new\", CASE WHEN old IS NULL THEN 'created' WHEN \"new\" IS NULL THEN 'deleted' ELSE 'changed' END AS event FROM a FULL OUTER JOIN b ON a.archive = b.archive AND a.rel_path = b.rel_path WHERE old IS DISTINCT FROM \"new\"")
Q.add("fs_archive_of", "docs archives", lambda d, a: S.owner(d.select(F.concat_ws("/", "archive", "rel_path").alias("path")), a.select(F.col("id").alias("root"), "id")), "SELECT concat(archive, '/', rel_path) AS path, archive AS id FROM {docs}")
Q.add("catalog_index", "supplier customer", lambda s, c: S.catalog(s.select(F.lit("library").alias("kind"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("archive"), F.lit("").alias("file"), F.lit("").alias("notes"), F.col("s_name").alias("title"), F.col("s_suppkey").alias("ord")).unionByName(c.select(F.when(F.col("c_nationkey") % 3 == 0, "university").otherwise("course").alias("kind"), F.lit("").alias("archive"), F.lit("").alias("file"), F.concat(F.col("c_mktsegment"), F.col("c_nationkey")).alias("notes"), F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("ord")))).select("kind", "key", "ord"), "WITH e AS (SELECT 'library' AS kind, concat('n', s_nationkey) AS key, s_suppkey AS ord FROM {supplier} UNION ALL SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'university' ELSE 'course' END, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE concat(c_mktsegment, c_nationkey) END, c_custkey FROM {customer}) SELECT kind, key, min(ord) AS ord FROM e GROUP BY kind, key")

URI = "concat('http://corpus.org?a=', archive, '&p=', split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2), '&d=o', CAST(k AS STRING), '&l=en')"
BASE = "http://corpus.org"
Q.add("uri_from_relpath", "docs", lambda d: d.select("k", U.document_of(F.lit(BASE), F.col("archive"), F.col("rel_path")).alias("uri")), f"SELECT k, {URI} AS uri FROM {{docs}}")
Q.add("uri_parse", "docs", lambda d: d.select("k", U.parse(U.document_of(F.lit(BASE), F.col("archive"), F.col("rel_path"))).alias("u")).select("k", *[F.col(f"u.{c}").alias(c) for c in ("base", "a", "p", "m", "d", "l", "kind", "error")]), "SELECT k, 'http://corpus.org' AS base, archive AS a, concat(split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2)) AS p, CAST(NULL AS STRING) AS m, concat('o', CAST(k AS STRING)) AS d, 'en' AS l, 'document' AS kind, CAST(NULL AS STRING) AS error FROM {docs}")
Q.add("uri_compose", "elements", lambda e: e.select("uri", U.compose(F.lit(BASE), a=F.lit("x/y"), m=F.concat(F.lit("mod"), F.col("supplier")), s=F.when(F.col("kind") == "definition", F.concat(F.lit("sym"), F.col("part")))).alias("id")), "SELECT uri, concat('http://corpus.org?a=x/y&m=mod', supplier, CASE WHEN kind = 'definition' THEN concat('&s=sym', part) ELSE '' END) AS id FROM {elements}")
Q.add("uri_language", "documents", lambda d: d.select("doc_id", U.language(F.concat(F.lit("dir/d"), F.col("doc_id"), F.lit("."), F.col("lang"), F.lit(".tex"))).alias("language")), "SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr', 'ro', 'ar', 'bg', 'ru', 'fi', 'tr', 'sl') THEN lang ELSE 'en' END AS language FROM {documents}")
Q.add("uri_from_components", "docs", lambda d: d.select("k", U.from_components(F.when(F.col("k") % 3 == 0, F.col("uri")), F.when(F.col("k") % 3 != 0, F.col("archive")), F.when(F.col("k") % 3 == 1, F.col("rel_path")), F.lit(BASE)).alias("id")), f"SELECT k, CASE k % 3 WHEN 0 THEN uri WHEN 1 THEN {URI} END AS id FROM {{docs}}")
Q.add("iri_escape", "documents", lambda d: d.select("doc_id", U.escaped(F.col("text")).alias("iri"), (U.unescaped(U.escaped(F.col("text"))) == F.replace(F.replace(F.replace(F.replace(F.replace(F.col("text"), F.lit("%20"), F.lit(" ")), F.lit("%5C"), F.lit("\\")), F.lit("%5E"), F.lit("^")), F.lit("%5B"), F.lit("[")), F.lit("%5D"), F.lit("]"))).alias("back")), "SELECT doc_id, replace(replace(replace(replace(replace(text, ' ', '%20'), '\\', '%5C'), '^', '%5E'), '[', '%5B'), ']', '%5D') AS iri, true AS back FROM {documents}")
_wanted = lambda d: d.select("archive", F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1).alias("path"), F.concat(F.lit("o"), F.col("k")).alias("name"), F.lit("de").alias("lang"))
_files = lambda d: d.select("archive", F.when(F.col("k") % 4 == 0, F.regexp_replace("rel_path", r"\.tex$", ".de.tex")).otherwise(F.col("rel_path")).alias("rel_path")).where("k % 7 != 0")
Q.add("uri_source_file", "docs", lambda d: S.source_file(_wanted(d), _files(d)).select("archive", "name", "rel_path"), "SELECT archive, concat('o', CAST(k AS STRING)) AS name, CASE WHEN k % 4 = 0 THEN replace(rel_path, '.tex', '.de.tex') ELSE rel_path END AS rel_path FROM {docs} WHERE k % 7 <> 0")
Q.add("uri_document_of", "docs", lambda d: S.source_file(_wanted(d), _files(d)).select("archive", "name", U.document_of(F.lit(BASE), F.col("archive"), F.col("rel_path")).alias("uri")), "SELECT archive, concat('o', CAST(k AS STRING)) AS name, concat('http://corpus.org?a=', archive, '&p=', split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2), '&d=o', CAST(k AS STRING), CASE WHEN k % 4 = 0 THEN '&l=de' ELSE '&l=en' END) AS uri FROM {docs} WHERE k % 7 <> 0")


def _legacy(d, a):
    """Documents by their old names: as symbols, symbols of structures, modules and files, some of archives that nobody knows."""
    k, place = F.col("k").cast("string"), F.concat(F.lit("http://old.org/"), F.when(F.col("k") % 11 == 0, "gone/").otherwise(""), F.col("archive"), F.lit("/"), F.regexp_extract("rel_path", "^(.*)/", 1))
    forms = [F.concat(place, F.lit("?o"), k, F.lit("-module?s")), F.concat(place, F.lit("?o"), k, F.lit("?["), place, F.lit("/x?t-module]/s")), F.concat(place, F.lit("/?o"), k), F.concat(place, F.lit("/o"), k, F.lit(".de.tex"))]
    uri = F.coalesce(*[F.when(F.col("k") % 4 == n, form) for n, form in enumerate(forms)])
    return legacy.converted(d.select(uri.alias("uri")), a.select(F.lit(BASE).alias("base"), "id"), ("http://old.org",))


PLACE = "concat('http://old.org/', CASE WHEN k % 11 = 0 THEN 'gone/' ELSE '' END, archive, '/', split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2))"
Q.add("uri_legacy", "docs archives", _legacy, f"""SELECT CASE k % 4 WHEN 0 THEN concat({PLACE}, '?o', k, '-module?s') WHEN 1 THEN concat({PLACE}, '?o', k, '?[', {PLACE}, '/x?t-module]/s') WHEN 2 THEN concat({PLACE}, '/?o', k) ELSE concat({PLACE}, '/o', k, '.de.tex') END AS uri,
CASE WHEN k % 11 <> 0 THEN concat('http://corpus.org?a=', archive, '&p=', split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2), CASE k % 4 WHEN 0 THEN concat('&m=o', k, '&s=s') WHEN 2 THEN concat('&m=o', k) WHEN 3 THEN concat('&d=o', k, '&l=de') END) END AS id FROM {{docs}} WHERE k % 4 <> 1
UNION ALL SELECT concat({PLACE}, '?o', k, '?[', {PLACE}, '/x?t-module]/s'), CASE WHEN k % 11 <> 0 THEN concat('http://corpus.org?a=', archive, '&p=', split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2), '&m=o', k, '&s=t/s') END FROM {{docs}} WHERE k % 4 = 1""")
