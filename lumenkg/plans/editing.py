"""Linting, logs, histories and users over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import lint as L
from ..operators import logs as G
from .build import _sources
from .registry import Queries

Q = Queries()
Q.add("lint_files", "elements", lambda e: L.annotated(_sources(e)).groupBy("file", "kind").agg(F.count("*").alias("n")), "SELECT k AS file, CASE kind WHEN 'definition' THEN 'import' ELSE 'input' END AS kind, count(*) AS n FROM {elements} WHERE kind <> 'example' GROUP BY 1, 2")
_ranges = lambda e: e.select(F.col("doc").alias("file"), (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + F.col("level") * 5).alias("stop"), F.col("level").alias("depth"), F.col("ord").alias("id"))
_pos = lambda e: e.select(F.col("doc").alias("file"), (F.col("ord") * 10 + F.col("line")).alias("pos")).distinct()
Q.add("lint_at_position", "elements", lambda e: L.at_positions(_pos(e), _ranges(e)), "SELECT file, pos, id FROM (SELECT p.file, p.pos, r.ord AS id, row_number() OVER (PARTITION BY p.file, p.pos ORDER BY r.level DESC, r.ord DESC) AS n FROM (SELECT DISTINCT doc AS file, ord * 10 + line AS pos FROM {elements}) p JOIN {elements} r ON r.doc = p.file AND p.pos BETWEEN r.ord * 10 AND r.ord * 10 + r.level * 5) x WHERE n = 1")
Q.add("lint_references", "elements", lambda e: e.join(e.where("kind = 'definition'").select("part").distinct(), "part").where("kind != 'definition'").select("uri", F.concat(F.lit("sym/"), "part").alias("symbol")), "SELECT uri, concat('sym/', part) AS symbol FROM {elements} e WHERE kind <> 'definition' AND EXISTS (SELECT 1 FROM {elements} d WHERE d.kind = 'definition' AND d.part = e.part)")
Q.add("lint_hierarchy", "quads", lambda q: q.where("p = 'extends'").groupBy(F.col("o").alias("module")).agg(F.count("*").alias("by")).join(q.where("p = 'extends'").select(F.col("s").alias("module"), F.col("o").alias("over")), "module", "left").fillna("", ["over"]), "SELECT a.module, a.by, coalesce(b.o, '') AS over FROM (SELECT o AS module, count(*) AS by FROM {quads} WHERE p = 'extends' GROUP BY o) a LEFT JOIN {quads} b ON b.s = a.module AND b.p = 'extends'".replace(" AS over", ' AS "over"'))
Q.add("lint_token_deltas", "elements", lambda e: L.token_deltas(e.select(F.col("doc").alias("file"), F.col("line"), (F.col("ord") * 3).alias("col"), F.when(F.col("level") > 0, F.col("level")).alias("length"), F.col("kind").alias("type"))), "SELECT doc AS file, line, ord * 3 AS col, kind AS type, line - coalesce(lag(line) OVER w, 0) AS d_line, CASE WHEN line = coalesce(lag(line) OVER w, 0) THEN ord * 3 - coalesce(lag(ord * 3) OVER w, 0) ELSE ord * 3 END AS d_col, CASE WHEN level > 0 THEN level ELSE 999 END AS length FROM {elements} WINDOW w AS (PARTITION BY doc ORDER BY line, ord, kind)")
Q.add("lint_diagnostic_counts", "elements", lambda e: L.diagnostics(L.annotated(e.groupBy(F.col("k").alias("file")).agg(F.concat_ws("\n", F.collect_list(F.concat(F.when(F.col("level") < 4, F.lit("\\begin{sdefinition}")).otherwise(F.lit("\\end{sdefinition}"))))).alias("text")))).groupBy(F.substring_index("message", ":", 1).alias("what")).agg(F.count("*").alias("n")), "SELECT what, count(*) AS n FROM (SELECT k, CASE WHEN sum(CASE WHEN level < 4 THEN 1 ELSE -1 END) > 0 THEN 'not closed' WHEN sum(CASE WHEN level < 4 THEN 1 ELSE -1 END) < 0 THEN 'not opened' END AS what FROM {elements} GROUP BY k) x WHERE what IS NOT NULL GROUP BY what")
Q.add("log_parse", "log_lines", lambda l: G.parsed(l.select(F.to_json(F.struct("tag", F.col("span").alias("parent"), F.col("level").alias("name"), "ts", "level", F.map_from_arrays(F.array(F.lit("k")), F.array(F.col("event_id").cast("string"))).alias("args"))).alias("value"))).select("tag", "parent", "level", F.col("args")["k"].cast("long").alias("event_id")), "SELECT tag, span AS parent, level, event_id FROM {log_lines}")
Q.add("log_span_durations", "log_lines", G.spans, "WITH a AS (SELECT *, sum(CASE WHEN tag = 'open' THEN 1 ELSE 0 END) OVER (PARTITION BY span ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM {log_lines}), b AS (SELECT span, nth, min(CASE WHEN tag = 'open' THEN ts END) AS opened, min(CASE WHEN tag = 'close' THEN ts END) AS closed, min(CASE WHEN tag = 'close' THEN event_id END) AS last FROM a WHERE nth > 0 GROUP BY span, nth) SELECT b.span, b.nth, opened, closed, (SELECT count(*) FROM a WHERE a.span = b.span AND a.nth = b.nth AND a.tag = 'message' AND (b.last IS NULL OR a.event_id < b.last)) AS messages FROM b")
Q.add("log_level_counts", "log_lines", lambda l: l.where(G.level_rank(F.col("level")) >= 2).groupBy("level", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")), "SELECT level, date_trunc('hour', ts) AS hour, count(*) AS n FROM {log_lines} WHERE level <> 'TRACE' GROUP BY 1, 2")
Q.add("log_tree", "log_lines", lambda l: G.tree(l.where("tag = 'open'").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 3).alias("parent"))).fillna(-1, ["parent"]), "SELECT a.event_id AS id, coalesce(b.event_id, -1) AS parent FROM {log_lines} a LEFT JOIN {log_lines} b ON b.tag = 'open' AND b.event_id = CAST(floor(a.event_id / 3.0) AS BIGINT) WHERE a.tag = 'open'")
Q.add("fmt_duration", "events", lambda e: e.select("event_id", G.duration(F.col("event_id") * 12_345).alias("text")), "WITH x AS (SELECT event_id, event_id * 12345 AS ms FROM {events}) SELECT event_id, concat_ws(' ', CASE WHEN ms >= 86400000 THEN concat(ms // 86400000, 'd') END, CASE WHEN ms >= 3600000 THEN concat(ms // 3600000 % 24, 'h') END, CASE WHEN ms >= 60000 THEN concat(ms // 60000 % 60, 'm') END, concat(ms % 60000 // 1000, '.', lpad(CAST(ms % 1000 AS STRING), 3, '0'), 's')) AS text FROM x")
Q.add("ema_delta", "events", lambda e: G.moving_averages(e, "user_id", "event_id", "value", scale=0.75).select("user_id", F.round("average", 6).alias("average")), "WITH RECURSIVE x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}), r AS (SELECT user_id, n, value AS a FROM x WHERE n = 1 UNION ALL SELECT x.user_id, x.n, r.a * 0.75 + x.value * 0.25 FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1) SELECT user_id, round(last(a ORDER BY n), 6) AS average FROM r GROUP BY user_id")


def _commits(o):
    """Every order is a commit and the tip of a branch; some have a second parent."""
    own = o.where("o_orderkey >= 0").select((F.col("o_orderkey") % 7).alias("repo"), F.col("o_orderkey").alias("id"))
    first = own.select("repo", "id", (F.col("id") - 7 * (1 + F.col("id") % 3)).alias("parent"), F.lit(1).alias("nth"))
    second = own.where("id % 97 = 0").select("repo", "id", (F.col("id") - 35).alias("parent"), F.lit(2).alias("nth"))
    parents = first.unionByName(second).withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))
    tips = own.select("repo", F.concat(F.lit("b"), "id").alias("name"), F.col("id").alias("tip"), F.lit(False).alias("is_head"))
    heads = own.where("id between 630 and 636").select("repo", F.lit("main").alias("name"), F.col("id").alias("tip"), F.lit(True).alias("is_head"))
    return H.new_commits(tips.unionByName(heads), parents)


WALK = """WITH RECURSIVE o AS (SELECT CAST(o_orderkey AS BIGINT) AS id FROM {orders} WHERE o_orderkey >= 0),
c AS (SELECT id, list_concat(CASE WHEN id >= 7 * (1 + id % 3) THEN [id - 7 * (1 + id % 3)] ELSE [] END, CASE WHEN id % 97 = 0 AND id >= 35 THEN [id - 35] ELSE [] END) AS up FROM o),
r AS (SELECT id AS tip, [id] AS todo, 0 AS n, false AS found FROM c UNION ALL
SELECT r.tip, list_concat(r.todo[:-2], c.up), r.n + 1, list_contains(c.up, 630 + r.tip % 7) FROM r JOIN c ON c.id = r.todo[-1] WHERE NOT r.found AND r.n < 500)
SELECT tip % 7 AS repo, concat('b', tip) AS name, tip FROM r WHERE found AND tip NOT BETWEEN 630 AND 636"""
Q.add("git_new_commits", "orders", _commits, WALK)
Q.add("git_archive_states", "archives docs", lambda a, d: H.archive_states(a.select("id").unionByName(a.select(F.concat("id", F.lit("/x")).alias("id"))), a.where("nation % 2 = 0").select("id"), d.where("k % 400 = 0").select(F.col("archive").alias("id"))), "WITH p AS (SELECT id FROM {archives} UNION ALL SELECT concat(id, '/x') FROM {archives}) SELECT id, CASE WHEN id IN (SELECT archive FROM {docs} WHERE k % 400 = 0) THEN 'queued' WHEN id IN (SELECT id FROM {archives} WHERE nation % 2 = 0) THEN 'live' ELSE 'none' END AS state FROM p")
_users = lambda c, name: c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1000).alias("gitlab_id"), F.concat(F.lit(name), F.col("c_nationkey")).alias("name"), (F.col("c_nationkey") == 3).alias("is_admin"))
Q.add("users_upsert", "customer", lambda c: H.with_admin(H.upserted(_users(c.where("c_custkey % 3 != 0"), "old"), _users(c.where("c_custkey % 2 = 0"), "new").withColumn("is_admin", F.lit(False))), 10, True), "SELECT c_custkey AS id, c_custkey + 1000 AS gitlab_id, concat(CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END, c_nationkey) AS name, c_custkey = 10 OR (c_custkey % 3 <> 0 AND c_nationkey = 3) AS is_admin FROM {customer} WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
