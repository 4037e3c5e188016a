"""Builds over the derived tasks and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators.states import state
from .registry import Queries

Q = Queries()
_state = lambda t: t.withColumn("state", state(F.col("last_changed"), F.col("last_built")))
ST = "s AS (SELECT archive, rel_path, target, CASE WHEN last_built IS NULL THEN 1 WHEN last_built > last_changed THEN 3 ELSE 2 END AS state FROM {file_targets})"
ENQ = "SELECT archive, rel_path, string_agg(target, ',' ORDER BY target) AS steps, count(*) AS n_steps FROM s WHERE state IN (1, 2) {} GROUP BY archive, rel_path"
Q.add("build_enqueue", "file_targets", lambda t: B.enqueue(_state(t), ["first", "second"]), f"WITH {ST} " + ENQ.replace("{}", ""))
Q.add("build_enqueue_scoped", "file_targets", lambda t: B.enqueue(_state(t), ["first", "second"], scope=B.in_scope(group="AFRICA", folder="y1995")), f"WITH {ST} " + ENQ.replace("{}", "AND archive LIKE 'AFRICA/%' AND rel_path LIKE 'y1995/%'"))
Q.add("build_resolve_deps", "tasks deps", lambda t, d: B.resolved(d.join(t.select(F.col("id").alias("dep"), "archive", "rel_path"), "dep").select("task", "archive", F.when(F.col("task") % 10 == 0, F.lit("none.tex")).otherwise(F.col("rel_path")).alias("rel_path"), "strict"), t).select("task", F.coalesce("dep", F.lit(-1)).alias("dep"), "strict"), "SELECT task, CASE WHEN task % 10 = 0 THEN -1 ELSE dep END AS dep, strict FROM {deps}")
Q.add("build_ready", "tasks deps", lambda t, d: B.ready(t, d).select("id"), "SELECT id FROM {tasks} t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM {deps} d JOIN {tasks} u ON u.id = d.dep WHERE d.task = t.id AND d.strict AND d.task <> d.dep AND u.state IN ('queued', 'running'))")
Q.add("build_levels", "tasks deps", lambda t, d: B.order(t, d), "WITH RECURSIVE q AS (SELECT id FROM {tasks} WHERE state = 'queued'), l AS (SELECT q.id, 0 AS level FROM q LEFT JOIN {deps} d ON d.task = q.id LEFT JOIN q p ON p.id = d.dep WHERE p.id IS NULL UNION ALL SELECT d.task, l.level + 1 FROM l JOIN {deps} d ON d.dep = l.id JOIN q ON q.id = d.task) SELECT id, level, 'queued' AS placed FROM l")
Q.add("build_state_snapshot", "tasks", lambda t: B.snapshot(B.requeued(t), "archive"), "SELECT archive, CASE state WHEN 'failed' THEN 'queued' ELSE state END AS state, count(*) AS n FROM {tasks} GROUP BY 1, 2")
Q.add("build_eta", "events", lambda e: B.eta(e.select((F.col("user_id") % 10).alias("queue"), F.col("event_id").alias("id"), "ts"), 200).where("done > 1").withColumn("left", F.round("left", 6)), "SELECT queue, id, done, elapsed, round(elapsed * 1.0 / (done - 1) * (200 - done), 6) AS left FROM (SELECT user_id % 10 AS queue, event_id AS id, row_number() OVER w AS done, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', first_value(ts) OVER w)) AS BIGINT) AS elapsed FROM {events} WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id)) x WHERE done > 1".replace(" AS left ", ' AS "left" '))


def _after(e):
    first = e.select(F.col("k").alias("task"), F.col("ord"), F.col("kind").alias("target"))
    events = e.where("level < 5 and ord <= 2").select(F.col("k").alias("task"), "ord", (F.col("level") != 1).alias("ok"))
    return B.after_events(first, events)


Q.add("build_apply_events", "elements", _after, "WITH x AS (SELECT k AS task, ord, kind AS target, CASE WHEN level < 5 AND ord <= 2 THEN level <> 1 END AS ok FROM {elements}), y AS (SELECT *, max(CASE WHEN ok = false THEN 1 ELSE 0 END) OVER w AS f, sum(CASE WHEN ok IS NULL THEN 1 ELSE 0 END) OVER w AS n FROM x WINDOW w AS (PARTITION BY task ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT task, ord, target, CASE WHEN f = 1 THEN 'failed' WHEN ok THEN 'done' WHEN n = 1 THEN 'queued' ELSE 'blocked' END AS state FROM y")
_sources = lambda e: e.groupBy(F.col("k").alias("file")).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.when(F.col("kind") == "definition", "\\importmodule[").when(F.col("kind") == "example", "% \\usemodule[").otherwise("\\inputref["), F.lit("a"), F.col("level"), F.lit("]{p/m"), F.col("supplier"), F.lit("?x}"))))).alias("text"))
Q.add("build_source_deps", "elements", lambda e: B.source_deps(_sources(e)), "WITH x AS (SELECT DISTINCT k AS file, CASE kind WHEN 'definition' THEN 'import' ELSE 'input' END AS kind, concat('a', level) AS archive, concat('p/m', supplier) AS path FROM {elements} WHERE kind <> 'example') SELECT x.*, false AS strict FROM x UNION ALL SELECT x.*, true FROM x WHERE kind = 'import'")
Q.add("overlay_archives", "docs", lambda d: B.overlaid([d.where("k % 5 = 0").select("uri", F.lit("sandbox").alias("text")), d.where("k % 3 = 0").select("uri", F.lit("temporary").alias("text")), d.select("uri", F.lit("global").alias("text"))], "uri"), "SELECT uri, CASE WHEN k % 5 = 0 THEN 'sandbox' WHEN k % 3 = 0 THEN 'temporary' ELSE 'global' END AS text, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 3 = 0 THEN 1 ELSE 2 END AS layer FROM {docs}")
Q.add("overlay_required", "archives", lambda a: B.required(a.select("id").unionByName(a.select(F.concat("grp", F.lit("/meta-inf")).alias("id")).distinct()), a.where("nation % 4 = 0").select("id")), "SELECT id FROM {archives} WHERE nation % 4 = 0 UNION SELECT concat(grp, '/meta-inf') FROM {archives} WHERE nation % 4 = 0")
_queues = lambda t: t.where("size % 4 != 1").select("id", F.col("archive").alias("name"), (F.floor(F.col("id") / 3) % 9).alias("idx"))
Q.add("build_queue_registry", "tasks", lambda t: B.registered(_queues(t)).crossJoin(B.next_id(_queues(t)).withColumnRenamed("id", "next")), "WITH q AS (SELECT DISTINCT archive AS name, id, CAST(floor(id / 3.0) AS BIGINT) % 9 AS idx FROM {tasks} WHERE size % 4 <> 1) SELECT name, (SELECT min(g) FROM unnest(generate_series(0, 9)) s(g) WHERE NOT EXISTS (SELECT 1 FROM q r WHERE r.name = n.name AND r.idx = g)) AS idx, (SELECT max(id) + 1 FROM q) AS \"next\" FROM (SELECT DISTINCT name FROM q) n")
