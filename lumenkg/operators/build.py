"""Builds: what is to be done, in which order, and how far it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import levels
from .states import NEW, STALE, ancestors

# The targets of each format in their order.
TARGETS = {"tex": ("first", "second", "html", "extract", "check"), "html": ("import", "extract", "check")}


def targets(spark) -> DataFrame:
    return spark.createDataFrame([(f, n, t) for f, ts in TARGETS.items() for n, t in enumerate(ts)], "format string, ord int, target string")


def enqueue(file_targets: DataFrame, wanted: list[str], stale_only: bool = True, scope: Column | None = None) -> DataFrame:
    """Files (archive, rel_path) of the scope with a wanted target to build, and these targets as steps, in order; all states start anew."""
    own = file_targets.where(F.col("target").isin(wanted))
    if scope is not None:
        own = own.where(scope)
    if stale_only:
        own = own.where(F.col("state").isin(NEW, STALE))
    return own.groupBy("archive", "rel_path").agg(F.concat_ws(",", F.array_sort(F.collect_set("target"))).alias("steps"), F.count("*").alias("n_steps"))


def in_scope(archive: str | None = None, group: str | None = None, folder: str | None = None) -> Column:
    out = F.lit(True)
    if archive is not None:
        out &= F.col("archive") == archive
    if group is not None:
        out &= (F.col("archive") == group) | F.col("archive").startswith(f"{group}/")
    if folder is not None:
        out &= (F.col("rel_path") == folder) | F.col("rel_path").startswith(f"{folder}/")
    return out


def resolved(deps: DataFrame, tasks: DataFrame) -> DataFrame:
    """deps (task, archive, rel_path, strict) with the task they mean (dep), null if there is none; dependencies on itself go."""
    return deps.join(tasks.select(F.col("id").alias("dep"), "archive", "rel_path"), ["archive", "rel_path"], "left").where(~F.col("task").eqNullSafe(F.col("dep"))).select("task", "dep", "strict")


def order(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """tasks (id, state) with level and placed: queued or blocked.

    A finished dependency counts no more. When only cycles are left, weak dependencies are dropped; what
    still waits then is blocked and has no level.
    """
    open_ = tasks.where("state = 'queued'").select("id")
    live = deps.join(open_.select(F.col("id").alias("dep")), "dep").join(open_.select(F.col("id").alias("task")), "task").select("task", "dep", "strict")
    first = levels(open_, live)
    stuck = first.where("level is null").select("id")
    strict = live.where("strict").join(stuck.select(F.col("id").alias("task")), "task").join(stuck.select(F.col("id").alias("dep")), "dep")
    second = levels(stuck, strict).withColumnRenamed("level", "late")
    top = first.agg(F.coalesce(F.max("level"), F.lit(-1)).alias("top"))
    out = first.join(second, "id", "left").crossJoin(F.broadcast(top))  # one row
    return out.select("id", F.coalesce("level", F.col("top") + 1 + F.col("late")).alias("level"), F.when(F.coalesce("level", "late").isNull(), "blocked").otherwise("queued").alias("placed"))


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Queued tasks with no strict dependency that is queued or running."""
    busy = tasks.where(F.col("state").isin("queued", "running")).select(F.col("id").alias("dep"))
    waits = deps.where("strict and task != dep").join(busy, "dep", "left_semi").select(F.col("task").alias("id")).distinct()
    return tasks.where("state = 'queued'").join(waits, "id", "left_anti")


def after_events(steps: DataFrame, events: DataFrame) -> DataFrame:
    """steps (task, ord, target) with the state after events (task, ord, ok): done; failed, and failed behind a failed one; queued is the first step that is left, later ones are blocked."""
    own = steps.join(events.select("task", "ord", "ok"), ["task", "ord"], "left")
    before = Window.partitionBy("task").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.coalesce(F.max((~F.col("ok")).cast("int")).over(before), F.lit(0)) == 1
    open_ = F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).over(before)
    state = F.when(failed, "failed").when(F.col("ok"), "done").when(open_ == 1, "queued").otherwise("blocked")
    return own.withColumn("state", state).drop("ok")


def requeued(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("state", F.when(F.col("state") == "failed", "queued").otherwise(F.col("state")))


def snapshot(tasks: DataFrame, *keys: str) -> DataFrame:
    return tasks.groupBy(*keys, "state").agg(F.count("*").alias("n"))


def eta(done: DataFrame, total: int, queue: str = "queue", ts: str = "ts") -> DataFrame:
    """After each finished step: how many are done, seconds so far, and seconds left at that rate."""
    own = Window.partitionBy(queue).orderBy(ts, "id")
    n = F.row_number().over(own)
    seconds = F.unix_timestamp(F.col(ts)) - F.unix_timestamp(F.first(ts).over(own))
    return done.select(queue, "id", n.alias("done"), seconds.alias("elapsed"), F.when(n > 1, seconds / (n - 1) * (total - n)).alias("left"))


def registered(queues: DataFrame) -> DataFrame:
    """name and idx, the first free number, from 0, that a new queue of the name would get. queues: name, idx.

    The k-th of the numbers in use is k as long as none is free before it.
    """
    nth = F.row_number().over(Window.partitionBy("name").orderBy("idx")) - 1
    used = queues.select("name", "idx").distinct().withColumn("nth", nth)
    gap = F.min(F.when(F.col("idx") != F.col("nth"), F.col("nth")))
    return used.groupBy("name").agg(F.coalesce(gap, F.count("*").cast("int")).cast("long").alias("idx"))


def next_id(queues: DataFrame) -> DataFrame:
    """The number that a new queue gets among all: id."""
    return queues.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id"))


def source_deps(sources: DataFrame, text: str = "text") -> DataFrame:
    """file, kind, archive (null: its own), path, strict, of the commands of a source that name other sources.

    Imports and uses are weak in the first pass and strict in the check, inputs are weak only; comments do not count.
    """
    plain = F.regexp_replace(F.col(text), r"(?m)(?<!\\)%.*$", "")
    command = r"\\(importmodule|usemodule|setmetatheory|inputref|mhinput|includeproblem)\*?(?:\[([^\]]*)\])?\{([^}]*)\}"
    found = F.arrays_zip(*[F.regexp_extract_all(plain, F.lit(command), F.lit(n)).alias(name) for n, name in enumerate(("macro", "option", "arg"), 1)])
    own = sources.select("file", F.explode(found).alias("f")).select("file", "f.*")
    imports = F.col("macro").isin("importmodule", "usemodule", "setmetatheory")
    own = own.select("file", F.when(imports, "import").otherwise("input").alias("kind"), F.nullif(F.trim("option"), F.lit("")).alias("archive"), F.substring_index(F.trim("arg"), "?", 1).alias("path"))
    weak = own.withColumn("strict", F.lit(False))
    return weak.unionByName(own.where("kind = 'import'").withColumn("strict", F.lit(True))).distinct()


def overlaid(layers: list[DataFrame], *keys: str) -> DataFrame:
    """Rows of the first layer that has the key; later layers are shadowed."""
    rows = None
    for n, layer in enumerate(layers):
        own = layer.withColumn("layer", F.lit(n))
        rows = own if rows is None else rows.unionByName(own)
    first = F.min("layer").over(Window.partitionBy(*keys))
    return rows.withColumn("first", first).where("layer = first").drop("first")


def required(archives: DataFrame, wanted: DataFrame, meta: str = "meta-inf") -> DataFrame:
    """The wanted archives and the archives for meta data of the groups above them."""
    groups = wanted.select(F.explode(ancestors(F.col("id"))).alias("g")).where("g != ''").distinct()
    metas = groups.select(F.concat("g", F.lit(f"/{meta}")).alias("id"))
    return archives.join(wanted.select("id").unionByName(metas).distinct(), "id", "left_semi")
