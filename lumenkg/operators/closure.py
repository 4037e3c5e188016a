"""Reachability with set semantics: cycles are safe, and every pair comes once."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, tidy

#: Rounds after which what they have found is written as one table.
MERGE = 16


@tidy
def closure(edges: DataFrame, seeds: DataFrame | None = None, include_start: bool = False, most_rounds: int | None = None) -> DataFrame:
    """Pairs (src, dst) where dst is reached from src over one or more edges (src, dst); with include_start also over none.

    seeds (src): where to start; all sources if None. Each round joins what is new with the edges and
    takes out what is known, so it is as many joins as the longest shortest path has edges; what is known
    is written as one table now and then. Null ends of edges are left out. With most_rounds, an error is
    raised where they do not do.
    """
    edges = stored(edges.select("src", "dst").dropna().distinct(), "edges")
    step = edges.select(F.col("src").alias("via"), F.col("dst").alias("next"))
    starts = (edges.select("src") if seeds is None else seeds.select("src").dropna()).distinct()
    new = stored(starts.join(edges, "src"), "reached")
    known = new
    for n in count(1):
        if new.isEmpty():
            break
        if most_rounds is not None and n > most_rounds:
            raise ValueError(f"not finished after {most_rounds} rounds")
        reached = new.join(step, new["dst"] == step["via"]).select("src", F.col("next").alias("dst")).distinct()
        new = stored(reached.join(known, ["src", "dst"], "left_anti"), "reached")
        known = known.unionByName(new)
        if n % MERGE == 0:
            known = stored(known, "reached")
    if include_start:
        known = known.unionByName(starts.select("src", F.col("src").alias("dst"))).distinct()
    return known


@tidy
def doubled(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst) where dst is reached from src over one or more edges: as closure() from all sources, in log2 of the longest shortest path rounds.

    Each round puts the pairs that are exactly 2 ** n edges apart behind all pairs that are known, which makes
    no pair twice where paths are single, as in trees. Made for hierarchies; cycles end, as the pairs are a set.
    """
    near = stored(edges.select("src", "dst").dropna().distinct(), "near")
    apart, size = near, near.count()
    while size:
        far = apart.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        both = stored(near.unionByName(near.join(far, "dst").select("src", F.col("far").alias("dst"))).distinct(), "near")
        grown = both.count()
        near = both
        if grown == size:
            break
        size = grown
        apart = stored(apart.join(far, "dst").select("src", F.col("far").alias("dst")).distinct(), "apart")
    return near


@tidy
def levels(tasks: DataFrame, deps: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """tasks (id) with level: 0 for those without open dependencies, else one more than the highest of their dependencies; null on or behind a cycle.

    deps: (task, dep). A dependency that is no task is open for good; one on itself does not count. There
    are as many rounds as levels; with most_rounds, an error is raised where they do not do.
    """
    deps = stored(deps.where("task != dep").select("task", "dep").distinct(), "deps")
    left = stored(tasks.select("id").distinct(), "tasks")
    done, at = None, 0
    for at in count():
        blocked = deps.select(F.col("task").alias("id")).distinct()
        ready = stored(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(at)), "ready")
        if ready.isEmpty():
            break
        if most_rounds is not None and at >= most_rounds:
            raise ValueError(f"not finished after {most_rounds} rounds")
        done = ready if done is None else done.unionByName(ready)
        if (at + 1) % MERGE == 0:
            done = stored(done, "ready")
        left = stored(left.join(ready, "id", "left_anti"), "tasks")
        deps = stored(deps.join(ready.select(F.col("id").alias("dep")), "dep", "left_anti"), "deps")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


@tidy
def rooted_paths(nodes: DataFrame, most_depth: int = 1 << 20) -> DataFrame:
    """nodes (doc, node, parent, part) with path: the parts from the root of the tree down.

    Each round doubles the steps that a node has looked up, so a tree of depth d takes log2(d) + 1 joins.
    Nodes under a parent that does not exist are left out; deeper trees than most_depth, and cycles, are
    an error.
    """
    own = stored(nodes.select("doc", "node", F.col("parent").alias("up"), F.array("part").alias("path")), "paths")
    reach = 1
    while not own.where("up is not null").isEmpty():
        if reach > most_depth:
            raise ValueError(f"a tree is deeper than {most_depth}, or no tree")
        above = own.select("doc", F.col("node").alias("up"), F.col("up").alias("next_"), F.col("path").alias("path_"))
        path = F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("path_", "path"))
        own = stored(own.join(above, ["doc", "up"], "left").select("doc", "node", F.col("next_").alias("up"), path.alias("path")), "paths")
        reach *= 2
    return own.where("path is not null").select("doc", "node", "path")
