"""Cycles of a graph: its strongly connected components, and one cycle of each with its path.

Components are found by colouring (Orzan, 2004): nodes that cannot be on a cycle are trimmed; the largest node
that reaches a node is its colour; what reaches back to a colour's own node, within the colour, is a component.
Components are taken out, and the rest is coloured anew. All steps are joins on nodes; no component is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored, tidy

#: Edges that one job follows.
HOPS = 8


def _within(edges: DataFrame, nodes: DataFrame, same: bool = False) -> DataFrame:
    """The edges between the nodes (node, group); with same only those within one group."""
    a = nodes.select(F.col("node").alias("src"), F.col("group").alias("a"))
    b = nodes.select(F.col("node").alias("dst"), F.col("group").alias("b"))
    both = edges.join(a, "src").join(b, "dst")
    return (both.where("a = b") if same else both).select("src", "dst")


def _hops(rows: DataFrame, step: DataFrame, *combine: Column) -> DataFrame:
    """rows moved along step (src, dst) HOPS times, in one job; of what meets at a node, ``combine`` stays."""
    for _ in range(HOPS):
        moved = rows.join(step, rows["node"] == step["src"]).drop("node", "src").withColumnRenamed("dst", "node")
        rows = moved.groupBy("node").agg(*combine) if combine else moved.distinct()
    return rows


def _staying(edges: DataFrame) -> DataFrame:
    """The edges, and one from each node to itself, so that what has come to a node stays there."""
    return stored(edges.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("src")).withColumn("dst", F.col("src"))).distinct(), "staying")


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges of nodes that no walk of HOPS edges ends at, or begins at, again and again."""
    size = None
    while (left := edges.count()) != size and left:
        size = left
        nodes = edges.select(F.col("src").alias("node")).distinct()
        from_, to = (_hops(nodes, e) for e in (edges, _turned(edges)))
        alive = stored(from_.join(to, "node", "left_semi"), "alive")
        edges = stored(edges.join(alive.withColumnRenamed("node", "src"), "src", "left_semi").join(alive.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "trimmed")
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node, group: the largest node from which the node is reached, itself included."""
    step = _staying(edges)
    colours = stored(step.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("group")), "coloured")
    while True:
        more = stored(_hops(colours, step, F.max("group").alias("group")), "coloured")
        if more.join(colours, ["node", "group"], "left_anti").isEmpty():
            return more
        colours = more


def _back(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, group: nodes from which the node that names their colour is reached within the colour."""
    step = _staying(_turned(_within(edges, colours, same=True)))
    found, size = stored(colours.where("node = group"), "back"), 0
    while (left := found.count()) != size:
        size = left
        own = found.join(step.select("src"), found["node"] == step["src"], "left_anti")  # on no edge
        found = stored(_hops(found, step, F.max("group").alias("group")).unionByName(own), "back")
    return found


@tidy
def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes that are on a cycle; edges: src, dst. An edge of a node to itself is a cycle."""
    left = stored(edges.select("src", "dst").dropna().distinct(), "left")
    loops = left.where("src = dst").select(F.col("src").alias("node"))
    done = None
    while not (left := _trimmed(left)).isEmpty():
        colours = _coloured(left)
        found = stored(_back(left, colours), "components")
        real = found.groupBy("group").count().where("count > 1").select("group")
        own = found.join(real, "group", "left_semi").unionByName(found.join(real, "group", "left_anti").join(loops, "node", "left_semi").select("group", "node"), allowMissingColumns=True).select("node", "group")
        done = own if done is None else done.unionByName(own)
        gone = found.select("node")
        left = stored(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "left")
    if done is None:
        return loops.select("node", F.col("node").alias("component")).limit(0)
    names = done.groupBy("group").agg(F.min("node").alias("component"))
    return done.join(names, "group").select("node", "component")


@tidy
def cycles(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """component, length, path: a shortest cycle through the smallest node of each component, from that node on; of equally short ones each node is the smallest that leads on, from the end.

    found: components() of the edges, if they are known. The search goes on from all smallest nodes at once,
    within their components; then each node has the smallest before it, and the cycle is followed backwards. A
    path is an array of ``length`` nodes.
    """
    known = components(edges) if found is None else found
    names = known.select(F.col("node").alias("src"), "component")
    own = stored(_within(edges.dropna().distinct(), known.withColumnRenamed("component", "group"), same=True).join(names, "src"), "own")
    step = stored(own.select("src", "dst", F.lit(1).alias("more")).unionByName(own.select("src", F.col("src").alias("dst"), F.lit(0).alias("more")).distinct()), "steps")
    seen, size = stored(own.where("src = component").select(F.col("dst").alias("node"), F.lit(1).alias("level")), "levels"), None
    while (now := seen.agg(F.count("*"), F.sum("level")).first()) != size:
        size = now
        for _ in range(HOPS):
            seen = seen.join(step, seen["node"] == step["src"]).select(F.col("dst").alias("node"), (F.col("level") + F.col("more")).alias("level")).groupBy("node").agg(F.min("level").alias("level"))
        seen = stored(seen, "levels")
    before = own.join(seen.select(F.col("node").alias("src"), F.col("level").alias("of")), "src").join(seen.withColumnRenamed("node", "dst"), "dst").where("of = level - 1")
    before = stored(before.groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("src")), "before")
    walk = stored(seen.join(known.select("component").distinct(), F.col("node") == F.col("component")).select("component", F.col("level").alias("length"), "node", F.array().cast("array<string>").alias("path")), "walk")
    while not walk.where("size(path) < length - 1").isEmpty():
        for _ in range(HOPS):
            walk = walk.join(before, F.col("node") == F.col("at"), "left").select("component", "length", F.coalesce("src", "node").alias("node"), F.when(F.col("src").isNull(), F.col("path")).otherwise(F.concat(F.array(F.col("src").cast("string")), "path")).alias("path"))
        walk = stored(walk, "walk")
    return walk.select("component", "length", F.concat(F.array(F.col("component").cast("string")), "path").alias("path"))
