"""Centroid clustering of integer vectors by ball trees.

The tasks that read the vectors build a metric tree over each block of them, once: a ball has its radius, the
count of its vectors and their integer sum. In each round the centroids are sent to all trees. Where the
triangle inequality shows that one centroid is the nearest of a whole ball, the ball is assigned by its count
and sum, and its vectors are not looked at; else its two halves are tried, down to leaves, in which distances
are measured exactly. What tasks send is a count and a sum for each centroid; trees are rows of a table, so a
lost executor costs the tasks that it ran. A table has any number of trees, none of more than ``block`` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, stored
from .vectors import distances, floored, totals, whole

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 8192, 32


class Tree:
    """A balanced tree: level l has 2 ** l balls, of which each is a range of the points."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None, depth: int, sums: list[np.ndarray] | None = None, radii: list[np.ndarray] | None = None):
        self.points, self.depth, self.bounds = points, depth, [np.array([0, len(points)])]
        for _ in range(depth):
            last = self.bounds[-1]
            both = np.empty(2 * len(last) - 1, dtype=np.int64)
            both[::2], both[1::2] = last, (last[:-1] + last[1:]) // 2
            self.bounds.append(both)
        self.order, self.sums, self.radii = order, sums, radii

    @staticmethod
    def grown(points: np.ndarray, leaf: int = LEAF) -> Tree:
        depth = max(0, int(np.ceil(np.log2(len(points) / leaf)))) if len(points) else 0
        tree = Tree(points, np.arange(len(points)), depth)
        for level in range(depth):
            for a, mid, b in zip(tree.bounds[level][:-1], tree.bounds[level + 1][1::2], tree.bounds[level][1:], strict=True):
                own = points[tree.order[a:b]].astype(np.float64)
                far = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
                along = own @ (own[np.argmax(((own - far) ** 2).sum(1))] - far)
                tree.order[a:b] = tree.order[a:b][np.argpartition(along, mid - a)]
        tree.points = points[tree.order]
        tree.sums, tree.radii = [], []
        for level in range(depth + 1):
            starts, counts = tree.bounds[level][:-1], np.diff(tree.bounds[level])
            sums = np.add.reduceat(tree.points, starts, axis=0)
            away = tree.points - np.repeat(sums / counts[:, None], counts, axis=0)
            tree.sums.append(sums)
            tree.radii.append(np.sqrt(np.maximum.reduceat((away * away).sum(1), starts)))
        return tree

    def parted(self, centroids: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
        """Balls that have one nearest centroid (level, balls, centroids), and the leaves that are left."""
        whole_balls, open_balls = [], np.array([0])
        for level in range(self.depth + 1):
            sums, counts = self.sums[level][open_balls], np.diff(self.bounds[level])[open_balls]
            apart = (sums / counts[:, None])[:, None, :] - centroids[None, :, :]
            away = np.sqrt((apart * apart).sum(2))
            nearest = away.argmin(1)
            if len(centroids) > 1:
                two = np.partition(away, 1, axis=1)[:, :2]
                radius = self.radii[level][open_balls]
                # any point is nearer than near + radius to the one, and not nearer than second - radius to another; the rest is for rounding
                sure = two[:, 1] - two[:, 0] > 2 * radius + 1e-9 * (two[:, 1] + radius) + 1e-6
            else:
                sure = np.ones(len(open_balls), dtype=bool)
            whole_balls.append((level, open_balls[sure], nearest[sure]))
            open_balls = open_balls[~sure]
            if level < self.depth:
                open_balls = np.stack([2 * open_balls, 2 * open_balls + 1], axis=1).ravel()
        return whole_balls, open_balls

    def rows(self, level: int, balls: np.ndarray) -> np.ndarray:
        """The places of all points of the balls."""
        starts, counts = self.bounds[level][balls], self.bounds[level][balls + 1] - self.bounds[level][balls]
        return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(balls) else np.empty(0, dtype=np.int64)


def _trees(dims: int, scale: int, block: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        ids, held, n = [], [], 0

        def row() -> pa.RecordBatch:
            names, points = pa.concat_arrays(ids), np.concatenate(held)
            tree = Tree.grown(points)
            # numbers as narrow as they may be
            kind = next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= points.min() and points.max() <= np.iinfo(t).max)
            out = [pa.array([x], t) for x, t in ((tree.points.astype(kind).tobytes(), pa.binary()), (np.dtype(kind).itemsize, pa.int32()), (tree.depth, pa.int32()), (np.concatenate(tree.sums).tobytes(), pa.binary()), (np.concatenate(tree.radii).tobytes(), pa.binary()))]
            listed = pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), names.take(pa.array(tree.order)))
            return pa.RecordBatch.from_arrays([listed, *out], names=["ids", "points", "width", "depth", "sums", "radii"])

        for batch in batches:
            kept, points = whole(batch.column(1), dims, scale)
            names = batch.column(0).filter(pa.array(kept))
            for at in range(0, len(points), block):
                take = points[at : at + block]
                if n and n + len(take) > block:
                    yield row()
                    ids, held, n = [], [], 0
                ids.append(names.slice(at, block))
                held.append(take)
                n += len(take)
        if n:
            yield row()

    return run


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, Tree]]:
    for k in range(batch.num_rows):
        ids = batch.column("ids")[k].values
        points, width, depth, sums, radii = (batch.column(c)[k].as_py() for c in ("points", "width", "depth", "sums", "radii"))
        ends = [(1 << level) - 1 for level in range(depth + 2)]
        per_level = lambda flat, ends=ends: [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        yield ids, Tree(np.frombuffer(points, np.dtype(f"i{width}")).reshape(-1, dims).astype(np.int64), None, depth, per_level(np.frombuffer(sums, np.int64).reshape(-1, dims)), per_level(np.frombuffer(radii, np.float64)))


def _summed(centroids: np.ndarray, dims: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        counts, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dims), dtype=np.int64)
        for batch in batches:
            for _, tree in _read(batch, dims):
                balls, leaves = tree.parted(centroids)
                for level, own, nearest in balls:
                    np.add.at(counts, nearest, np.diff(tree.bounds[level])[own])
                    np.add.at(sums, nearest, tree.sums[level][own])
                points = tree.points[tree.rows(tree.depth, leaves)]
                nearest = distances(points, centroids).argmin(1)  # the first of equals
                np.add.at(counts, nearest, 1)
                np.add.at(sums, nearest, points)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, dims: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for ids, tree in _read(batch, dims):
                cluster = np.empty(len(tree.points), dtype=np.int32)
                balls, leaves = tree.parted(centroids)
                for level, own, nearest in balls:
                    cluster[tree.rows(level, own)] = np.repeat(nearest, np.diff(tree.bounds[level])[own])
                rows = tree.rows(tree.depth, leaves)
                cluster[rows] = distances(tree.points[rows], centroids).argmin(1)
                apart = tree.points - centroids[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array((apart * apart).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", dims: int = 64, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that do not have ``dims`` components, all of them finite, are left out. A component x counts as
    floor(scale * x), at most 2 ** 27 either way. The first centroids are the vectors with the smallest SHA-256
    of ``seed:vec_id`` (null: nothing after the colon); of rows with equal vec_id that of the smaller vector
    comes first. Fewer vectors than k make fewer clusters. Rows that repeat each other are vectors of their
    own; ties go to the smaller cluster; an empty table, or one without such vectors, gives no rows; other
    columns are left out.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[vec_id].dataType
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec")).where(F.size("vec") == dims)
    trees = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *[T.StructField(c, t) for c, t in (("points", T.BinaryType()), ("width", T.IntegerType()), ("depth", T.IntegerType()), ("sums", T.BinaryType()), ("radii", T.BinaryType()))]])
    forest = stored(rows.mapInArrow(frugal(_trees(dims, scale, block)), trees), "trees")

    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    start = rows.where(ok).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("name"), "vec").orderBy("name", "vec").limit(k).collect()
    centroids = whole(pa.array([r["vec"] for r in start], pa.list_(pa.float64())), dims, scale)[1].tolist()
    if not centroids:
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", id_type)])).selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    for _ in range(rounds):
        parts = forest.mapInArrow(frugal(_summed(np.array(centroids), dims)), "slot int, n long, total array<long>")
        centroids = floored(centroids, totals(parts, dims))

    out = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    done = stored(forest.mapInArrow(frugal(_assigned(np.array(centroids), dims)), out), "clustered")
    inertias = {r["cluster"]: r["n"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    of = [(c, inertias.get(c, 0), sum(inertias.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    return done.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
