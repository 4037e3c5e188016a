"""Vectors as whole numbers, and sums of them that tasks make and Spark adds up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this are taken as this: the squared distance of two vectors of 64 of them still fits a long.
MOST = 1 << 27
#: Up to this, sums of products of 64 components are exact as doubles.
EXACT = 1 << 22


def whole(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold ``dims`` finite components and nothing else, and floor(scale * x) of those rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sized = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False), dtype=bool)
    values = pc.cast(column.filter(pa.array(sized)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    kept = sized.copy()
    kept[sized] = finite
    with np.errstate(over="ignore"):
        return kept, np.clip(np.floor(values[finite] * scale), -MOST, MOST).astype(np.int64)


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all of ``to``, exact."""
    if max(np.abs(points).max(initial=0), np.abs(to).max(initial=0)) <= EXACT:
        a, b = points.astype(np.float64), to.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((points - t) ** 2).sum(1) for t in to], axis=1)


def totals(parts: DataFrame, dims: int, *more: Column) -> DataFrame:
    """Rows (slot, n, total) of tasks added up by slot: each task sends a row for each slot at most."""
    return parts.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(dims)]).alias("total"), *more)


def floored(before: list[list[int]], sums: DataFrame) -> list[list[int]]:
    """The entries after a round: floor(sum / count) of those that sums (slot, n, total) has, the others as before. sums has as many rows as there are entries, at most."""
    out = [list(e) for e in before]
    for row in sums.collect():
        out[row["slot"]] = [t // row["n"] for t in row["total"]]
    return out
