"""Product codes of vectors, with the nearest entries found as in a vector-approximation file.

The coordinates of a codebook's entries are quantised to a few bits, that is to cells. For a part of a vector,
tables say how far each coordinate is from each cell at least and at most; added up by the entries' cells they
are bounds for the distances to all entries. Only entries whose lower bound is not above the least upper bound
are measured, in whole numbers (Weber, Schek and Blott, 1998). Tasks send a count and a sum for each entry.
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
from .vectors import floored, totals, whole

#: Vectors that a task holds bounds of at a time.
CHUNK = 1024
#: Sums by label that are sent to all executors; more of them are joined by a shuffle.
MOST_SENT = 100_000


class Cells:
    """The entries of a codebook by the cells of their coordinates; a coordinate has 2 ** bits cells with about equally many entries."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, (n, dims), cells = entries, entries.shape, 1 << bits
        cell = np.empty((n, dims), dtype=np.int64)
        self.low, self.high = np.zeros((dims, cells)), np.zeros((dims, cells))
        for j in range(dims):
            marks = np.sort(entries[:, j])[np.arange(1, cells) * n // cells]
            cell[:, j] = np.searchsorted(marks, entries[:, j], side="right")
            for c in np.unique(cell[:, j]):
                own = entries[cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = own.min(), own.max()
        self.within = np.zeros((dims * cells, n))  # which cells an entry is in: a product with it adds up its table values
        for j in range(dims):
            self.within[j * cells + cell[:, j], np.arange(n)] = 1

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part (of equals the first), the squared distance, and how many distances were measured."""
        at = parts[:, :, None].astype(np.float64)
        below, above = self.low[None] - at, at - self.high[None]
        least = np.maximum(np.maximum(below, above), 0).reshape(len(parts), -1) ** 2 @ self.within
        most = np.maximum(-below, -above).reshape(len(parts), -1) ** 2 @ self.within
        limit = most.min(1)
        rows, cols = np.nonzero(least <= (limit * (1 + 1e-9) + 1)[:, None])  # the rest is for rounding
        apart = parts[rows] - self.entries[cols]
        found = (apart * apart).sum(1)
        starts = np.searchsorted(rows, np.arange(len(parts)))
        best = np.minimum.reduceat(found, starts)
        hits = np.flatnonzero(found == best[rows])
        return cols[hits[np.searchsorted(rows[hits], np.arange(len(parts)))]], best, len(rows)


def _books(codebooks: list[list[int]], parts: int, bits: int) -> list[Cells]:
    each = len(codebooks) // parts
    return [Cells(np.array(codebooks[p * each : (p + 1) * each], dtype=np.int64), bits) for p in range(parts)]


def _chunks(batch: pa.RecordBatch, dims: int, parts: int) -> Iterator[tuple[slice, np.ndarray]]:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, dims // parts)
    for at in range(0, len(flat), CHUNK):
        yield slice(at, at + CHUNK), flat[at : at + CHUNK]


def _kept(dims: int, scale: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            kept, values = whole(batch.column(2), dims, scale)
            mask = pa.array(kept)
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, dims), pa.int32()), pa.array(values.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), v], names=["vec_id", "label", "v"])

    return run


def _summed(codebooks: list[list[int]], dims: int, parts: int, bits: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        books, width, each = _books(codebooks, parts, bits), dims // parts, len(codebooks) // parts
        counts, sums = np.zeros(parts * each, dtype=np.int64), np.zeros((parts * each, width), dtype=np.int64)
        for batch in batches:
            for _, own in _chunks(batch, dims, parts):
                for p, book in enumerate(books):
                    slot = p * each + book.nearest(own[:, p])[0]
                    np.add.at(counts, slot, 1)
                    np.add.at(sums, slot, own[:, p])
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["slot", "n", "total"])

    return run


def _coded(codebooks: list[list[int]], dims: int, parts: int, bits: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        books = _books(codebooks, parts, bits)
        for batch in batches:
            for rows, own in _chunks(batch, dims, parts):
                found = [book.nearest(own[:, p]) for p, book in enumerate(books)]
                text = np.stack([x[0] for x in found], axis=1).astype(np.uint8).tobytes().hex()
                code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
                ids, labels = (batch.column(c).slice(rows.start, len(own)) for c in range(2))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(sum(x[1] for x in found))], names=["vec_id", "label", "code", "error"])

    return run


def coded(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, bits: int = 3, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[list[int]]]:
    """Per vector vec_id, label, code, error, as a table in the shared folder; and the codebooks, part by part, with ``entries`` (256 at most) entries each.

    See codes() for what is left out and how ties and repeated rows are taken.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("vec"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(ok & (F.size("vec") > 0) & (F.size("vec") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "vec")
    head = good.limit(1).collect()
    empty = vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("label", vectors.schema[label].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    if not head:
        return empty, []
    dims = len(head[0]["vec"])
    width = dims // parts
    first = good.where(F.size("vec") == dims).limit(entries).collect()
    start = whole(pa.array([r["vec"] for r in first], pa.list_(pa.float64())), dims, scale)[1].reshape(-1, parts, width)
    codebooks = [e for p in range(parts) for e in start[:, p].tolist()]

    kinds = T.StructType([*empty.schema.fields[:2], T.StructField("v", T.ArrayType(T.IntegerType()))])
    numbers = stored(rows.where(F.size("vec") == dims).mapInArrow(frugal(_kept(dims, scale)), kinds), "numbers")
    for _ in range(rounds):
        part = numbers.mapInArrow(frugal(_summed(codebooks, dims, parts, bits)), "slot int, n long, total array<long>")
        codebooks = floored(codebooks, totals(part, width))
    return stored(numbers.mapInArrow(frugal(_coded(codebooks, dims, parts, bits)), empty.schema), "codes"), codebooks


def codes(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, code (two hex digits for each part), error (squared distances to the entries), label_error (error of all vectors with the label), codebooks_sha256.

    Options are those of coded(). A vector that is null or holds a null or non-finite component is left out;
    so is one whose length is not that of the vector with the smallest vec_id whose length the parts divide. A
    component x counts as floor(scale * x), at most 2 ** 27 either way. Codebooks start as the vectors with the
    smallest vec_ids (null last; of equal ones the smaller vector first); fewer vectors make fewer entries. Rows
    that repeat each other are vectors of their own; ties go to the first entry; null labels are one label;
    an empty table gives no rows; other columns are left out.
    """
    done, codebooks = coded(vectors, **options)
    sums = stored(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= MOST_SENT:
        sums = F.broadcast(sums)
    sha = hashlib.sha256(",".join(str(x) for e in codebooks for x in e).encode()).hexdigest()
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
