"""What is around a row: ranges that open and close like brackets, in one pass over the sorted rows of documents.

Rows are dealt by document and sorted by Spark; a task reads them as batches and keeps only the ranges that are
open at a row. The other columns pass through as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names of the columns that only the pass reads.
GIVEN, NAME = "__given", "__name"
#: What paths add: the identifier, its container's, the depth of containers, and of imports their place and whether that extends what they name.
PATHS = "id string, place string, level int, content string, extending boolean"


def sorted_rows(own: DataFrame) -> DataFrame:
    """own dealt by doc and sorted by place: the window asks for both, and costs no shuffle where rows are dealt so already."""
    by = [c for c in ("start", "nth", "turn") if c in own.columns]
    return own.withColumn("__n", F.row_number().over(Window.partitionBy("doc").orderBy(*by)))


class Around:
    """The innermost ranges of several kinds around the rows of a document, row by row in their order; only what is open is kept. See around()."""

    def __init__(self, kinds: list[frozenset[str]], traced: int | None = None) -> None:
        self.kinds, self.traced, self.doc, self.stacks = kinds, traced, None, [[] for _ in kinds]

    def __call__(self, d, nth: int, kind: str, start: int, stop: int | None) -> list:
        """nth of the innermost range for each of the kinds; with traced, the trail of this one last."""
        if d != self.doc:
            self.doc, self.stacks = d, [[] for _ in self.kinds]
        out, trail = [], None
        for turn, (stack, of) in enumerate(zip(self.stacks, self.kinds)):
            while stack and stack[-1][0] <= start:
                stack.pop()
            same = bool(stack) and stack[-1][1] == nth
            if turn == self.traced:
                trail = [s[1] for s in stack[: len(stack) - same]]
            out.append((stack[-2][1] if len(stack) > 1 else None) if same else stack[-1][1] if stack else None)
            if stop is not None and not same and kind in of:
                stack.append((stop, nth))
        return out if self.traced is None else [*out, trail]


def around(own: DataFrame, wanted: dict[str, tuple[str, ...]], trail: str | None = None) -> DataFrame:
    """own (doc, nth, kind, start, stop) with a column for each name of wanted: nth of the innermost range of its kinds that holds the row's and is not its own. trail: one of the names, for which ``trail`` holds all these ranges from the outermost in."""
    out = ", ".join([*(f"{name} int" for name in wanted), *(["trail array<int>"] if trail else [])])
    traced = list(wanted).index(trail) if trail else None
    kinds = [frozenset(k) for k in wanted.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Around(kinds, traced)
        for batch in batches:
            found = [look(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "nth", "kind", "start", "stop")))]
            arrays = [pa.array([f[n] for f in found], pa.int32()) for n in range(len(kinds))]
            more = [pa.array([f[-1] for f in found], pa.list_(pa.int32()))] if trail else []
            yield _with(batch, ["__n"], [*arrays, *more], [*wanted, *(["trail"] if trail else [])])

    return _run(own, run, out)


class Places:
    """Where the rows of a document are, row by row in their order; only what is open is kept. See placed()."""

    def __init__(self, containers: tuple[str, ...], content: tuple[str, ...], extension: str) -> None:
        self.holds, self.inner, self.extension = frozenset(containers), frozenset(content), extension
        self.doc, self.stack, self.modules, self.counts = None, [], [], {}

    def __call__(self, d, nth: int, kind: str, start: int, stop: int | None, given: str | None, name: str | None) -> tuple:
        """parent, and the values of PATHS."""
        if d != self.doc:
            self.doc, self.stack, self.modules, self.counts = d, [], [], {}
        stack, modules = self.stack, self.modules
        while stack and stack[-1][0] <= start:
            stack.pop()
        while modules and modules[-1][0] <= start:
            modules.pop()
        same = bool(stack) and stack[-1][1] == nth
        top = (stack[-2] if len(stack) > 1 else None) if same else stack[-1] if stack else None
        place, level = (top[2], top[3] + 1) if top else (None, 0)
        ident = around_ = None
        if kind in self.holds:
            ident = given
            if ident is None:
                n = self.counts.get(kind, 0)
                self.counts[kind] = n + 1
                ident = f"{kind}_{n}" if n else kind
            uri = f"{place}/{ident}" if place else f"{d}&e={ident}"
            if stop is not None and not same:
                stack.append((stop, nth, uri, level))
        elif kind == "import":
            mine = [m for m in modules[-2:] if m[1] != nth]
            around_ = mine[-1] if mine else None
        if kind in self.inner and stop is not None and not (modules and modules[-1][1] == nth):
            modules.append((stop, nth, uri, kind == "structure" and name is not None and name.replace("?", "/").rsplit("/", 1)[-1].startswith(self.extension)))
        return top[1] if top else None, ident, place, level, around_[2] if around_ else None, around_[3] if around_ else None


def placed(own: DataFrame, containers: tuple[str, ...], content: tuple[str, ...], extension: str, dealt: bool = False) -> DataFrame:
    """own (doc, nth, turn, kind, start, stop, and GIVEN and NAME for the pass alone) with parent (nth of the container around it) and PATHS.

    A container's id is the given one, else its kind, with _1, _2, ... for those after the first of a document. dealt: documents lie whole and sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Places(containers, content, extension)
        for batch in batches:
            found = list(map(place, *(batch.column(c).to_pylist() for c in ("doc", "nth", "kind", "start", "stop", GIVEN, NAME))))
            types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield _with(batch, ["__n", GIVEN, NAME], [pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types], ["parent", "id", "place", "level", "content", "extending"])

    return _run(own, run, f"parent int, {PATHS}", (GIVEN, NAME), dealt)


def _with(batch: pa.RecordBatch, gone: list[str], arrays: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in gone]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *names])


def _run(own: DataFrame, run, more: str, gone: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    schema = StructType([*own.drop(*gone).schema.fields, *StructType.fromDDL(more).fields])
    return (own if dealt else sorted_rows(own)).mapInArrow(run, schema)
