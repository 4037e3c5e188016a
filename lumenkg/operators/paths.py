"""Regular paths: sequences, alternatives, repetition and inverses, nested in any way, as an automaton over edges.

A path is built of objects, so there is nothing to parse: (step("p") / inv("q")).star | step("r").opt. It
becomes an automaton without empty moves (Glushkov, 1961): a state for each step that is written, and moves
between steps that may follow each other. Steps are walked in their order, a join each; those that may be
repeated are searched semi-naively, as (node of entry, node, state).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, tidy
from .closure import MERGE


@dataclass(frozen=True)
class Atom:
    """One edge: of one of the predicates, or with negate of any other; inverse against its direction."""

    predicates: tuple[str, ...]
    inverse: bool = False
    negate: bool = False


@dataclass(frozen=True)
class Path:
    """Steps in the order in which they are written; which may come first and last, which may follow which; whether the empty path is one."""

    atoms: tuple[Atom, ...]
    first: frozenset[int]
    last: frozenset[int]
    follow: frozenset[tuple[int, int]]
    empty: bool

    def __truediv__(self, then: Path) -> Path:
        n = len(self.atoms)
        moved = lambda xs: frozenset(x + n for x in xs)
        over = frozenset((a, b + n) for a in self.last for b in then.first)
        return Path(self.atoms + then.atoms, self.first | moved(then.first) if self.empty else self.first, self.last | moved(then.last) if then.empty else moved(then.last), self.follow | over | frozenset((a + n, b + n) for a, b in then.follow), self.empty and then.empty)

    def __or__(self, other: Path) -> Path:
        n = len(self.atoms)
        moved = lambda xs: frozenset(x + n for x in xs)
        return Path(self.atoms + other.atoms, self.first | moved(other.first), self.last | moved(other.last), self.follow | frozenset((a + n, b + n) for a, b in other.follow), self.empty or other.empty)

    @property
    def plus(self) -> Path:
        return Path(self.atoms, self.first, self.last, self.follow | frozenset((a, b) for a in self.last for b in self.first), self.empty)

    @property
    def opt(self) -> Path:
        return Path(self.atoms, self.first, self.last, self.follow, True)

    @property
    def star(self) -> Path:
        return self.plus.opt

    @property
    def inverse(self) -> Path:
        """The same path from its end to its start."""
        turned = tuple(Atom(a.predicates, not a.inverse, a.negate) for a in self.atoms)
        return Path(turned, self.last, self.first, frozenset((b, a) for a, b in self.follow), self.empty)


def _one(atom: Atom) -> Path:
    return Path((atom,), frozenset([0]), frozenset([0]), frozenset(), False)


def step(*predicates: str) -> Path:
    return _one(Atom(predicates))


def inv(*predicates: str) -> Path:
    return _one(Atom(predicates, inverse=True))


def no(*predicates: str, inverse: bool = False) -> Path:
    """A negated set: an edge of any other predicate."""
    return _one(Atom(predicates, inverse, True))


def _stages(path: Path) -> list[tuple[list[int], bool]]:
    """The steps, those that may follow each other in turn together, each after those that lead to it; with whether they may be walked again."""
    ahead = {n: {b for a, b in path.follow if a == n} for n in range(len(path.atoms))}
    for via in ahead:
        for n in ahead:
            if via in ahead[n]:
                ahead[n] |= ahead[via]
    together = {tuple(sorted({n} | {m for m in ahead[n] if n in ahead[m]})) for n in ahead}
    return [(list(ns), ns[0] in ahead[ns[0]]) for ns in sorted(together, key=lambda ns: (sum(ns[0] in ahead[m] for m in ahead if m not in ns), ns))]


def _inside(doors: DataFrame, edges: Callable[[int], DataFrame], moves: list[tuple[int, int]]) -> DataFrame:
    """door, entered, node, state: reached from doors (node, state) over one or more of the moves between steps. As many rounds as the longest shortest walk has edges."""
    own = stored(reduce(DataFrame.unionByName, [edges(n).withColumn("state", F.lit(n)) for n in sorted({b for _, b in moves})]).distinct(), "edges")
    to = F.broadcast(doors.sparkSession.createDataFrame(moves, "state int, to int"))  # the steps of the path, squared at most

    def moved(found: DataFrame) -> DataFrame:
        ready = found.join(to, "state").select("door", "entered", "node", F.col("to").alias("state"))
        return ready.join(own, ["state", "node"]).select("door", "entered", F.col("next").alias("node"), "state").distinct()

    new = stored(moved(doors.select(F.col("node").alias("door"), F.col("state").alias("entered"), "node", "state")), "walked")
    known = new
    for n in count(1):
        if new.isEmpty():
            break
        new = stored(moved(new).join(known, ["door", "entered", "node", "state"], "left_anti"), "walked")
        known = known.unionByName(new)
        if n % MERGE == 0:
            known = stored(known, "walked")
    return known


@tidy
def pairs(triples: DataFrame, path: Path, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """src, dst, each pair once, between which the path runs in triples (s, p, o), which are read for each step.

    starts (src) or ends (dst) are where it begins or ends; with ends alone it is searched from there. Without
    either it may begin at any subject or object. The empty path joins each of these to itself; a start that
    is in no triple, too. Steps that are walked once are a join each. What is repeated is searched in rounds
    from the nodes where it is entered, each of them once, whatever the number of starts that come to it.
    """
    if starts is None and ends is not None:
        return pairs(triples, path.inverse, ends.select(F.col("dst").alias("src"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if starts is not None:
        starts = stored(starts.select("src").dropna().distinct(), "starts")

    def edges(n: int) -> DataFrame:
        atom = path.atoms[n]
        own = triples.where(F.col("p").isin(*atom.predicates) != F.lit(atom.negate)) if atom.predicates else triples.where(F.lit(atom.negate))
        a, b = ("o", "s") if atom.inverse else ("s", "o")
        return own.select(F.col(a).alias("node"), F.col(b).alias("next")).dropna()

    walked: dict[int, DataFrame] = {}
    for steps, again in _stages(path):
        came = []
        for n in steps:
            if n in path.first:
                own = edges(n).withColumnsRenamed({"node": "src", "next": "node"})
                came.append((own if starts is None else own.join(starts, "src", "left_semi")).withColumn("state", F.lit(n)))
            for m in sorted(m for m, to in path.follow if to == n and m not in steps):
                came.append(walked[m].join(edges(n), "node").select("src", F.col("next").alias("node"), F.lit(n).alias("state")))
        found = stored(reduce(DataFrame.unionByName, came).distinct(), "walked")
        if again:
            inside = _inside(found.select("node", "state").distinct(), edges, sorted((a, b) for a, b in path.follow if a in steps and b in steps))
            on = found.withColumnsRenamed({"node": "door", "state": "entered"}).join(inside, ["door", "entered"]).select("src", "node", "state")
            found = stored(found.unionByName(on).distinct(), "walked")
        walked |= {n: found.where(F.col("state") == n).select("src", "node") for n in steps}
    ended = [walked[n].withColumnRenamed("node", "dst") for n in sorted(path.last)]
    if path.empty:
        nodes = triples.select(F.explode(F.array("s", "o")).alias("src")).dropna().distinct() if starts is None else starts
        ended.append(nodes.select("src", F.col("src").alias("dst")))
    out = reduce(DataFrame.unionByName, ended)
    if ends is not None:
        out = out.join(ends.select("dst").distinct(), "dst", "left_semi").select("src", "dst")
    return out.distinct()
