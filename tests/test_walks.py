"""Regular paths against a plain walk of an expression, and cycles against a plain search."""

from __future__ import annotations

import random

import pytest

from lumenkg.operators import cycles as C
from lumenkg.operators.closure import closure, doubled
from lumenkg.operators.paths import inv, no, pairs, step


def edges_of(seed: int, n: int, m: int) -> list[tuple[str, str, str]]:
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", rng.choice("pqr"), f"n{rng.randrange(n)}") for _ in range(m)]


def relation(triples, p, backwards=False, other=False):
    return {((o, s) if backwards else (s, o)) for s, x, o in triples if (x != p if other else x == p)}


def after(a, b):
    return {(x, z) for x, y in a for w, z in b if y == w}


def many(a):
    out = set(a)
    while (more := out | after(out, a)) != out:
        out = more
    return out


CASES = {
    "star of a sequence, or an option": ((step("p") / inv("q")).star | step("r").opt, lambda t, i: many(after(relation(t, "p"), relation(t, "q", True))) | i | relation(t, "r")),
    "sequence": (step("p") / step("q") / step("r"), lambda t, i: after(after(relation(t, "p"), relation(t, "q")), relation(t, "r"))),
    "nested": (((step("p") | inv("r")).plus / step("q")).plus, lambda t, i: many(after(many(relation(t, "p") | relation(t, "r", True)), relation(t, "q")))),
    "negated": (no("p") / no("q", inverse=True), lambda t, i: after(relation(t, "p", other=True), relation(t, "q", True, True))),
    "empty parts": (step("p").opt / step("q").star / step("r").opt, lambda t, i: after(after(relation(t, "p") | i, many(relation(t, "q")) | i), relation(t, "r") | i)),
}


@pytest.mark.parametrize("name", CASES)
def test_paths(spark, name):
    path, plain = CASES[name]
    triples = edges_of(1, 9, 18)
    df = spark.createDataFrame([*triples, triples[0], (None, "p", "n1"), ("n1", "p", None)], "s string, p string, o string")
    nodes = {x for s, _, o in triples for x in (s, o)} | {"n1"}
    want = plain(triples, {(x, x) for x in nodes})
    if name != "nested":
        assert sorted(map(tuple, pairs(df, path).collect())) == sorted(want)
    if name in ("nested", "empty parts"):
        some = spark.createDataFrame([("n1",), ("n2",), ("n1",)], "src string")
        assert sorted(map(tuple, pairs(df, path, starts=some).collect())) == sorted((a, b) for a, b in want | ({("n1", "n1"), ("n2", "n2")} if path.empty else set()) if a in ("n1", "n2"))
        to = spark.createDataFrame([("n3",)], "dst string")
        assert sorted(map(tuple, pairs(df, path, ends=to).collect())) == sorted((a, b) for a, b in want | ({("n3", "n3")} if path.empty else set()) if b == "n3")


def test_no_triples(spark):
    assert pairs(spark.createDataFrame([], "s string, p string, o string"), step("p").star).count() == 0


def test_repetition_is_searched_once_for_all_starts(spark, monkeypatch):
    """Many starts that enter a chain at one node: what is stored in rounds is the chain, not the chain for each start."""
    from lumenkg.operators import paths

    rows, real = [], paths.stored

    def counted(df, name):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(paths, "stored", counted)
    n = 60
    triples = [(f"a{k}", "p", "c0") for k in range(n)] + [(f"c{k}", "q", f"c{k + 1}") for k in range(12)]
    found = pairs(spark.createDataFrame(triples, "s string, p string, o string"), step("p") / step("q").star)
    assert found.count() == n * 13
    # first arrivals, the chain and where it was entered, and the result: not each round for each start
    assert len([r for r in rows if r >= n]) == 3


def test_doubling_is_the_closure(spark):
    edges = spark.createDataFrame([(f"{seed}{a}", f"{seed}{b}") for seed in range(4) for a, _, b in edges_of(seed, 30, 32)] + [("x0", "x1"), (None, "x1")] + [(f"x{k}", f"x{k + 1}") for k in range(20)], "src string, dst string")
    assert sorted(doubled(edges).collect()) == sorted(closure(edges).collect())
    assert doubled(edges.limit(0)).count() == 0


def plain_components(edges):
    reach = many(set(edges))
    return {a: min(b for x, b in reach if x == a and (b, a) in reach) for a, _ in edges if (a, a) in reach}


GRAPHS = {
    "chain": [(1, 2), (2, 3), (3, 4)], "loop": [(5, 5), (5, 6)], "one": [(1, 2), (2, 3), (3, 1), (0, 1), (3, 9)],
    "two that touch": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "two that share a node": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)],
    "nested": [(1, 2), (2, 3), (3, 4), (4, 1), (2, 4), (3, 2)], "long": [(k, (k + 1) % 40) for k in range(40)] + [(40, 0), (39, 41)],
    "none": [], **{f"random {s}": [(int(a[1:]), int(b[1:])) for a, _, b in edges_of(s, 25, 40)] for s in range(5)},
}


def test_cycles(spark):
    """All graphs beside each other, each with numbers of its own."""
    edges = [(1000 * n + a, 1000 * n + b) for n, graph in enumerate(GRAPHS.values()) for a, b in graph]
    df = spark.createDataFrame([*edges, *edges[:2], (None, 1)], "src long, dst long")
    want = {}
    for n in range(len(GRAPHS)):
        want |= plain_components([e for e in edges if e[0] // 1000 == n])
    found = C.components(df)
    assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)
    rows = C.cycles(df, found).collect()
    assert sorted(r.component for r in rows) == sorted(set(want.values()))
    for r in rows:
        path = [int(x) for x in r.path]
        assert len(path) == r.length == len(set(path)) and path[0] == r.component
        assert all(step in edges for step in zip(path, path[1:] + path[:1], strict=True))
        level, n = {b for a, b in edges if a == r.component and want.get(b) == r.component}, 1
        while r.component not in level:
            level, n = {b for a, b in edges if a in level}, n + 1
        assert n == r.length
    assert C.components(df.limit(0)).count() == 0 and C.cycles(df.where("src = 1 and dst = 2")).count() == 0
