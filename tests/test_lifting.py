"""What is found below documents goes up to them, over any graph, without all pairs of documents."""

from __future__ import annotations

import random

import pytest

from lumenkg.operators import graph

UP = ("contains", "hasPart")


def graph_of(seed: int, n: int, m: int, one_above: bool) -> list[tuple[str, str, str]]:
    """Nodes of which some are documents; with one_above each has one holder at most, and cycles may still be."""
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(n)]
    held = rng.sample(nodes, min(n, m)) if one_above else [rng.choice(nodes) for _ in range(m)]
    out = [(rng.choice(nodes), rng.choice(UP), x) for x in held]
    out += [(x, "type", "document") for x in nodes if rng.random() < 0.6]
    out += [(rng.choice(nodes), rng.choice(("crossrefs", "defines")), f"s{rng.randrange(6)}") for _ in range(n)]
    out += [(f"arch/{rng.randrange(4)}", "contains", x) for x in nodes if rng.random() < 0.5]
    return out + [(rng.choice(nodes), rng.choice(("requires", "imports")), rng.choice(nodes)) for _ in range(n // 2)]


def below(triples, up):
    """doc, node: reached over any nodes, each document from itself."""
    out = {(s, s) for s, p, o in triples if p == "type" and o == "document"}
    while more := {(d, o) for d, x in out for s, p, o in triples if p in up and s == x} - out:
        out |= more
    return out


GRAPHS = [graph_of(1, 30, 25, True), graph_of(2, 30, 30, True), graph_of(3, 25, 40, False), graph_of(4, 40, 38, False)]


@pytest.mark.parametrize("triples", GRAPHS, ids=["one above", "one above, cycles", "many above", "sparse"])
def test_any_graph(spark, triples):
    q = spark.createDataFrame([("g", *t) for t in triples] + [("h", *triples[0]), ("h", None, "contains", "n1"), ("h", "n1", "crossrefs", None)], "g string, s string, p string, o string")
    want = {(d, o) for d, x in below(triples, UP) for s, p, o in triples if p == "crossrefs" and s == x}
    got = [tuple(r) for r in graph.symbols_of(q, "crossrefs").collect() if r.symbol is not None]
    assert sorted(got) == sorted(want)
    docs = {s for s, p, o in triples if p == "type" and o == "document"}
    held = {(s, o) for s, p, o in triples if p == "contains" and s.startswith("arch/") and o in docs}
    owned = {(d, d) for d in docs} | {(o, s) for s, p, o in triples if p == "contains" and s in docs}
    used = {(d, o) for d, x in below(triples, ("contains",)) for s, p, o in triples if p in ("requires", "imports", "hasPart") and s == x}
    edges = {(a, b) for a, d in held for e, m in used if e == d for w, f in owned if w == m for b, g in held if g == f}
    assert sorted(map(tuple, graph.archive_edges(q).collect())) == sorted(edges)


def test_chain_without_all_pairs(spark, monkeypatch):
    """In a chain of documents with one symbol at its end, rows stored are a few for each document, not the pairs."""
    n, rows = 200, []
    real = graph.stored

    def counted(df, name):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    q = spark.createDataFrame([(f"d{k}", "type", "document") for k in range(n)] + [(f"d{k}", "hasPart", f"d{k + 1}") for k in range(n - 1)] + [(f"d{n - 1}", "crossrefs", "s")], "s string, p string, o string")
    assert graph.symbols_of(q, "crossrefs").count() == n
    assert 0 < sum(rows) < 15 * n
