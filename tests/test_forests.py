"""Quizzes against a plain recursive reading of the documents; folds of random forests."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenkg.operators import braces as B
from lumenkg.operators import forests as O

SCHEMA = "doc string, path array<int>, kind string, title string, html string, uri string, solution string, target string"


def plain_quiz(docs: dict, name: str, trail: tuple = ()) -> tuple[list, dict]:
    """elements and solutions of a document; LookupError for what is missing."""
    solutions: dict = {}

    def walk(path: tuple, in_problem: bool) -> list:
        out = []
        for p in sorted(p for p in docs[name] if len(p) == len(path) + 1 and p[: len(path)] == path):
            n = docs[name][p]
            if n["kind"] == "inputref":
                if n["target"] is None or n["target"] in (*trail, name):
                    continue
                if n["target"] not in docs:
                    raise LookupError(n["target"])
                more, found = plain_quiz(docs, n["target"], (*trail, name))
                out += more
                solutions.update(found)
            elif n["kind"] == "section":
                inner = walk(p, in_problem)
                out += inner if n["title"] is None else [{"Section": {"title": n["title"], "elements": inner}}]
            elif n["kind"] == "paragraph":
                out.append({"Paragraph": {"html": n["html"] or ""}})
            elif n["kind"] == "problem":
                if n["solution"] is None:
                    raise LookupError(n["uri"])
                solutions[n["uri"]] = n["solution"]
                if not in_problem:
                    out += [{"Problem": {"uri": n["uri"], "html": n["html"] or ""}}, *walk(p, True)]
            else:
                out += walk(p, in_problem)
        return out

    own = walk((), False)
    if len(own) == 1 and "Section" in own[0]:
        own = own[0]["Section"]["elements"]
    return own, solutions


def forest(seed: int) -> dict:
    rng = random.Random(seed)
    docs: dict = {}
    for d in range(8):
        nodes: dict = {}
        for k in range(rng.randint(0, 9)):
            above = rng.choice([(), *nodes])
            if above and nodes[above]["kind"] == "inputref":
                continue
            path = (*above, k)
            kind = rng.choice(["section", "section", "paragraph", "problem", "problem", "slide", "inputref"])
            nodes[path] = {"kind": kind, "title": rng.choice([None, 'A "b" é\n', "T"]) if kind == "section" else None, "html": rng.choice(["<p>x</p>", "\\", None]), "uri": f"d{d}/{k}", "solution": rng.choice(["s"] * 12 + [None]), "target": rng.choice([f"d{rng.randrange(8)}", f"d{rng.randrange(8)}", "gone", None]) if kind == "inputref" else None}
        if nodes:
            docs[f"d{d}"] = nodes
    return docs


SINGLE = {
    "d0": {(0,): {"kind": "section", "title": "outer", "html": None, "uri": "a", "solution": None, "target": None}, (0, 0): {"kind": "section", "title": "inner", "html": None, "uri": "b", "solution": None, "target": None}, (0, 0, 0): {"kind": "paragraph", "title": None, "html": "p", "uri": "c", "solution": None, "target": None}},
    "d1": {(0,): {"kind": "inputref", "title": None, "html": None, "uri": None, "solution": None, "target": "d0"}},
    "d2": {(0,): {"kind": "slide", "title": None, "html": None, "uri": None, "solution": None, "target": None}, (0, 1): {"kind": "inputref", "title": None, "html": None, "uri": None, "solution": None, "target": "d1"}},
}


@pytest.mark.parametrize("docs", [SINGLE, *[forest(s) for s in range(4)]])
def test_quizzes(spark, docs):
    rows = [(d, list(p), *(n[c] for c in ("kind", "title", "html", "uri", "solution", "target"))) for d, nodes in docs.items() for p, n in nodes.items()]
    tree = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.root: r for r in O.quizzes(O.opened(tree, tree.select(F.col("doc").alias("root")).distinct())).collect()}
    assert set(got) == set(docs)
    for d in docs:
        try:
            elements, solutions = plain_quiz(docs, d)
        except LookupError:
            assert got[d].quiz is None and got[d].error
            continue
        assert got[d].error is None, got[d]
        assert json.loads(got[d].quiz) == {"elements": elements, "solutions": solutions}


def test_fold_of_random_trees(spark):
    rng = random.Random(9)
    rows, parents = [], {}
    for k in range(300):
        parents[k] = rng.randrange(k) if k and rng.random() < 0.95 else None
        rows.append(("d", k, parents[k], rng.randrange(3), None if k % 9 == 0 else f"n{k}"))

    def value(k):
        own = {} if k % 9 == 0 else {"name": f"n{k}"}
        return own | {"children": [value(c) for _, c in sorted((r[3], r[1]) for r in rows if r[2] == k)]}

    df = spark.createDataFrame(rows, "doc string, node int, parent int, ord int, name string").repartition(3)
    got = {r.node: json.loads(r.value) for r in O.structures(df, "name").collect()}
    assert got == {k: value(k) for k in range(300)}
    assert O.structures(df.limit(0), "name").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_ranges_within_ranges(spark, seed):
    rng = random.Random(seed)
    ranges, at = {}, [0]

    def grow(parent, depth):
        for _ in range(rng.randint(0, 3) if depth else 3):
            node, start = len(ranges), at[0]
            at[0] += 1
            ranges[node] = [start, None, parent]
            if depth < 4:
                grow(node, depth + 1)
            ranges[node][1] = at[0] if rng.random() < 0.7 or at[0] > start + 1 else start
            at[0] = max(at[0], ranges[node][1]) + 1

    grow(None, 0)
    df = spark.createDataFrame([("f", n, a, b) for n, (a, b, _) in ranges.items()], "file string, node int, at int, close int")
    assert {r.node: r.parent for r in B.nested(df).collect()} == {n: p for n, (_, _, p) in ranges.items()}


def test_forests_are_not_stored(spark):
    """Which documents are opened is stored, and no nodes; a fold stores nothing."""
    from pathlib import Path

    from lumenkg.storage import shared_dir

    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir())
    rows = [(d, list(p), *(n[c] for c in ("kind", "title", "html", "uri", "solution", "target"))) for d, nodes in SINGLE.items() for p, n in nodes.items()]
    tree = spark.createDataFrame(rows, SCHEMA)
    assert O.quizzes(O.opened(tree, tree.select(F.col("doc").alias("root")).distinct())).count() == 3
    O.structures(spark.createDataFrame([("d", 0, None, 0)], "doc string, node int, parent int, ord int"), "node").collect()
    assert [spark.read.parquet(str(p)).columns for p in set(place.iterdir()) - before] == [["root", "doc", "above"]]


def test_trees_that_are_none(spark):
    df = lambda *rows: spark.createDataFrame(rows, "doc string, node int, parent int, ord int")
    assert [r.node for r in O.structures(df(("d", 0, None, 0), ("d", 1, 7, 0), ("d", 2, 1, 0)), "node").collect()] == [0]
    assert [r.value for r in O.structures(df(("d", 0, None, 0), ("d", 1, 0, 0), ("e", 0, None, 0)), "node", tops=True).orderBy("doc").collect()] == ['{"node":0,"children":[{"node":1,"children":[]}]}', '{"node":0,"children":[]}']
    with pytest.raises(Exception, match="cycle"):
        O.structures(df(("d", 0, None, 0), ("d", 1, 2, 0), ("d", 2, 1, 0)), "node").collect()
