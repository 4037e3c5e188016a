"""New commits against a walk of every branch, on its own."""

from __future__ import annotations

import random

import pytest

from lumenkg.operators import history

BRANCHES, PARENTS = "repo string, name string, tip int, is_head boolean", "repo string, id int, parent int, nth int"


def walked(parents: dict[int, list[int]], tip: int, head: int, most: int) -> bool:
    todo, visited = [tip], 0
    while todo:
        at = todo.pop()
        visited += 1
        if visited > most:
            return False
        for parent in parents.get(at, []):
            if parent == head:
                return True
            if parent in parents:
                todo.append(parent)
    return False


@pytest.mark.parametrize(("seed", "most", "merges"), [(1, 12, 0.2), (2, 12, 0.5), (3, 500, 0.1), (4, 7, 0.8), (5, 1, 0.3)])
def test_every_branch(spark, seed, most, merges):
    rng, rows, branches, want = random.Random(seed), [], [], set()
    for repo in ("a", "b", "c"):
        parents: dict[int, list[int]] = {0: []}
        for n in range(1, 70):
            near = lambda: max(0, n - 1 - int(rng.expovariate(0.4)))  # noqa: E731, B023
            parents[n] = [] if rng.random() < 0.04 else [near() if rng.random() < 0.95 else 1000 + n for _ in range(rng.choice((2, 3)) if rng.random() < merges else 1)]
            parents[n] = list(dict.fromkeys(parents[n]))
        head = rng.randrange(15, 40)
        branches += [(repo, "main", head, True), *[(repo, f"b{n}", n, False) for n in parents], (repo, "gone", 5000, False)]
        rows += [(repo, n, p, k) for n, ps in parents.items() for k, p in enumerate(ps)] + [(repo, n, None, 0) for n, ps in parents.items() if not ps]
        want |= {(repo, f"b{n}", n) for n in parents if n != head and walked(parents, n, head, most)}
    got = history.new_commits(spark.createDataFrame(branches, BRANCHES), spark.createDataFrame([*rows, *rows[:9], (None, 1, 2, 0), ("a", None, 3, 0)], PARENTS), most)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert want


def test_cycles_and_nothing(spark):
    rows = [("a", 1, 2, 0), ("a", 2, 1, 0), ("a", 3, 1, 0), ("a", 3, 9, 1), ("a", 9, None, 0), ("a", 4, 9, 0)]
    branches = [("a", "main", 9, True), ("a", "x", 1, False), ("a", "y", 3, False), ("a", "z", 4, False), ("b", "alone", 4, False), ("a", None, None, False)]
    got = history.new_commits(spark.createDataFrame(branches, BRANCHES), spark.createDataFrame(rows, PARENTS))
    assert sorted(map(tuple, got.collect())) == [("a", "y", 3), ("a", "z", 4)]
    assert history.new_commits(spark.createDataFrame([], BRANCHES), spark.createDataFrame([], PARENTS)).count() == 0
