"""Clustering, product codes and mixing against plain versions, and with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lumenkg.llm import clustering, mixing, vectorcodes
from lumenkg.llm.vectors import distances

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def rows_of(n: int, dims: int, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    out = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=dims) * 0.1], i % 3 if i % 7 else None, "x") for i in range(n)]
    out += [(n + i, out[3][1], 1, "copy") for i in range(40)]  # a ball of radius 0
    bad = [None, [], [0.5] * (dims - 1), [NAN] + [0.0] * (dims - 1), [INF] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1)]
    return [*out, out[0], *[(1000 + i, v, None, None) for i, v in enumerate(bad)], (None, [0.25] * dims, None, None)]


def kept(rows: list[tuple], dims: int, scale: int) -> list[tuple]:
    return [(r[0], [math.floor(scale * x) for x in r[1]], r[2], r[1]) for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def lloyd(points: list[list[int]], start: list[list[int]], rounds: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p: min((apart(p, c), k) for k, c in enumerate(start))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        start = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(start)]
    return start, [nearest(p) for p in points]


@pytest.mark.parametrize("block", [16, 8192])
def test_clusters(spark, block):
    rows = rows_of(200, 6)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = clustering.clustered(df, k=7, rounds=3, dims=6, scale=256, block=block).collect()
    own = kept(rows, 6, 256)
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    start = [r[1] for r in sorted(own, key=lambda r: (name(r[0]), r[3]))[:7]]
    centroids, nearest = lloyd([r[1] for r in own], start, 3)
    inertia = [sum(d for d, c in nearest if c == k) for k in range(7)]
    want = [(r[0], c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for r, (d, c) in zip(own, nearest, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_whole_balls_are_assigned():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, size=(4, 8))
    points = (centres[rng.integers(0, 4, 3000)] + rng.integers(-3, 4, size=(3000, 8))).astype(np.int64)
    tree = clustering.Tree.grown(points)
    balls, leaves = tree.parted(centres)
    assert sum(len(b) for _, b, _ in balls) > 0 and len(tree.rows(tree.depth, leaves)) < len(points) // 4
    nearest = distances(tree.points, centres).argmin(1)
    for level, own, found in balls:
        for b, c in zip(own, found, strict=True):
            assert set(nearest[tree.rows(level, np.array([b]))]) == {c}


def test_large_numbers_and_ties():
    far = np.array([[1 << 27] * 64, [-(1 << 27)] * 64], dtype=np.int64)
    assert distances(far, far)[0, 1] == 64 << 56
    points = np.array([[0, 0], [4, 0], [2, 0]], dtype=np.int64)
    assert distances(points, points[:2]).argmin(1).tolist() == [0, 1, 0]


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "x"), (2, [NAN] * 6, 1, "x")]):
        df = spark.createDataFrame(rows, VECTORS)
        assert clustering.clustered(df, dims=6).count() == 0
        assert vectorcodes.codes(df).count() == 0


def test_codes(spark):
    rows = rows_of(150, 8)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vectorcodes.codes(df, parts=4, entries=32, rounds=2).collect()
    own = kept(rows, 8, 1024)
    first = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:32]
    found, books = [], []
    for p in range(4):
        part = slice(2 * p, 2 * p + 2)
        book, nearest = lloyd([r[1][part] for r in own], [r[1][part] for r in first], 2)
        found.append(nearest)
        books += book
    sha = hashlib.sha256(",".join(str(x) for e in books for x in e).encode()).hexdigest()
    errors = [sum(f[i][0] for f in found) for i in range(len(own))]
    label = {key: sum(e for e, r in zip(errors, own, strict=True) if r[2] == key) for key in {r[2] for r in own}}
    want = [(r[0], "".join(f"{f[i][1]:02x}" for f in found), errors[i], label[r[2]], sha) for i, r in enumerate(own)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bounds_leave_out_entries():
    rng = np.random.default_rng(5)
    entries = rng.integers(-500, 500, size=(256, 16))
    parts = entries[rng.integers(0, 256, 400)] + rng.integers(-20, 21, size=(400, 16))
    index, distance, measured = vectorcodes.Cells(entries, 3).nearest(parts)
    every = distances(parts, entries)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 400 * 256 // 10


def plain_targets(totals: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = sum(totals.values()), set(names), {}
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * totals[s]}
        if not over:
            return out | share
        out |= {s: most * totals[s] for s in over}
        rest -= sum(most * totals[s] for s in over)
        open_ -= over
    return out


DOCS = "doc_id long, text string, source string, size string, n string"


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 2, 3, 7, 7, 7, 50]))), rng.choice(["a", "a", "a", "b", "B", "é", None]), "s", "n") for i in range(600)]
    rows += [(900, None, "a", "", ""), (901, "", "zz", "", ""), (902, "  x\x0b y\x1cz", "a", "", ""), (903, "one two", "rare", "", ""), *[(904, "a b c", "b", "", "")] * 200]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mixed(df.repartition(5)).collect()
    again = mixing.mixed(df.orderBy("text").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    totals: dict = {}
    for r in rows:
        totals[r[2]] = totals.get(r[2], 0) + size(r[1])
    want = plain_targets(totals)
    taken = dict.fromkeys(totals, 0)
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        taken[r.source] += r.taken
    assert want["rare"] == 6 and want["zz"] == 0
    assert all(abs(taken[s] - want[s]) <= 1 for s in totals), (taken, want)


def test_mixture_of_nothing(spark):
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0
    only = mixing.mixed(spark.createDataFrame([(1, None, None, "", ""), (2, "", "a", "", "")], DOCS)).collect()
    assert [(r["size"], r.taken, r.target) for r in only] == [(0, 0, 0.0)] * 2


def test_many_rows_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i % 700, "a b c d e", "abc"[i % 3], "", "") for i in range(2100)] + [(5, "a b c d e", "b", "", "")] * 900
    got = mixing.mixed(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2.5


@pytest.mark.parametrize("seed", range(30))
def test_fitting(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
    counts = [rng.randint(1, 5) for _ in lengths]
    every = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = rng.randint(1, every)
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    most = rng.randint(budget, every)
    taken = mixing.knapsack(lengths, counts, budget, most)
    assert all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
    got = sum(n * k for n, k in zip(lengths, taken, strict=True))
    assert abs(got - budget) == min(abs(s - budget) for s in sums if s <= most)
    taken = mixing.fitted(lengths, counts, budget)
    assert all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
    assert abs(sum(n * k for n, k in zip(lengths, taken, strict=True)) - budget) <= max(lengths)


def test_fitting_of_long_documents():
    assert mixing.fitted([1, 300_000], [1, 1], 299_997) == [0, 1] or mixing.fitted([1, 300_000], [1, 1], 299_997) == [1, 1]
    assert mixing.fitted([500_000, 900_000], [10, 10], 2_000_000) in ([4, 0], [2, 1])
    assert mixing.fitted([700_000], [3], 300_000) == [0] and mixing.fitted([700_000], [3], 400_000) == [1]


def test_fitting_of_many_words():
    rng = random.Random(1)
    lengths = list(range(1, 4000))
    counts = [rng.randint(0, 2000) for _ in lengths]
    every = sum(n * c for n, c in zip(lengths, counts, strict=True))
    taken = mixing.fitted(lengths, counts, every // 3)
    assert sum(n * k for n, k in zip(lengths, taken, strict=True)) == every // 3
    assert all(abs(k - c / 3) <= 6 for k, c in list(zip(taken, counts, strict=True))[100:])  # the shape of the source stays


def test_other_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    vectors = spark.createDataFrame(rows_of(60, 8), VECTORS)
    for c in ("slot", "n", "total", "ids", "points", "code", "error", "of", "id", "vec"):
        vectors = vectors.withColumn(c, F.lit("own"))
    assert clustering.clustered(vectors, k=3, rounds=1, dims=8).count() == vectorcodes.codes(vectors, entries=4, rounds=1).count() == 102
    docs = spark.createDataFrame([(1, "w " * 300_000, "a", "s", "n"), (2, "w", "a", "s", "n"), (3, "w w", None, "s", "n")], DOCS)
    for c in ("hash", "part", "total", "target", "times", "more", "cut", "source_", "bucket"):
        docs = docs.withColumn(c, F.lit("own"))
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(docs).collect()}
    assert got[1] == (300_000, 300_000) and got[2][1] <= 1 and got[3] == (2, 6)
