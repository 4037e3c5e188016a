"""Inputs that are long, deep or unbalanced lose nothing and stop nothing."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from lumenkg.functions import uri as U
from lumenkg.operators import build, grading, graph, trees
from lumenkg.operators.closure import levels
from lumenkg.sources import html as H
from lumenkg.sources import triples as N

ROOT = Path(__file__).resolve().parent.parent


def test_text_after_a_stray_sign(spark):
    page = "<p>a < " + "letters \"quoted\" it's " * 50_000 + "</p><b>"
    found = H.tags(spark.createDataFrame([("d", page)], "doc string, html string")).collect()
    assert [r.name for r in found if r.name in "pb"] == ["p", "p", "b"]


def test_long_literal_and_escapes(spark):
    texts = ["x" * 1_000_000, 'a\\nb \\\\n \\t"', "\ttab\r\nend", "\\", "é 𝒜", 'say \\"'] + ['"\\' * 50_000]
    quads = spark.createDataFrame([(str(k), "s", "iri", "p", "literal", t, None, None) for k, t in enumerate(texts)], "g string, s string, s_kind string, p string, o_kind string, o string, o_lang string, o_dtype string")
    lines = quads.select("g", N.line(quads).alias("value"))
    assert {r.g: r.o for r in N.parsed(lines).collect()} == {str(k): t for k, t in enumerate(texts)}
    escaped = spark.createDataFrame([(r'<s> <p> "é\U0001D49C\tz\\u0041" .',)], "value string")
    assert N.parsed(escaped).first().o == "é𝒜\tz\\u0041"


def test_deep_nesting(spark):
    n = 150
    page = "".join(f'<div data-kg-section="" data-kg-id="é{k}">' for k in range(n)) + "</div>" * n
    own = H.rows(H.annotated(H.nodes(H.tags(spark.createDataFrame([("d", page)], "doc string, html string")))))
    found = H.elements(own).select("uri", "depth").collect()
    assert {(r.uri, r.depth) for r in found} == {("d&e=" + "/".join(f"é{i}" for i in range(k + 1)), k) for k in range(n)}


def test_deep_trees_and_far_places(spark):
    nodes = spark.range(1200).select(F.lit("d").alias("doc"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") % 3).alias("ord"))
    tree = trees.paths(nodes.unionByName(spark.createDataFrame([("d", 5000, 4999, 0)], nodes.schema)))
    assert {(r.node, r.depth, tuple(r.path)) for r in tree.where("node > 1190 or node < 3").collect()} == {(k, k, tuple(i % 3 for i in range(k + 1))) for k in (0, 1, 2, *range(1191, 1200))}
    assert tree.count() == 1200
    flat = spark.createDataFrame([("d", str(k), [k], "section", f"t{k}", None) for k in (999_999, 1_000_000, 5)], "doc string, node string, path array<long>, kind string, title string, target string")
    found = trees.contents(flat, flat, spark.createDataFrame([("d",)], "root string"))
    assert [r.node for r in found.orderBy("key").collect()] == ["5", "999999", "1000000"]


def test_chain_of_tasks(spark):
    n = 40
    tasks, deps = spark.range(n), spark.range(1, n).select(F.col("id").alias("task"), (F.col("id") - 1).alias("dep"))
    assert {r.id: r.level for r in levels(tasks, deps).collect()} == {k: k for k in range(n)}


def test_patterns(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), (None, "y"), (None, None)], "k string, v string")
    b = spark.createDataFrame([("1", None), (None, "y")], "k string, v string")
    assert sorted(map(tuple, graph.minus(a, b).collect()), key=repr) == [("2", None), (None, None)]
    assert "NestedLoop" not in graph.minus(a, b)._jdf.queryExecution().toString() and "Cartesian" not in graph.minus(a, b)._jdf.queryExecution().toString()
    assert graph.optional(a.select("k"), b.select(F.col("v").alias("w"))).count() == 8
    data = spark.createDataFrame([("a", "p", "b"), ("c", "q", "d"), ("b", "r", "c")], "s string, p string, o string")
    joined = graph.bgp(data, ("?a", "p", "?b"), ("?c", "q", "?d"), ("?b", "r", "?c"))
    assert [r.asDict() for r in joined.collect()] == [{"a": "a", "b": "b", "c": "c", "d": "d"}]
    assert "Cartesian" not in joined._jdf.queryExecution().toString()


def test_depth_counts(spark):
    """A file is used, a symbol referenced and an archive depended on over more than one step."""
    rows = [("arch/a", "contains", "f"), ("arch/a", "contains", "g"), ("arch/b", "contains", "h"), ("f", "type", "document"), ("g", "type", "document"), ("h", "type", "document"), ("h", "contains", "m"), ("m", "contains", "n"), ("f", "requires", "n"), ("g", "hasPart", "f"), ("f", "contains", "e"), ("e", "crossrefs", "s"), ("h", "contains", "x"), ("x", "imports", "m")]
    q = spark.createDataFrame([("g0", *r) for r in rows], "g string, s string, p string, o string")
    assert [tuple(r) for r in graph.unused_files(q).collect()] == [("arch/a", "g")]
    assert {tuple(r) for r in graph.symbols_of(q, "crossrefs").collect()} == {("f", "s"), ("g", "s")}
    # n lies in m, not in a document itself: only what a document contains counts as its own
    assert {tuple(r) for r in graph.archive_edges(q).collect()} == {("arch/a", "arch/a"), ("arch/b", "arch/b")}


def test_numbers_of_answers(spark):
    texts = ["1.", "1.5e3", ".5", " 7", "+7", "2147483648", "-2147483648", "1e3", ".", "0x1", "NaN", "1.5\n", "9" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(grading.number(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [1.0, 1500.0, 0.5, None, 7.0, None, -2147483648.0, None, None, None, None, None, None]


def test_identifiers(spark):
    good = {"http://x.y": "base", "http://x.y?a=b": "archive", "http://x.y?a=b&p=c/d": "path", "http://x.y?a=b&m=n": "module", "http://x.y?a=b&p=c&m=n&s=t": "symbol", "http://x.y?a=b&d=e": "document", "http://x.y?a=b&d=e&l=de&e=f/g": "element"}
    bad = {"x.y?a=b": "base", "http://x.y?": "unknown part", "http://x.y?z=1": "unknown part", "http://x.y?p=c&a=b": "order", "http://x.y?p=c": "archive", "http://x.y?a=b&m=n&d=e": "too many parts", "http://x.y?a=b&s=t": "partial", "http://x.y?a=": "empty part", "http://x.y?a=b&d=e&l=xx": "language"}
    rows = spark.createDataFrame([(u,) for u in [*good, *bad]], "u string").select("u", U.parse(F.col("u")).alias("x")).collect()
    assert {r.u: r.x.kind for r in rows if r.x.error is None} == good and {r.u: r.x.error for r in rows if r.x.error} == bad
    assert [r.x.l for r in rows if r.x.kind in ("document", "element")] == ["en", "de"] and all(r.x.a is None for r in rows if r.x.error)


def test_first_free_number(spark):
    queues = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 3), (4, "b", 1), (7, "c", 0), (8, "c", 0)], "id long, name string, idx long")
    assert {r.name: r.idx for r in build.registered(queues).collect()} == {"a": 2, "b": 0, "c": 1} and build.next_id(queues).first().id == 9


def test_without_the_folders_of_training_text(tmp_path):
    shutil.copytree(ROOT, tmp_path / "own", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "*.json", "*.md"))
    (tmp_path / "own/lumenkg/llm/__pycache__").mkdir(parents=True)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path / "own", check=False)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 100, done.stderr
