from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenkg.functions import text, uri
from lumenkg.operators import grading, lint, logs, search, states, trees
from lumenkg.operators import build
from lumenkg.sources import files, html, triples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tree_orders(spark):
    nodes = spark.createDataFrame([("t", "root", None, 0)] + [("t", n, p, k) for n, p, k in (("a", "root", 0), ("b", "root", 1), ("g", "root", 2), ("c", "b", 0), ("d", "b", 1), ("e", "d", 0), ("f", "d", 1), ("h", "g", 0), ("i", "g", 1))], "doc string, node string, parent string, ord int")
    tree = trees.paths(nodes)
    names = lambda df: " ".join(r.node for r in df.orderBy("n").collect())
    assert names(trees.depth_first(tree)) == "root a b c d e f g h i"
    assert names(trees.breadth_first(tree)) == "root a b g c d h i e f"


@pytest.mark.parametrize(
    "given, kind, error",
    [
        ("http://x.org", "base", None), ("http://x.org?a=b/c", "archive", None), ("http://x.org?a=b&p=q/r", "path", None), ("http://x.org?a=b&m=m&s=t", "symbol", None), ("http://x.org?a=b&p=q&d=d", "document", None),
        ("http://x.org?a=b&d=d&l=de&e=x/y", "element", None), ("http://x.org?a=b&z=1", None, "unknown part"), ("http://x.org?p=q&a=b", None, "order"), ("http://x.org?a=b&m=m&d=d", None, "too many parts"), ("http://x.org?a=b&s=t", None, "partial"), ("x.org?a=b", None, "base"), ("http://x.org?p=q", None, "archive"), ("http://x.org?a=", None, "empty part"), ("http://x.org?a=b&d=d&l=xx", None, "language"),
    ],
)
def test_uri(spark, given, kind, error):
    found = one(spark, uri.parse(F.lit(given)))
    assert (found.kind, found.error) == (kind, error)
    if kind == "document":
        assert found.l == "en"


def test_file_names(spark):
    name = lambda p: one(spark, uri.document_of(F.lit("http://x"), F.lit("a"), F.lit(p)))
    assert name("f/g/n.de.tex") == "http://x?a=a&p=f/g&d=n&l=de"
    assert name("n.zz.tex") == "http://x?a=a&d=n.zz&l=en"
    assert one(spark, uri.module_in(F.lit("p"), F.lit("d"), F.lit("m"))) == "p/d"
    assert one(spark, uri.module_in(F.lit("p"), F.lit("d"), F.lit("d"))) == "p"


def test_line_ends(spark):
    fold = lambda s: one(spark, text.folded_lines(F.lit(s)))
    assert fold("a\nb.\nc:\nd!\n\nx") == "ab.\nc:\nd!\n\nx"
    assert fold("a\n") == "a\n"
    assert "script" not in one(spark, text.html_to_text(F.lit("<p>x &amp; y</p><script>script</script>")))


def test_search_edges(spark):
    records = spark.createDataFrame([("u1", "Graph theory", "a directed graph", 1, True, ["s1", "s2"]), ("u2", None, "", 2, False, ["s1"]), ("u3", "x", "graph", 1, False, ["s3"])], "uri string, title string, body string, kind int, def_like boolean, fors array<string>")
    found = search.index(records, positions=True)
    assert [r.uri for r in search.search(found, "GRAPH").collect()] == ["u1", "u3"]
    assert search.search(found, "").count() == 0
    assert search.search(found, "graph", kinds=()).count() == 0
    assert [r.uri for r in search.search(found, "graph", definition_like=True, k=5).collect()] == ["u1"]
    assert [r.uri for r in search.phrase(found, ["directed", "graph"]).collect()] == ["u1"]
    assert [r.symbol for r in search.search_symbols(found, "graph", k=2).collect()] == ["s1", "s2"]


def test_states(spark):
    rows = spark.createDataFrame([("a", "x/f", 5, None), ("a", "x/g", 5, 5), ("a", "h", 5, 6)], "archive string, rel_path string, last_changed int, last_built int")
    found = states.file_states(rows)
    assert {r.rel_path: r.state for r in found.collect()} == {"x/f": states.NEW, "x/g": states.STALE, "h": states.UP_TO_DATE}
    up = {r.folder: (r.new, r.stale, r.up_to_date) for r in states.rollup(found, "rel_path", "archive").collect()}
    assert up == {"": (1, 1, 1), "x": (1, 1, 0)}


def test_owner_is_the_outer_archive(spark):
    paths = spark.createDataFrame([("a/b/c/f",), ("ax/f",)], "path string")
    roots = spark.createDataFrame([("a/b", "outer"), ("a/b/c", "inner")], "root string, id string")
    assert [tuple(r) for r in states.owner(paths, roots).collect()] == [("a/b/c/f", "outer")]


def test_grading(spark):
    mark = lambda c: one(spark, c)
    choices = F.array(*[F.struct(F.lit(c).alias("correct")) for c in (True, False, True)])
    assert tuple(mark(grading.single(choices, F.lit(0)))) == (1.0, True)
    assert tuple(mark(grading.single(choices, F.lit(1)))) == (0.0, False)
    assert tuple(mark(grading.single(choices, F.lit(None).cast("int")))) == (0.0, True)
    assert tuple(mark(grading.single(choices, F.lit(9)))) == (0.0, True)
    picks = lambda *p: F.array(*map(F.lit, p))
    assert mark(grading.multiple(choices, picks(True, False, True))).points == 1
    assert mark(grading.multiple(choices, picks(False, False, False))).points == 0
    assert mark(grading.multiple(choices, picks(True, True, True))).points == pytest.approx(1 / 3)
    assert mark(grading.multiple(choices, picks(True))) is None
    assert mark(grading.case_of(F.lit("range"), F.lit("-5"))).asDict() == {"kind": "range", "value": None, "lo": None, "hi": 5.0}
    assert mark(grading.case_of(F.lit("range"), F.lit("-5-7"))).asDict() == {"kind": "range", "value": None, "lo": -5.0, "hi": 7.0}
    assert [mark(grading.number(F.lit(s))) for s in ("12", "1e3", "99999999999", " 2.5 ", "2.5")] == [12.0, None, None, None, 2.5]
    assert tuple(mark(grading.answer_kind(F.lit("+2.5")))) == ("trait", 2.5)


def test_batch_needs_all_responses(spark):
    items = spark.createDataFrame([("p", 0, "choice", False, [(True,)], None), ("p", 1, "solution", False, None, None)], "id string, ord int, tag string, multiple boolean, choices array<struct<correct boolean>>, cases array<struct<kind:string,value:string,lo:float,hi:float,verdict:boolean>>")
    given = spark.createDataFrame([("p", "s1", 0, "single", None, 0, None), ("p", "s2", 0, "text", None, None, "x"), ("p", "s3", 0, "single", None, 0, None), ("p", "s3", 1, "single", None, 0, None)], "id string, submission string, ord int, tag string, picks array<boolean>, pick int, text string")
    found = {r.submission: (r.score, r.correct) for r in grading.graded(items, given, "id").collect()}
    assert found == {"s1": (1.0, True), "s2": (None, None), "s3": (None, None)}


def test_build_order(spark):
    tasks = spark.createDataFrame([(k, "queued") for k in range(5)] + [(9, "failed")], "id int, state string")
    deps = spark.createDataFrame([(1, 0, True), (2, 3, False), (3, 2, True), (4, 9, True)], "task int, dep int, strict boolean")
    found = {r.id: (r.level, r.placed) for r in build.order(tasks, deps).collect()}
    assert found[0] == (0, "queued") and found[1] == (1, "queued") and found[4] == (0, "queued")
    assert found[2][1] == found[3][1] == "queued" and found[2][0] < found[3][0]  # the weak link goes
    cycle = spark.createDataFrame([(2, 3, True), (3, 2, True)], "task int, dep int, strict boolean")
    assert {r.id: r.placed for r in build.order(tasks, cycle).collect()}[2] == "blocked"


PAGE = """<html><body data-kg-doctitle=""><section data-kg-section="" data-kg-id="s"><h1 data-kg-title="">Überschrift</h1>
<div data-kg-module="m1"><p data-kg-definition="" data-kg-fors="a, b,a" data-kg-styles="symdoc-x">é <b data-kg-title="">Titel</b></p>
<!-- <p data-kg-example=""> --><span data-kg-symdecl="sym" data-kg-args="iB" data-kg-macroname="mac"></span><i data-kg-import="m0"/></div>
<div data-kg-problem=""><div data-kg-multiple-choice-block=""><p data-kg-problem-choice="true">x</p><p data-kg-problem-choice="false">y</p></div>
<span data-kg-objectivedimension="apply" data-kg-objectivesymbol="a"></span></div></section><img src="x.png"><a data-kg-inputref="d2"></a></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([("d", PAGE), ("e", None), ("f", "<div data-kg-section=''><p></div>")], "doc string, html string")
    nodes = html.nodes(html.tags(pages))
    own = html.rows(html.annotated(nodes))
    found = html.elements(own)
    by = {r.kind: r for r in found.where("doc = 'd'").collect()}
    assert by["section"].uri == "d&e=s" and by["module"].uri == "d&e=s/module" and by["definition"].uri == "d&e=s/module/definition" and by["problem"].depth == 1
    assert by["definition"].fors == ["a", "b"] and by["definition"].styles == ["symdoc-x"]
    raw = PAGE.encode()
    assert raw[by["definition"].title.start : by["definition"].title.stop].decode() == "Titel"
    assert raw[by["section"].title.start : by["section"].title.stop].decode() == "Überschrift"
    got = {(r.s, r.p, r.o) for r in html.triples(own, found).where("g = 'd'").collect()}
    assert {("d", "type", "document"), ("d", "contains", "d&e=s"), ("d&e=s/module/definition", "defines", "b"), ("d&e=s/module", "imports", "m0"), ("d&e=s/module", "declares", "sym"), ("sym", "type", "declaration"), ("d", "hasPart", "d2")} <= got
    assert {o for _, p, o in got if p in ("po-symbol", "cognitive-dimension")} == {"a", "cd-apply"}
    assert [(r.multiple, r.choices) for r in html.choices(own).collect()] == [(True, [True, False])]
    symbol = html.declarations(own).first()
    assert (symbol.uri, symbol.arity, symbol.macroname) == ("sym", ["i", "B"], "mac")
    assert [tuple(r) for r in html.errors(nodes).collect()] == [("f", "unbalanced")]
    assert one(spark, html.with_images(F.lit('<img src="x.png"><img src="/y">'), "b/")) == '<img src="b/x.png"><img src="/y">'


def test_archives(spark, tmp_path):
    def put(path, content):
        p = tmp_path / "lib" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)

    put("g/a/META-INF/MANIFEST.MF", "id: g/a\nformat: tex\ndependencies: g/b,g/a\nignore: */code/*|*/tutorial/solution/*\n")
    put("g/a/inner/META-INF/MANIFEST.MF", "id: g/a/inner\nformat: tex\n")
    put("g/b/META-INF/MANIFEST.MF", "id: other\nformat: tex\n")
    put("g/.c/META-INF/MANIFEST.MF", "id: g/.c\nformat: tex\n")
    put("g/a/META-INF/archive.json", '[{"type": "course", "title": "T", "notes": "n"}]')
    for p in ("x.tex", "code/y.tex", "tutorial/solution/z.tex", "tutorial/math/w.tex", "v.txt"):
        put(f"g/a/source/{p}", "\\symdecl{x}")
    root = f"file://{tmp_path}/lib"
    found = {r.root: r for r in files.manifests(spark, root).collect()}
    assert set(found) == {"g/a", "g/b"} and found["g/a"].error is None and found["g/b"].error == "id is not the place"
    assert found["g/a"].dependencies == ["g/b"]
    own = files.sources(files.listed(spark, root, "*.t*"), files.manifests(spark, root).where("error is null"), {"tex": "tex"})
    assert sorted(r.rel_path for r in own.collect()) == ["tutorial/math/w.tex", "x.tex"]
    assert files.catalog(spark, root).first().title == "T"


def test_triples_files(spark, tmp_path):
    quads = spark.createDataFrame([("g1", "http://x/a b", "iri", "http://x/p", 'say "x"\n\\', "literal", "en", None), ("g2", "_:b1", "bnode", "http://x/p", "http://x/o", "iri", None, None)], "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string")
    triples.write(quads, f"file://{tmp_path}/t")
    back = triples.parsed(spark.read.text(f"file://{tmp_path}/t"))
    assert sorted(map(tuple, back.select(*quads.columns).collect()), key=str) == sorted(map(tuple, quads.collect()), key=str)
    assert triples.parsed(spark.createDataFrame([("nonsense",)], "value string")).count() == 0
    assert triples.replaced(quads, quads.where("g = 'g1'").withColumn("o", F.lit("new"))).count() == 2


def test_lint(spark):
    source = spark.createDataFrame([("f", "\\begin{smodule}{m} % \\symdecl{no}\n  \\symdecl{yes} \\sn{yes}\\symdef\n")], "file string, text string")
    found = lint.annotated(source)
    assert sorted((r.line, r.col, r.kind) for r in found.collect()) == [(0, 0, "module"), (1, 2, "symbol"), (1, 16, "reference"), (1, 24, "symbol")]
    assert sorted(r.message for r in lint.diagnostics(found).collect()) == ["no argument: symdef", "not closed: smodule"]


def test_times(spark):
    assert one(spark, logs.duration(F.lit(93_784_005))) == "1d 2h 3m 4.005s"
    assert one(spark, logs.moving_average(F.array(F.lit(4.0), F.lit(8.0)))) == 6.0
    lines = spark.createDataFrame([('{"tag": "open", "name": "n", "args": {"b": "2", "a": "1"}}',), ("broken",)], "value string")
    assert logs.parsed(lines).count() == 1
