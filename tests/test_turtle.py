"""Turtle that is written is read again; lines by other hands; what a file looks like."""

from __future__ import annotations

from pathlib import Path

from lumenkg.sources import triples as N
from lumenkg.sources import turtle as T

COLUMNS = "g string, s string, s_kind string, p string, o string, o_kind string, o_lang string, o_dtype string"
RDF, XSD, DOC = T.PREFIXES["rdf"], T.PREFIXES["xsd"], "http://corpus.org?a=x/y&d=doc&l=en"
ROWS = [
    (DOC, f"{DOC}&e=s/e1", "iri", f"{RDF}type", "http://voc.org/ulo#section", "iri", None, None),
    (DOC, f"{DOC}&e=s/é", "iri", "http://purl.org/dc/elements/1.1/title", 'a "b" \\ é\n. <x> ^^', "literal", "en", None),
    (DOC, DOC, "iri", "http://voc.org/ulo#n", "7", "literal", None, f"{XSD}integer"),
    (DOC, DOC, "iri", "http://voc.org/ulo#n", 'x"^^<y>', "literal", None, "http://other.org/t y"),
    (DOC, "_:b1", "bnode", "http://voc.org/ulo#p", "_:b2", "bnode", None, None),
    ("g/2", "doc/7", "iri", "contains", "", "literal", None, None),
    ("7", "doc/7", "iri", "contains", "doc/8 -x.y", "iri", None, None),
]


def key(r):
    return tuple(x or "" for x in r)


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    given = spark.createDataFrame([*ROWS, ROWS[0], (None, *ROWS[0][1:]), (DOC, None, *ROWS[0][2:])], COLUMNS)
    T.write(given, path, {**T.PREFIXES, "ulo": "http://voc.org/ulo#", "short": "http://voc.org/"})
    assert sorted(map(key, T.read(spark, path).collect())) == sorted(map(key, ROWS))
    own = [f.read_text() for f in Path(f"{tmp_path}/t").rglob("*.txt") if "corpus" in str(f)]
    assert len(own) == 1 and own[0].startswith(f"@prefix ns: <{DOC}> .\n@prefix rdf: ")
    assert "\nns:\\&e\\=s\\/e1 a ulo:section .\n" in own[0] and '\nns: ulo:n "7"^^xsd:integer .\n' in own[0]


def test_large_graphs_have_several_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    given = spark.range(500).selectExpr("'g' as g", "concat('s', id) as s", "'iri' as s_kind", "'p' as p", "cast(id as string) as o", "'literal' as o_kind", "cast(null as string) as o_lang", "cast(null as string) as o_dtype", "1 as file")
    T.write(given, path, namespace=None, file_rows=100)
    files = list(Path(f"{tmp_path}/t").rglob("*.txt"))
    assert len(files) == 5 and all(f.read_text().startswith("@prefix") for f in files)
    assert T.read(spark, path).distinct().count() == 500


def test_lines_of_others_and_nothing(spark, tmp_path):
    place = tmp_path / "t" / "g=x" / "part=0"
    place.mkdir(parents=True)
    (place / "a.ttl").write_text('@prefix a: <http://a/> .\n# remark\n a:b a <c> .\nz:b a:b a:c .\na:b a:b "x"@de .\na:b nonsense\n\na:b a:b a:c\\#d.\n')
    (place / "b.ttl").write_text('@prefix a: <http://other/> .\na:b a:b a:c .\n')
    got = sorted((r.s, r.p, r.o, r.o_lang) for r in T.read(spark, f"file://{tmp_path}/t").fillna("").collect())
    assert got == [("http://a/b", "http://a/b", "http://a/c#d", ""), ("http://a/b", "http://a/b", "x", "de"), ("http://a/b", f"{RDF}type", "c", ""), ("http://other/b", "http://other/b", "http://other/c", "")]
    T.write(spark.createDataFrame([], COLUMNS), f"file://{tmp_path}/none")
    assert T.read(spark, f"file://{tmp_path}/none").count() == 0


def test_what_is_written_is_derived_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    given = spark.createDataFrame(ROWS, COLUMNS)
    T.write(given.mapInArrow(seen, given.schema), f"file://{tmp_path}/t")
    assert read.value == len(ROWS)


def test_a_line_is_matched_once(spark, tmp_path):
    """What is made of a line's parts, or asked of them, does not match the line again."""
    path = f"file://{tmp_path}/t"
    T.write(spark.createDataFrame(ROWS, COLUMNS), path)
    plan = T.read(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(T._STATEMENT) == 1 and plan.count(N._LINE) == 1


def test_quotes_in_literals_and_marks(spark):
    lines = [(r'<a> <p> "x\"^^<y"^^<t> .',), ('<a> <p> "m\x01n\x01o" .',), ("\x01\x01<a>\x01<p>\x01<o>",), ("\x01<a>\x01<p>\x01<o>",), ("<a>\x01<p>\x01<o>",)]
    got = sorted((r.s, r.p, r.o, r.o_dtype or "") for r in N.parsed(spark.createDataFrame(lines, "value string")).collect())
    assert got == [("a", "p", "m\x01n\x01o", ""), ("a", "p", 'x"^^<y', "t")]
