"""Words are counted where the records lie: adding deals nothing out by term, and no posting, length or repeated uri is lost by that."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lumenkg.operators import search as S
from lumenkg.operators.segments import Segments

SCHEMA = "uri string, title string, body string, kind int, def_like boolean, fors array<string>"
TEXTS = [("a", "One two", "the that the THE é that x9 9"), ("b", None, ""), ("c", "", "..."), ("d", "the", None), ("e", "z", "z " * 3000 + "é z ß"), ("f", "one", "that"), ("f", "one one", "that the")]


def test_added_without_a_shuffle(spark, tmp_path):
    frame = spark.createDataFrame([(*t, 0, False, []) for t in TEXTS], SCHEMA)
    own, plain = Segments(spark, f"file://{tmp_path}/index"), S.index(frame, keep=False)
    postings = S.by_record(frame)
    assert "Exchange" not in postings._jdf.queryExecution().toString()
    of = lambda df, *names: Counter(tuple(r) for r in df.select(*names).collect())
    own.add(frame)
    for found in (own.open(), (own.compact(), own.open())[1]):
        assert of(found.postings, "term", "field", "uri", "tf") == of(plain.postings, "term", "field", "uri", "tf")
        assert of(found.lengths, "uri", "field", "length") == of(plain.lengths, "uri", "field", "length")
        assert of(S.search(found, "the that", every=False), "uri", F.round("score", 9)) == of(S.search(plain, "the that", every=False), "uri", F.round("score", 9))
