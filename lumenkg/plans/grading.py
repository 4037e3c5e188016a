"""Grading over choices and answers derived from labels, line items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading as G
from .registry import Queries

Q = Queries()
_choices = lambda n: F.array(*[F.struct((F.get(F.col("bits"), i) == 1).alias("correct")) for i in range(n)])
_l = lambda l: l.select("doc_id", F.array("quality", "toxic", F.col("quality").bitwiseXOR(F.col("toxic"))).alias("bits"), (F.col("doc_id") % 5).cast("int").alias("pick"), F.array(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 == 0).alias("picks"))
BITS = "b AS (SELECT doc_id, quality = 1 AS c0, toxic = 1 AS c1, quality <> toxic AS c2, doc_id % 5 AS pick, doc_id % 2 = 0 AS p0, doc_id % 3 = 0 AS p1, doc_id % 7 = 0 AS p2 FROM {labels})"
SINGLE = "CASE pick WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 END"
SAME = "(CAST(c0 = p0 AS INT) + CAST(c1 = p1 AS INT) + CAST(c2 = p2 AS INT))"
Q.add("grade_single", "labels", lambda l: _l(l).select("doc_id", G.single(_choices(3), F.col("pick")).alias("m")).select("doc_id", F.col("m.points").cast("double").alias("points"), "m.correct"), f"WITH {BITS} SELECT doc_id, CASE WHEN {SINGLE} THEN 1.0 ELSE 0.0 END::DOUBLE AS points, coalesce({SINGLE}, true) AS correct FROM b")
Q.add("grade_multiple", "labels", lambda l: _l(l).select("doc_id", G.multiple(_choices(3), F.col("picks")).alias("m")).select("doc_id", F.round(F.col("m.points").cast("double"), 5).alias("points"), "m.correct"), f"WITH {BITS} SELECT doc_id, CASE WHEN p0 OR p1 OR p2 THEN round(greatest((2 * {SAME} - 3) / 3.0, 0), 5) ELSE 0 END::DOUBLE AS points, {SAME} = 3 AS correct FROM b")
_cases = lambda: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"), F.lit(lo).cast("float").alias("lo"), F.lit(hi).cast("float").alias("hi"), F.lit(w).alias("verdict")) for k, v, lo, hi, w in (("exact", "7", None, None, True), ("range", None, 10.0, 20.0, True), ("range", None, 30.0, None, False), ("regex", "^4[0-9]", None, None, True), ("regex", "3", None, None, True))])
_answer = lambda: F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.format_string("%.2f", "l_quantity"))
Q.add("grade_fillin", "lineitem", lambda l: l.select("l_orderkey", "l_partkey", "l_suppkey", _answer().alias("answer"), G.fillin(_cases(), _answer()).alias("m")).groupBy("answer").agg(F.count("*").alias("n"), F.sum(F.col("m.points").cast("double")).alias("points")), "WITH a AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) ELSE printf('%.2f', l_quantity) END AS answer FROM {lineitem}) SELECT answer, count(*) AS n, CAST(sum(CASE WHEN answer = '7' THEN 1 WHEN CAST(answer AS DOUBLE) BETWEEN 10 AND 20 THEN 1 WHEN CAST(answer AS DOUBLE) >= 30 THEN 0 WHEN answer LIKE '4_%' AND substring(answer, 2, 1) BETWEEN '0' AND '9' THEN 1 WHEN answer LIKE '%3%' THEN 1 ELSE 0 END) AS DOUBLE) AS points FROM a GROUP BY answer")


def _batch(l):
    own = _l(l)
    items = own.select("doc_id", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("tag"), F.lit(m).alias("multiple")) for o, t, m in ((0, "choice", False), (1, "solution", False), (2, "choice", True), (3, "fillin", False))])).alias("i"), _choices(3).alias("choices")).select("doc_id", "i.*", "choices", _cases().alias("cases"))
    given = own.select("doc_id", "pick", "picks", F.posexplode(F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("single"), F.lit("multiple"))).otherwise(F.array(F.lit("single"), F.lit("multiple"), F.lit("text")))).alias("ord", "tag"))
    return G.graded(items, given.select("doc_id", F.lit("s").alias("submission"), "ord", "tag", "picks", "pick", (F.col("doc_id") % 50).cast("string").alias("text")), "doc_id").where("score is not null").withColumn("score", F.round("score", 5)).drop("submission")


TEXT = "CASE WHEN doc_id % 50 = 7 THEN 1 WHEN doc_id % 50 BETWEEN 10 AND 20 THEN 1 WHEN doc_id % 50 >= 30 THEN 0 WHEN doc_id % 50 IN (3, 23) THEN 1 ELSE 0 END"
Q.add("grade_batch", "labels", _batch, f"WITH {BITS}, m AS (SELECT doc_id, CASE WHEN {SINGLE} THEN 1.0 ELSE 0.0 END AS a, CASE WHEN p0 OR p1 OR p2 THEN greatest((2 * {SAME} - 3) / 3.0, 0) ELSE 0 END AS b, {TEXT} AS c, coalesce({SINGLE}, true) AND {SAME} = 3 AND {TEXT} = 1 AS correct FROM b WHERE doc_id % 11 <> 0) SELECT doc_id, CAST(round((a + b + c) / 3, 5) AS DOUBLE) AS score, correct FROM m")
Q.add("grade_answer_kind", "lineitem", lambda l: l.select(F.concat(F.when(F.col("l_linenumber") % 3 == 0, "+").when(F.col("l_linenumber") % 3 == 1, "-").otherwise("c"), F.col("l_quantity").cast("int")).alias("text")).distinct().select("text", G.answer_kind(F.col("text")).alias("a")).select("text", "a.kind", F.coalesce(F.col("a.points").cast("double"), F.lit(0.0)).alias("points")), "SELECT DISTINCT concat(CASE l_linenumber % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'c' END, CAST(l_quantity AS INT)) AS text, CASE WHEN l_linenumber % 3 = 2 THEN 'class' ELSE 'trait' END AS kind, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN -l_quantity ELSE 0 END AS points FROM {lineitem}")
