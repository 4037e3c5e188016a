"""Full-text search over the documents and pages at hand."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators import segments as G
from ..sources import html as H
from ..storage import shared_dir
from .extraction import _rows, pages_of
from .registry import Queries

Q = Queries()
#: Written without braces, which mark the names of tables.
RUNS = "[\\pL\\pN]+"
POST = f"""tok AS (SELECT uri, 'title' AS field, regexp_extract_all(lower(title), '{RUNS}') AS ts FROM r UNION ALL SELECT uri, 'body', regexp_extract_all(lower(body), '{RUNS}') FROM r),
len AS (SELECT uri, field, len(ts) AS length FROM tok),
post AS (SELECT term, field, uri, count(*) AS tf FROM (SELECT uri, field, unnest(ts) AS term FROM tok) x GROUP BY term, field, uri)"""
WORDS = ("the", "that")


def _score(terms: tuple[str, ...], where: str = "", every: bool = True) -> str:
    named = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH r AS (SELECT * FROM {{records}}), {POST}, h AS (SELECT * FROM post WHERE term IN ({named})),
w AS (SELECT h.field, h.term, count(*) AS df FROM h GROUP BY h.field, h.term), a AS (SELECT field, count(*) AS n, avg(length) AS average FROM len GROUP BY field),
s AS (SELECT h.uri, sum(ln(1 + (a.n - w.df + 0.5) / (w.df + 0.5)) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * len.length / a.average))) AS score, count(DISTINCT h.term) AS met
FROM h JOIN w ON h.field = w.field AND h.term = w.term JOIN a ON a.field = h.field JOIN len ON len.uri = h.uri AND len.field = h.field JOIN r ON r.uri = h.uri {where} GROUP BY h.uri)
SELECT uri, round(score, 6) AS score FROM s {f"WHERE met = {len(terms)}" if every else ""}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


Q.add("search_html_to_text", "pages", lambda p: p.select("page_id", T.html_to_text(F.col("html")).alias("text")))
Q.add("search_index_build", "records", lambda r: S.index(r, keep=False).postings, f"WITH r AS (SELECT * FROM {{records}}), {POST} SELECT * FROM post")
Q.add("search_def_like", "elements", lambda e: e.select("uri", S.def_like(F.col("kind"), F.array(F.concat(F.when(F.col("level") == 3, "symdoc-").otherwise("plain-"), F.col("level")))).alias("def_like")), "SELECT uri, kind IN ('definition', 'assertion') OR level = 3 AS def_like FROM {elements}")
Q.add("search_index_stats", "records", lambda r: S.statistics(S.index(r, keep=False)).withColumn("average", F.round("average", 6)), f"WITH r AS (SELECT * FROM {{records}}), {POST} SELECT len.field, count(*) AS n, round(avg(length), 6) AS average, max(t.terms) AS terms, max(t.tokens) AS tokens FROM len LEFT JOIN (SELECT field, count(DISTINCT term) AS terms, sum(tf) AS tokens FROM post GROUP BY field) t ON t.field = len.field GROUP BY len.field")
Q.add("search_topk", "records", lambda r: _rounded(S.search(S.index(r, keep=False), "the that", k=20, every=False)), _score(WORDS, every=False) + " ORDER BY s.score DESC, uri LIMIT 20")
Q.add("search_filtered", "records", lambda r: _rounded(S.search(S.index(r, keep=False), "the that", kinds=(1, 3, 4), definition_like=True)), _score(WORDS, "AND r.kind IN (1, 3, 4) AND r.def_like"))
Q.add("search_conjunctive", "records", lambda r: _rounded(S.search(S.index(r, keep=False), "The thing licensed")), _score(("the", "thing", "licensed")))
Q.add("search_phrase", "records", lambda r: S.phrase(S.index(r, keep=False, positions=True), ["of", "the"]), f"WITH r AS (SELECT * FROM {{records}}), {POST}, x AS (SELECT uri, unnest(ts) AS term, generate_subscripts(ts, 1) AS at FROM tok WHERE field = 'body') SELECT DISTINCT a.uri AS uri FROM x a JOIN x b ON a.uri = b.uri AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the'")
_fors = lambda r: r.withColumn("fors", F.array(F.concat(F.lit("sym/"), F.col("id") % 17), F.concat(F.lit("sym/"), F.col("id") % 5)))
Q.add("search_symbols", "records", lambda r: S.search_symbols(S.index(_fors(r), keep=False), "the that", k=10, definition_like=True).drop("nth"), "WITH top AS (SELECT *, row_number() OVER (ORDER BY score DESC, uri) AS rank FROM (" + _score(WORDS, "AND r.def_like").replace("round(score, 6) AS score", "score") + "\nORDER BY score DESC, uri LIMIT 20) y), h AS (SELECT rank, uri, 0 AS nth, concat('sym/', CAST(split_part(uri, '/', 2) AS BIGINT) % 17) AS symbol FROM top UNION ALL SELECT rank, uri, 1, concat('sym/', CAST(split_part(uri, '/', 2) AS BIGINT) % 5) FROM top) SELECT symbol, min(rank) AS rank, string_agg(uri, ',' ORDER BY rank) AS uris FROM h GROUP BY symbol ORDER BY min(rank * 2 + nth) LIMIT 10")


def _grown(r):
    """Additions, new texts of what is there, a deletion and a compaction, then a search."""
    own = G.Segments(r.sparkSession, f"{shared_dir(r.sparkSession)}/index-{uuid.uuid4().hex}")
    rows = r.withColumn("fors", F.array().cast("array<string>"))
    own.add(rows.where("id % 2 = 0").withColumn("body", F.concat(F.lit("the that the "), "title")))
    own.add(rows.where("id % 2 = 1"))
    own.delete(rows.where("id % 7 = 3"))
    own.compact()
    own.add(rows.where("id % 2 = 0 and id % 7 != 3"))
    return _rounded(S.search(own.open(), "the that", every=False))


_LIVING = _score(WORDS, every=False).replace("SELECT * FROM {records}", "SELECT * FROM {records} WHERE id % 7 <> 3")
Q.add("search_incremental", "records", _grown, _LIVING)


def _ranked(r):
    """All records that hold the words, by rank, without a task that orders all of them."""
    return S.placed(S.scored(S.index(r, keep=False), list(WORDS), every=False).withColumn("score", F.round("score", 6)), F.desc("score"), F.col("uri"))


Q.add("search_ranks", "records", _ranked, f"SELECT uri, score, CAST(row_number() OVER (ORDER BY score DESC, uri) AS INT) AS rank FROM ({_score(WORDS, every=False)}) s")
Q.add("search_records", "elements", lambda e: G.records(H.elements(_rows(e)), pages_of(e)).select("uri", F.coalesce("title", F.lit("")).alias("title"), "body", "kind", "def_like", F.concat_ws(",", "fors").alias("fors")), "SELECT doc AS uri, '' AS title, concat(string_agg(concat('é ', ord, 'x < y'), '' ORDER BY ord), chr(10)) AS body, 0 AS kind, false AS def_like, '' AS fors FROM {elements} GROUP BY doc UNION ALL SELECT concat(doc, '&e=s/e', ord), concat('é ', ord), concat('é ', ord, 'x < y', chr(10)), CASE kind WHEN 'paragraph' THEN 1 WHEN 'definition' THEN 2 ELSE 3 END, kind = 'definition', concat('sym/', part) FROM {elements} WHERE kind IN ('paragraph', 'definition', 'example')")
