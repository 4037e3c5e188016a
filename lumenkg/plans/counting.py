"""Numbers of sections and paragraphs by the counters that pages declare."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counters as C
from .registry import Queries

Q = Queries()
#: Definitions and examples count as theorems, set back by sections down to level 1; definitions of the style deep have a counter that nothing sets back; problems one that level 0 sets back; paragraphs do not count.
HEAD = (
    '<div data-kg-style="definition" data-kg-counter="thm"></div><div data-kg-style="example" data-kg-counter="thm"></div><div data-kg-style="definition-deep" data-kg-counter="deep"></div><div data-kg-style="problem" data-kg-counter="ex"></div>'
    '<div data-kg-style="paragraph" data-kg-counter=""></div><div data-kg-counter-parent="1" data-kg-counter="thm"></div><div data-kg-counter-parent="0" data-kg-counter="ex"></div>'
)


def pages_of(e):
    """A page for each document: before an element of a level below 3 a section of this level begins."""
    section = F.when(F.col("level") < 3, F.concat(F.lit('<section data-kg-section="'), "level", F.lit('" data-kg-id="s'), "ord", F.lit('"></section>'))).otherwise("")
    style = F.when(F.col("part") % 3 == 0, F.lit(' data-kg-styles="none,deep"')).otherwise("")
    one = F.concat(section, F.lit("<div data-kg-"), "kind", style, F.lit(' data-kg-id="e'), "ord", F.lit('">é</div>'))
    return e.groupBy("k", "doc").agg(F.concat(F.lit(HEAD), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "")).alias("html")).drop("k")


SQL = """WITH x AS (SELECT doc, ord, kind, level, CASE WHEN level < 3 THEN level END AS sec, CASE WHEN kind = 'definition' AND part % 3 = 0 THEN 'deep' WHEN kind IN ('definition', 'example') THEN 'thm' WHEN kind = 'problem' THEN 'ex' END AS c FROM {elements}),
a AS (SELECT *, count(*) FILTER (WHERE sec = 0) OVER w AS s0, count(*) FILTER (WHERE sec <= 1) OVER w AS upto1 FROM x WINDOW w AS (PARTITION BY doc ORDER BY ord)),
b AS (SELECT *, count(*) FILTER (WHERE sec = 1) OVER (PARTITION BY doc, s0 ORDER BY ord) AS s1, count(*) FILTER (WHERE sec = 2) OVER (PARTITION BY doc, upto1 ORDER BY ord) AS s2,
count(*) FILTER (WHERE c = 'thm') OVER (PARTITION BY doc, upto1 ORDER BY ord) AS thm, count(*) FILTER (WHERE c = 'ex') OVER (PARTITION BY doc, s0 ORDER BY ord) AS ex, count(*) FILTER (WHERE c = 'deep') OVER (PARTITION BY doc ORDER BY ord) AS deep FROM a)
SELECT doc, concat('s', ord) AS id, concat('section ', sec) AS counter, CASE sec WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS number, concat_ws('.', CASE WHEN s0 > 0 THEN CAST(s0 AS STRING) END, CASE WHEN sec >= 1 AND s1 > 0 THEN CAST(s1 AS STRING) END, CASE WHEN sec = 2 THEN CAST(s2 AS STRING) END) AS label FROM b WHERE sec IS NOT NULL
UNION ALL SELECT doc, concat('e', ord), c, CASE c WHEN 'thm' THEN thm WHEN 'ex' THEN ex ELSE deep END, concat_ws('.', CASE WHEN c <> 'deep' AND s0 > 0 THEN CAST(s0 AS STRING) END, CASE WHEN c = 'thm' AND s1 > 0 THEN CAST(s1 AS STRING) END, CASE c WHEN 'thm' THEN CAST(thm AS STRING) WHEN 'ex' THEN CAST(ex AS STRING) ELSE CAST(deep AS STRING) END) FROM b WHERE c IS NOT NULL"""
Q.add("doc_declared_counters", "elements:dealt", lambda e: C.page_numbers(pages_of(e)).select("doc", "id", "counter", "number", "label"), SQL)
