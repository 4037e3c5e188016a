"""Problems of pages: their parts, and their texts without them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import problems as P
from ..sources import html as H
from .registry import Queries

Q = Queries()
SOLUTION = ('<div data-kg-solution="" data-kg-answerclass="c', '">Lösung ', '<div data-kg-problemgnote="">inner ', "</div>!</div>")
NOTE = ('<div data-kg-problemgnote="">nöte<span data-kg-answerclass="" data-kg-id="AC', '" data-kg-answerclass-pts="', '"><i data-kg-answerclass-feedback="">fb ', "</i></span></div>")
CASE = ('<b data-kg-fillinsol="" data-kg-fillinsol-width="3">_<span data-kg-fillin-case="exact" data-kg-fillin-case-value="', '" data-kg-fillin-case-verdict="', '">ok</span></b>')


def pages_of(e):
    """A page for each document: problems hold a hint, a solution with a note inside, and each in its turn a note with an answer class, a fill-in, or two choices; the subproblem is within the problem before it."""
    part, ord, level = (F.col(c).cast("string") for c in ("part", "ord", "level"))
    solution = F.concat(F.lit(SOLUTION[0]), level, F.lit(SOLUTION[1]), part, F.lit(SOLUTION[2]), ord, F.lit(SOLUTION[3]))
    note = F.concat(F.lit(NOTE[0]), ord, F.lit(NOTE[1]), level, F.lit(NOTE[2]), part, F.lit(NOTE[3]))
    case = F.concat(F.lit(CASE[0]), part, F.lit(CASE[1]), (F.col("level") > 2).cast("string"), F.lit(CASE[2]))
    choice = F.concat(F.lit('<ul data-kg-multiple-choice-block="">'), *[F.concat(F.lit('<li data-kg-problem-choice="'), (F.col("level") % 2 == n).cast("string"), F.lit(f'">c{n}<em data-kg-problem-choice-verdict="">v{n}</em><em data-kg-problem-choice-feedback="">f'), part, F.lit("</em></li>")) for n in range(2)], F.lit("</ul>"))
    more = F.when(F.col("ord") % 3 == 0, note).when(F.col("ord") % 3 == 1, case).otherwise(choice)
    one = F.concat(F.lit('<div data-kg-problem="" data-kg-id="p'), ord, F.lit('">é'), ord, F.lit('<p data-kg-problemhint="">hint '), part, F.lit("</p>"), solution, more, F.lit("</div>"))
    own = e.where("kind in ('problem', 'subproblem')")
    return own.groupBy("k", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "\n").alias("html")).drop("k")


def _rows(e):
    return H.rows(H.marked(pages_of(e)), dealt=True)


def _parts(e):
    return P.page_parts(pages_of(e)).where("top").groupBy("doc", "id", "part", "name", "value", "flag", "html", "feedback", "verdict").agg(F.count("*").alias("n"))


def _texts(e):
    rows = _rows(e)
    ids = rows.where("kind = 'problem'").select("doc", "nth", F.col("attrs")["id"].alias("id"))
    return P.texts(rows, pages_of(e)).join(ids, ["doc", "nth"]).select("doc", "id", "text")


_X = "x AS (SELECT doc, ord, concat('p', ord) AS id, part, level FROM {elements} WHERE kind IN ('problem', 'subproblem'))"
_N = "CAST(NULL AS STRING)"
Q.add("extract_problem_parts", "elements:dealt", _parts, f"""WITH {_X}
SELECT doc, id, 'hint' AS part, {_N} AS name, {_N} AS value, CAST(NULL AS BOOLEAN) AS flag, concat('hint ', part) AS html, {_N} AS feedback, {_N} AS verdict, 1 AS n FROM x
UNION ALL SELECT doc, id, 'solution', concat('c', level), NULL, NULL, concat('Lösung ', part, '<div data-kg-problemgnote=""></div>!'), NULL, NULL, 1 FROM x
UNION ALL SELECT doc, id, 'note', NULL, NULL, NULL, concat('inner ', ord), NULL, NULL, 1 FROM x
UNION ALL SELECT doc, id, 'note', NULL, NULL, NULL, concat('nöte<span data-kg-answerclass="" data-kg-id="AC', ord, '" data-kg-answerclass-pts="', level, '"></span>'), NULL, NULL, 1 FROM x WHERE ord % 3 = 0
UNION ALL SELECT doc, id, 'class', concat('AC', ord), CAST(level AS STRING), NULL, NULL, concat('<i data-kg-answerclass-feedback="">fb ', part, '</i>'), NULL, 1 FROM x WHERE ord % 3 = 0
UNION ALL SELECT doc, id, 'fillin', NULL, '3', NULL, NULL, NULL, NULL, 1 FROM x WHERE ord % 3 = 1
UNION ALL SELECT doc, id, 'case', 'exact', CAST(part AS STRING), level > 2, NULL, NULL, NULL, 1 FROM x WHERE ord % 3 = 1
UNION ALL SELECT doc, id, 'block', NULL, NULL, true, NULL, NULL, NULL, 1 FROM x WHERE ord % 3 = 2
UNION ALL SELECT doc, id, 'choice', NULL, NULL, level % 2 = c, NULL, concat('<em data-kg-problem-choice-feedback="">f', part, '</em>'), concat('<em data-kg-problem-choice-verdict="">v', c, '</em>'), 1 FROM x, (SELECT 0 AS c UNION ALL SELECT 1) y WHERE ord % 3 = 2""")
Q.add("extract_problem_texts", "elements", _texts, f"""WITH {_X} SELECT doc, id, concat('<div data-kg-problem="" data-kg-id="', id, '">é', ord, '<p data-kg-problemhint="">hint ', part, '</p><div data-kg-solution="" data-kg-answerclass="c', level, '"></div>',
CASE ord % 3 WHEN 0 THEN '<div data-kg-problemgnote=""></div>' WHEN 1 THEN '<b data-kg-fillinsol="" data-kg-fillinsol-width="3">_</b>' ELSE concat('<ul data-kg-multiple-choice-block=""><li data-kg-problem-choice="', CASE WHEN level % 2 = 0 THEN 'true' ELSE 'false' END, '">c0</li><li data-kg-problem-choice="', CASE WHEN level % 2 = 1 THEN 'true' ELSE 'false' END, '">c1</li></ul>') END, '</div>') AS text FROM x""")


def _feedback(e):
    rows = _rows(e)
    ids = rows.where("kind = 'problem'").select("doc", F.col("nth").alias("problem"), F.col("attrs")["id"].alias("id"))
    option = lambda o: F.concat_ws("|", o["is_correct"].cast("string"), o["verdict"], o["feedback"], F.coalesce(o["kind"], F.lit("-")), F.coalesce(o["value"], F.lit("-")))
    data = F.array_join(F.transform("data", lambda d: F.concat(d["kind"], F.lit(":"), F.array_join(F.transform(d["options"], option), ";"))), "\n")
    return P.default_feedback(P.parts(rows, pages_of(e))).join(ids, ["doc", "problem"]).select("doc", "id", "correct", "score", F.array_join("solutions", "\n").alias("solutions"), F.coalesce(data, F.lit("")).alias("data"))


Q.add("grade_default_feedback", "elements", _feedback, f"""WITH {_X} SELECT doc, id, false AS correct, CAST(0 AS DOUBLE) AS score, concat('Lösung ', part, '<div data-kg-problemgnote=""></div>!') AS solutions, CASE ord % 3 WHEN 1 THEN concat('fillin:', CASE WHEN level > 2 THEN 'true' ELSE 'false' END, '|||exact|', part)
WHEN 2 THEN concat('multiple:', CASE WHEN level % 2 = 0 THEN 'true' ELSE 'false' END, '|<em data-kg-problem-choice-verdict="">v0</em>|<em data-kg-problem-choice-feedback="">f', part, '</em>|-|-;', CASE WHEN level % 2 = 1 THEN 'true' ELSE 'false' END, '|<em data-kg-problem-choice-verdict="">v1</em>|<em data-kg-problem-choice-feedback="">f', part, '</em>|-|-') ELSE '' END AS data FROM x""")
