"""Parts of problems, as one reading of a page finds them, are those of the general job."""

from __future__ import annotations

import random

from lumenkg.operators import problems as P
from lumenkg.sources import html as H

OPEN = [
    '<div data-kg-problem="" data-kg-id="p">', '<div data-kg-problem="">', '<div data-kg-subproblem="" data-kg-id="q">', '<div data-kg-problemhint="">', '<div data-kg-solution="" data-kg-answerclass="c">', '<div data-kg-solution="">', '<div data-kg-problemgnote="">',
    '<div data-kg-answerclass="" data-kg-id="AC" data-kg-answerclass-pts="2">', '<div data-kg-answerclass-feedback="">', '<div data-kg-multiple-choice-block="">', '<div data-kg-single-choice-block="">', '<div data-kg-problem-choice="TRUE">', '<div data-kg-problem-choice="?">',
    '<div data-kg-problem-choice-verdict="">', '<div data-kg-problem-choice-feedback="">', '<div data-kg-fillinsol="" data-kg-fillinsol-width="3">', '<div data-kg-fillin-case="exact" data-kg-fillin-case-value="1" data-kg-fillin-case-verdict="no">', '<div data-kg-fillin-case="" data-kg-fillin-case-verdict="false">',
]


def _page(rng, depth=0):
    out = []
    while rng.random() < (0.85 if depth < 4 else 0.1):
        out.append(f"{rng.choice(OPEN)}{rng.choice(('é', '&lt;', ''))}{_page(rng, depth + 1)}{'</div>' if rng.random() < 0.98 else '</p>'}")
    return "".join(out)


def test_same_as_parts(spark):
    rng = random.Random(11)
    pages = [(f"d{n}", _page(rng)[:20_000]) for n in range(60)]
    df = spark.createDataFrame(pages, "doc string, html string").repartition(3)
    rows = H.rows(H.marked(df), dealt=True)
    want = P.parts(rows, df)
    got = P.page_parts(df)
    key = lambda f: sorted(map(repr, f.select(want.columns).collect()))
    assert key(got) == key(want) and want.count() > 300 and want.where("feedback is not null").count() > 3
    ids = {(r.doc, r.nth): r.id for r in rows.where("kind = 'problem'").selectExpr("doc", "nth", "attrs['id'] as id").collect()}
    assert all(((r.doc, r.problem) in ids) == r.top and ids.get((r.doc, r.problem)) == r.id for r in got.collect())


def test_nothing_is_dealt_or_stored(spark, monkeypatch):
    monkeypatch.setattr(P, "stored", None)
    found = P.page_parts(spark.createDataFrame([("d", "<p>")], "doc string, html string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
