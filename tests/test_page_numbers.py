"""Counters of pages that lie whole are those of the general job, and need no shuffle."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumenkg.operators import counters as C
from lumenkg.sources import html as H

KINDS = ("definition", "example", "problem", "paragraph")


def _page(rng):
    out = []
    for _ in range(rng.randint(0, 40)):
        kind, name = rng.choice(KINDS), rng.choice(("", "-x", "-y"))
        out.append(
            rng.choice(
                (
                    f'<i data-kg-style="{kind}{name}" data-kg-counter="{rng.choice(("a", "b", "c", ""))}"></i>', f'<i data-kg-counter-parent="{rng.choice(("0", "1", "2", "no", "-1"))}" data-kg-counter="{rng.choice("abc")}"></i>',
                    f'<section data-kg-section="{rng.choice(("0", "1", "2", "3", " +2 ", "x", "2.5", "99999999999", "\u00b2", "-2"))}" data-kg-id="s"></section>', f'<p data-kg-{kind}="" data-kg-styles="{rng.choice(("", "x", "z, y", " y,x"))}" data-kg-id="p">', "</p>",
                )
            )
        )
    return "".join(out)


def test_same_as_numbers(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(f"d{n}", _page(rng)) for n in range(200)], "doc string, html string").repartition(3)
    rows = H.rows(H.marked(df), dealt=True)
    split = F.filter(F.transform(F.split(F.coalesce(F.col("attrs")["styles"], F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    own = rows.where(F.col("kind").isin(*H.CONTAINERS)).select("doc", F.col("nth").alias("node"), "kind", F.col("attrs")["section"].try_cast("int").alias("level"), split.alias("styles"))
    want = sorted(map(tuple, C.numbers(own, C.styles(rows), C.parents(rows)).collect()))
    found = C.page_numbers(df)
    assert sorted((r.doc, r.node, r.counter, r.number, r.label) for r in found.collect()) == want and len(want) > 500
    assert {r.id for r in found.collect()} == {"s", "p"}


def test_nothing_is_dealt(spark):
    found = C.page_numbers(spark.createDataFrame([("d", "<p>")], "doc string, html string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
