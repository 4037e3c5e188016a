"""What is dealt of quizzes: nothing that is not looked at, and no column twice."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lumenkg.operators import forests as O


def test_what_is_below_ends_is_left_out(spark):
    rng, rows = random.Random(4), []

    def grow(doc, path):
        for n in range(rng.randint(0, 3) if len(path) < 4 else 0):
            kind = rng.choice(("section", "paragraph", "problem", "inputref"))
            own = [*path, n]
            rows.append((doc, own, kind, "t" if rng.random() < 0.5 else None, "h", f"{doc}/{own}", "s" if rng.random() < 0.9 else None, f"d{rng.randrange(40)}" if kind == "inputref" else None))
            if kind != "inputref":
                grow(doc, own)

    for d in range(30):
        grow(f"d{d}", [])
    rows += [("twice", [0], "paragraph", None, "a", "u", None, None), ("twice", [0], "paragraph", None, "b", "v", None, None)]
    tree = spark.createDataFrame(rows, "doc string, path array<int>, kind string, title string, html string, uri string, solution string, target string").repartition(3)
    roots = tree.select(F.col("doc").alias("root")).distinct()
    every, some = O.opened(tree, roots), O.opened(O.needed(tree), roots, ("paragraph",))
    assert some.columns == every.columns and some.count() < every.count()
    quizzes = lambda f: {r.root: (r.quiz and "".join(sorted(r.quiz)) if r.root == "twice" else r.quiz, r.error) for r in O.quizzes(f).collect()}
    assert quizzes(some) == quizzes(every) and sum(q is not None for q, _ in quizzes(some).values()) > 3


def test_columns_are_dealt_once(spark):
    nodes = spark.createDataFrame([("r", "1", None, "problem", "t", "h", "u", "s", None, False)], "root string, node string, parent string, kind string, title string, html string, uri string, solution string, target string, missing boolean")
    plan = O.quizzes(nodes)._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in plan[plan.index("Exchange hashpartitioning(root") :].splitlines()[1:] if "Project" in line)
    assert "to_json" not in dealt and " AS uri" not in dealt and " AS solution" not in dealt
    assert O.quizzes(nodes).first().quiz == '{"elements":[{"Problem":{"uri":"u","html":"h"}}],"solutions":{"u":"s"}}'
