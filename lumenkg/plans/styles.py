"""Style sheets of modules, made of the parts at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import styles as S
from .registry import Queries

Q = Queries()
NAMES = (*S.BEGINNINGS, *S.NAMES, "other", "zeta", "problem-x", "section-x")


def _sheets(p):
    name = F.concat(F.lit("kg-"), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_size") % len(NAMES) + 1).cast("int")))
    kind = F.when(F.col("p_partkey") % 5 == 0, "link").when(F.col("p_partkey") % 5 == 1, "inline").otherwise("class")
    return p.select(F.col("p_brand").alias("module"), kind.alias("kind"), F.when(kind == "class", name).alias("name"), F.concat(F.lit("css"), F.col("p_size") % 11).alias("css"))


_CASE = " ".join(f"WHEN {n} THEN 'kg-{name}'" for n, name in enumerate(NAMES))
_RANK = " ".join(f"WHEN name LIKE 'kg-{b}%' THEN {n + 1}" for n, b in enumerate(S.BEGINNINGS)) + " " + " ".join(f"WHEN name = 'kg-{b}' THEN {n + 6}" for n, b in enumerate(S.NAMES))
Q.add("css_merged", "part", lambda p: S.merged(_sheets(p), "module").select("module", F.array_join(F.transform("sheets", lambda s: F.concat_ws(" ", s["kind"], s["name"], s["css"])), ";").alias("sheets")), f"""WITH a AS (SELECT p_brand AS module, CASE p_partkey % 5 WHEN 0 THEN 'link' WHEN 1 THEN 'inline' ELSE 'class' END AS kind, CASE p_size % {len(NAMES)} {_CASE} END AS name, concat('css', p_size % 11) AS css FROM {{part}}),
b AS (SELECT DISTINCT module, kind, CASE WHEN kind = 'class' THEN name END AS name, css FROM a),
c AS (SELECT *, CASE kind WHEN 'link' THEN 1 WHEN 'inline' THEN 2 ELSE 3 END AS k, CASE WHEN kind <> 'class' THEN 0 {_RANK} ELSE 0 END AS r FROM b)
SELECT module, string_agg(concat_ws(' ', kind, name, css), ';' ORDER BY k, r, name, css) AS sheets FROM c GROUP BY module""")
