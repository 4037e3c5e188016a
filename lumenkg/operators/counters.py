"""Numbering by counters that documents declare: which styles count with which counter, and which sections set it back.

A section level is a counter, too, that all higher sections set back, so there are as many levels as documents
have. A running number is a scan: what a block of rows does to a counter is a map, either n more, or set back
and then n; such maps compose, so blocks are summed up first, the maps of blocks are composed, and within a
block numbers go on from there. No task has to hold more than a block, or the maps of one counter's blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import html as H

#: Rows of a block.
BLOCK = 4096
# Fixed value: what a cast to a number leaves out at the ends.
_BLANK = "".join(map(chr, range(33))) + "\x7f"


def running(rows: DataFrame, keys: tuple[str, ...], ord: str, adds: Column, resets: Column, name: str = "number", block: int = BLOCK) -> DataFrame:
    """rows with a running number by keys: a row that resets begins at 0 again, and one that adds is one more. ord: a whole number, unique within the keys."""
    own = rows.withColumns({"__add": adds.cast("int"), "__reset": resets.cast("int"), "__block": F.floor(F.col(ord) / block)})
    upto = Window.partitionBy(*keys, "__block").orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("__epoch", F.sum("__reset").over(upto))
    own = own.withColumn("__here", F.sum("__add").over(Window.partitionBy(*keys, "__block", "__epoch").orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.struct("__epoch", "__here")
    maps = own.groupBy(*keys, "__block").agg(F.max(last).alias("__last"))  # of an epoch's rows the last has the most
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    maps = maps.withColumn("__run", F.sum((F.col("__last.__epoch") > 0).cast("int")).over(before))
    carried = F.sum("__last.__here").over(Window.partitionBy(*keys, "__run").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    maps = maps.withColumn("__after", carried)
    maps = maps.withColumn("__carry", F.coalesce(F.lag("__after").over(Window.partitionBy(*keys).orderBy("__block")), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block") == F.col("__b")]
    right = maps.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), "__carry")
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = own.join(right, on)
    number = F.col("__here") + F.when(F.col("__epoch") == 0, F.col("__carry")).otherwise(0)
    return out.select(*rows.columns, number.cast("int").alias(name))


def styles(rows: DataFrame) -> DataFrame:
    """doc, style (kind or kind-name), counter: the style declarations of annotated rows. Without a counter, or with an empty one, a style does not count; of two for one style the later holds."""
    own = rows.where("key = 'style'").select("doc", "nth", F.col("attrs")["style"].alias("style"), F.nullif(F.col("attrs")["counter"], F.lit("")).alias("counter"))
    return own.groupBy("doc", "style").agg(F.max_by("counter", "nth").alias("counter"))


def parents(rows: DataFrame) -> DataFrame:
    """doc, counter, parent: the section level that sets a counter back; null for none. A declaration without a counter says nothing; of two the later holds."""
    own = rows.where("key = 'counter-parent'").select("doc", "nth", F.nullif(F.col("attrs")["counter"], F.lit("")).alias("counter"), F.col("attrs")["counter-parent"].try_cast("int").alias("parent"))
    return own.where("counter is not null").groupBy("doc", "counter").agg(F.max_by(F.struct("parent"), "nth")["parent"].alias("parent"))


def counted(elements: DataFrame, declared: DataFrame) -> DataFrame:
    """elements (doc, node, kind, styles) that count: doc, node, counter, by the first of kind-style in their order that is declared, else by the kind."""
    names = F.concat(F.transform("styles", lambda s: F.concat("kind", F.lit("-"), s)), F.array("kind"))
    own = elements.where("kind != 'section'").select("doc", "node", F.posexplode(names).alias("turn", "style")).join(declared, ["doc", "style"])
    first = own.groupBy("doc", "node").agg(F.min_by(F.struct("counter"), "turn")["counter"].alias("counter"))
    return first.where("counter is not null")


def numbers(elements: DataFrame, declared: DataFrame, counters: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc, node, counter, number, label of sections and of elements that count, in the order of nodes.

    elements: doc, node (a number that rises through the document), kind, level (of sections), styles.
    declared: styles(); counters: parents(). A section counts in its level and is labelled by the numbers of
    the levels down to its own, without those that are 0; another element by those of the sections down to its
    counter's parent, and its own number. A counter that is not declared is set back by nothing.
    """
    sections = elements.where("kind = 'section' and level is not null").select("doc", "node", "level")
    levels = sections.select("doc", "level").distinct()
    marks = counted(elements, declared)
    used = marks.select("doc", "counter").distinct().join(counters, ["doc", "counter"], "left").select("doc", "counter", "parent")
    every = used.unionByName(levels.select("doc", F.concat(F.lit("\x00"), "level").alias("counter"), (F.col("level") - 1).alias("parent")))
    adds = marks.select("doc", "node", "counter").unionByName(sections.select("doc", "node", F.concat(F.lit("\x00"), "level").alias("counter")))
    adds = adds.withColumns({"add": F.lit(True), "reset": F.lit(False)})
    back = sections.join(every, "doc").where("level <= parent").select("doc", "node", "counter", F.lit(False).alias("add"), F.lit(True).alias("reset"))
    steps = adds.unionByName(back)
    run = running(steps, ("doc", "counter"), "node", F.col("add"), F.col("reset"), block=block)
    own = run.where("add").join(every, ["doc", "counter"], "left").select("doc", "node", "counter", "number", F.coalesce("parent", F.lit(-1)).alias("parent"))
    # the sections that an element is in: of each level the last before it that no higher one has ended
    of_level = run.where("add and counter like '\x00%'").select("doc", "node", F.expr("int(substring(counter, 2))").alias("level"), "number")
    asked = own.select("doc", "node", "counter", "parent").join(levels, "doc").where("level <= parent").select("doc", "node", "counter", "level")
    events = asked.select("doc", "level", "node", "counter", F.lit(0).alias("turn"), F.lit(None).cast("int").alias("n"))
    events = events.unionByName(of_level.select("doc", "level", "node", F.lit(None).cast("string").alias("counter"), F.lit(1).alias("turn"), F.col("number").alias("n")))
    ended = sections.withColumnRenamed("level", "by").join(levels, "doc").where("by < level").select("doc", "level", "node", F.lit(None).cast("string").alias("counter"), F.lit(1).alias("turn"), F.lit(0).alias("n"))
    latest = F.last("n", True).over(Window.partitionBy("doc", "level").orderBy("node", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = events.unionByName(ended).withColumn("n", latest).where("turn = 0 and n > 0")
    above = known.groupBy("doc", "node", "counter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "n"))), lambda x: x["n"].cast("string")), ".").alias("above"))
    out = own.join(above, ["doc", "node", "counter"], "left")
    name = F.when(F.col("counter").startswith("\x00"), F.concat(F.lit("section "), F.expr("substring(counter, 2)"))).otherwise(F.col("counter"))
    return out.select("doc", "node", name.alias("counter"), "number", F.concat_ws(".", "above", F.col("number").cast("string")).alias("label"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """numbers() of the elements of annotated pages (doc, html), as one reading of each page finds them, with the id of each: doc, node, id, counter, number, label.

    A task holds what is counted of one page, which is one row; nothing is shuffled.
    """
    looked, wanted = H.patterns(), frozenset((*H.CONTAINERS, "style", "counter"))
    asked, holds = H.asked(wanted), frozenset(H.CONTAINERS)

    def each(doc, page: bytes) -> list[tuple]:
        rows = []
        for row in H.rows_in(doc, page, *looked, kinds=wanted, asked=asked):
            nth, of, key, kind = row[0], dict(row[7]), row[8], row[9]
            if kind in holds:
                rows.append((nth, kind, key, _whole(of.get("section")) if kind == "section" else None, of.get("styles"), None, of.get("id")))
            elif key in ("style", "counter-parent"):
                rows.append((nth, kind, key, _whole(of.get("counter-parent")), of.get("style"), of.get("counter") or None, None))
        return _numbered(rows)

    return H.read_pages(pages, "doc", "html", each, "node int, id string, counter string, number int, label string", (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()))


def _whole(text: str | None) -> int | None:
    """The text as Spark casts it to an int; None where it cannot."""
    text = (text or "").strip(_BLANK)
    number = int(text) if re.fullmatch("[+-]?[0-9]+", text) else None
    return number if number is not None and -(2**31) <= number < 2**31 else None


def _numbered(rows: Iterable[tuple]) -> list[tuple]:
    """node, id, counter, number, label of one page's rows (nth, kind, key, level or parent, style or styles, counter, id), see numbers()."""
    declared, above, elements = {}, {}, []
    for nth, kind, key, level, styles_, counter, ident in rows:
        if key == "style":
            declared[styles_] = counter
        elif key == "counter-parent":
            if counter is not None:
                above[counter] = level
        else:
            elements.append((nth, kind, level, styles_, ident))
    out, levels, counts = [], {}, {}
    for nth, group in groupby(elements, key=lambda e: e[0]):
        before, turns = levels, []
        for n, (_, kind, level, styles_, ident) in enumerate(group):
            if kind != "section":
                names = (f"{kind}-{x.strip(' ')}" for x in (styles_ or "").split(",") if x.strip(" "))
                turns += [(turn, n, declared[name], ident) for turn, name in enumerate((*names, kind)) if name in declared][:1]
            elif level is not None:
                number = levels.get(level, 0) + 1
                label = _label(levels, level - 1, number)
                levels = {at: c for at, c in levels.items() if at < level} | {level: number}
                counts = {c: k for c, k in counts.items() if above.get(c) is None or level > above[c]}
                out.append((nth, ident, f"section {level}", number, label))
        if turns and (counter := min(turns, key=lambda t: t[:2])[2]) is not None:
            counts[counter] = number = counts.get(counter, 0) + 1
            parent = above.get(counter)
            out.append((nth, turns[0][3], counter, number, _label(before, -1 if parent is None else parent, number)))
    return out


def _label(levels: dict[int, int], down_to: int, number: int) -> str:
    return ".".join(str(x) for x in (*(levels[at] for at in sorted(levels) if at <= down_to), number))
