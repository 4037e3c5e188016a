"""Documents as tables of nodes: doc, node, parent, ord (place among its siblings), kind; orders, numbers and contents."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import html as H
from ..storage import stored
from .closure import rooted_paths

#: Digits of the largest whole number that a place can be.
PLACE_DIGITS = 19

# Section levels from the highest.
SECTION_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


def paths(nodes: DataFrame, most_depth: int = 1 << 20) -> DataFrame:
    """nodes with path (places from the root down) and depth."""
    known = rooted_paths(nodes.withColumn("part", F.col("ord")), most_depth)
    return nodes.join(known, ["doc", "node"]).withColumn("depth", F.size("path") - 1)


def depth_first(tree: DataFrame) -> DataFrame:
    return tree.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("path")))


def breadth_first(tree: DataFrame) -> DataFrame:
    return tree.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("depth", "path")))


def within(tree: DataFrame, doc: str, path: Column | list[int]) -> DataFrame:
    """The nodes below a path, itself among them."""
    path = F.array(*map(F.lit, path)) if isinstance(path, list) else path
    return tree.where((F.col("doc") == doc) & (F.slice("path", F.lit(1), F.size(path)) == path))


def section_numbers(elements: DataFrame, keys: tuple[str, ...] = ("doc",), ord: str = "ord", level: str = "level") -> DataFrame:
    """elements with number (of its level) and label, for rows with a level (0 to 6).

    A section counts on from the last of its level since a higher one, but that parts and chapters do not
    reset each other.
    """
    upto = Window.partitionBy(*keys).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what a level counts since it was set back is what it counts in all, less what it had counted then: one order for all levels
    is_level = lambda k: F.coalesce(F.col(level) == k, F.lit(False))
    higher = lambda k: F.coalesce((F.col(level) < k) & ~((F.col(level) == 0) & F.lit(k == 1)), F.lit(False))
    out = elements.withColumns({f"__all{k}": F.count_if(is_level(k)).over(upto) for k in range(7)})
    out = out.withColumns({f"__then{k}": F.max(F.when(higher(k), F.col(f"__all{k}"))).over(upto) for k in range(7)})
    n = [F.col(f"__all{k}") - F.coalesce(f"__then{k}", F.lit(0)) for k in range(7)]
    number = F.coalesce(*[F.when(F.col(level) == k, n[k]) for k in range(7)])
    label = F.concat_ws(".", *[F.when((F.col(level) >= k) & (n[k] > 0), n[k].cast("string")) for k in range(7)])
    return out.withColumns({"number": number, "label": F.when(F.col(level).isNotNull(), label)}).drop(*[f"__{x}{k}" for x in ("all", "then") for k in range(7)])


def counters(elements: DataFrame, counted: Column, resets: Column, keys: tuple[str, ...] = ("doc",), ord: str = "ord", name: str = "number") -> DataFrame:
    """A running number of the counted rows, which starts anew with each row that resets."""
    upto = Window.partitionBy(*keys).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = elements.withColumn("__all", F.count_if(counted).over(upto))
    own = own.withColumn("__then", F.max(F.when(resets, F.col("__all") - F.coalesce(counted, F.lit(False)).cast("int"))).over(upto))
    return own.withColumn(name, F.when(counted, F.col("__all") - F.coalesce("__then", F.lit(0)))).drop("__all", "__then")


def fragments(ranges: DataFrame, html: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """The text of byte ranges (doc, start, stop): html holds doc and html, whose UTF-8 bytes are cut."""
    own = ranges.join(html.select("doc", F.encode("html", "UTF-8").alias("__raw")), "doc")
    return own.withColumn("fragment", F.decode(F.substring("__raw", F.col(start) + 1, F.col(stop) - F.col(start)), "UTF-8")).drop("__raw")


#: Kinds of elements that can have a title.
TITLED = ("section", "definition", "paragraph", "assertion", "example", "proof", "subproof", "problem", "subproblem")


def titles(elements: DataFrame, heads: DataFrame, html: DataFrame, kinds: tuple[str, ...] = TITLED) -> DataFrame:
    """uri, title (a fragment of the page, empty where there is none) of documents, by their names, and of elements of the kinds; others have no row.

    elements: doc, kind, uri, title (start, stop).  heads: doc, start, stop of titles of documents; the first counts.
    html: doc, html, one row a document; a null page has empty titles. Ranges that lie outside of the page are cut at
    its ends. A page is read once, for all of its titles.
    """
    own = elements.where(F.col("kind").isin(*kinds)).select("doc", "uri", F.col("title.start").cast("long").alias("start"), F.col("title.stop").cast("long").alias("stop"))
    first = heads.where("start is not null and stop is not null").groupBy("doc").agg(F.min(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))).alias("head"))
    docs = html.select("doc").join(first, "doc", "left").select("doc", F.col("doc").alias("uri"), "head.start", "head.stop")
    ranges = own.unionByName(docs).groupBy("doc").agg(F.collect_list(F.struct("uri", "start", "stop")).alias("ranges"))
    pages = html.select("doc", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("raw"))
    cut = lambda x: F.decode(F.substring("raw", x["start"] + 1, F.greatest(x["stop"] - x["start"], F.lit(0))), "UTF-8")
    each = ranges.join(pages, "doc").select(F.explode(F.transform("ranges", lambda x: F.struct(x["uri"].alias("uri"), F.coalesce(cut(x), F.lit("")).alias("title")))).alias("t"))
    return each.select("t.uri", "t.title")


def page_titles(pages: DataFrame, kinds: tuple[str, ...] = TITLED) -> DataFrame:
    """titles() of annotated pages (doc, html), one row a document, as one reading of each page finds them; nothing is shuffled."""
    patterns, holds = H.patterns(), frozenset(H.CONTAINERS)
    wanted, none = frozenset([*H.CONTAINERS, "doctitle"]), frozenset()
    asked = H.asked(wanted)

    def each(doc, page: bytes) -> list[tuple]:
        found = H.rows_in(doc, page, *patterns, wanted, True, none, asked)
        heads = min((row[-1] for row in found if row[9] == "doctitle" and row[-1][1] is not None), default=None)
        out = [(f"{doc}", heads[2] if heads else "")]
        for row in found:
            if row[9] in holds and row[9] in kinds:
                ident, place, title = row[12], row[13], row[-1]
                out.append((f"{place}/{ident}" if place else f"{doc}&e={ident}", title[2] if title and title[2] is not None else ""))
        return out

    return H.read_pages(pages, "doc", "html", each, "uri string, title string", (pa.string(), pa.string()), empty=True).select("uri", "title")


def contents(tree: DataFrame, parts: DataFrame, roots: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Tables of contents of roots (root): root, path (of nodes), doc, node, kind, title.

    tree: doc, node, path, kind, title, target (document of an inputref). parts are the edges (doc,
    target) that occur. Inputs are replaced by the contents of what they name, which may nest; entries
    without a title that hold nothing are left out, and a document within itself is not opened again.
    """
    entries = tree.where(F.col("kind").isin("section", "inputref", "skipped", "slide", "paragraph")).select("doc", "node", "path", "kind", "title", "target")
    text = F.transform("path", lambda p: F.lpad(p.cast("string"), PLACE_DIGITS, "0"))
    entries = stored(entries.withColumn("key", F.array_join(text, ".")).drop("path"), "entries")
    level = roots.select("root", F.col("root").alias("doc"), F.lit("").alias("key"), F.array("root").alias("trail"))
    found = None
    for n in count():
        if most_rounds is not None and n > most_rounds:
            raise ValueError(f"not finished after {most_rounds} rounds")
        own = level.withColumnRenamed("key", "above").join(entries, "doc").withColumn("key", F.concat_ws(".", F.nullif("above", F.lit("")), "key")).drop("above")
        own = stored(own, "contents")
        found = own if found is None else found.unionByName(own)
        level = own.where("kind = 'inputref' and target is not null and not array_contains(trail, target)").select("root", F.col("target").alias("doc"), "key", F.concat("trail", F.array("target")).alias("trail"))
        if level.isEmpty():  # trails end: no document is within itself
            break
    # what is above an entry that stays, stays
    real = found.where("kind not in ('inputref', 'skipped') and (kind != 'section' or title is not null)")
    above = real.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("key", r"\."))), lambda n: F.array_join(F.slice(F.split("key", r"\."), F.lit(1), n), "."))).alias("key")).distinct()
    return found.drop("trail").join(above, ["root", "key"], "left_semi")


def quiz(elements: DataFrame) -> DataFrame:
    """Per document: problems in order with the solutions of problems within them; null where a problem has no solution at all."""
    problems = elements.where("kind in ('problem', 'subproblem')")
    outer = F.last(F.when(F.col("kind") == "problem", F.col("ord")), True).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = problems.withColumn("outer", F.coalesce(outer, F.col("ord")))
    per = own.groupBy("doc", "outer").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("ord", "solution"))).alias("solutions"))
    whole = per.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("outer", "parts", F.transform("solutions", lambda s: s["solution"]).alias("solutions")))).alias("problems"))
    return whole.withColumn("error", F.exists("problems", lambda p: F.forall(p["solutions"], lambda s: s.isNull())))


def resolved(links: DataFrame, known: DataFrame) -> DataFrame:
    """links (…, target) with resolved: whether the target is known (uri)."""
    return links.join(known.select(F.col("uri").alias("target")).distinct().withColumn("__there", F.lit(True)), "target", "left").withColumn("resolved", F.coalesce("__there", F.lit(False))).drop("__there")
