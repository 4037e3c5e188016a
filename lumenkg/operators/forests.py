"""Folding of forests: nested values (JSON of quizzes, structures, outlines) made level by level from the leaves.

A node's value is made of its own columns and the values of its children in their order. Each level is one
grouping by parents and one join, so there are as many rounds as a tree is deep; what a round reads and writes
is one level. A value holds all that is below its node: the root's is the document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stored, tidy
from .trees import PLACE_DIGITS


def folded(nodes: DataFrame, make: Callable[[Column], Column], keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """nodes (keys, node, parent, ord, depth and others) with value: make() of the array of the children's values, in order; an empty array for leaves.

    Nodes whose parent is no node come to nothing above. Depths start at 0 and are one more than the parent's.
    """
    return _folded(nodes, make, keys)


@tidy
def _folded(nodes: DataFrame, make: Callable[[Column], Column], keys: tuple[str, ...]) -> DataFrame:
    nodes = stored(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    kind = nodes.withColumn("value", make(F.array())).schema["value"].dataType if deepest is None else nodes.select(make(F.array()).alias("value")).schema["value"].dataType
    nothing = F.array().cast(f"array<{kind.simpleString()}>")
    out = below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is None:
            level = here.withColumn("value", make(nothing))
        else:
            kids = below.where("parent is not null").groupBy(*keys, F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node", "value"))), lambda x: x["value"]).alias("__kids"))
            level = here.join(kids, [*keys, "node"], "left").withColumn("value", make(F.coalesce("__kids", nothing))).drop("__kids")
        below = stored(level, "folded")
        out = below if out is None else out.unionByName(below)
    return nodes.withColumn("value", make(nothing)) if out is None else out


def opened(tree: DataFrame, roots: DataFrame, ends: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of roots (root) with those of the documents that they take in: root, node (key), parent, ord, depth and the other columns of tree.

    tree: doc, path (array of places), kind, target (the document that an inputref takes in, else null) and
    others. A document within itself is not opened again; ``missing`` is true where a target has no nodes.
    Which documents a root opens, and where, is found from inputrefs alone; nodes are joined to that once.
    ends: kinds below which nothing is looked at: what a document has there is left out before it is opened.
    """
    tree = tree.withColumn("key", F.transform("path", lambda p: F.lpad(p.cast("string"), PLACE_DIGITS, "0"))).drop("path")
    docs = tree.select(F.col("doc").alias("target")).distinct().withColumn("__known", F.lit(True))
    # a target that is null is not dealt by: most nodes have none
    entries = tree.where("target is null").withColumn("missing", F.lit(False)).unionByName(tree.where("target is not null").join(docs, "target", "left").withColumn("missing", F.col("__known").isNull()).drop("__known"))
    if ends:  # in the order of keys a node's subtree is one run, so a node lies in one iff the farthest end before it is behind it
        end = F.when(F.col("kind").isin(*ends), F.struct(F.concat("key", F.array(F.lit("~"))).alias("end"), "key"))
        entries = entries.withColumn("__end", F.max(end).over(Window.partitionBy("doc").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)))
        entries = entries.where("__end is null or __end.end < key or __end.key = key").drop("__end")
    found = _visits(tree, roots).join(entries, "doc").withColumn("key", F.concat("above", "key"))
    text = lambda k: F.array_join(k, ".")
    up = F.slice("key", F.lit(1), F.size("key") - 1)
    return found.select("root", text(F.col("key")).alias("node"), F.when(F.size("key") > 1, text(up)).alias("parent"), F.element_at("key", -1).alias("ord"), (F.size("key") - 1).alias("depth"), "missing", *[c for c in tree.columns if c != "key"])


@tidy
def _visits(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """root, doc, above (key of the inputref, none for the root itself): each document that a root opens, as often as it does."""
    docs = tree.select("doc").distinct()
    inputs = tree.where("kind = 'inputref'").select("doc", "key", "target")
    inputs = stored(inputs.join(docs.select(F.col("doc").alias("target")), "target", "left_semi").select("doc", "key", "target"), "inputs")
    level = roots.select("root", F.col("root").alias("doc"), F.array().cast("array<string>").alias("above"), F.array("root").alias("trail"))
    visits = None
    for _ in count():
        level = stored(level, "visits")
        if level.isEmpty():
            break
        visits = level if visits is None else visits.unionByName(level)
        level = level.join(inputs, "doc").where("not array_contains(trail, target)").select("root", F.col("target").alias("doc"), F.concat("above", "key").alias("above"), F.concat("trail", F.array("target")).alias("trail"))
    return (level if visits is None else visits).drop("trail")


# -- quizzes

Pieces = tuple[str, int, list[tuple[str, int]]]


def _pieces(kids: list[Pieces]) -> Pieces:
    """One list of several: its text, how many elements it has, and while it is a single section, what that holds."""
    full = [k for k in kids if k[1]]
    n = sum(k[1] for k in full)
    return ",".join(k[0] for k in full), n, full[0][2] if n == 1 else []


def _bare(own: Pieces) -> Pieces:
    """A list that is one section alone is what that holds."""
    return (*own[2][0], own[2][1:]) if own[1] == 1 and own[2] else own


def _quizzed(kind: str | None, title: str | None, html: str, uri: str, in_problem: bool, kids: list[Pieces]) -> Pieces:
    """What a node gives to what is around it; title, html and uri are quoted."""
    if kind == "paragraph":
        return f'{{"Paragraph":{{"html":{html}}}}}', 1, []
    if kind == "problem":
        return ("", 0, []) if in_problem else _pieces([(f'{{"Problem":{{"uri":{uri},"html":{html}}}}}', 1, []), *kids])
    inner = _pieces(kids)
    if kind == "section" and title is not None:
        return f'{{"Section":{{"title":{title},"elements":[{inner[0]}]}}}}', 1, [inner[:2], *inner[2]]
    return _bare(inner) if kind == "inputref" else inner


def _folded_quizzes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quiz of each root, of rows sorted by root and node: only what is open at a row is kept, and what is done of the root at hand."""
    columns = ("root", "node", "parent", "kind", "title", "html", "uri", "name", "solution", "solved", "target", "missing")
    root, seen, stack, top, solutions, errors = None, False, [], [], {}, ([], [])

    def close() -> None:
        # an open node: its name, what gives its value, its children's values, and whether it is not shown, in a problem, or stands for a node of the tree
        node, own, kids, hidden, in_problem, whole = stack.pop()
        if hidden:
            return
        value = _quizzed(*own, in_problem, kids)
        if whole and stack:
            stack[-1][2].append(value)
        elif whole:
            top.append(value)

    def done() -> tuple | None:
        while stack:
            close()
        if not top_seen:
            return None
        error = min(errors[0], default=None)
        error = min(errors[1], default=None) if error is None else error
        quiz = None
        if error is None:
            found = ",".join(x for _, x in sorted(solutions.items(), key=lambda x: (*x[0][:2], json.loads(x[0][2]))))
            quiz = f'{{"elements":[{_bare(_pieces(top))[0]}],"solutions":{{{found}}}}}'
        return root, quiz, error

    top_seen = False
    for batch in batches:
        out = []
        for r, node, parent, kind, title, html, uri, name, solution, solved, target, missing in zip(*(batch.column(c).to_pylist() for c in columns)):
            if not seen or r != root:
                if seen and (row := done()):
                    out.append(row)
                root, seen, top_seen, top, solutions, errors = r, True, False, [], {}, ([], [])
            while stack and not node.startswith(stack[-1][0] + "."):
                close()
            in_problem = hidden = False
            if stack:
                _, (above, *_), _, hidden, within, _ = stack[-1]
                hidden = hidden or above == "paragraph" or (above == "problem" and within)
                in_problem = above == "problem" or (within and above != "inputref")
            whole = parent is None or (bool(stack) and stack[-1][0] == parent)
            stack.append((node, (kind, title, html, uri), [], hidden, in_problem, whole))
            top_seen = top_seen or parent is None
            if hidden:
                continue
            if kind == "problem" and solved:
                solutions[(name is not None, name or "", solution)] = f"{uri}:{solution}"
            elif kind == "problem" and name is not None:
                errors[1].append(f"no solution: {name}")
            if missing:
                errors[0].append(f"missing document: {target}")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["root", "quiz", "error"])
    if seen and (row := done()):
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in row], names=["root", "quiz", "error"])


def needed(tree: DataFrame) -> DataFrame:
    """tree or forest without the titles, texts, names and solutions that quizzes() has no use for at a node's kind."""
    of = {"title": ("section",), "html": ("paragraph", "problem"), "uri": ("problem",), "solution": ("problem",)}
    return tree.withColumns({c: F.when(F.col("kind").isin(*kinds), F.col(c)) for c, kinds in of.items()})


def quizzes(forest: DataFrame) -> DataFrame:
    """root, quiz (JSON of elements and solutions) and error, of opened() nodes with title, html, uri and solution.

    Sections with a title hold their elements; others, and documents that are taken in, give them to what is
    around them. Paragraphs and problems are elements. A problem within a problem gives its solution only;
    what is below it, or below a paragraph, is not looked at. A document that is one section is what that
    holds. error: a document that is missing, or else a problem without a solution.
    """
    text = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    quoted = lambda c: F.substr(text(c), F.lit(2), F.length(text(c)) - 2)
    shown = lambda c, *kinds: F.when(F.col("kind").isin(*kinds), c)
    # dealt as it is, without what a kind has no use for; quotes, and what node and uri say once more, come after that
    last = F.substring_index("node", ".", -1)
    over = F.when(F.contains("node", F.lit(".")), F.substr("node", F.lit(1), F.length("node") - F.length(last) - 1))
    odd = F.when(~F.col("parent").eqNullSafe(over), F.coalesce("parent", F.lit("")))
    own = needed(forest).where("root is not null").select(
        "root", "node", odd.alias("odd"), "kind", "title", "html", F.col("uri").alias("name"), F.col("solution").alias("answer"), F.when(F.col("missing"), F.col("target")).alias("target"), F.nullif("missing", F.lit(False)).alias("missing"),
    ).repartition("root").sortWithinPartitions("root", "node")
    own = own.select(
        "root", "node", F.when(F.col("odd").isNull(), over).otherwise(F.nullif("odd", F.lit(""))).alias("parent"), "kind", F.when(F.col("title").isNotNull(), quoted(F.col("title"))).alias("title"), shown(quoted(F.col("html")), "paragraph", "problem").alias("html"), shown(quoted(F.col("name")), "problem").alias("uri"),
        "name", shown(quoted(F.col("answer")), "problem").alias("solution"), F.col("answer").isNotNull().alias("solved"), "target", F.coalesce("missing", F.lit(False)).alias("missing"),
    )
    return own.mapInArrow(_folded_quizzes, "root string, quiz string, error string")


def structures(nodes: DataFrame, *columns: str, tops: bool = False) -> DataFrame:
    """nodes (doc, node, parent, ord) with depth and value: JSON of the columns (nulls left out) and of all below, as ``children``. tops: only nodes without a parent.

    A document's nodes are folded where they meet, as the value of its root holds them all. Nodes under a
    parent that does not exist are left out; cycles are an error.
    """
    own = nodes.withColumn("__own", F.to_json(F.struct(*columns)))
    schema = StructType([*own.drop("__own").schema.fields, *StructType.fromDDL("depth int, value string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the document that the next batch may go on with
        for batch in batches:
            docs = batch.column("doc")
            if held and docs[0].as_py() == held[-1].column("doc")[0].as_py() and docs[len(docs) - 1].as_py() == docs[0].as_py():
                held.append(batch)
                continue
            known = docs.to_pylist()
            last = known.index(known[-1])
            if last:
                yield from _valued([*held, batch.slice(0, last)], tops)
                held = []
            elif held:
                yield from _valued(held, tops)
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _valued(held, tops)

    return own.where("doc is not null and node is not null").repartition("doc").sortWithinPartitions("doc").mapInArrow(run, schema)


def _valued(held: list[pa.RecordBatch], tops: bool) -> list[pa.RecordBatch]:
    """The rows of whole documents with depth and value."""
    rows = pa.Table.from_batches(held)
    docs, node, parent, ord, text = (rows.column(c).to_pylist() for c in ("doc", "node", "parent", "ord", "__own"))
    cuts = [0, *(k for k in range(1, len(docs)) if docs[k] != docs[k - 1]), len(docs)]
    places, depths, values = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        below: dict = {}
        for k in sorted(range(a, b), key=lambda k: (ord[k] is not None, ord[k], node[k])):
            below.setdefault(parent[k], []).append(k)
        order = [(k, 0) for k in below.pop(None, [])]
        for k, depth in order:  # grows: from the roots down
            order += [(c, depth + 1) for c in below.pop(node[k], [])]
        if below:
            _ends({node[k]: p for p, ks in below.items() for k in ks})
        kids: dict = {}
        for k, depth in reversed(order):
            inner = ",".join(reversed(kids.pop(node[k], [])))
            head = text[k][:-1]
            value = f'{head}{"," if len(head) > 1 else ""}"children":[{inner}]}}'
            kids.setdefault(parent[k], []).append(value)
            if not tops or not depth:
                places.append(k)
                depths.append(depth)
                values.append(value)
    if not places:
        return []
    return rows.drop_columns(["__own"]).take(pa.array(places)).append_column("depth", pa.array(depths, pa.int32())).append_column("value", pa.array(values, pa.string())).combine_chunks().to_batches()


def _ends(above: dict) -> None:
    """Nodes under no root (by name, their parents) must end at a parent that does not exist."""
    done: set = set()
    for name in above:
        trail: set = set()
        while name in above and name not in done:
            if name in trail:
                raise ValueError("a tree that is none: a cycle")
            trail.add(name)
            name = above[name]
        done |= trail
