"""Annotated HTML as tables: tags with byte offsets, nodes with their nesting, and what the annotations say.

Tags and nodes are splits and windows; of whole pages, nodes with annotations are found where the page lies,
in one reading of its tags, so that other tags are never dealt or sorted. Annotations are attributes that start with a prefix; what follows it is a key of KEYS. Offsets are bytes of UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import ranges

PREFIX = "data-kg-"
# Keys that make a row of their own, in the order in which they are looked for, with the kind of the row.
KEYS = {
    "module": "module", "feature-structure": "structure", "feature-morphism": "morphism", "section": "section", "skipsection": "skipped", "definition": "definition", "paragraph": "paragraph", "assertion": "assertion", "example": "example",
    "problem": "problem", "subproblem": "subproblem", "slide": "slide", "slide-number": "slidenumber", "doctitle": "doctitle", "title": "title", "prooftitle": "title", "subprooftitle": "title", "symdecl": "symbol", "vardef": "variable", "varseq": "varseq",
    "notation": "notation", "notationcomp": "notationcomp", "notationopcomp": "notationopcomp", "definiendum": "definiendum", "type": "type", "conclusion": "conclusion", "definiens": "definiens", "rule": "rule", "argsep": "argsep", "argmap": "argmap", "argmap-sep": "argmapsep",
    "term": "term", "arg": "arg", "headterm": "headterm", "import": "import", "usemodule": "use", "inputref": "inputref", "sectionlevel": "sectionlevel", "style": "style", "counter-parent": "counter", "counter": "counter", "proof": "proof", "subproof": "subproof", "proofbody": "proofbody",
    "preconditiondimension": "precondition", "objectivedimension": "objective", "fillinsol": "fillin", "fillin-case": "fillincase", "solution": "solution", "problemhint": "hint", "problemgnote": "gradingnote", "multiple-choice-block": "multiple", "single-choice-block": "single",
    "problem-choice": "choice", "problem-choice-verdict": "verdict", "problem-choice-feedback": "feedback", "answerclass": "answerclass", "answerclass-feedback": "answerfeedback", "comp": "comp", "varcomp": "varcomp", "maincomp": "maincomp", "defcomp": "defcomp", "invisible": "invisible", "ifinputref": "ifinputref", "assign": "assign",
}
# Keys that are read with another one.
ARGUMENTS = ("preconditionsymbol", "objectivesymbol", "fillinsol-width", "fillin-case-value", "fillin-case-verdict", "answerclass-pts", "assoctype", "reorderargs", "argnum", "bind", "problempoints", "autogradable", "domain", "total", "argmode", "notationid", "head", "language", "metatheory", "signature", "args", "macroname", "inline", "fors", "id", "notationfragment", "precedence", "role", "styles", "argprecs", "proofhide")
#: Kinds that hold others and have a place in identifiers.
CONTAINERS = ("module", "structure", "morphism", "section", "slide", "definition", "paragraph", "assertion", "example", "proof", "subproof", "problem", "subproblem")
#: Containers of declarations.
CONTENT = ("module", "structure", "morphism")
# Fixed value: how the names of structures that extend another begin.
EXTENSION = "EXTSTRUCT"
PARAGRAPHS = ("definition", "paragraph", "assertion", "example", "proof", "subproof")
# Tags that are never closed.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def tags(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """doc, nth, start, stop (bytes of the tag), name, closing, void, text of the tag. Comments, and what is within scripts and styles, are left out."""
    parts = pages.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(html, F.lit("")), "<")).alias("nth", "part"))
    order = Window.partitionBy("doc").orderBy("nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("start", F.coalesce(F.sum(F.octet_length("part") + 1).over(before), F.lit(0)) - 1)
    note = F.when(F.col("part").startswith("!--") & ~F.contains("part", F.lit("-->")), True).when(F.contains("part", F.lit("-->")), False)
    raw = F.when(F.col("part").rlike(r"(?i)^(script|style)[\s>]"), True).when(F.col("part").rlike(r"(?i)^/(script|style)\s*>"), False)
    state = lambda c: F.coalesce(F.last(c, True).over(before), F.lit(False))
    own = own.withColumns({"note": note, "raw": raw}).withColumns({"in_note": state("note"), "in_raw": state("raw")})
    tag = F.regexp_extract("part", r"""^(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", 0)
    own = own.where("nth > 0 and not in_note and (not in_raw or raw = false)").select("doc", "nth", "start", tag.alias("text"))
    own = own.where(F.col("text").rlike("^/?[A-Za-z]"))
    name = F.lower(F.regexp_extract("text", "^/?([A-Za-z][A-Za-z0-9-]*)", 1))
    return own.select("doc", "nth", F.col("start").cast("long").alias("start"), (F.col("start") + 1 + F.octet_length("text")).cast("long").alias("stop"), name.alias("name"), F.col("text").startswith("/").alias("closing"), (name.isin(*VOID) | F.col("text").endswith("/>")).alias("void"), "text")


def nodes(found: DataFrame) -> DataFrame:
    """Elements: doc, nth, name, text of the tag, depth, start, inner_start, inner_stop, stop. stop is null where the closing tag is missing or another one."""
    upto = Window.partitionBy("doc").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("void"), 0).when(F.col("closing"), -1).otherwise(1)
    own = found.where("not (void and closing)").withColumn("sum", F.sum(step).over(upto))
    own = own.withColumn("depth", F.when(F.col("closing"), F.col("sum") + 1).when(F.col("void"), F.col("sum") + 1).otherwise(F.col("sum")))
    same = Window.partitionBy("doc", "depth", "void").orderBy("nth")
    after = F.lead(F.struct("start", "stop", "name", "closing")).over(same)
    own = own.withColumn("end", F.when(~F.col("void"), after)).where("not closing")
    good = F.col("end.closing") & (F.col("end.name") == F.col("name"))
    return own.select("doc", "nth", "name", "text", "depth", "start", F.col("stop").alias("inner_start"), F.when(F.col("void"), F.col("stop")).when(good, F.col("end.start")).alias("inner_stop"), F.when(F.col("void"), F.col("stop")).when(good, F.col("end.stop")).alias("stop"))


# A comment's beginning, or a tag: whether it closes, its name, and the rest of it, which is missing where the tag is not whole.
_TOKEN = re.compile(rb"""<(?:(!--)|(/?)([A-Za-z][A-Za-z0-9-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>)?)""")
_RAW, _RAW_END = re.compile(rb"(?:script|style)[\s>]", re.I), re.compile(rb"/(?:script|style)\s*>", re.I)
_VOID, _RAW_NAMES = frozenset(v.encode() for v in VOID), (b"script", b"style")
_NODE = "nth int, name string, depth int, start long, inner_start long, inner_stop long, stop long, attrs map<string,string>"
_NODE_TYPES = (pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4)


def patterns(prefix: str = PREFIX) -> tuple[bytes, re.Pattern]:
    """What rows_in() and marked_in() look for."""
    return prefix.lower().encode(), re.compile(rf"""\s{prefix}([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'))?""", re.I | re.A)


def read_pages(pages: DataFrame, doc: str, html: str, each: Callable[[Any, bytes], Iterable[Sequence]], columns: str, types: Sequence[pa.DataType], empty: bool = False) -> DataFrame:
    """The rows that each gives for a page (its doc and its bytes; of null and empty pages only with empty), with doc before them, page by page and in their order: nothing is shuffled. types: of the columns; maps come as lists of pairs, structs as tuples."""
    names = ["doc", *(c.split()[0] for c in re.split(r",\s*(?![^<]*>)", columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for k, (d, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())):
                if page or empty:
                    before = len(out)
                    out += each(d, page or b"")
                    which += [k] * (len(out) - before)
            if out:
                arrays = [_array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int32())), *arrays], names=names)

    return pages.select(F.col(doc).alias("doc"), html).mapInArrow(run, f"doc {pages.schema[doc].dataType.simpleString()}, {columns}")


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    if pa.types.is_map(kind):
        ends = list(accumulate(map(len, values), initial=0))
        flat = list(chain.from_iterable(values))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for k, _ in flat], kind.key_type), pa.array([v for _, v in flat], kind.item_type))
    if pa.types.is_struct(kind):
        none = (None,) * kind.num_fields
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(v or none for v in values)), kind)], fields=list(kind), mask=pa.array([v is None for v in values]))
    return pa.array(values, kind)


def marked(pages: DataFrame, doc: str = "doc", html: str = "html", prefix: str = PREFIX) -> DataFrame:
    """annotated() of the nodes() of the tags() of pages, page by page and in their order: one row a page is given, and nothing is shuffled."""
    looked = patterns(prefix)
    return read_pages(pages, doc, html, lambda _, page: marked_in(page, *looked), _NODE, (*_NODE_TYPES, pa.map_(pa.string(), pa.string())))


def _attrs(text: str, key: re.Pattern) -> list[tuple[str, str]]:
    """Keys and values of a tag, entities resolved; a key that comes twice counts once, as its first value."""
    found: dict[str, str] = {}
    for name, a, b in key.findall(text):
        value = a or b
        if "&" in value:
            value = value.replace("&quot;", '"').replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        found.setdefault(name, value)
    return list(found.items())


def marked_in(page: bytes, prefix: bytes, key: re.Pattern, asked: re.Pattern | None = None) -> list[list]:
    """nth, name, depth, start, inner_start, inner_stop, stop, attrs of the annotated elements of one page, or of those whose tags asked finds something in."""
    out, open_, depth = [], [], 0  # open_: name of each open element, and its row, if it has one
    first = page.split(b"<", 1)[0]
    raw = bool(_RAW.match(first))
    skip = _comment_end(page, 0) if first.startswith(b"!--") else 0  # tags before it lie in a comment
    nth = counted = 0
    least, names = len(prefix), _names
    for found in _TOKEN.finditer(page):
        note, slash, name, rest = found.groups()
        if note:
            at = found.start()
            if at >= skip:
                skip = _comment_end(page, at + 1)
            continue
        known = names.get(name)
        if known is None:
            low = name.lower()
            known = low, low in _VOID, low in _RAW_NAMES
            if len(names) < 10_000:
                names[name] = known
        name, void, script = known
        if script:
            at, within = found.start(), raw
            if slash:
                ends = bool(_RAW_END.match(page, at + 1))
                raw = raw and not ends
                if within and not ends:
                    continue
            else:
                raw = raw or bool(_RAW.match(page, at + 1))
                if within:
                    continue
        elif raw:
            continue
        if rest is None or (skip and found.start() < skip):
            continue
        void = void or rest[-2:] == b"/>"
        if slash:
            if not void:
                depth -= 1
                if open_:
                    own, row = open_.pop()
                    if row is not None and own == name:
                        row[5:7] = found.span()
            continue
        row = None
        if len(rest) > least and (prefix in rest or prefix in rest.lower()) and (asked is None or asked.search(rest)) and (attrs := _attrs(rest.decode(), key)):
            at, stop = found.span()
            nth += page.count(b"<", counted, at + 1)
            counted = at + 1
            row = [nth, name.decode(), depth + 1, at, stop, stop if void else None, stop if void else None, attrs]
            out.append(row)
        if not void:
            depth += 1
            open_.append((name, row))
    return out


#: Names of tags as they were met: in small letters, whether they are never closed, whether what is within is no tag.
_names: dict[bytes, tuple[bytes, bool, bool]] = {}


def _comment_end(page: bytes, at: int) -> int:
    end = page.find(b"-->", at)
    return len(page) if end < 0 else end


_HOLDS = frozenset(CONTAINERS)
_TURNS = {key: (n, key, kind) for n, (key, kind) in enumerate(KEYS.items(), 1)}
_ROW = f"{_NODE}, key string, kind string, turn int, parent int, {ranges.PATHS}, title struct<start:long,stop:long,text:string>"
_ROW_TYPES = (*_NODE_TYPES, pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())]))


def rows_in(doc: Any, page: bytes, prefix: bytes, key: re.Pattern, kinds: frozenset[str] | None = None, texts: bool = False, keys: frozenset[str] | None = None, asked: re.Pattern | None = None) -> list[tuple]:
    """The rows() of one page, see page_rows()."""
    place = ranges.Places(CONTAINERS, CONTENT, EXTENSION)
    out, heads = [], {}
    for node in marked_in(page, prefix, key, asked):
        attrs = node[7]
        ruled = [_TURNS[k] for k, _ in attrs if k in _TURNS]
        if len(ruled) > 1:
            ruled.sort()
        nth, _, _, start, inner_start, inner_stop, stop, _ = node
        of = dict(attrs)
        if keys is not None:
            node[7] = [x for x in attrs if x[0] in keys]
        for turn, name, kind in ruled:
            parent, *more = place(doc, nth, kind, start, stop, of.get("id") or None, of.get("feature-structure"))
            title = None
            if kind == "title" or kind == "doctitle":
                title = inner_start, inner_stop, page[inner_start:inner_stop].decode("utf-8", "replace") if texts and inner_stop is not None else None
                if kind == "title":
                    if parent is not None:
                        heads.setdefault(parent, title)
                    title = None
            if kinds is None or kind in kinds:
                out.append((*node, name, kind, turn, parent, *more, title))
    return [(*row[:-1], heads[row[0]]) if row[0] in heads and row[9] in _HOLDS else row for row in out]


def asked(kinds: frozenset[str], prefix: str = PREFIX) -> re.Pattern:
    """What tags hold that rows of the kinds, and where they are, are made of."""
    ruling = "|".join(k for k, kind in KEYS.items() if kind in kinds or kind in CONTAINERS or kind == "title")
    return re.compile(rf"{prefix}(?:{ruling})(?![a-z-])".encode(), re.I)


def page_rows(pages: DataFrame, doc: str = "doc", html: str = "html", prefix: str = PREFIX, kinds: Sequence[str] | None = None, texts: bool = False, keys: Sequence[str] | None = None) -> DataFrame:
    """rows() of marked() pages in one reading of each page, with title; nothing is shuffled or stored.

    title: of containers the range (inner_start to inner_stop) of the nearest title within, of titles of documents
    their own; with its text, where texts are asked for. kinds: the kinds of the rows that are wanted, all for None;
    keys: the annotations that attrs has, all for None.
    """
    looked, wanted, held = patterns(prefix), None if kinds is None else frozenset(kinds), None if keys is None else frozenset(keys)
    some = None if wanted is None else asked(wanted, prefix)
    return read_pages(pages, doc, html, lambda d, page: rows_in(d, page, *looked, wanted, texts, held, some), _ROW, _ROW_TYPES)


def annotated(found: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Nodes with annotations: the columns of nodes() and attrs, a map from key to value (entities resolved)."""
    pattern = rf"""(?i)\s{prefix}([a-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'))?"""
    part = lambda n: F.regexp_extract_all("text", F.lit(pattern), F.lit(n))
    clean = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    own = found.where(F.contains(F.lower("text"), F.lit(prefix))).withColumns({"ks": part(1), "vs": F.zip_with(part(2), part(3), lambda a, b: clean(F.concat(a, b)))})
    # a key that comes twice counts once, as its first value
    firsts = F.filter(F.sequence(F.lit(0), F.size("ks") - 1), lambda i: F.array_position("ks", F.get("ks", i)) == i + 1)
    pairs = F.map_from_arrays(F.transform(firsts, lambda i: F.get("ks", i)), F.transform(firsts, lambda i: F.get("vs", i)))
    return own.where(F.size("ks") > 0).withColumn("attrs", pairs).drop("ks", "vs", "text")


def rows(found: DataFrame, dealt: bool = False) -> DataFrame:
    """One row for each key with a rule: the columns of annotated(), key, kind and turn (its place in KEYS), and where it is.

    parent: nth of the nearest container around it; place: the container's identifier, null outside of all; level:
    how many containers are around it; id: of containers, that of the annotation, else their kind, with _1, _2, ...
    for those after the first of a document; content, extending: of imports, the identifier of the module, structure
    or morphism around them, and whether that is a structure whose name begins with EXTENSION. Of several
    containers at one tag the first in the order of KEYS is the one around what is within. dealt: pages lie whole
    and in their order, as marked() gives them, and need not be shuffled.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KEYS.items() for x in kv])
    turn = lambda key: F.array_position(F.array(*map(F.lit, KEYS)), key)
    ruled = F.array_sort(F.transform(F.filter(F.map_keys("attrs"), lambda key: F.try_element_at(kinds, key).isNotNull()), lambda key: F.struct(turn(key).alias("turn"), key.alias("key"))))
    own = found.withColumn("__key", F.explode(ruled)).withColumns({"key": F.col("__key.key"), "kind": F.try_element_at(kinds, F.col("__key.key")), "turn": F.col("__key.turn")}).drop("__key")
    own = own.withColumns({ranges.GIVEN: F.nullif(F.col("attrs")["id"], F.lit("")), ranges.NAME: F.col("attrs")["feature-structure"]})
    return stored(ranges.placed(own, CONTAINERS, CONTENT, EXTENSION, dealt), "rows")


def containers(own: DataFrame) -> DataFrame:
    """The containers of rows(): doc, nth, parent, kind, id, place, uri (doc and the ids from the outermost down), depth, ranges, fors, styles, attrs."""
    words = lambda key: F.filter(F.transform(F.split(F.coalesce(F.col("attrs")[key], F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    uri = F.concat(F.coalesce(F.concat("place", F.lit("/")), F.concat("doc", F.lit("&e="))), "id")
    return own.where(F.col("kind").isin(*CONTAINERS)).select("doc", "nth", "parent", "kind", "id", "place", uri.alias("uri"), F.col("level").alias("depth"), "start", "stop", F.array_distinct(words("fors")).alias("fors"), words("styles").alias("styles"), "attrs", *(["title"] if "title" in own.columns else []))


def elements(own: DataFrame, most_depth: int | None = None) -> DataFrame:
    """Containers: doc, nth, parent, kind, id, uri, depth, ranges, fors, styles, title (range of the nearest title within). With most_depth, an error is raised where they lie deeper. own: rows(), or page_rows(), which know titles."""
    if most_depth is not None and not own.where(F.col("kind").isin(*CONTAINERS) & (F.col("level") >= most_depth)).isEmpty():
        raise ValueError(f"a tree is deeper than {most_depth}")
    columns = ("doc", "nth", "parent", "kind", "id", "uri", "depth", "start", "stop", "fors", "styles", "title", "attrs")
    if "title" in own.columns:
        return containers(own).select(*columns)
    titles = own.where("kind = 'title' and parent is not null").groupBy("doc", F.col("parent").alias("nth")).agg(F.min_by(F.struct(F.col("inner_start").alias("start"), F.col("inner_stop").alias("stop")), "nth").alias("title"))
    out = containers(own).join(titles, ["doc", "nth"], "left")
    return out.select(*columns)


def triples(own: DataFrame, found: DataFrame | None = None, archive: Column | None = None, language: Column | None = None) -> DataFrame:
    """g, s, p, o: what documents, containers, declarations and references say. A row belongs to the container around it, or to its document.

    Imports belong to the module, structure or morphism around them, and are nothing outside of these; uses
    and inputs belong to the document. A structure whose name begins with EXTENSION extends the first module
    that it imports and that is no such structure itself. archive and language: of a document, by its ``doc``.
    Each row is read once and gives all that it says; found (elements()) need not be given, as rows know their places.
    """
    c = F.col
    text = lambda v: v.cast("string") if isinstance(v, Column) else F.lit(v)
    one = lambda s, p, o: F.struct(text(s).alias("s"), text(p).alias("p"), text(o).alias("o"))
    said = lambda df, *which: df.select(c("doc").alias("g"), F.explode(F.concat(*which)).alias("t")).select("g", "t.*")
    many = lambda *which: F.array(*which)
    none = F.array().cast("array<struct<s:string,p:string,o:string>>")

    of_doc = [one(c("doc"), "type", "document")]
    if archive is not None:
        of_doc.append(one(archive, "contains", c("doc")))
    if language is not None:
        of_doc.append(one(c("doc"), "language", language))
    out = said(own.select("doc").distinct(), many(*of_doc))

    types = {"module": "theory", "structure": "structure", "paragraph": "para"}
    kind = F.coalesce(*[F.when(c("kind") == k, v) for k, v in types.items()], c("kind"))
    like = c("kind").isin("definition", "assertion") | F.exists("styles", lambda s: s.rlike("^(symdoc|decl)"))
    fors = F.transform("fors", lambda f: one(c("uri"), F.when(like, "defines").otherwise("example-for"), f))
    domain = F.when(c("kind") == "morphism", many(one(c("uri"), "domain", c("attrs")["domain"])))
    held = containers(own).withColumn("place", F.coalesce("place", "doc"))
    out = out.unionByName(said(held, many(one(c("uri"), "type", kind), one(c("place"), "contains", c("uri"))), F.when(c("kind").isin(*PARAGRAPHS), fors).otherwise(none), F.coalesce(domain, none)))

    blank = F.concat(F.lit("_:"), F.sha2(F.concat_ws("|", "place", "kind", c("nth").cast("string")), 256))
    note = F.concat("place", F.lit("/notation_"), c("nth").cast("string"))
    goal = many(one(c("place"), c("kind"), blank), one(blank, "cognitive-dimension", F.concat(F.lit("cd-"), c("attrs")[F.concat("kind", F.lit("dimension"))])), one(blank, "po-symbol", c("attrs")[F.concat("kind", F.lit("symbol"))]))
    says = F.when(c("kind").isin("objective", "precondition"), goal)
    for kind_, p, key in (("use", "requires", "usemodule"), ("inputref", "hasPart", "inputref")):
        says = says.when(c("kind") == kind_, many(one(c("doc"), p, c("attrs")[key])))
    for kind_, key, type_ in (("symbol", "symdecl", "declaration"), ("variable", "vardef", "variable"), ("varseq", "varseq", "variable")):
        says = says.when(c("kind") == kind_, many(one(c("place"), "declares", c("attrs")[key]), one(c("attrs")[key], "type", type_)))
    says = says.when(c("kind") == "notation", many(one(note, "notation-for", c("attrs")["notation"]), one(note, "type", "notation"), one(c("place"), "declares", note)))
    says = says.when((c("kind") == "term") & (c("attrs")["term"] == "OMID"), many(one(c("place"), "crossrefs", c("attrs")["head"])))
    says = says.when((c("kind") == "import") & c("content").isNotNull(), many(one(c("content"), "imports", c("attrs")["import"])))
    out = out.unionByName(said(own.withColumn("place", F.coalesce("place", "doc")), F.coalesce(says, none)))

    extends = lambda name: F.startswith(F.element_at(F.split(name, "[/?]"), -1), F.lit(EXTENSION))
    first = own.where(c("extending") & ~extends(c("attrs")["import"])).groupBy("doc", "content").agg(F.min_by(c("attrs")["import"], "nth").alias("of"))
    out = out.unionByName(said(first, many(one(c("content"), "extends", c("of")))))
    return out.dropna().distinct()


def arity(args: Column) -> Column:
    """Modes of the arguments: a number of plain ones, or a letter (i, a, b, B) for each."""
    return F.when(args.rlike("^[0-9]$"), F.array_repeat(F.lit("i"), args.try_cast("int"))).when(args.rlike("^[iabB]{1,9}$"), F.filter(F.split(args, ""), lambda x: x != ""))


def declarations(own: DataFrame) -> DataFrame:
    """Symbols and variables: doc, nth, parent, kind, uri, arity, macroname, role, assoctype, reordering."""
    a = F.col("attrs")
    return own.where("kind in ('symbol', 'variable', 'varseq')").select("doc", "nth", "parent", "kind", F.coalesce(a["symdecl"], a["vardef"], a["varseq"]).alias("uri"), arity(a["args"]).alias("arity"), a["macroname"].alias("macroname"), F.split(a["role"], ",").alias("role"), a["assoctype"].alias("assoctype"), a["reorderargs"].alias("reordering"))


def terms(own: DataFrame) -> DataFrame:
    """Terms and their arguments as flat rows: doc, nth, tag (OMID, OMV, OMA, arg, ...), head, mode, number."""
    a = F.col("attrs")
    return own.where("kind in ('term', 'arg', 'headterm')").select("doc", "nth", "parent", F.coalesce(a["term"], "kind").alias("tag"), a["head"].alias("head"), a["argmode"].alias("mode"), a["arg"].alias("number"), a["notationid"].alias("notation"))


def notations(own: DataFrame) -> DataFrame:
    a = F.col("attrs")
    return own.where("kind = 'notation'").select("doc", "nth", a["notation"].alias("symbol"), a["notationfragment"].alias("id"), a["precedence"].try_cast("long").alias("precedence"), F.transform(F.split(a["argprecs"], ","), lambda x: F.trim(x).try_cast("long")).alias("argprecs"), "inner_start", "inner_stop")


def choices(own: DataFrame) -> DataFrame:
    """Choice blocks: doc, nth, parent (problem), multiple, choices (array of correct), by place within the block."""
    blocks = own.where("kind in ('multiple', 'single')").select("doc", F.col("nth").alias("block"), "parent", (F.col("kind") == "multiple").alias("multiple"), F.col("start").alias("a"), F.col("stop").alias("b"))
    one = own.where("kind = 'choice'").select("doc", "parent", "nth", "start", (F.col("attrs")["problem-choice"] == "true").alias("correct"))
    met = blocks.join(one, ["doc", "parent"]).where("start > a and start < b")
    return met.groupBy("doc", "block", "parent", "multiple").agg(F.array_sort(F.collect_list(F.struct("nth", "correct"))).alias("cs")).select("doc", F.col("block").alias("nth"), "parent", "multiple", F.transform("cs", lambda x: x["correct"]).alias("choices"))


def errors(found: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """doc, message: annotated elements that are not closed, and keys that are unknown. found: nodes(), or marked()."""
    own = found if "attrs" in found.columns else annotated(found, prefix)
    known = F.array(*[F.lit(k) for k in (*KEYS, *ARGUMENTS)])
    unknown = F.transform(F.array_except(F.map_keys("attrs"), known), lambda k: F.concat(F.lit("unknown key: "), k))
    every = F.concat(F.when(F.col("stop").isNull(), F.array(F.lit("unbalanced"))).otherwise(F.array().cast("array<string>")), unknown)
    return own.select("doc", F.explode(every).alias("message")).distinct()


def page_errors(pages: DataFrame, doc: str = "doc", html: str = "html", prefix: str = PREFIX) -> DataFrame:
    """errors() of pages, as one reading of each page finds them: nothing is shuffled, as a page is one row, with a doc of its own."""
    looked, known = patterns(prefix), frozenset((*KEYS, *ARGUMENTS))

    def each(_, page: bytes) -> list[tuple[str]]:
        found = marked_in(page, *looked)
        messages = {"unbalanced": None} if any(row[6] is None for row in found) else {}
        for row in found:
            for name, _ in row[7]:
                if name not in known:
                    messages[f"unknown key: {name}"] = None
        return [(m,) for m in messages]

    return read_pages(pages, doc, html, each, "message string", (pa.string(),))


def stylesheets(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """doc and its linked and inline style sheets, each once, in order."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<link\b[^>]*\brel="stylesheet"[^>]*\bhref="([^"]*)"""), F.lit(1))
    inline = F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)</style"), F.lit(1))
    return pages.select(F.col(doc).alias("doc"), F.array_distinct(F.concat(links, inline)).alias("css"))


def with_images(html: Column, base: str) -> Column:
    """Relative sources of images made absolute."""
    return F.regexp_replace(html, r"""(?i)(<img\b[^>]*\bsrc=")(?![a-z]+:|/)""", f"$1{base}")
