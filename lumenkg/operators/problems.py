"""What problems of annotated pages hold: solutions, hints, grading notes with answer classes, choices, fill-in cases.

The texts of solutions and notes are cut out of what is around them. That is a subtraction of intervals by a
sweep: holes of one nesting level never overlap, so the bytes that are left of a document are its pieces
between them, and a range lies in what is left at its ends less all holes before them. Each level is one
pass over a document's holes; no range meets each hole. Spark brings a page, its ranges and its holes together.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import html as H
from ..sources.ranges import Around, around
from ..storage import stored

# Kinds whose content is cut out, and those that are cut out with their tags.
INNER = ("solution", "gradingnote")
WHOLE = ("answerfeedback", "verdict", "feedback", "fillincase")


def holes(rows: DataFrame) -> DataFrame:
    """doc, nth, start, stop (bytes): what is cut out."""
    own = rows.where(F.col("kind").isin(*INNER, *WHOLE) & F.col("stop").isNotNull())
    inner = F.col("kind").isin(*INNER)
    return own.select("doc", "nth", F.when(inner, F.col("inner_start")).otherwise(F.col("start")).alias("start"), F.when(inner, F.col("inner_stop")).otherwise(F.col("stop")).alias("stop")).distinct().where("stop > start")


def _left(raw: bytes, ranges: list[tuple[int, int, int]], holes: list[tuple[int, int]]) -> list[str]:
    """The texts of ranges (nth, start, stop) of one page without the holes within them: of each level the page is cut once, and a range lies in what is left at its ends less all holes before them."""
    starts, stops = sorted(h[0] for h in holes), sorted(h[1] for h in holes)
    level = lambda at: bisect_right(starts, at) - bisect_right(stops, at)
    gaps: dict[int, list[tuple[int, int]]] = {}
    for a, b in sorted(holes):
        gaps.setdefault(level(a) - 1, []).append((a, b))
    cut: dict[int, tuple[bytes, list[int], list[int]]] = {}
    for n, of in gaps.items():
        ends, before = [b for _, b in of], [0]
        for a, b in of:
            before.append(before[-1] + b - a)
        cut[n] = b"".join(raw[a:b] for a, b in zip([0, *ends], [*(a for a, _ in of), len(raw)])), ends, before
    out = []
    for _, a, b in ranges:
        left, ends, before = cut.get(level(a), (raw, [], [0]))
        out.append(left[a - before[bisect_right(ends, a)] : b - before[bisect_right(ends, b)]].decode("utf-8", "replace"))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ranges = [(r["nth"], r["start"], r["stop"]) for r in row["ranges"]]
            texts_ = [None] * len(ranges) if row["html"] is None else _left(row["html"].encode(), ranges, [(h["start"], h["stop"]) for h in row["holes"] or []])
            nths, starts, stops = zip(*ranges)
            yield pa.RecordBatch.from_arrays([pa.array([row["doc"]] * len(ranges), batch.schema.field("doc").type), pa.array(nths, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(texts_, pa.string())], names=["doc", "nth", "start", "stop", "text"])


def stripped(ranges: DataFrame, cut: DataFrame, pages: DataFrame) -> DataFrame:
    """ranges (doc, nth, start, stop) with text: their bytes of pages (doc, html) without the holes (cut: doc, start, stop) within them.

    A range that is itself a hole, or in one, keeps what is its own; holes that hold it do not count. A page
    meets its ranges and holes once.
    """
    own = ranges.groupBy("doc").agg(F.collect_list(F.struct(F.col("nth").cast("int").alias("nth"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))).alias("ranges"))
    gone = cut.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("holes"))
    met = own.join(gone, "doc", "left").join(pages.select("doc", "html"), "doc", "left").select("doc", "html", "ranges", "holes")
    kind = ranges.schema["doc"].dataType.simpleString()
    return met.mapInArrow(_texts, f"doc {kind}, nth int, start long, stop long, text string")


def _flag(c: Column) -> Column:
    """A truth value of an attribute; other texts are none."""
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


_AROUND = {"problem": ("problem", "subproblem"), "inside": ("gradingnote", "multiple", "single", "fillin"), "of": ("answerclass", "choice", "fillincase")}
_KINDS = {"solution": "solution", "hint": "hint", "gradingnote": "note", "answerclass": "class", "multiple": "block", "single": "block", "choice": "choice", "fillin": "fillin", "fillincase": "case"}


def parts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, problem (nth), nth, part, html, value: all that problems hold, in their order; value is a struct with what the part's attributes say.

    rows: those of annotated pages. part: solution (answer class), hint, note, class (id, points), choice block
    (multiple, inline), choice (correct), fill-in (width), case (kind, value, verdict). ``inside`` is the note,
    block or fill-in that a class, choice or case is in. html is the part's text without what is cut out of
    it; of classes, choices and cases it is the feedback within them, of a choice verdict its verdict.
    """
    own = stored(around(rows, _AROUND), "parts")
    kinds = _KINDS
    a = F.col("attrs")
    found = own.where(F.col("kind").isin(*kinds) & F.col("problem").isNotNull() & F.col("stop").isNotNull()).where("not (key = 'answerclass' and element_at(attrs, 'solution') is not null)")
    none = F.lit(None).cast("string")
    value = F.struct(
        F.coalesce(F.nullif(a["answerclass"], F.lit("")), a["fillin-case"], F.nullif(a["id"], F.lit(""))).alias("name"), F.coalesce(a["answerclass-pts"], a["fillin-case-value"], a["fillinsol-width"]).alias("value"),
        F.when(F.col("kind") == "choice", F.coalesce(_flag(a["problem-choice"]), F.lit(False))).when(F.col("kind") == "fillincase", _flag(a["fillin-case-verdict"])).when(F.col("kind").isin("multiple", "single"), F.col("kind") == "multiple").alias("flag"),
    )
    part = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in kinds.items()], none)
    cut = holes(own)
    texts = own.where("kind in ('solution', 'hint', 'gradingnote', 'answerfeedback', 'feedback', 'verdict') and stop is not null").where("not (kind = 'answerclass')")
    inner = F.col("kind").isin("solution", "hint", "gradingnote")
    ranges = texts.select("doc", "nth", F.when(inner, F.col("inner_start")).otherwise(F.col("start")).alias("start"), F.when(inner, F.col("inner_stop")).otherwise(F.col("stop")).alias("stop")).distinct()
    html = stored(stripped(ranges, cut, pages).select("doc", "nth", "text"), "texts")
    direct = found.select("doc", "problem", "nth", part.alias("part"), F.when(F.col("inside") != F.col("nth"), F.col("inside")).alias("inside"), value.alias("value")).distinct()
    side = texts.where("of is not null and kind in ('answerfeedback', 'feedback', 'verdict')").select("doc", F.col("of"), "kind", "nth").join(html, ["doc", "nth"])
    side = side.groupBy("doc", F.col("of").alias("nth")).agg(F.max_by("text", F.when(F.col("kind") != "verdict", F.col("nth"))).alias("feedback"), F.max_by("text", F.when(F.col("kind") == "verdict", F.col("nth"))).alias("verdict"))
    return direct.join(html, ["doc", "nth"], "left").join(side, ["doc", "nth"], "left").select("doc", "problem", "nth", "part", "inside", F.col("text").alias("html"), "feedback", "verdict", "value.*")


def page_parts(pages: DataFrame) -> DataFrame:
    """parts() of annotated pages (doc, html), as one reading of each page finds them, with id, the annotation of the problem, and top, whether it is no subproblem; nothing is shuffled or stored."""
    looked, asked = H.patterns(), H.asked(_ALL)
    types = (pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    columns = "problem int, top boolean, id string, nth int, part string, inside int, html string, feedback string, verdict string, name string, value string, flag boolean"
    return H.read_pages(pages, "doc", "html", lambda doc, page: _parts_in(page, H.rows_in(doc, page, *looked, kinds=_ALL, asked=asked)), columns, types)


_OF = [frozenset(k) for k in _AROUND.values()]
_INNER_TEXTS, _WHOLE_TEXTS = ("solution", "hint", "gradingnote"), ("answerfeedback", "feedback", "verdict")
_ALL = frozenset([k for kinds in _AROUND.values() for k in kinds] + [*INNER, *WHOLE, *_KINDS, *_INNER_TEXTS, *_WHOLE_TEXTS])
_TRUTH = {"true": True, "false": False}


def _parts_in(page: bytes, rows: list[tuple]) -> list[tuple]:
    """What page_parts() gives for a page, of its rows."""
    look, ids, found, holes_, ranges, sides = Around(_OF), {}, {}, {}, {}, []
    for nth, _, _, start, inner_start, inner_stop, stop, attrs, key, kind, *_ in rows:
        problem, inside, of = look(None, nth, kind, start, stop)
        a = dict(attrs)
        if kind == "problem":
            ids[nth] = a.get("id")
        if stop is None:
            continue
        span = (inner_start, inner_stop) if kind in _INNER_TEXTS else (start, stop)
        if (kind in INNER or kind in WHOLE) and span[1] > span[0]:
            holes_[nth, *span] = None
        if kind in _INNER_TEXTS or kind in _WHOLE_TEXTS:
            ranges[nth, *span] = None
            if of is not None and kind in _WHOLE_TEXTS:
                sides.append((of, kind, nth))
        if kind in _KINDS and problem is not None and not (key == "answerclass" and "solution" in a):
            flag = None
            if kind == "choice":
                flag = _TRUTH.get(a.get("problem-choice", "").lower(), False)
            elif kind == "fillincase":
                flag = _TRUTH.get(a.get("fillin-case-verdict", "").lower())
            elif kind in ("multiple", "single"):
                flag = kind == "multiple"
            name = next((x for x in (a.get("answerclass") or None, a.get("fillin-case"), a.get("id") or None) if x is not None), None)
            value = next((a[k] for k in ("answerclass-pts", "fillin-case-value", "fillinsol-width") if k in a), None)
            found[problem, nth, _KINDS[kind], inside, name, value, flag] = None
    texts_: dict[int, list[str]] = {}
    for (nth, *_), text in zip(ranges, _left(page, list(ranges), [h[1:] for h in holes_]) if ranges else ()):
        texts_.setdefault(nth, []).append(text)
    feedback: dict[int, tuple[int, str]] = {}
    verdict: dict[int, tuple[int, str]] = {}
    for of, kind, nth in sides:
        into = verdict if kind == "verdict" else feedback
        into[of] = max(into.get(of, (-1, "")), *((nth, t) for t in texts_[nth]))
    said = lambda into, nth: into[nth][1] if nth in into else None
    return [(problem, problem in ids, ids.get(problem), nth, part, inside, text, said(feedback, nth), said(verdict, nth), name, value, flag) for problem, nth, part, inside, name, value, flag in found for text in texts_.get(nth, (None,))]


def texts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, nth, text of problems, without the contents of solutions and notes and without feedback."""
    own = rows.where("kind in ('problem', 'subproblem') and stop is not null").select("doc", "nth", "start", "stop").distinct()
    return stripped(own, holes(rows), pages).select("doc", "nth", "text")


def default_feedback(found: DataFrame) -> DataFrame:
    """doc, problem, correct, score, solutions, data: what is answered before anything is chosen or written; found: parts().

    solutions are the texts of the problem's solutions; data has, in their order, its choice blocks (single or
    multiple, with nothing chosen) and fill-ins (no case met), each with its options: whether right, verdict
    and feedback, and of cases their kind and value. Nothing is correct, and the score is 0.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    option = F.struct("nth", F.coalesce("flag", F.lit(False)).alias("is_correct"), text("verdict").alias("verdict"), text("feedback").alias("feedback"), F.when(F.col("part") == "case", F.col("name")).alias("kind"), F.when(F.col("part") == "case", F.col("value")).alias("value"))
    options = found.where("part in ('choice', 'case') and inside is not null").groupBy("doc", "problem", F.col("inside").alias("nth")).agg(F.array_sort(F.collect_list(option)).alias("options"))
    kind = F.when(F.col("part") == "fillin", "fillin").when(F.col("flag"), "multiple").otherwise("single")
    asked = found.where("part in ('block', 'fillin')").select("doc", "problem", "nth", kind.alias("kind")).join(options, ["doc", "problem", "nth"], "left")
    data = asked.groupBy("doc", "problem").agg(F.array_sort(F.collect_list(F.struct("nth", "kind", "options"))).alias("data"))
    solved = found.where("part = 'solution'").groupBy("doc", "problem").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "html"))), lambda s: s["html"]).alias("solutions"))
    every = found.select("doc", "problem").distinct()
    return every.join(solved, ["doc", "problem"], "left").join(data, ["doc", "problem"], "left").select("doc", "problem", F.lit(False).alias("correct"), F.lit(0.0).alias("score"), "solutions", "data")
