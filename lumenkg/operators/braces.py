"""Commands of sources with their whole arguments: braces are matched over lines, by a running depth over the file.

A file becomes tokens (commands, escapes, comments, braces, brackets, line ends and the text between), each
with its place. Commands are found where a source lies, in one reading of its tokens, and only they are written
and shuffled; environments and ranges are windows over one file. Places are line and col from 0, in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .lint import ENVIRONMENTS, MACROS

_TOKEN = r"\\[A-Za-z]+\*?|\\[\s\S]|%[^\n]*|[{}\[\]\n]|[^\\%{}\[\]\n]+|\\"
#: Groups in braces after a command that are read as its arguments.
ARGUMENTS = 3
#: What commands() says of each but its file.
ARROW = [*(pa.field(c, pa.int32() if c in ("at", "line", "col", "stop_line", "stop_col") else pa.string()) for c in ("at", "name", "kind", "line", "col", "stop_line", "stop_col", "option")), pa.field("args", pa.list_(pa.string()))]


def tokens(sources: DataFrame, text: str = "text") -> DataFrame:
    """file, at (number of the token), pos (characters before it), line, col, token, depth (of braces around it; a brace counts as within its group), without comments. Null texts have none."""
    parts = sources.select("file", F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("at", "token"))
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    own = parts.withColumns({"pos": F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)), "line": F.coalesce(F.sum(breaks).over(before), F.lit(0))})
    start = F.coalesce(F.max(F.when(F.contains("token", F.lit("\n")), F.col("pos") + F.length("token"))).over(before), F.lit(0))
    opened = F.sum(F.when(F.col("token") == "{", 1).otherwise(0)).over(upto) - F.coalesce(F.sum(F.when(F.col("token") == "}", 1).otherwise(0)).over(before), F.lit(0))
    own = own.withColumns({"col": F.col("pos") - start, "depth": opened}).where(~F.col("token").startswith("%"))
    return own.select("file", "at", *[F.col(c).cast("int").alias(c) for c in ("pos", "line", "col", "depth")], "token")


def groups(found: DataFrame) -> DataFrame:
    """file, at, close: for each brace or bracket that opens, the token that closes it; null where none does. A bracket is closed by the next one at its depth of braces."""
    after = Window.partitionBy("file", "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    nearest = lambda c: F.min(F.when(F.col("token") == c, F.col("at"))).over(after)
    marks = found.where(F.col("token").isin("{", "}", "[", "]"))
    end = F.coalesce(F.min(F.when(F.col("token") == "}", F.col("at"))).over(after), F.lit(1 << 30))
    own = marks.withColumns({"brace": nearest("}"), "bracket": nearest("]"), "end": end})
    return own.where(F.col("token").isin("{", "[")).select("file", "at", F.when(F.col("token") == "{", F.col("brace")).when(F.col("bracket") < F.col("end"), F.col("bracket")).alias("close"))


def commands(sources: DataFrame, text: str = "text") -> DataFrame:
    """file, at, name, kind, line, col, stop_line, stop_col, option, args: all known commands and begin and end, from the backslash to the end of the last argument.

    Up to ARGUMENTS groups in braces may follow, and an option in brackets before or after the first, with space
    and line ends between; they may nest and span lines. args holds the texts within the braces, without the outer ones.
    """
    names = {**MACROS, "begin": "begin", "end": "end"}
    schema = f"file {sources.schema['file'].dataType.simpleString()}, at int, name string, kind string, line int, col int, stop_line int, stop_col int, option string, args array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, out = [], []
            for k, own in enumerate(batch.column(1).to_pylist()):
                found = list(_commands(own or "", names))
                which += [k] * len(found)
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *(pa.array(c, f.type) for c, f in zip(zip(*out), ARROW))], names=["file", *(f.name for f in ARROW)])

    return stored(sources.where("file is not null").select("file", text).mapInArrow(run, schema), "commands")


def _commands(text: str, names: dict[str, str]) -> Iterator[tuple]:
    """The commands of one text: its tokens are read once, and braces and brackets are matched by what is open."""
    live, found = [], []  # tokens that count: their number, text, pos, line, and where the line begins
    opened, closes = [[None, []]], {}  # of each depth the brace that opened it, and the brackets in it; what closes what, as places in live
    pos = line = begin = 0
    for at, token in enumerate(re.findall(_TOKEN, text)):
        first, here = token[0], len(live)
        if first == "{":
            opened.append([here, []])
        elif first == "}":
            brace, _ = opened.pop()
            if brace is not None:
                closes[brace] = here
            if not opened:
                opened.append([None, []])
        elif first == "[":
            opened[-1][1].append(here)
        elif first == "]":
            for bracket in opened[-1][1]:
                closes[bracket] = here
            opened[-1][1].clear()
        elif first == "\\" and token[1:] in names:
            found.append(here)
        # what is blank is no token that may follow, and comments count for nothing
        if first != "%" and first != "\n" and (first != " " or token.strip(" ")):
            live.append((at, token, pos, line, begin))
        pos += len(token)
        if token[-1] == "\n":
            line, begin = line + 1, pos
    for k in found:
        at, token, start, row, edge = live[k]
        last, option, args = k, None, []
        for mark in "[" + "{" + "[" + "{" * (ARGUMENTS - 1):
            then = last + 1
            if then < len(live) and live[then][1] == mark and (mark == "{" or option is None) and then in closes:
                last = closes[then]
                inner = text[live[then][2] + 1 : live[last][2]]
                if mark == "[":
                    option = inner
                else:
                    args.append(inner)
            elif mark == "{":
                break
        _, end, stop, stop_row, stop_edge = live[last]
        yield at, token[1:], names[token[1:]], row, start - edge, stop_row, stop - stop_edge + len(end), option, args


def environments(found: DataFrame) -> DataFrame:
    """file, at, close, kind, name, line, col, stop_line, stop_col, arg, level of known environments (commands() begin and end); of those that are never closed, or closed by another, the stop is null."""
    own = found.where("name in ('begin', 'end')").withColumn("env", F.get("args", F.lit(0)))
    order = Window.partitionBy("file").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("level", F.sum(F.when(F.col("name") == "begin", 1).otherwise(0)).over(upto) - F.coalesce(F.sum(F.when(F.col("name") == "end", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nearest = F.lead(F.struct("at", "name", "env", "stop_line", "stop_col")).over(Window.partitionBy("file", "level").orderBy("at"))
    own = own.withColumn("end", nearest).where("name = 'begin'")
    good = (F.col("end.name") == "end") & (F.col("end.env") == F.col("env"))
    kinds = F.create_map(*[F.lit(x) for kv in ENVIRONMENTS.items() for x in kv])
    own = own.withColumn("kind", F.try_element_at(kinds, F.col("env"))).where("kind is not null")
    return own.select("file", "at", F.when(good, F.col("end.at")).alias("close"), "kind", F.col("env").alias("name"), "line", "col", *[F.when(good, F.col(f"end.{c}")).alias(c) for c in ("stop_line", "stop_col")], F.get("args", F.lit(1)).alias("arg"), F.col("level").cast("int").alias("level"))


def within(found: DataFrame, envs: DataFrame, kind: str) -> DataFrame:
    """found with ``inside`` (the argument of the innermost environment of the kind around it): the last that opened at a depth is the one that is open."""
    own = envs.where((F.col("kind") == kind) & F.col("close").isNotNull())
    marks = own.select("file", "at", F.lit(1).alias("step"), "arg").unionByName(own.select("file", F.col("close").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("arg")))
    marks = marks.unionByName(found.select("file", "at", F.lit(0).alias("step"), F.lit(None).cast("string").alias("arg")))
    deep = F.sum("step").over(Window.partitionBy("file").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    open_ = F.last(F.when(F.col("step") == 1, F.struct("arg")), True).over(Window.partitionBy("file", "deep").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = marks.withColumn("deep", deep).withColumn("inside", F.when(F.col("deep") > 0, open_)).where("step = 0").select("file", "at", F.col("inside.arg").alias("inside")).distinct()
    return found.join(inside, ["file", "at"], "left")


def _name(c: Column) -> Column:
    """A symbol's name without its module."""
    return F.element_at(F.split(c, r"\?"), -1)


def references(found: DataFrame, inside: DataFrame) -> DataFrame:
    """file, line, col, symbol, def_file, def_line: uses of a symbol joined to where it is declared; def_file is null where it is nowhere. inside: within() of the declarations, by module.

    A symbol is module?name; a use without a module means any declaration of that name in the same file.
    """
    uses = found.where("kind in ('reference', 'definiendum') and size(args) > 0").select("file", "line", "col", F.get("args", F.lit(0)).alias("symbol"))
    made = inside.where("kind = 'symbol' and size(args) > 0").select(F.col("file").alias("def_file"), F.col("line").alias("def_line"), F.get("args", F.lit(0)).alias("own"), "inside")
    full = uses.where(F.contains("symbol", F.lit("?"))).join(made.withColumn("symbol", F.concat("inside", F.lit("?"), "own")), "symbol", "left")
    near = uses.where(~F.contains("symbol", F.lit("?"))).join(made.withColumnsRenamed({"own": "symbol"}).withColumn("file", F.col("def_file")), ["file", "symbol"], "left")
    columns = ("file", "line", "col", "symbol", "def_file", "def_line")
    return full.select(*columns).unionByName(near.select(*columns))


def hierarchy(inside: DataFrame) -> DataFrame:
    """module, kind (import or use), target, n: what each module imports and uses; inside: within() of the commands, by module. What is in no module belongs to the file, and counts as a use."""
    own = inside.where("kind in ('import', 'use') and size(args) > 0")
    kind = F.when(F.col("inside").isNull(), "use").otherwise(F.col("kind"))
    return own.groupBy(F.coalesce("inside", F.col("file").cast("string")).alias("module"), kind.alias("kind"), F.get("args", F.lit(0)).alias("target")).agg(F.count("*").alias("n"))


def unbalanced(sources: DataFrame, text: str = "text") -> DataFrame:
    """file, line, col, message: braces that are not closed, and those that close nothing."""
    found = stored(tokens(sources, text), "tokens")
    open_ = groups(found).where("close is null").join(found.where("token = '{'"), ["file", "at"]).select("file", "line", "col", F.lit("not closed").alias("message"))
    # below all others so far, a closing brace has none to close
    low = F.min("depth").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    extra = found.where("token in ('{', '}')").withColumn("low", F.coalesce(low, F.lit(1))).where("token = '}' and depth < 1 and depth < low").select("file", "line", "col", F.lit("closes nothing").alias("message"))
    return open_.unionByName(extra)


def semantic_tokens(found: DataFrame) -> DataFrame:
    """Tokens of a file in the form in which editors take them: file, nth, d_line, d_col, length, type.

    found: file, nth (their order), line, col, stop_line, stop_col, type. A token that does not begin after
    the last kept one, which is the furthest so far, is skipped; so is one at the very beginning of a file.
    Tokens over several lines, and those that end before they begin, count as 999 long.
    """
    order = Window.partitionBy("file").orderBy("nth")
    place = F.struct("line", "col")
    far = F.greatest(F.max(place).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.struct(F.lit(0).alias("line"), F.lit(0).alias("col")))
    own = found.withColumn("far", F.coalesce(far, F.struct(F.lit(0).alias("line"), F.lit(0).alias("col")))).where(place > F.col("far"))
    length = F.when((F.col("line") == F.col("stop_line")) & (F.col("stop_col") >= F.col("col")), F.col("stop_col") - F.col("col")).otherwise(999)
    d_line = F.col("line") - F.col("far.line")
    return own.select("file", "nth", d_line.alias("d_line"), F.when(d_line == 0, F.col("col") - F.col("far.col")).otherwise(F.col("col")).alias("d_col"), length.alias("length"), "type")


def nested(ranges: DataFrame) -> DataFrame:
    """ranges (file, node, at, close; properly nested) with parent: the node of the smallest range that holds each one. The last that opened one level up is the one that is open."""
    last = F.lit(1 << 30)
    marks = ranges.select("file", "node", F.col("at").alias("place"), F.lit(1).alias("step"), (last - F.col("close")).alias("tie")).unionByName(ranges.select("file", "node", F.col("close").alias("place"), F.lit(-1).alias("step"), F.col("at").alias("tie")))
    # at one place a range opens before it closes, and the larger first
    order = [F.col("place"), F.desc("step"), F.col("tie")]
    deep = marks.withColumn("deep", F.sum("step").over(Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opens = deep.where("step = 1").select("file", "node", "place", "tie", "deep")
    both = opens.select("file", "place", "tie", F.col("deep").alias("at_depth"), F.col("node").alias("holder"), F.lit(None).cast(ranges.schema["node"].dataType).alias("node"))
    both = both.unionByName(opens.select("file", "place", "tie", (F.col("deep") - 1).alias("at_depth"), F.lit(None).cast(ranges.schema["node"].dataType).alias("holder"), "node"))
    parent = F.last("holder", True).over(Window.partitionBy("file", "at_depth").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("parent", parent).where("node is not null").select("file", "node", "parent")
    return ranges.join(found, ["file", "node"], "left")
